"""Operators that compare rows: near-duplicates, decontamination, lines, chat, language model, pipeline."""

import math
import os
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import catalog, chat, components, decontam, lines, lm, neardup

SMALL = DATA.replace("sf0.001", "sf0.01")


def docs_of(spark, folder=DATA):
    return spark.read.parquet(f"{folder}/documents.parquet")


def empty_docs(spark):
    return spark.createDataFrame([], docs_of(spark).schema)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(catalog.ORACLE[name])
    given = [d[0] for d in cursor.description]
    assert sorted(given) == columns
    theirs = sorted((tuple(r[given.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert ours == theirs


# components

@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_a_search(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {n: find(n) for a, b in edges for n in (a, b) if a != b}
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in found} == want and len(found) == len(want)


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# near-duplicates

def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(rows, texts):
    want = plain_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in docs_of(spark, SMALL).collect()}
    check(catalog.op10_near_duplicates(spark, SMALL).collect(), texts)


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_links_beside_the_hub_are_found(spark, monkeypatch):
    """A large group around the threshold: many members are like others but not like the hub."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = {i: edited(draw, base, draw.randrange(0, 8)) for i in range(150)}
    texts |= {1000 + i: edited(draw, texts[i].split(), 1) for i in range(40)}
    texts |= {2000 + i: texts[i] for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(neardup.near_duplicates(df).collect(), texts)


def test_low_bytes_do_not_pick_the_bucket(spark):
    """Pairs whose signatures agree by chance in a band before the one whose bucket they share."""
    plan = neardup.Plan()
    signature = bytes(plan.hashes)
    classes = [(i, [100 * i + band if band != 3 else 7 for band in range(plan.bands)], signature) for i in (1, 2)]
    classes += [(i, [100 * i + band if band not in (5, 9) else band for band in range(plan.bands)], signature)
                for i in (3, 4)]
    members = [(7, 3, 1), (7, 3, 2), (5, 5, 3), (5, 5, 4), (9, 9, 3), (9, 9, 4)]
    found = neardup.crossing_pairs(
        spark.createDataFrame(members, "key long, band int, id long"),
        spark.createDataFrame(classes, "id long, bands array<long>, signature binary"),
        spark.createDataFrame([], "node long, component long"), plan).collect()
    assert sorted((r.a, r.b) for r in found) == [(1, 2), (3, 4)]


def test_near_duplicate_edges(spark):
    long = " ".join(f"t{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A B"), (6, "a b c"), (7, long), (8, long + " end"),
            (9, "same same same same same same"), (10, "same " * 30), (11, "a b"), (11, "a b"), (12, "p q r s t u"),
            (None, "a b"), (11, "p q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"kept": F.lit(3), "node": F.lit(1), "component": F.lit("x")})
    found = neardup.near_duplicates(df).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.component_id, r.kept) for r in found}
    # Id 11 has two texts and so joins what either is like.
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (4, False), 6: (6, True), 7: (7, True),
                   8: (7, False), 9: (9, True), 10: (9, False), 11: (4, False), 12: (4, False), None: (None, True)}
    assert [r.n_shingles for r in found if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0


# decontamination

def test_decontamination_edges(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(1, "Before. " + item.upper() + ", after"), (2, " ".join(item.split()[:15])), (3, " ".join(item.split()[:18])),
            (4, None), (5, ""), (6, "x " * 20_000 + item), (None, item), (7, "clean text of its own, nothing else"), (1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(1), "h": F.lit(2)})
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item), (4, item + " tail")],
                                  "item_id long, text string")
    found = decontam.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (1, 4), (3, 1), (3, 4), (6, 1), (6, 4)}
    assert all(r.n_shared >= 0.75 * r.n_item for r in found)
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 7]
    assert decontam.contaminated(empty_docs(spark), items).count() == 0
    assert decontam.clean(docs, items.limit(0)).count() == len(rows)


@pytest.mark.parametrize("n", range(1, 40))
def test_a_sketch_cannot_be_missed(n):
    """Whatever three quarters of an item a document holds, one of the sketch is among them."""
    need = math.ceil(0.75 * n)
    assert n - (n - need + 1) < need


def test_no_python_on_native_paths(spark):
    for name in ("op6_decontamination", "op8_chat"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


# lines

def test_line_edges(spark):
    rows = [(i, "s", f"menu\n own {i} \n menu \n\nfoot") for i in range(10)]
    rows += [(20, "s", None), (21, "s", ""), (22, None, "menu\nx"), (23, "t", "menu"), (23, "t", "menu")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns(
        {"host": F.lit("h"), "total": F.lit(1), "_host": F.lit("x"), "drops": F.lit(2), "n_lines": F.lit("old")})
    found = lines.line_dedup(docs)
    assert found.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert {(r.host, r._host, r.drops) for r in found.collect()} == {("h", "x", 2)}
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in found.collect()}
    assert got[3] == (" own 3 \n", 5, 3) and got[20] == (None, 0, 0) and got[21] == ("", 1, 0)
    assert got[22] == ("menu\nx", 2, 0) and got[23] == ("menu", 1, 0) and found.count() == len(rows)
    assert lines.line_dedup(empty_docs(spark)).count() == 0


def test_lines_without_a_broadcast_are_the_same(spark, monkeypatch):
    want = sorted(map(tuple, catalog.op9_lines(spark, DATA).collect()))
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert sorted(map(tuple, catalog.op9_lines(spark, DATA).collect())) == want


# chat

def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_rotates_perspectives(spark):
    df = turns(spark, [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"),
                       (2, 0, "system", "alone"), (3, None, None, "x"), (None, 1, "ann", "lost"), (1, 3, "ann", "bye")])
    views = chat.perspectives(df.withColumns({"name": F.lit("n"), "start": F.lit(1)}))
    whole = {(r.conv_id, r.perspective): r for r in chat.rendered(views).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (3, "unknown")}
    ann = whole[1, "ann"]
    assert [ann.text[s.start:s.end] for s in ann.mask] == ["hi<|end|>", "bye<|end|>", "bye<|end|>"]
    assert ann.text.startswith("<|turn|>system<|text|>be kind<|end|>\n<|turn|>assistant<|text|>hi<|end|>\n"
                               "<|turn|>user name=bob<|text|><|end|>\n")
    assert [whole[1, "bob"].text[s.start:s.end] for s in whole[1, "bob"].mask] == ["<|end|>"]
    parts = chat.rendered(views.where("conv_id = 1 AND perspective = 'ann'"), most_turns=2).collect()
    assert "".join(p.text for p in sorted(parts, key=lambda p: p.part)) == ann.text
    assert chat.perspectives(turns(spark, [])).count() == 0


def test_a_long_dialogue_is_cut_over_ranges(spark):
    rows = [(7, i, f"p{i % 3}", "w" * (i % 9)) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        views = chat.perspectives(turns(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for who in ("p0", "p1", "p2"):
        own = sorted((r for r in views if r.perspective == who), key=lambda r: r.position)
        assert [r.turn for r in own] == list(range(600)) and [r.position for r in own] == list(range(600))
        assert all(a.end == b.start and a.end - a.start == len(a.segment) for a, b in zip(own, own[1:]))


def test_a_long_conversation_is_dealt_by_range(spark):
    """Without broadcasts, turns meet their participants by range, so one conversation fills many tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, t, f"p{t % 3}", f"t{t}") for t in range(6000)] + [(2, 0, "a", "x")]
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        views = chat.perspectives(turns)
        plan = views._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(range_id" in plan
        whole = views.withColumn("task", F.spark_partition_id()).where("conv_id = 1")
        assert whole.select("task").distinct().count() > 1
        got = whole.where("perspective = 'p1'").orderBy("position").select("position", "turn", "start", "end").collect()
        assert [(r.position, r.turn) for r in got] == [(t, t) for t in range(6000)]
        assert all(a["end"] == b["start"] for a, b in zip(got, got[1:]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# language model

def test_unigram_scores_equal_plain_ones(spark):
    texts = {r.doc_id: r.text for r in docs_of(spark, SMALL).collect()}
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*t.encode().lower().split(), None])
    total, distinct = sum(counts.values()), len(counts)
    rows = catalog.op5_language_model(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens = [*texts[r.doc_id].encode().lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_a_small_head_changes_nothing_but_the_way(spark):
    docs = docs_of(spark)
    every = [F.lit(True), F.lit(False)]
    tight = lm.scores(docs, *every, lm.Settings(words=20, head=25)).collect()
    wide = lm.scores(docs, *every, lm.Settings(words=20, head=10**6)).collect()
    for a, b in zip(sorted(tight, key=lambda r: r.doc_id), sorted(wide, key=lambda r: r.doc_id)):
        assert (a.n_tokens, a.n_known) == (b.n_tokens, b.n_known) and a.base_score == pytest.approx(b.base_score)


def model_of(shares, scale=1.0, **more):
    settings = lm.Settings(words=len(shares) - lm.CLASSES - 1, **more)
    model = lm.Model.fresh(np.asarray(shares), settings)
    draw = np.random.default_rng(1)
    return model.filled(model.flat() + scale * draw.normal(0, 0.3, len(model.flat()))), settings


@pytest.mark.parametrize("scale", [0, 1, 30])
@pytest.mark.parametrize("words", [0, 5, 143])
def test_both_levels_are_normalised(words, scale):
    """Over all outputs of a context the chances are one, whether or not the last group is full."""
    shares = np.arange(1, words + lm.CLASSES + 2) / 100
    model, settings = model_of(shares, scale)
    for context in (3, settings.end):
        chances = 10 ** model.log10(np.arange(settings.outputs), np.full((settings.outputs, settings.places), context))
        assert chances.sum() == pytest.approx(1, abs=1e-4)


def test_scores_equal_plain_ones():
    model, settings = model_of(np.random.default_rng(3).random(300))
    draw = np.random.default_rng(1)
    targets = draw.integers(0, settings.outputs, 2000)
    contexts = draw.integers(0, settings.outputs, (2000, settings.places))
    slots = model.groups.slot
    got = model.log10(targets, contexts, block=700)
    for i in range(0, 2000, 37):
        vector = sum(model.context[p, contexts[i, p]].astype(float) for p in range(settings.places))
        group, member = divmod(int(slots[targets[i]]), settings.members)
        heads = model.heads @ vector + model.head_bias
        scores = [model.vectors[slots[o]] @ vector + model.bias[slots[o]]
                  for o in range(settings.outputs) if slots[o] // settings.members == group]
        own = model.vectors[slots[targets[i]]] @ vector + model.bias[slots[targets[i]]]
        plain = heads[group] - np.log(np.exp(heads).sum()) + own - np.log(np.exp(scores).sum())
        assert got[i] == pytest.approx(plain / np.log(10), abs=1e-4)


def test_training_learns_a_pattern():
    shares = np.full(4 + lm.CLASSES + 1, 1.0)
    shares[:4] += 200
    settings = lm.Settings(words=4, batch=64)
    model = lm.Model.fresh(shares / shares.sum(), settings)
    codes = np.tile(np.arange(4), 2000)
    targets, contexts = lm.windows(codes, np.array([len(codes)]), settings)
    before = model.log10(targets, contexts).mean()
    squares = None
    for seed in range(3):
        squares = model.train(targets, contexts, settings, 0.05, seed, squares)
    assert model.log10(targets, contexts).mean() > before + 0.3


def test_sums_by_row():
    draw = np.random.default_rng(2)
    rows, values = draw.integers(0, 9, 40), draw.random((20, 3))
    found, sums = lm._summed(rows, values, 9)
    assert found.tolist() == sorted(set(rows.tolist()))
    for row, total in zip(found, sums):
        assert np.allclose(total, values[np.flatnonzero(rows == row) % 20].sum(axis=0))


def plain_training(model, targets, contexts, settings, rate, seed):
    """The parameters after one pass, example by example in double precision."""
    groups, draw = model.groups, np.random.default_rng(seed)
    context, heads, head_bias, vectors, bias = values = [x.astype(float) for x in model.parts()]
    squares = [np.full(x.shape, 1e-2) for x in values]
    slots = groups.slot[targets]
    mixed, batches = draw.permutation(len(targets)), []
    for g in range(groups.count):
        own = [i for i in mixed if slots[i] // settings.members == g]
        batches += [own[at:at + settings.batch] for at in range(0, len(own), settings.batch)]
    for k in draw.permutation(len(batches)):
        group = slots[batches[k][0]] // settings.members
        far = groups.group_draws[draw.integers(0, groups.drawn, settings.noise)]
        near = groups.member_draws[group, draw.integers(0, groups.drawn, settings.noise)]
        moved = [np.zeros(x.shape) for x in values]
        for i in batches[k]:
            expected = sum(context[p, c] for p, c in enumerate(contexts[i]))
            toward = np.zeros(settings.size)
            for own, noise, at in ((group, far, 1), (slots[i], near, 3)):
                shares = groups.log_groups if at == 1 else groups.log_members
                for output, sign in [(own, 1), *((o, -1) for o in noise)]:
                    score = values[at][output] @ expected + values[at + 1][output] - shares[output] - math.log(settings.noise)
                    pull = sign / (1 + math.exp(min(max(sign * score, -30), 30)))
                    toward += pull * values[at][output]
                    moved[at][output] += pull * expected
                    moved[at + 1][output] += pull
            for p, c in enumerate(contexts[i]):
                moved[0][p, c] += toward
        for value, square, step in zip(values, squares, moved):
            square += step * step
            value += rate * step / np.sqrt(square)
    return np.concatenate([x.ravel() for x in values])


@pytest.mark.parametrize("size", [6, 5])
def test_training_equals_plain_steps(size):
    model, settings = model_of(np.random.default_rng(3).random(150), 1, size=size, noise=4, batch=50)
    draw = np.random.default_rng(4)
    targets = draw.integers(0, settings.outputs, 260)
    contexts = draw.integers(0, 9, (260, settings.places)).astype(np.int32)
    plain = plain_training(model, targets, contexts, settings, 0.07, 5)
    before = model.flat()
    model.train(targets, contexts, settings, 0.07, 5)
    assert np.abs(model.flat() - before).max() > 0.05
    assert np.allclose(model.flat(), plain, atol=2e-4)


def seconds(run, times):
    """The least CPU time of several runs."""
    found = []
    for _ in range(times):
        began = time.process_time()
        run()
        found.append(time.process_time() - began)
    return min(found)


def test_sums_cost_less_than_a_count_of_every_column():
    draw = np.random.default_rng(2)
    rows = (4096 * draw.random(4096) ** 3).astype(np.intp) + np.repeat(np.arange(4) * 4096, 1024)
    values = draw.random((1024, 24)).astype(np.float32)

    def plain():
        found, at = np.unique(rows, return_inverse=True)
        return found, np.stack([np.bincount(at, x, len(found)) for x in np.tile(values.T, 4)], axis=1)

    for a, b in zip(lm._summed(rows, values, 4 * 4096), plain()):
        assert np.allclose(a, b, rtol=1e-4)
    found, at = plain()[0], np.unique(rows, return_inverse=True)[1]
    columns = np.tile(values.T, 4)

    def counts():
        for _ in range(40):
            np.stack([np.bincount(at, x, len(found)) for x in columns], axis=1)

    def sums():
        for _ in range(40):
            lm._summed(rows, values, 4 * 4096)

    assert seconds(sums, 9) < 0.9 * seconds(counts, 9)


def test_spelling_classes_equal_plain_ones_and_cost_less():
    draw = np.random.default_rng(6)
    letters = ["a", "z", "m", "0", "-", "é", "中", ".", ",", ";", ":", "!", "?", "~", "\x01"]
    words = ["".join(draw.choice(letters, n)) for n in draw.integers(1, 9, 20_000)]

    def plain():
        found = []
        for word in words:
            first = word.encode()[0]
            kind = first - 97 if 97 <= first <= 122 else 26 if first < 128 else 27
            found.append((kind * lm.MARKED + (not word.isascii())) * lm.CLOSED + (word[-1] in ".,;:!?"))
        return found

    table = pa.array(words)
    assert lm.spelling_classes(table).tolist() == plain()
    assert lm.spelling_classes(table.slice(7, 100)).tolist() == plain()[7:107]
    assert lm.spelling_classes(pa.array([], pa.string())).tolist() == []
    assert 3 * seconds(lambda: lm.spelling_classes(table), 5) < seconds(plain, 5)


def test_all_training_texts_give_examples_once(spark):
    """Vectors are averaged by examples; the rounds share the texts among them."""
    texts = spark.createDataFrame([(f"a b c {i}",) for i in range(40)], "text string").repartition(3)
    counts = lm.word_counts(texts).cache()
    vocabulary = lm.learn_vocabulary(counts, 40, lm.Settings())
    assert vocabulary.settings.words == 43
    seen = []
    part = F.pmod(F.xxhash64(F.lit(vocabulary.settings.seed), "text"), F.lit(sum(vocabulary.settings.shares)))
    upto = 0
    for share in vocabulary.settings.shares:
        seen.append(texts.where((part >= upto) & (part < upto + share)).count())
        upto += share
    assert sum(seen) == 40 and seen[-1] > seen[0]
    model = lm.train(texts, vocabulary)
    fresh = lm.Model.fresh(vocabulary.shares(), vocabulary.settings)
    assert np.isfinite(model.flat()).all() and np.abs(model.context - fresh.context).max() > 0.01


def test_windows_stay_inside_their_text():
    settings = lm.Settings(places=2)
    targets, contexts = lm.windows(np.array([1, 2, 3]), np.array([2, 0, 1]), settings)
    end = settings.end
    assert targets.tolist() == [1, 2, end, end, 3, end]
    assert contexts.tolist() == [[end, end], [1, end], [2, 1], [end, end], [end, end], [3, end]]


def test_language_model_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "a"), (4, "zz " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "word": F.lit("a")})
    found = lm.scores(docs, F.col("doc_id") == 3, F.lit(False)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in found) == [
        (0, 2, 2), (1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4), (4, 50_001, 1)]
    assert all(r.train_tokens == 8 and r.score < 0 for r in found)
    untrained = lm.scores(docs, F.lit(False), F.lit(True)).collect()
    assert len(untrained) == len(rows) and all(r.base_score == 0 and r.n_known == 0 for r in untrained)
    assert lm.scores(empty_docs(spark), F.lit(True), F.lit(False)).count() == 0


# pipeline

@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Every stage's input and output."""
    folder = str(tmp_path_factory.mktemp("steps"))
    docs = docs_of(spark, SMALL)
    made = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        made.append((name, docs, after))
        docs = after
    return made


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_pipeline_stages(spark, steps):
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns, name
    (_, raw, spoken), (_, _, cut), (_, _, single), (_, _, clean), (_, _, coded) = steps
    assert ids(spoken) == sorted(r.doc_id for r in raw.collect() if any(c.isalpha() for c in r.text))
    assert ids(cut) == ids(spoken)
    con = duckdb.connect()
    con.register("documents", spoken.toPandas())
    assert {(r.doc_id, r.text) for r in cut.collect()} == {
        (r[0], r[1]) for r in con.execute(f"SELECT doc_id, text FROM ({lines.SQL})").fetchall()}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    want = plain_components({r.doc_id: r.text for r in cut.collect()})
    assert ids(single) == sorted(i for i, (_, c) in want.items() if i == c)
    con.register("documents", single.toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    held = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontam.SQL})").fetchall()}
    assert held and ids(clean) == sorted(set(ids(single)) - held)
    assert ids(coded) == ids(clean)


def test_pipeline_codes_equal_the_library(spark, steps):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(catalog.vocabulary_path())
    _, before, after = steps[-1]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_pipeline_edges(spark, tmp_path):
    schema = docs_of(spark).schema.add("_extra", "string").add("_held", "integer")
    rows = [(1, None, "en", "s", None, "x", 1), (2, "", "en", "s", 0, "x", 1), (None, "hello there you", "en", "s", 15, "x", 1),
            (4, "hello there you", "en", None, 15, "x", 1), (5, "hello there you", "en", "s", 15, "x", 1),
            (5, "hello there you", "en", "s", 15, "x", 1)]
    os.makedirs(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/in").collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 4]
    spark.createDataFrame([], docs_of(spark).schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
