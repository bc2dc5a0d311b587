"""Conversation trie, main text of pages, whitening of embeddings."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from codeloom.llm import burst_trie, catalog, html_text, whitening

SMALL = DATA.replace("sf0.001", "sf0.01")

# conversation trie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved, result = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * words
    for p, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if len(built[c]) == len(p))))
        result.append((min(inside), len(p), min(members[p[:-1]]) if p else None, len(inside), len(children[p]), leaves[p],
                       saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=repr)


def trie_of(df, limit):
    return sorted((tuple(r[c] for c in NODE) for r in burst_trie.trie(df, limit).collect()), key=repr)


def odd_turns():
    draw = random.Random(3)
    rows = [(c, t if draw.random() < 0.95 else None, draw.choice(["user", "assistant", None]),
             draw.choice(["a b", "c", None, "x\ty z", ""]))
            for c in [-45, -40, -3, *range(60), 399] for t in range(40 if c == 7 else draw.choice([1, 1, 2, 3, 5, 9]))]
    rows += [(None, 1, "a", "b"), (5, None, None, None), (5, None, None, None)]
    return rows + [(c, t, "u", f"w{t} " * t) for c in range(1000, 1060) for t in range(7)]


@pytest.mark.parametrize("limit", [10**6, 30])
def test_trie_equals_plain_one_for_any_container_size(spark, limit):
    rows = odd_turns()
    assert trie_of(spark.createDataFrame(rows, TURNS), limit) == plain_trie(rows)


def test_trie_of_nothing_and_with_other_columns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert burst_trie.trie(empty).collect() == []
    rows = [(1, 0, "user", "a b c"), (2, 0, "user", "a b c"), (2, 1, "user", "d")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("depth", "p1", "words", "range_id", "h")})
    assert trie_of(df, 2) == plain_trie(rows)


def test_long_conversation_is_spread_and_right(spark):
    rows = [(3, t, "user", f"{t % 7}") for t in range(700)] + [(4, 0, "user", "0")]
    assert trie_of(spark.createDataFrame(rows, TURNS).repartition(8), 20) == plain_trie(rows)


def test_sweep_of_one_container_carries_over_batches(spark):
    rows = [(c, t, "user", f"{(c * t) % 3}") for c in range(50) for t in range(6)]
    want = plain_trie(rows)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert trie_of(spark.createDataFrame(rows, TURNS), 1) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


# main text

PAGES = {
    "tables": ("<table><tr><td><a href=x>Home</a></td><td><a href=y>News</a></td></tr></table><table><tr><td>"
               + "A long text that goes on and on. " * 4 + "</td></tr></table><center>© 2020 someone</center>",
               ["A long text that goes on and on. " * 3 + "A long text that goes on and on."]),
    "plain": ("just a text &amp; more\n\n of\xa0it", ["just a text & more of it"]),
    "named": ("<body class='has-sidebar'><div id=header>Site</div><div class=menu><a>1</a></div><div id=content><h1>T</h1>"
              "<p>Short.<div class='ad-slot'>Buy</div><p>More <b>bold</b> te<i>xt</i><p><a href=z>link only</a></p></div>"
              "<div id='comments'><p>" + "I think so too, really. " * 9 + "</p></div><div id=footer>f</div>",
              ["T", "Short.", "More bold text", "link only"]),
    "form": ("<main><form>Search <input></form><h2>A</h2>text<br>more<ul><li>x<li>y</ul></main><aside>z</aside>",
             ["A", "text more", "x", "y"]),
    "cut": ('<p>text</p><div class="a', ["text"]),
    "signs": ("a < b and c > d <p>&lt;e&gt; &eacute;&#8364; &am", ["a < b and c > d", "<e> é€ &am"]),
    "quote": ('<p class="x>text</p><p>more</p>', ["text", "more"]),
    "unnamed": ("<div><a href=1>a b c</a> | <a href=2>d e f</a></div><div><div>Heading here</div><div>"
                + "Text goes on for a while. " * 8 + "</div><div>Short one.</div></div><hr><div><a href=3>imprint</a></div>",
                ["Heading here", ("Text goes on for a while. " * 8).strip(), "Short one."]),
    "comments": ("<article><header><h1>Head</h1></header><p>a</p><section class='reader-comments'><article>no</article>"
                 "</section><p>b</p></article><article class='teaser'>x</article>", ["Head", "a", "b"]),
    "script": ("<p>a</p><script>if (a<b) write('<p>x</p>')</script>b<style>x", ["a", "b"]),
    "remark": ("<p>a<!-- <p>no</p> --> b</p><!-- open <p>c", ["a b"]),
    "unclosed": ("<nav><div><ul><li>x</div></nav><p>y", ["y"]),
    "menu only": ("<nav>a</nav>", []),
    "empty": ("", []),
    "null": (None, []),
    "blank": (" \n\t ", []),
}


def test_main_text_of_odd_pages(spark):
    rows = [(i, name, page) for i, (name, (page, _)) in enumerate(PAGES.items())] + [(None, None, "<p>x")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.main_text(df.coalesce(1)).collect()
    want = [(i, name, "\n\n".join(parts)) for i, (name, (_, parts)) in enumerate(PAGES.items())] + [(None, None, "x")] * 2
    assert [(r["page_id"], r["url"], r["text"]) for r in got] == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.main_text(df.limit(0)).collect() == []


def test_main_text_of_given_pages_is_their_article(spark):
    def plain(page):
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"</?\w+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        return "\n\n".join(b for b in blocks if b)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in catalog.op12_html(spark, SMALL).collect()}
    assert got == {i: plain(page) for i, page in pages.items()}


def test_a_very_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>part {i}</p><div class=ad>x</div>" for i in range(50_000)) + "</article>"
    assert html_text.main_texts([page]) == ["\n\n".join(f"part {i}" for i in range(50_000))]


def plain_stretches(weights, blanks):
    """Surges and dives by going through the lines of one page."""
    lines = []
    for w, b in zip(weights, blanks):
        lines += [None] * b + [w]
    sums = [sum(w or 0 for w in lines[max(0, i):i + 3]) for i in range(-2, len(lines))]
    stretches, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        if not s and start is not None:
            stretches.append((start, i - 2, max(sums[start:i]), sum(w or 0 for w in lines[start:i - 2])))
            start = None
    peak, most = max((s[2] for s in stretches), default=0), max((s[3] for s in stretches), default=0)
    kept = [s for s in stretches if s[2] >= min(html_text.SURGE, peak) and s[3] >= html_text.SHARE * most]
    at = [i for i, w in enumerate(lines) if w is not None]
    return [any(a <= i < b for a, b, *_ in kept) for i in at]


def test_stretches_equal_a_walk_over_the_lines():
    draw = random.Random(5)
    pages = [[(draw.choice([0, 0, 5, 40, 90, 200]), draw.randrange(5)) for _ in range(draw.randrange(1, 30))]
             for _ in range(200)]
    pages = [[(pages[k][0][0], 3), *pages[k][1:]] for k in range(len(pages))]
    flat = [line for page in pages for line in page]
    owner = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    got = html_text.kept_lines(np.array([w for w, _ in flat]), np.array([b for _, b in flat]), owner)
    assert got.tolist() == [x for page in pages for x in plain_stretches(*zip(*page))]


# whitening

def plain_whitening(vectors):
    distinct = np.unique(vectors, axis=0)
    n, mean = len(distinct), distinct.mean(axis=0)
    away = distinct - mean
    values, axes = np.linalg.eigh(away.T @ away / n)
    return distinct, (vectors - mean) @ axes[:, ::-1], values[::-1]


def check_whitening(rows, got):
    """`rows`: ids and whole vectors; ids are unique."""
    ids, vectors = [i for i, _ in rows], np.array([v for _, v in rows])
    distinct, moved, values = plain_whitening(vectors)
    n = len(distinct)
    by = {(r["vec_id"], r["component"]): r for r in got}
    rank = min(4, int((values > 1e-16 * values[0]).sum()))
    assert len(by) == len(got) == len(ids) * rank
    away = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(v, distinct.sum(axis=0))) for v in vectors]
    for j in range(rank):
        column = [by[i, j + 1] for i in ids]
        assert [r["deviation"] for r in column] == away
        assert all(r["n"] == n and abs(r["identity_error"]) < 1e-10 for r in column)
        assert column[0]["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-9)
        ours, want = np.array([r["whitened"] for r in column]), moved[:, j] / np.sqrt(values[j])
        assert min(np.abs(ours - want).max(), np.abs(ours + want).max()) < 1e-7


def test_whitening_equals_an_eigen_decomposition(spark):
    rows = [(r["vec_id"], [math.floor(256 * c) for c in r["embedding"]])
            for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(rows, catalog.op13_whitening(spark, SMALL).collect())


VECTORS = "vec_id long, embedding array<double>, x string"


@pytest.mark.parametrize("scale", [1.0, 1e-2])
def test_whitening_of_badly_conditioned_vectors(spark, scale):
    rng = np.random.default_rng(2)
    whole = np.rint(rng.normal(size=(300, 6)) * np.array([1e6, 1e4, 300, 20, 3, 1]) * scale).astype(int)
    whole[:, 5] = whole[:, 0]
    rows = [(i, v.tolist()) for i, v in enumerate(whole)]
    df = spark.createDataFrame([(i, [c / 256 for c in v], "x") for i, v in rows], VECTORS)
    check_whitening(rows, whitening.whitening(df.union(df.limit(0))).collect())


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [i / 256, (i * i % 7) / 256, 0.5]) for i in range(10)]
    odd = [(20, None), (21, [1.0, None, 2.0]), (22, [nan, 1.0, 2.0]), (23, [1.0, -inf, 2.0]), (24, []), (25, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in good + odd], VECTORS)
    got = whitening.whitening(df).collect()
    check_whitening([(i, [math.floor(256 * c) for c in v]) for i, v in good], got)
    # Repeated rows and a null id are returned, and learned from once.
    again = whitening.whitening(df.union(spark.createDataFrame([(3, good[3][1], "x"), (None, good[4][1], "x")], VECTORS))).collect()
    assert sorted(r["whitened"] for r in again if r["vec_id"] == 5) == pytest.approx(
        sorted(r["whitened"] for r in got if r["vec_id"] == 5))
    assert [sum(r["vec_id"] == i for r in again) for i in (3, None, 5)] == [4, 2, 2]
    assert {r["n"] for r in again} == {10}


@pytest.mark.parametrize("vectors", [[], [[]], [[1.0, 2.0]], [[1.0, 2.0], [1.0, 2.0]], [None]])
def test_whitening_without_spread(spark, vectors):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], VECTORS)
    assert whitening.whitening(df).collect() == []


def test_whitening_of_entries_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e300, 0.0], "x"), (1, [0.0, 1.0], "x"), (2, [2.0, 3.0], "x")], VECTORS)
    got = whitening.whitening(df).collect()
    assert len(got) and all(r["deviation"] is None and r["identity_error"] < 1e-4 for r in got)
