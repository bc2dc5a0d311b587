"""Operators that answer row by row: quality, PII, BPE, language, toxicity."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from codeloom.llm import bpe, catalog, language, pii, quality, toxicity

EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "a b c"), (5, "word " * 60),
    (6, "\n".join(["same line here"] * 40)), (7, "é " * 30_000), (8, "#$% " * 60), (9, "x" * 200_000),
]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"score": F.lit("mine"), "kept": F.lit(0), "row": F.lit(1)}) if extra else df


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# quality

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dups = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(marked),
            len(words) < 50 or 100 * len(marked) > 50 * len(words))


def test_quality_counts_equal_plain_ones(spark):
    given = texts(spark)
    rows = catalog.op1_quality(spark, DATA).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert tuple(r[1:7]) == plain_counts(given[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_edges(spark):
    rows = quality.quality(frame(spark, EDGES)).collect()
    assert sorted((r.doc_id or 0, *r[1:7]) for r in rows) == sorted((i or 0, *plain_counts(t)) for i, t in EDGES)
    assert quality.quality(empty(spark)).count() == 0


def test_rules_keep_prose_and_drop_junk():
    prose = " ".join(f"word{i} goes on" for i in range(60))
    junk = [" ".join(f"w{i}###" for i in range(60)), " ".join(f"LOUD{chr(65 + i % 26)}{i} TEXT" for i in range(60)),
            " ".join("a" + str(i) if i % 2 else "very" for i in range(60))]
    rules = quality.standard_rules()
    assert not any(r.rejects(quality.Page(prose)) for r in rules)
    assert all(any(r.rejects(quality.Page(j)) for r in rules) for j in junk)


def test_order_follows_rejections_per_cost():
    def slow(page):
        return sum(i % 7 for i in range(20_000)) < 0

    rules = [quality.Rule("slow", slow), quality.Rule("never", lambda p: False), quality.Rule("all", lambda p: True)]
    sample = [" ".join(f"w{i}" for i in range(60))] * 20
    assert quality.order_rules(rules, sample)[0].name == "all"


# PII

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_pii(text):
    def luhn(d):
        total = 0
        for i, x in enumerate(reversed(d)):
            x = int(x) * (1 + i % 2)
            total += x - 9 * (x > 9)
        return total % 10 == 0

    found = []
    for at, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), at, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def test_pii_base_equals_the_patterns(spark):
    given = texts(spark)
    for r in catalog.op3_pii(spark, DATA).collect():
        want = plain_pii(given[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PLAIN]
        assert set(want) <= set(r.spans.split(",")) if want else True


def test_pii_random_strings_equal_the_patterns():
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("0123456789 .-+()@ab%\n") for _ in range(draw.randrange(40)))
        assert pii.joined(pii.plain_spans(text)) == ",".join(plain_pii(text)), text


@pytest.mark.parametrize("text, kind, found", [
    ("mail john.doe [at] mail (dot) example (dot) com now", "email", "john.doe [at] mail (dot) example (dot) com"),
    ("john at example dot com ok", "email", "john at example dot com"),
    ("write jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("call +4 nine one seven five five five one two three four five", "phone",
     "+4 nine one seven five five five one two three four five"),
    ("dial +１ (234) 555-1234", "phone", "+１ (234) 555-1234"),
    ("host 97 dot 51 dot 17 dot 173 up", "ip", "97 dot 51 dot 17 dot 173"),
    ("pay four one one one-one one one one one one one one one one one one", "card",
     "four one one one-one one one one one one one one one one one one"),
    ("mail und.34 at mail7.example.com today", "email", "und.34 at mail7.example.com"),
    ("dial +1 (5O5) 555-l234 now", "phone", "+1 (5O5) 555-l234"),
    ("z​ero a​b@c​.de", "email", "a​b@c​.de"),
])
def test_pii_disguises_map_back(text, kind, found):
    spans = pii.disguised_spans(text, pii.plain_spans(text))
    assert [(k, text[s:e]) for s, k, e in spans] == [(kind, found)]


@pytest.mark.parametrize("text, kind, plain, found", [
    ("write jоhn@example.com", "email", "hn@example.com", "jоhn@example.com"),
    ("write john@example.cоm now", "email", "john@example.c", "john@example.cоm"),
    ("write jоhn@example.cоm now", "email", "hn@example.c", "jоhn@example.cоm"),
    ("dial +1 234 555 123４ now", "phone", "+1 234 555 123", "+1 234 555 123４"),
])
def test_pii_disguise_around_a_plain_fragment(text, kind, plain, found):
    base = pii.plain_spans(text)
    assert [(k, text[s:e]) for s, k, e in base] == [(kind, plain)]
    assert [(k, text[s:e]) for s, k, e in pii.disguised_spans(text, base)] == [(kind, found)]


def test_pii_covered_disguise_is_dropped():
    text = "write john@example.com and call nine"
    assert pii.disguised_spans(text, pii.plain_spans(text)) == []
    assert pii.disguised_spans("jоhn@example.com", [(0, "email", 16)]) == []


@pytest.mark.parametrize("text", ["look at example.com or at home", "one two three", "dot com was a bubble at noon",
                                  "Zwei oder drei Leute", "café at five"])
def test_pii_leaves_prose_alone(text):
    assert pii.disguised_spans(text, pii.plain_spans(text)) == []


def test_pii_edges(spark):
    rows = pii.personal_data(frame(spark, EDGES)).collect()
    assert len(rows) == len(EDGES) and all(r.spans == "" for r in rows)
    assert pii.personal_data(empty(spark)).count() == 0


# BPE

@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(catalog.vocabulary_path())


def library_row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(spark, library):
    given = texts(spark)
    for r in catalog.op4_bpe(spark, DATA).collect():
        ids, decoded = library_row(library, given[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_random_text_equals_the_library(library):
    model = bpe.WordBpe(catalog.vocabulary_path())
    draw = random.Random(1)
    ranges = [(32, 127), (32, 127), (32, 0x250), (0x370, 0x600), (0x2000, 0x2070), (0, 40), (0x3000, 0x3100),
              (0x10000, 0x1F700)]
    given = ["", " ", "Hello WORLD's it's 'llx ''s <|endoftext|>a<|startoftext|> b ΑΣ Σ İ x\x1cy \x85z　q", "ab" * 300]
    for _ in range(600):
        given.append("".join(c for c in (chr(draw.randrange(*draw.choice(ranges))) for _ in range(draw.randrange(40)))
                             if unicodedata.category(c) not in ("Cn", "Cs")))
    for text, (n, ids, decoded) in zip(given, model.render(given)):
        want, plain = library_row(library, text)
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), plain), text
    assert model.encode("Hello") == library_row(library, "Hello")[0]


def test_side_by_side_merging_equals_one_by_one():
    model = bpe.WordBpe(catalog.vocabulary_path())
    draw = random.Random(2)
    words = ["".join(draw.choice("etaoinshr'dlcé,!") for _ in range(draw.randrange(1, 80))) for _ in range(2000)]
    assert model.encode_words(words) == [model.encode_word(w) for w in words]


def test_remembered_words_are_bounded():
    known = bpe.Remembered(8)
    for i in range(100):
        known.put(str(i), ("", ""))
    known.put("x" * 100, ("", ""))
    assert len(known.young) + len(known.old) <= 8 and known.get("99") and not known.get("0")


def test_bpe_edges(spark, library):
    docs = frame(spark, EDGES)
    rows = bpe.encoded(docs, catalog.vocabulary_path()).collect()
    want = sorted((i or 0, library_row(library, t)[0]) for i, t in EDGES)
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == want
    assert bpe.digests(docs, catalog.vocabulary_path()).count() == len(EDGES)
    assert bpe.digests(empty(spark), catalog.vocabulary_path()).count() == 0


# language

def test_language_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = catalog.op2_language(spark, DATA).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.93 * len(held)


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en")] * 30 + [("der hund und die katze", "de")] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = catalog.language_profiles(docs)
    assert profiles.languages == ["de", "en"]
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, "12 34 !?"), (4, "the dog"), (4, "the dog"), (None, "und der"), (6, "ab " * 500_000)],
        "doc_id long, text string").withColumns({"score": F.lit(1), "lang_pred": F.lit("x"), "row": F.lit(2)})
    found = [(r.row.doc_id, r.lang_pred) for r in language.identify(odd, profiles).collect()]
    assert found[:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de")]
    kept = language.speaking(odd, profiles)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {4, None}
    assert language.speaking(empty(spark), catalog.language_profiles(empty(spark))).count() == 0
    assert language.Profiles({}, 5).predict("abc") == ("und", 0.0)


def test_ngrams_of_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Der schnelle Fuchs, über alles! " * 50
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "PIECE", 64)
    pieces = language.ngram_counts(text)
    assert all((a == b).all() for a, b in zip(whole, pieces))


# toxicity

def test_toxicity_on_held_out_rows(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = catalog.op7_toxicity(spark, folder).collect()
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    hits = sum(r.predicted == 1 and truth[r.doc_id] == 1 for r in held)
    wrong = sum(r.predicted == 1 and truth[r.doc_id] == 0 for r in held)
    assert hits >= 0.6 * sum(truth[r.doc_id] for r in held) and wrong <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_lexicon_folds_and_excepts():
    lexicon = toxicity.Lexicon({"idiot ": 5.0, "scumm": 3.0}, ("idiot proof",), 1.0)
    hit = lexicon.strength("what an idiot he is")
    assert hit > 0
    for disguised in ("what an 1d10t he is", "what an IDIOT he is", "what an іdiоt he is", "what an id!ot he is"):
        assert lexicon.strength(disguised) == hit, disguised
    assert lexicon.strength("it is idiot proof they say") == 0
    assert lexicon.strength("idiotic") == 0 and lexicon.strength("scummy") > 0 and lexicon.strength("ascummy") == 0
    assert lexicon.score("idiot") > lexicon.score("idiot " + "calm words " * 500) > 0
    assert lexicon.score(None) == lexicon.score("") == 0


def test_toxicity_edges(spark):
    lexicon = toxicity.Lexicon({"one ": 5.0})
    rows = toxicity.toxicity(frame(spark, EDGES), lexicon, F.lit(False)).collect()
    assert len(rows) == len(EDGES) and sum(r.score > 0 for r in rows) == 2
    assert toxicity.toxicity(empty(spark), lexicon, F.lit(False)).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(empty(spark), no_labels).weights == {}
    one_sided = spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, toxic int")
    assert toxicity.learn(frame(spark, EDGES), one_sided).weights == {}


def test_batches_are_cut_by_size():
    from codeloom.llm.text import in_pieces

    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "x" * 50, "", "c"])], names=["text"])
    assert [p.num_rows for p in in_pieces(batch, "text", 10)] == [2, 1, 2]
