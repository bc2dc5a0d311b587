"""Toxicity by a weighted lexicon.

Texts are folded first: look-alike letters and digits standing for letters are
undone, case goes. An Aho-Corasick automaton finds all lexicon entries in one
pass; hits that are part of an exception phrase do not count. The sum of weights
is normalised by length and squashed to a score.

The lexicon is learned from labels: words, and beginnings of words, that are
much more frequent in toxic texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.pii import LOOKALIKES
from codeloom.llm.sizes import join_checked
from codeloom.llm.text import row_wise
from codeloom.session import cut_lineage

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
THRESHOLD = 0.7
STEMS = range(3, 13)  # lengths of word beginnings that can become entries

# ---- fixed values: digits and signs that stand for letters inside a word
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# ---- end of fixed values

_SIGN_RUN = re.compile(r"[0134578@$!][0134578@$!]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
_LAST_WORD = re.compile(r"[^\W\d_]+(?=[\W\d_]*\Z)")
_SIGN_TABLE = str.maketrans(SIGNS)
_LETTERS = {k: v for k, v in LOOKALIKES.items() if unicodedata.category(k) in ("Ll", "Lu")}
_LETTER_TABLE = str.maketrans(_LETTERS)
_LETTER = re.compile("[" + "".join(_LETTERS) + "]")
NEARBY = 100  # characters around a hit in which its neighbour words are looked for


def fold(text: str) -> str:
    """Lower case without disguises."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _LETTER.search(text):
            text = text.translate(_LETTER_TABLE)
    text = text.lower()

    def undisguised(match: re.Match) -> str:
        at = match.start()
        inside = at and (text[at - 1].isalpha() or text[at - 1].isspace() and match[0][0] != "!")
        return match[0].translate(_SIGN_TABLE) if inside or not at else match[0]

    return _SIGN_RUN.sub(undisguised, text)


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, exception phrases, and the scale of the score.

    An entry `stem` matches words that begin with it, `word ` whole words. An
    exception is a phrase of two words; a hit in one of them does not count when
    the other is its neighbour.
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    scale: float = 1.0
    _automaton: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return self.weights, self.exceptions, self.scale

    def __setstate__(self, state):
        for name, value in zip(("weights", "exceptions", "scale", "_automaton"), (*state, [])):
            object.__setattr__(self, name, value)

    @property
    def automaton(self) -> ahocorasick.Automaton | None:
        if not self._automaton:
            found = None
            if self.weights:
                found = ahocorasick.Automaton()
                for entry, weight in self.weights.items():
                    bare = entry.rstrip()
                    _, whole, stem = found.get(bare, (0, 0.0, 0.0))
                    found.add_word(bare, (len(bare), weight, stem) if entry != bare else (len(bare), whole, weight))
                found.make_automaton()
            self._automaton.append(found)
        return self._automaton[0]

    def hits(self, folded: str) -> dict[int, tuple[int, float]]:
        """Place of each hit word with the length and weight of its heaviest entry."""
        found: dict[int, tuple[int, float]] = {}
        if self.automaton is None:
            return found
        for end, (size, whole, stem) in self.automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalpha():
                continue
            inner = end + 1 < len(folded) and folded[end + 1].isalpha()
            weight = stem if inner else max(whole, stem)
            if weight > found.get(start, (0, 0.0))[1]:
                found[start] = size, weight
        return found

    def strength(self, text: str | None) -> float:
        """Weights of the hits, one per word at most, over a slowly growing function of length."""
        folded = fold(text or "")
        hits = self.hits(folded)
        if hits and self.exceptions:
            hits = {s: x for s, x in hits.items() if self._shield.isdisjoint(phrases_at(folded, s))}
        if not hits:
            return 0.0
        blanks = folded.count(" ") + folded.count("\n")
        return sum(w for _, w in hits.values()) / (1 + math.log1p(blanks / 100))

    @property
    def _shield(self) -> frozenset[str]:
        return _frozen(self.exceptions)

    def score(self, text: str | None) -> float:
        return 1 - math.exp(-self.scale * self.strength(text))


@lru_cache(maxsize=4)
def _frozen(phrases: tuple[str, ...]) -> frozenset[str]:
    return frozenset(phrases)


def phrases_at(folded: str, start: int) -> set[str]:
    """The word at a place with its neighbour before and behind it."""
    here = _WORD.match(folded, start)
    if here is None:
        return set()
    found = set()
    left = _LAST_WORD.search(folded[max(0, start - NEARBY):start])
    if left:
        found.add(f"{left[0]} {here[0]}")
    right = _WORD.search(folded, here.end(), here.end() + NEARBY)
    if right:
        found.add(f"{here[0]} {right[0]}")
    return found


def features(text: str | None) -> set[str]:
    """Whole words and word beginnings of a text, written as entries."""
    found = set()
    for word in set(_WORD.findall(fold(text or ""))):
        found.add(f"{word} ")
        found.update(word[:n] for n in STEMS if n <= len(word))
    return found


def bounded_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Texts and labels of about `rows` documents of each label, chosen by the hash of their ids.

    A label with fewer gives all. Only ids are looked at before the choice.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    chance = F.when(F.col("toxic") == 1, F.lit(rows / max(totals.get(1, 0), 1))).otherwise(
        F.lit(rows / max(totals.get(0, 0), 1)))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    chosen = cut_lineage(marked.where(pick < chance).distinct(), "labelled")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    return cut_lineage(join_checked(texts, chosen, "doc_id", "inner").select("text", "toxic"), "labelled_texts")


def learn(docs: DataFrame, labels: DataFrame, rows_per_label: int = 10_000, least_texts: int = 4,
          least_odds: float = 8.0, most_entries: int = 5000, most_exceptions: int = 200) -> Lexicon:
    """A lexicon from a bounded sample of `docs` (doc_id, text) under `labels` (doc_id, toxic 0/1).

    Document counts of all features by label are summed by Spark over the sample.
    A feature becomes an entry if at least `least_texts` toxic texts have it and
    its share among toxic texts is, with the counts moved by their usual error,
    at least `least_odds` times that among the others; its weight is the
    logarithm of that ratio. Of entries that begin alike the longest of those
    with nearly the same texts stays, and longer ones only where they say clearly
    more. Two-word phrases around an entry that occur in clean texts only become
    exceptions.
    """
    sample = bounded_sample(docs, labels, rows_per_label)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for entry in features(text):
                sums.setdefault(entry, [0, 0])[toxic] += 1
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()),
             pa.array([v[1] for v in sums.values()], pa.int64())], names=["entry", "clean", "toxic"])

    counted = sample.mapInArrow(
        row_wise(count), "entry string, clean long, toxic long")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon({})
    low = F.greatest(F.col("toxic") - 1.6 * F.sqrt("toxic"), F.lit(0.0)) + 0.5
    high = F.col("clean") + 1.6 * F.sqrt("clean") + 0.5
    odds = (low / (n_toxic + 1)) / (high / (n_clean + 1))
    best = (counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .where(F.col("toxic") >= least_texts).withColumn("odds", odds)
            .where(F.col("odds") >= least_odds)
            .orderBy(F.col("toxic").desc(), F.col("odds").desc(), "entry").limit(most_entries).collect())
    weights = _nested({r["entry"]: (r["toxic"], r["odds"]) for r in best})
    draft = Lexicon(weights)
    phrases = _phrases(sample, draft, most_exceptions, least_texts) if weights else ()
    return _calibrated(Lexicon(weights, phrases), sample)


def _nested(found: dict[str, tuple[int, float]], alike: float = 0.9) -> dict[str, float]:
    """Entries with their weights, without those another one says as well."""
    longest: dict[str, int] = {}
    for entry, (toxic, _) in found.items():
        for n in range(1, len(entry)):
            longest[entry[:n]] = max(longest.get(entry[:n], 0), toxic)
    kept: dict[str, float] = {}
    for entry in sorted(found, key=lambda e: (len(e), e)):
        toxic, odds = found[entry]
        shorter = [kept[entry[:n]] for n in range(1, len(entry)) if entry[:n] in kept]
        if longest.get(entry, 0) < alike * toxic and all(odds > 2 * o for o in shorter):
            kept[entry] = odds
    return {entry: math.log(odds) for entry, odds in kept.items()}


def _phrases(sample: DataFrame, lexicon: Lexicon, most: int, least_texts: int) -> tuple[str, ...]:
    """Phrases with an entry inside that clean texts have and toxic ones do not."""
    def around(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            folded = fold(text or "")
            found = set().union(*(phrases_at(folded, at) for at in lexicon.hits(folded)))
            rows += [(p, toxic) for p in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())],
            names=["phrase", "toxic"])

    seen = sample.mapInArrow(
        row_wise(around), "phrase string, toxic int")
    rows = (seen.groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
            .where((F.col("toxic") == 0) & (F.col("n") >= least_texts))
            .orderBy(F.col("n").desc(), "phrase").limit(most).collect())
    return tuple(sorted(r["phrase"] for r in rows))


def _calibrated(lexicon: Lexicon, sample: DataFrame) -> Lexicon:
    """The lexicon with the scale that puts the threshold where it errs least on the sample.

    Strengths are counted in steps of 1/20, so what reaches the driver is small.
    """
    def strengths(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [min(int(lexicon.strength(t) * 20), 10_000) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), batch.column("toxic")],
                                          names=["step", "toxic"])

    table = (sample.mapInArrow(row_wise(strengths), "step int, toxic int").groupBy("step")
             .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
             .orderBy("step").collect())
    missed, falsely = 0, sum(r["clean"] for r in table)
    best, cut = None, 1.0
    for row in table:
        if row["step"] > 0 and (best is None or missed + falsely < best):
            best, cut = missed + falsely, row["step"] / 20
        missed += row["toxic"]
        falsely -= row["clean"]
    return Lexicon(lexicon.weights, lexicon.exceptions, -math.log(1 - THRESHOLD) / cut)


def toxicity(docs: DataFrame, lexicon: Lexicon, held_out: Column) -> DataFrame:
    """Score (0 to 1) and prediction for every row of `docs` (doc_id, text).

    `held_out` is a column carried to the result. A null or empty text has score
    0, as has everything under an empty lexicon. Rows are independent, so
    repeated rows and null ids are answered as they come; an empty table gives
    an empty result; other columns are ignored.
    """
    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [lexicon.score(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
             pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
            names=["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                         F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(row_wise(judge), SCHEMA)
