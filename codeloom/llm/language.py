"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams by rank. A text's own most
frequent n-grams are ranked the same way; the sum of rank differences is its
distance to a profile, and the nearest profile wins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from codeloom.llm.text import packed_row, row_wise

UNDETERMINED = "und"
SIZES = (1, 2, 3)
PIECE = 1 << 20  # code points counted at once
_BITS = np.int64(21)


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Lower-case letter for every code point, 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.int64)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


def letters(text: str) -> np.ndarray:
    """Folded letters with one 0 between words and at both ends; empty without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = np.concatenate([[0], _folding()[points], [0]])
    if not folded.any():
        return folded[:0]
    gap = folded == 0
    return folded[~(gap & np.concatenate([[False], gap[:-1]]))]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a whole text as numbers, and how often each occurs."""
    line = letters(text)
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for start in range(0, len(line), PIECE):
        part = line[start:start + PIECE + max(SIZES) - 1]
        fresh = min(PIECE, len(part))
        grams = [part[:fresh][part[:fresh] > 0]]
        value = part
        for size in SIZES[1:]:
            value = (value[:-1] << _BITS) | part[size - 1:]
            grams.append(value[:fresh])
        found, times = np.unique(np.concatenate(grams), return_counts=True)
        if len(codes):
            codes, at = np.unique(np.concatenate([codes, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, times])).astype(np.int64)
        else:
            codes, counts = found, times
    return codes, counts


def top_ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, most frequent first; equal counts by number."""
    if len(codes) > size:
        bound = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= bound], counts[counts >= bound]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Rank tables of all languages over the union of their n-grams."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.languages = sorted(ranked)
        self.size = size
        self.codes = np.unique(np.array([c for v in ranked.values() for c in v], dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, dtype=np.int32)
        for column, language in enumerate(self.languages):
            grams = np.array(ranked[language], dtype=np.int64)
            self.ranks[np.searchsorted(self.codes, grams), column] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 minus its distance as a share of the largest possible one."""
        codes, counts = ngram_counts(text or "")
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        top = top_ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        ranks = self.ranks[at]
        places = np.arange(len(top), dtype=np.int32)[:, None]
        distances = np.where(ranks < 0, self.size, np.abs(ranks - places)).sum(axis=0)
        best = int(np.argmin(distances))
        return self.languages[best], float(1 - distances[best] / (self.size * len(top)))


def learn_profiles(labelled: DataFrame, size: int = 400, texts_per_language: int = 1500,
                   most_languages: int = 1000) -> Profiles:
    """Profiles from a bounded sample of `labelled` (text, lang, pick).

    About `texts_per_language` texts of each language are read, chosen by the
    hash `pick` in [0, 1); a language with fewer gives all. The n-grams of a
    language are counted over its sample by a grouped sum; its `size` best are
    all that reaches the driver. More than `most_languages` labels is an error.
    """
    totals = labelled.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(totals) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not totals:
        return Profiles({}, size)
    chance = F.lit(0.0)
    for row in totals:
        chance = F.when(F.col("lang") == row["lang"], F.lit(texts_per_language / row["count"])).otherwise(chance)
    sample = labelled.where(F.col("pick") < chance).select("text", "lang")

    def count(batches):
        for batch in batches:
            for language, texts in _by_language(batch):
                tables = [ngram_counts(t or "") for t in texts]
                codes, at = np.unique(np.concatenate([c for c, _ in tables]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([n for _, n in tables]), minlength=len(codes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(codes), pa.string()), pa.array(codes, pa.int64()),
                     pa.array(sums.astype(np.int64))], names=["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # One list per language: its distinct n-grams in the bounded sample.
    best = grams.groupBy("lang").agg(
        F.expr(f"slice(array_sort(collect_list(struct(-n AS m, gram))), 1, {size}).gram").alias("grams"))
    return Profiles({row["lang"]: row["grams"] for row in best.collect()}, size)


def _by_language(batch: pa.RecordBatch) -> list[tuple[str, list[str | None]]]:
    groups: dict[str, list[str | None]] = {}
    for text, language in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
        groups.setdefault(language, []).append(text)
    return sorted(groups.items())


def identify(rows: DataFrame, profiles: Profiles) -> DataFrame:
    """Predicted language and score (0 to 1) of the text of every row: row, lang_pred, score.

    `row` is the whole row as a struct, so no column can clash. A null text, or
    one without a letter, is `und` with score 0, as is everything when no
    language was learned. Equal distances go to the language that sorts first.
    Rows are independent, so repeated rows and null ids are answered as they
    come; an empty table gives an empty result.
    """
    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [profiles.predict(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array([f[0] for f in found], pa.string()),
             pa.array([f[1] for f in found], pa.float64())], names=["row", "lang_pred", "score"])

    packed = rows.select(packed_row(rows), F.col("text").cast("string").alias("text"))
    schema = StructType([packed.schema["row"], StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])
    return packed.mapInArrow(row_wise(predict), schema)


def speaking(docs: DataFrame, profiles: Profiles, least_score: float = 0.1) -> DataFrame:
    """`docs` without the rows that have no language: `und`, or nothing like any profile.

    Where no language was learned, all rows with a letter stay.
    """
    found = identify(docs, profiles)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    if not profiles.languages:
        kept = found.where(F.col("row.text").rlike(r"\p{L}"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
