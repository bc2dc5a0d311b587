"""Near-duplicates by MinHash.

Texts with the same words are one class. Every class gets minima of many
universal hashes over its word shingles; bands of minima put classes into
buckets. Candidates are checked by their signatures, then on their full sets,
and links are closed to components.

Candidates come in two steps, so that no bucket emits all its pairs. First each
bucket member meets the bucket's least member. Components of these links label
the members; a bucket with one label needs nothing more. In the others, members
of different labels are compared by signature, block by block, and only pairs
that can be similar enough are emitted, each in the first bucket they share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.components import connected_components
from codeloom.llm.sizes import join_checked
from codeloom.llm.text import finish, row_wise, shingle_hashes, word_hashes, word_table
from codeloom.session import cut_lineage

SCHEMA = "doc_id long, n_shingles long, print binary, bands array<long>, signature binary"
BLOCK = 2048  # members of a bucket that are compared with as many others in one task


@dataclass(frozen=True)
class Plan:
    """Parameters of the search.

    With 50 bands of 5 rows a pair at similarity 0.75 shares no band with a
    chance of about 1e-6. Signatures have more minima than the bands use, so that
    few pairs below the threshold are left to the exact check. `slack` is how
    many standard deviations the agreement of two signatures may fall below the
    threshold before a pair is dropped.
    """

    width: int = 5
    percent: int = 75
    bands: int = 50
    rows: int = 5
    hashes: int = 512
    slack: float = 4.5
    seed: int = 20250

    @property
    def least_agreement(self) -> int:
        p = self.percent / 100
        return max(1, math.floor(self.hashes * p - self.slack * math.sqrt(self.hashes * p * (1 - p))))

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        """Odd factors and summands of the universal hashes on 32 bits."""
        draw = np.random.default_rng(self.seed)
        factors = draw.integers(0, 2**32, self.hashes, dtype=np.uint32) | np.uint32(1)
        return factors, draw.integers(0, 2**32, self.hashes, dtype=np.uint32)


def minima(shingles: np.ndarray, starts: np.ndarray, plan: Plan) -> np.ndarray:
    """Minima of every hash over each run of shingles: one row per hash, one column per text."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    table = np.empty((plan.hashes, len(starts)), np.uint32)
    for row, (factor, summand) in enumerate(zip(*plan.coefficients())):
        table[row] = np.minimum.reduceat(values * factor + summand, starts)
    return table


def band_keys(table: np.ndarray, plan: Plan) -> np.ndarray:
    """One 64-bit key per text and band."""
    keys = np.empty((table.shape[1], plan.bands), np.uint64)
    for band in range(plan.bands):
        total = np.full(table.shape[1], band + 1, np.uint64)
        for row in table[band * plan.rows:(band + 1) * plan.rows]:
            total = finish(total ^ row.astype(np.uint64)) + np.uint64(band)
        keys[:, band] = total
    return keys.view(np.int64)


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """Set size, 128-bit print of the words, band keys and signature of every row.

    A row without words has size 0 and nulls for the rest. The signature keeps
    the last byte of each minimum.
    """
    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, words, counts = word_table(batch.column("text"))
        hashes = word_hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
        shingles, made = shingle_hashes(hashes, counts, plan.width)
        ends, word_ends = np.cumsum(made), np.cumsum(counts)
        full = np.flatnonzero(made)
        sizes = np.zeros(len(counts), np.int64)
        prints: list[bytes | None] = [None] * len(counts)
        signatures: list[bytes | None] = [None] * len(counts)
        bands: list[np.ndarray | None] = [None] * len(counts)
        if len(full):
            table = minima(shingles, ends[full] - made[full], plan)
            keys = band_keys(table, plan)
            low = np.ascontiguousarray((table & np.uint32(0xFF)).astype(np.uint8).T)
            for place, at in enumerate(full.tolist()):
                sizes[at] = len(np.unique(shingles[ends[at] - made[at]:ends[at]]))
                prints[at] = xxhash.xxh3_128_digest(hashes[word_ends[at] - counts[at]:word_ends[at]].tobytes())
                signatures[at] = low[place].tobytes()
                bands[at] = keys[place]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(prints, pa.binary()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
            names=["doc_id", "n_shingles", "print", "bands", "signature"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(row_wise(sketch, limit=1 << 20), SCHEMA)


def similar_pairs(pairs: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Those of `pairs` (a, b: ids) whose full shingle sets reach the similarity: u, v.

    Only texts that a pair names are moved.
    """
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "named")
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = cut_lineage(join_checked(known, ids, "id", "left_semi").distinct(), "texts")
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))

    def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")])
        coded = texts.dictionary_encode()
        codes, words, counts = word_table(coded.dictionary)
        hashes = word_hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
        shingles, made = shingle_hashes(hashes, counts, plan.width)
        ends = np.cumsum(made)
        sets = [np.unique(shingles[e - m:e]) for e, m in zip(ends.tolist(), made.tolist())]
        which = coded.indices.to_numpy(zero_copy_only=False)
        similar = []
        for left, right in zip(which[:batch.num_rows].tolist(), which[batch.num_rows:].tolist()):
            one, other = sets[left], sets[right]
            common = len(np.intersect1d(one, other, assume_unique=True))
            similar.append(common > 0 and 100 * common >= plan.percent * (len(one) + len(other) - common))
        chosen = pa.array(similar, pa.bool_())
        return pa.RecordBatch.from_arrays(
            [batch.column("a").filter(chosen), batch.column("b").filter(chosen)], names=["u", "v"])

    return both.mapInArrow(row_wise(confirm, column="text_b", limit=2 << 20), "u long, v long")


def _block_pairs(plan: Plan):
    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        labels = table.column("label").to_numpy()
        tiles = table.column("tile").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        key = table.column("key")[0].as_py()
        bands = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
        rights = np.flatnonzero(tiles == high)
        found_a, found_b = [], []
        for left in np.flatnonzero(tiles == low).tolist():
            other = rights[labels[rights] != labels[left]]
            if low == high:
                other = other[ids[other] > ids[left]]
            other = other[(marks[other] == marks[left]).sum(axis=1) >= plan.least_agreement]
            # The first bucket a pair shares emits it; signatures hold too little of a minimum to tell which that is.
            first = (bands[other] == bands[left]).argmax(axis=1)
            other = other[bands[left][first] == key]
            found_a += [int(ids[left])] * len(other)
            found_b += ids[other].tolist()
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})
    return compare


def crossing_pairs(members: DataFrame, classes: DataFrame, labels: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of one bucket but different labels whose signatures allow the similarity: a, b.

    A bucket of n members is compared in blocks of about `BLOCK` by `BLOCK`.
    """
    named = (members.join(labels, F.col("id") == F.col("node"), "left")
             .select("key", "id", F.coalesce("component", "id").alias("label")))
    open_keys = named.groupBy("key").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where(
        F.col("least") != F.col("most")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("tiles"))
    left = named.join(open_keys, "key").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    blocks = (left.join(classes.select("id", "bands", "signature"), "id")
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
              .select("key", "id", "label", "bands", "signature", "tile",
                      F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")))
    return blocks.groupBy("key", "low", "high").applyInArrow(_block_pairs(plan), "a long, b long")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Set size and component for every row of `docs` (doc_id, text).

    Result: doc_id, n_shingles (distinct shingles of five words, A-Z folded; a
    shorter text is one shingle), component_id (the least id reachable over
    links of 75 % similarity or more, itself included), kept (whether it is that
    id). Null and empty texts, or texts without words, have 0 shingles and are
    linked with nothing. Rows sharing an id count as versions of one document:
    what one is linked with, all are. A row without an id has a null component
    and is kept. An empty table gives an empty result; other columns are ignored.
    """
    rows = cut_lineage(sketches(docs, plan), "sketches")
    filled = rows.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut_lineage(filled.groupBy("print").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("copies"),
        F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
    copies = (filled.select("doc_id", "print").join(classes.where(F.col("copies") > 1).select("print", "id"), "print")
              .select(F.col("doc_id").alias("u"), F.col("id").alias("v")))
    reached = connected_components(_links(docs, classes, plan).union(copies))
    component = F.coalesce("component", "doc_id")
    return (rows.select("doc_id", "n_shingles").join(reached, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def _links(docs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """Links between classes, those of the first step contracted to their components."""
    keys = classes.select("id", F.explode("bands").alias("key"))
    hubs = cut_lineage(keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n"))
                       .where(F.col("n") > 1).select("key", "hub"), "hubs")
    members = cut_lineage(join_checked(keys, hubs, "key", "inner").select("key", "id", "hub"), "members")
    stars = members.where(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = cut_lineage(similar_pairs(cut_lineage(stars, "stars"), docs, plan), "links")
    labels = cut_lineage(connected_components(first), "labels")
    crossing = cut_lineage(crossing_pairs(members, classes, labels, plan).distinct(), "crossing")
    second = similar_pairs(crossing, docs, plan)
    return labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(second)


SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM cut WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
  WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
reached AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.r)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, r.doc_id = min(r) AS kept
FROM reached r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""
