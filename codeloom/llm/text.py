"""Words and hashed word shingles of whole texts, in Arrow batches.

Words are runs of characters other than the six ASCII white-space characters;
where a contract folds case, A-Z only are folded.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EMPTY = pa.scalar("", pa.string())
# Odd 64-bit multipliers, one per place in a shingle, then the finishing mix.
_PLACE = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ** 3) % 2**64 | 1 for k in range(16)], dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def packed_row(df: DataFrame) -> Column:
    """The whole row as one struct `row`, so that no column of it can clash with another."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def residue(modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def in_pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about `limit` bytes of `column`, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def row_wise(function: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text",
             limit: int = 8 << 20, done: Callable[[], None] | None = None) -> Callable:
    """A `mapInArrow` function that works on pieces of bounded size; `done` runs at the end of a task.

    Python workers outlive their tasks and share the executor's memory, so what
    Arrow has set aside goes back after every batch, and all else with the task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, column, limit):
                yield function(piece)
            batch = piece = None
            pa.default_memory_pool().release_unused()
        if done is not None:
            done()
        gc.collect()
        pa.default_memory_pool().release_unused()
    return run


def word_table(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in reading order, the distinct words, and the words per text."""
    filled = pc.fill_null(texts, _EMPTY)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(filled) if fold else filled)
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists)
    full = pc.not_equal(flat, _EMPTY)
    flat, owner = flat.filter(full), owner.filter(full)
    counts = np.bincount(owner.to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, counts


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def finish(values: np.ndarray) -> np.ndarray:
    """Spread the bits of sums of products."""
    values = (values ^ (values >> _SHIFT)) * _MIX
    return (values ^ (values >> _SHIFT)) * _MIX


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (repeats included) of consecutive texts, and shingles per text.

    `hashes` holds the hash of each word in reading order. A text of fewer words
    than `width` has its whole sequence as one shingle, one without words none.
    """
    if width > len(_PLACE):
        raise ValueError(f"shingles of more than {len(_PLACE)} words")
    total = len(hashes)
    starts = np.cumsum(counts) - counts
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.repeat(starts, made)
    offset = np.arange(len(first)) - np.repeat(np.cumsum(made) - made, made)
    at = first + offset
    length = np.repeat(np.minimum(counts, width), made)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    sums = length.astype(np.uint64)
    for k in range(width):
        sums += np.where(k < length, padded[np.minimum(at + k, total)], np.uint64(0)) * _PLACE[k]
    return finish(sums), made
