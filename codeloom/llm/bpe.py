"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word starts as a row of byte symbols. Leaf i of a minimum tree holds the rank
of the pair (i, next of i) with the place as tie-break, so the root is always
the leftmost pair of lowest rank. A merge changes at most three leaves, each
repaired in a logarithmic number of steps, until the root holds no pair.

The new words of a batch are merged side by side: one row of a numpy table is
one word's tree. Very long words get a tree of their own.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.text import row_wise

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NO_PAIR = 1 << 62
REMEMBERED_WORDS = 1 << 17  # words whose ids a task remembers, some 50 MB; the others are encoded anew
BATCH_BYTES = 2 << 20  # of text cut and encoded at once
SIDE_BY_SIDE = 64  # longest word, in bytes, that is merged and remembered together with others

# Unicode white space, which differs from what str.split() takes for blank.
_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = regex.compile(rf"[^{_SPACE}]+")
_CONTROL_BLANKS = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte.

    Bytes that print as themselves in Latin-1 do so; the others take the code
    points from 256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def rank_tree(keys: list[int]) -> list[int]:
    """A minimum tree over `keys`: node i has the children 2i and 2i+1, the leaves are the second half."""
    width = 1 << (len(keys) - 1).bit_length()
    tree = [NO_PAIR] * width + keys + [NO_PAIR] * (width - len(keys))
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    return tree


def set_leaf(tree: list[int], node: int, key: int) -> None:
    """Put `key` into the leaf `node` and repair the way to the root, as far as it changes."""
    tree[node] = key
    while node > 1:
        other = tree[node ^ 1]
        if other < key:
            key = other
        node >>= 1
        if tree[node] == key:
            return
        tree[node] = key


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Merge a row of symbol ids until no adjacent pair can be merged.

    `ranks` gives the rank of a pair, `merged` the id a rank leads to. The key
    of a pair is its rank, then its place, in one number.
    """
    places = len(symbols)
    if places < 2:
        return symbols
    get = ranks.get
    symbols = list(symbols)
    after = list(range(1, places + 1))
    before = list(range(-1, places - 1))
    keys = []
    for left in range(places - 1):
        rank = get((symbols[left], symbols[left + 1]))
        keys.append(NO_PAIR if rank is None else rank * places + left)
    tree = rank_tree(keys)
    leaves = len(tree) >> 1
    while (top := tree[1]) != NO_PAIR:
        rank, left = divmod(top, places)
        right = after[left]
        symbols[left] = new = merged[rank]
        symbols[right] = -1
        following = after[left] = after[right]
        key = NO_PAIR
        if following < places:
            set_leaf(tree, leaves + right, NO_PAIR)
            before[following] = left
            rank = get((new, symbols[following]))
            if rank is not None:
                key = rank * places + left
        set_leaf(tree, leaves + left, key)
        previous = before[left]
        if previous >= 0:
            rank = get((symbols[previous], new))
            set_leaf(tree, leaves + previous, NO_PAIR if rank is None else rank * places + previous)
    return [s for s in symbols if s >= 0]


class PairTable:
    """Merge ranks of symbol pairs as sorted numbers, for many look-ups at once."""

    def __init__(self, ranks: dict[tuple[int, int], int], merged: list[int]):
        self.base = 1 + max([*merged, *(i for pair in ranks for i in pair)], default=0)
        pairs = np.array([a * self.base + b for a, b in ranks], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(list(ranks.values()), dtype=np.int64)[order], 0)
        self.merged = np.array(merged, dtype=np.int64)

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, places: int) -> np.ndarray:
        wanted = left * self.base + right
        at = np.searchsorted(self.pairs, wanted)
        known = (self.pairs[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at] * places + place, NO_PAIR)


def set_leaves(trees: np.ndarray, rows: np.ndarray, nodes: np.ndarray, keys: np.ndarray) -> None:
    """`set_leaf` for one leaf of each of several trees."""
    trees[rows, nodes] = keys
    for _ in range((trees.shape[1] >> 1).bit_length() - 1):
        keys = np.minimum(keys, trees[rows, nodes ^ 1])
        nodes = nodes >> 1
        trees[rows, nodes] = keys


def merge_table(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """`merge_word` for every row of `symbols`, padded by -1 on the right; merged places become -1."""
    words, places = symbols.shape
    if places < 2:
        return symbols
    width = 1 << (places - 2).bit_length()
    column = np.arange(places, dtype=np.int64)
    after = np.tile(column + 1, (words, 1))
    after[np.arange(words), (symbols >= 0).sum(axis=1) - 1] = places
    before = np.tile(column - 1, (words, 1))
    trees = np.full((words, 2 * width), NO_PAIR, dtype=np.int64)
    trees[:, width:width + places - 1] = table.keys(symbols[:, :-1], symbols[:, 1:], column[:-1], places)
    for node in range(width - 1, 0, -1):
        np.minimum(trees[:, 2 * node], trees[:, 2 * node + 1], out=trees[:, node])
    rows = np.flatnonzero(trees[:, 1] != NO_PAIR)
    while len(rows):
        rank, left = np.divmod(trees[rows, 1], places)
        right = after[rows, left]
        new = table.merged[rank]
        symbols[rows, left] = new
        symbols[rows, right] = -1
        following = after[rows, right]
        after[rows, left] = following
        inner = following < places
        some, place = rows[inner], left[inner]
        before[some, following[inner]] = place
        key = np.full(len(rows), NO_PAIR)
        key[inner] = table.keys(new[inner], symbols[some, following[inner]], place, places)
        set_leaves(trees, some, width + right[inner], np.full(len(some), NO_PAIR))
        set_leaves(trees, rows, width + left, key)
        previous = before[rows, left]
        inner = previous >= 0
        some, place = rows[inner], previous[inner]
        set_leaves(trees, some, width + place, table.keys(symbols[some, place], new[inner], place, places))
        rows = rows[trees[rows, 1] != NO_PAIR]
    return symbols


class Remembered:
    """A bounded map of two generations: when the young one is full, the old one goes."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def get(self, chunk: str) -> tuple[str, str] | None:
        value = self.young.get(chunk)
        if value is None:
            value = self.old.get(chunk)
            if value is not None:
                self.put(chunk, value)
        return value

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def put(self, chunk: str, value: tuple[str, str]) -> None:
        if len(chunk) > SIDE_BY_SIDE:
            return
        if len(self.young) >= self.size // 2:
            self.old, self.young = self.young, {}
        self.young[chunk] = value


@contextmanager
def _no_collection() -> Iterator[None]:
    """Millions of small tuples and no cycles: looking for cycles costs more than the work."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class WordBpe:
    """Encoder and decoder of a vocabulary file in the public tokenizer JSON format.

    Reads the byte-level BPE model with a word-end suffix, its split pattern and
    its added tokens. Normalisation is that of the file: NFC, white space to one
    blank, lower case letter by letter. Letters are those of the installed
    Unicode tables; characters newer than those of the file's library may be
    cut elsewhere.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("not a byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.added.items()})
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = [(a, b) for a, b in pairs]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        signs = byte_symbols()
        self.inner = [vocab[s] for s in signs]
        self.last = [vocab[s + self.suffix] for s in signs]
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0].replace(r"\s", _SPACE))
        longest = sorted(self.added, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.table = PairTable(self.ranks, self.merged)
        self.inner_ids, self.last_ids = np.array(self.inner), np.array(self.last)
        self.known = Remembered(REMEMBERED_WORDS)

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        return merge_word([self.inner[b] for b in data[:-1]] + [self.last[data[-1]]], self.ranks, self.merged)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of many words, those of like length side by side."""
        data = [w.encode() for w in words]
        result: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for at, word in enumerate(data):
            if len(word) > SIDE_BY_SIDE:
                result[at] = self.encode_word(words[at])
            else:
                classes.setdefault(max(4, 1 << (len(word) - 2).bit_length()) + 1, []).append(at)
        for places, members in classes.items():
            some = [data[at] for at in members]
            sizes = np.array([len(w) for w in some])
            rows = np.arange(len(some))
            filled = np.frombuffer(b"".join(w.ljust(places, b"\0") for w in some), np.uint8).reshape(-1, places)
            symbols = self.inner_ids[filled]
            symbols[rows, sizes - 1] = self.last_ids[filled[rows, sizes - 1]]
            symbols[np.arange(places) >= sizes[:, None]] = -1
            symbols = merge_table(symbols, self.table)
            left = symbols >= 0
            ids = symbols[left].tolist()
            end = 0
            for at, n in zip(members, left.sum(axis=1).tolist()):
                result[at] = ids[end:end + n]
                end += n
        return result

    def rendered(self, chunks: set[str]) -> dict[str, tuple[str, str]]:
        """Ids and tokens of chunks, each joined by blanks.

        A chunk is text between white space; a word is a chunk of its own, so
        one map serves both.
        """
        found, cut = {}, {}
        for chunk in chunks:
            value = self.known.get(chunk)
            if value is not None:
                found[chunk] = value
            else:
                cut[chunk] = self.pattern.findall(chunk)
        new = {w for words in cut.values() for w in words} - found.keys()
        for word in [w for w in new if w not in chunks and self.known.get(w)]:
            found[word] = self.known.get(word)
            new.discard(word)
        words = list(new)
        for word, ids in zip(words, self.encode_words(words)):
            found[word] = value = " ".join(map(str, ids)), self.decode(ids)
            self.known.put(word, value)
        for chunk, words in cut.items():
            if chunk not in found:
                parts = [found[w] for w in words]
                found[chunk] = value = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
                self.known.put(chunk, value)
        return found

    def sections(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at added tokens, each section with the id of the token behind it."""
        if self.specials is None or not self.specials.search(text):
            return [(text, None)]
        parts, upto = [], 0
        for match in self.specials.finditer(text):
            parts.append((text[upto:match.start()], self.added[match[0]]))
            upto = match.end()
        return [*parts, (text[upto:], None)]

    @staticmethod
    def chunks(section: str) -> list[str]:
        """Normalised text between white space."""
        # Capital sigma has one lower case here, not one by its place in the word.
        low = unicodedata.normalize("NFC", section).replace("Σ", "σ").lower()
        return _CHUNKS.findall(low) if _CONTROL_BLANKS.search(low) else low.split()

    def render(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each whole text the number of ids, the ids joined by one blank, and the decoded text."""
        with _no_collection():
            return self._render(texts)

    def _render(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        cut = [[(self.chunks(section), special) for section, special in self.sections(text or "")]
               for text in texts]
        distinct: set[str] = set()
        for parts in cut:
            for chunks, _ in parts:
                distinct.update(chunks)
        found = self.rendered(distinct)
        result = []
        for parts in cut:
            pairs = []
            for chunks, special in parts:
                pairs += [found[c] for c in chunks]
                if special is not None:
                    pairs.append((str(special), self.tokens[special]))
            ids = " ".join([p[0] for p in pairs])
            result.append((ids.count(" ") + bool(ids), ids, " ".join([p[1] for p in pairs])))
        return result

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.render([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by blanks, as a file without a decoder asks for; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One encoder for each vocabulary and Python worker."""
    return WordBpe(path)


def forget(name: str) -> None:
    """Free what a task has remembered: its worker goes on with other work."""
    loaded(SparkFiles.get(name)).known.clear()


def shipped(spark, path: str) -> str:
    """Send a vocabulary file to the executors; the name it has there."""
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def _id_lists(found: list[tuple[int, str, str]]) -> pa.Array:
    """The ids of rendered texts as lists, read from one text of all of them."""
    sizes = np.array([n for n, _, _ in found], dtype=np.int64)
    flat = np.fromstring(" ".join([ids for _, ids, _ in found if ids]), dtype=np.int32, sep=" ")
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))


def _encoding(docs: DataFrame, vocabulary: str, columns: Callable[[list], dict[str, pa.Array]], schema: str) -> DataFrame:
    """doc_id and what `columns` makes of the rendered texts of a batch."""
    name = shipped(docs.sparkSession, vocabulary)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = columns(loaded(SparkFiles.get(name)).render(batch.column("text").to_pylist()))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **made})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(row_wise(encode, limit=BATCH_BYTES, done=lambda: forget(name)), schema)


def _counts(found: list[tuple[int, str, str]]) -> pa.Array:
    return pa.array([n for n, _, _ in found], pa.int64())


def _sha256(texts: Iterable[str]) -> pa.Array:
    return pa.array([hashlib.sha256(text.encode()).hexdigest() for text in texts], pa.string())


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Ids and decoded text for every row of `docs` (doc_id, text).

    Result: doc_id, n_tokens, ids (array), decoded. `vocabulary` is the path of
    a vocabulary file. A null text counts as empty: no ids, empty decoded text.
    Rows are independent, so repeated rows and null ids are answered as they
    come; an empty table gives an empty result; other columns are ignored.
    """
    def columns(found):
        return {"n_tokens": _counts(found), "ids": _id_lists(found), "decoded": pa.array([f[2] for f in found], pa.string())}

    return _encoding(docs, vocabulary, columns, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, ids: bool = False) -> DataFrame:
    """As `encoded`, with SHA-256 of the ids joined by blanks and of the decoded text instead.

    Digests are taken where the texts are encoded. With `ids` the ids come as well, the last column.
    """
    def columns(found):
        made = {"n_tokens": _counts(found), "ids_sha256": _sha256(f[1] for f in found),
                "decoded_sha256": _sha256(f[2] for f in found)}
        return {**made, "ids": _id_lists(found)} if ids else made

    return _encoding(docs, vocabulary, columns, SCHEMA + ", ids array<int>" * ids)
