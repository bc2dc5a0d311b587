"""Prefix trie of conversations: heads burst while they are too large, the rest is sorted and swept.

Every conversation starts in the container of the root. A container of more than
`limit` turns bursts: its suffixes move on to one container for each next turn and
its node becomes a trie head. Several levels burst in a round, twice as many each
time, so rounds grow with the logarithm of the depth, and only members of
oversized containers take part in them. Containers that are left are of bounded
size; each is sorted by its suffixes and swept into nodes in one task. Sums over
the members of the heads, which may be all conversations, are plain aggregates.

Turns are known by 128 bits of hash, prefixes by the exclusive or of the hashes of
(position, turn); equal bits are taken as equal turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.sizes import join_checked
from codeloom.session import cut_lineage

LIMIT = 4096  # turns, and members, of a container
HEAD = 3  # shared turns, at most
FAMILY = 20  # conversations that may share the first turns of one
NO_END = hashlib.sha256(b"").hexdigest()
KEY = ["p1", "p2"]


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, range_id, at, h1, h2, words: turns by conversation in order, cut into ranges of like size.

    `at` rises with the order (conversation, turn, role, text); a long conversation
    fills several ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    clean = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    placed = clean.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return cut_lineage(placed.select(
        "conv_id", F.shiftright("at", 33).alias("range_id"), "at", F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(1), "text", "role").alias("h2"), words.alias("words")), "trie_turns")


def _upto(columns: list[str], order: str) -> Window:
    return Window.partitionBy(*columns).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def own_turns(stored: DataFrame) -> DataFrame:
    """Stored turns as a table of conv_id, range_id, pos (from 0), h1, h2, words."""
    before = Window.partitionBy("conv_id").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy("conv_id", "range_id").agg(F.count("*").alias("rows"))
    offsets = counts.select("conv_id", "range_id", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("conv_id", "range_id").orderBy("at")
    return (stored.withColumn("n", F.row_number().over(inside)).join(offsets, ["conv_id", "range_id"])
            .select("conv_id", "range_id", (F.col("n") + F.col("rows_before") - 1).alias("pos"), "h1", "h2", "words"))


def shared(own: DataFrame) -> DataFrame:
    """Every conversation c with its first turns replaced by those of c - c % 20: conv_id, range_id, pos, h1, h2, words, len.

    The first h = crc32(c) % 4 turns come from that conversation, as far as it has
    them, the others follow. A row of position -1 stands for the conversation
    itself, so that those without any turn are kept.
    """
    own = cut_lineage(own, "trie_own")
    start = F.struct("pos", "h1", "h2", "words")
    heads = (own.where((F.col("pos") < HEAD) & (F.col("conv_id") % FAMILY == 0))
             .groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(start)).alias("start")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    convs = own.groupBy("conv_id").agg(F.count("*").alias("rows")).withColumn("h", h.cast("int"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    taken = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.array())
    convs = cut_lineage(convs.withColumn("start", taken).select(
        "conv_id", "h", "start", (F.size("start") - F.col("h")).alias("shift"),
        (F.size("start") + F.greatest(F.col("rows") - F.col("h"), F.lit(0))).alias("len")), "trie_convs")
    zero = F.lit(0).cast("long")
    first = convs.select("conv_id", F.lit(-1).cast("long").alias("range_id"), F.lit(-1).cast("long").alias("pos"),
                         zero.alias("h1"), zero.alias("h2"), zero.alias("words"), "len")
    given = convs.select("conv_id", F.lit(-1).cast("long").alias("range_id"), "len", F.inline("start")).select(first.columns)
    # Joined by range, so that the turns of a long conversation stay apart.
    ranges = own.groupBy("conv_id", "range_id").agg(F.max("pos").alias("last"))
    ranges = ranges.join(convs, "conv_id").where(F.col("last") >= F.col("h")).select(
        "conv_id", "range_id", "h", "shift", "len")
    kept = (own.join(ranges, ["conv_id", "range_id"]).where(F.col("pos") >= F.col("h"))
            .withColumn("pos", F.col("pos") + F.col("shift")).select(first.columns))
    return first.unionByName(given).unionByName(kept)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, len, x1, x2 (the turn in its place), p1, p2 (the prefix), words and upto (words of the prefix)."""
    there = F.col("pos") >= 0
    x = rows.select("conv_id", "range_id", (F.col("pos") + 1).alias("depth"), "len", "words",
                    F.when(there, F.xxhash64("pos", "h1", "h2")).otherwise(0).alias("x1"),
                    F.when(there, F.xxhash64("h2", "h1", "pos")).otherwise(0).alias("x2"))
    w = _upto(["conv_id", "range_id"], "depth")
    local = (x.withColumn("p1", F.bit_xor("x1").over(w)).withColumn("p2", F.bit_xor("x2").over(w))
             .withColumn("upto", F.sum("words").over(w)))
    before = Window.partitionBy("conv_id").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy("conv_id", "range_id").agg(
        F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.sum("words").alias("sw"))
    offsets = sums.select("conv_id", "range_id", *[
        F.coalesce(f(c).over(before), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "s1"), (F.bit_xor, "s2"), (F.sum, "sw"))])
    joined = local.join(offsets, ["conv_id", "range_id"])
    return cut_lineage(joined.select(
        "conv_id", "depth", "len", "x1", "x2", F.col("p1").bitwiseXOR(F.col("s1")).alias("p1"),
        F.col("p2").bitwiseXOR(F.col("s2")).alias("p2"), "words", (F.col("upto") + F.col("sw")).alias("upto")), "trie_rows")


def burst(rows: DataFrame, limit: int) -> DataFrame:
    """The trie heads (p1, p2): prefixes whose containers hold more than `limit` turns and members."""
    heads, inside, depth, step = [], rows, -1, 1
    while True:
        level = inside.where((F.col("depth") > depth) & (F.col("depth") <= depth + step))
        sizes = level.groupBy("depth", *KEY).agg(F.sum(F.col("len") - F.col("depth") + 1).alias("size"))
        found = cut_lineage(sizes.where(F.col("size") > limit).select("depth", *KEY), "trie_heads")
        depth += step
        heads.append(found)
        last = found.where(F.col("depth") == depth).select(*KEY)
        if last.isEmpty():
            break
        # Whoever is in an oversized container of the last level goes on to the next ones.
        open_convs = join_checked(rows.where(F.col("depth") == depth), last, KEY, "left_semi").select("conv_id")
        inside = rows.where(F.col("depth") > depth).join(cut_lineage(open_convs, "trie_open"), "conv_id", "left_semi")
        step *= 2
    every = heads[0]
    for more in heads[1:]:
        every = every.unionByName(more)
    return cut_lineage(every.select(*KEY), "trie_heads")


def _ends(conv_ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(conv_ids))).encode()).hexdigest() if conv_ids else NO_END


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, q1 long, q2 long")
_NAMES = [c.split()[0] for c in NODE.split(", ")]
_ARROW = pa.schema([(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in _NAMES])


class _Node:
    __slots__ = ("parent", "depth", "words", "least", "members", "children", "leaves", "saved", "ends")

    def __init__(self, parent: _Node | None, depth: int, words: int) -> None:
        self.parent, self.depth, self.words = parent, depth, words
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []


def _finished(nodes: list[_Node], parent_key: tuple[int, int]) -> Iterator[tuple]:
    """Rows of one container's nodes, given in the order in which they were met."""
    for node in reversed(nodes):
        node.leaves = node.leaves or 1
        node.saved += (node.members - 1) * node.words
        if node.parent is not None:
            node.parent.children += 1
            node.parent.leaves += node.leaves
            node.parent.saved += node.saved
    for node in nodes:
        above = (None if node.parent is None else node.parent.least,)
        key = parent_key if node.parent is None and node.depth else (None, None)
        yield (node.least, node.depth, *above, node.members, node.children, node.leaves, node.saved, _ends(node.ends), *key)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose members come sorted: one open path, branched where a suffix leaves the one before."""
    nodes: list[_Node] = []
    path: list[_Node] = []
    seen: list[tuple[int, int]] = []
    container = parent_key = None
    made: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id", "depth", "steps", "words")]
        for k1, k2, conv, depth, steps, words in zip(*columns):
            turns = [(s["x1"], s["x2"]) for s in steps]
            if (k1, k2) != container:
                made.extend(_finished(nodes, parent_key))
                nodes, path, seen, container = [], [], [], (k1, k2)
                parent_key = (k1 ^ turns[0][0], k2 ^ turns[0][1])
            common = 0
            for a, b in zip(seen, turns):
                if a != b:
                    break
                common += 1
            del path[common:]
            for i in range(common, len(turns)):
                path.append(_Node(path[-1] if path else None, depth + i, words[i]))
                nodes.append(path[-1])
            for node in path:
                node.members += 1
                node.least = conv if node.least is None or conv < node.least else node.least
            path[-1].ends.append(conv)
            seen = turns
        if len(made) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _ARROW)], schema=_ARROW)
            made = []
    made.extend(_finished(nodes, parent_key))
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _ARROW)], schema=_ARROW)


def swept(rows: DataFrame) -> DataFrame:
    """The nodes of the containers; `rows` holds no head."""
    step = F.struct("depth", "x1", "x2", *KEY, "words")
    # No conversation has more than `limit` rows below the heads.
    members = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("m"))
    members = members.select(
        F.col("m")[0]["p1"].alias("k1"), F.col("m")[0]["p2"].alias("k2"), "conv_id", F.col("m")[0]["depth"].alias("depth"),
        F.transform("m", lambda s: F.struct(s["x1"].alias("x1"), s["x2"].alias("x2"))).alias("steps"),
        F.col("m.words").alias("words"))
    return members.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "steps", "conv_id").mapInArrow(sweep, NODE)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (p1, p2, conv_id) as runs of ids joined by commas."""
    for batch in batches:
        keys, runs = list(zip(*(batch.column(c).to_pylist() for c in KEY))), []
        for key, conv in zip(keys, batch.column("conv_id").to_pylist()):
            if runs and runs[-1][0] == key:
                runs[-1][1].append(conv)
            else:
                runs.append((key, [conv]))
        yield pa.RecordBatch.from_pydict({
            "p1": [k[0] for k, _ in runs], "p2": [k[1] for k, _ in runs], "first": [ids[0] for _, ids in runs],
            "ids": [",".join(map(str, ids)) for _, ids in runs]})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal keys; the state of the last one is carried from batch to batch."""
    now, digest = None, None
    for batch in batches:
        done = []
        for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids"))):
            if (p1, p2) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (p1, p2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip((*KEY, "ends"), map(list, zip(*done)))))
    if now is not None:
        yield pa.RecordBatch.from_pydict({"p1": [now[0]], "p2": [now[1]], "ends": [digest.hexdigest()]})


def ends_of(ended: DataFrame) -> DataFrame:
    """p1, p2, ends: digest of the ids of `ended` (p1, p2, conv_id) under each prefix, in numeric order.

    Ids are joined in ranges side by side; the digest of a prefix, which has to be
    taken in one go, then reads few long strings one after the other.
    """
    order = [*KEY, "conv_id"]
    chunks = (ended.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(_chunks, "p1 long, p2 long, first long, ids string"))
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "p1 long, p2 long, ends string")


def _zero(column: str) -> Column:
    return F.coalesce(column, F.lit(0).cast("long"))


def head_nodes(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of the heads, with their keys; `rows` holds the heads' members, `tops` the containers' first nodes.

    A conversation is the least member of a node from some depth on. What it adds
    to `saved_tokens` of a head are its words from there up to that depth, or to
    the container it goes to; sums and leaves of a container are added by its least
    member.
    """
    parent = [F.col(p).bitwiseXOR(F.col(x)).alias(q) for p, x, q in (("p1", "x1", "q1"), ("p2", "x2", "q2"))]
    stats = cut_lineage(rows.groupBy("depth", *KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        F.max("x1").alias("x1"), F.max("x2").alias("x2")).select(
        "depth", *KEY, "n_convs", "conv_id", "words", *parent), "trie_stats")
    below = stats.where(F.col("depth") > 0).select("q1", "q2").unionByName(tops.select("q1", "q2"))
    children = below.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(stats.join(children, KEY, "left").withColumn("n_children", _zero("n_children")), "trie_stats")

    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("owns"),
                                         F.sum((F.col("n_children") == 0).cast("long")).alias("end_leaf"))
    at_owned = rows.select("conv_id", (F.col("depth")).alias("owns"), (F.col("upto") - F.col("words")).alias("before_owned"))
    owned = owned.join(at_owned, ["conv_id", "owns"]).drop("owns")
    all_words = rows.groupBy("conv_id").agg(F.max("upto").alias("all_words"))
    container = tops.select("conv_id", F.col("saved_tokens").alias("extra"), F.col("n_leaves").alias("extra_leaves"))
    convs = cut_lineage(all_words.join(owned, "conv_id", "left").join(container, "conv_id", "left").select(
        "conv_id", F.coalesce("before_owned", "all_words").alias("until"), _zero("extra").alias("extra"),
        (_zero("extra_leaves") + _zero("end_leaf")).alias("leaves")), "trie_members")
    gain = F.greatest(F.col("until") - (F.col("upto") - F.col("words")), F.lit(0)) + F.col("extra")
    sums = rows.join(convs, "conv_id").groupBy(*KEY).agg(
        F.sum(gain).alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = ends_of(rows.where(F.col("depth") == F.col("len")))
    return nodes.join(sums, KEY).join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_END)))


def trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of all conversations of `turns` (conv_id, turn, role, text) after they share first turns.

    Result: conv_id (least member), depth, parent_conv_id (the parent's, null for
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256; see
    `shared` for how a conversation is rebuilt. `limit` is the size of a container
    and changes nothing in the result.

    A null turn comes first, equal turns are ordered by role, then text, so repeated
    rows follow each other as turns of their own. A null role or text is empty.
    Rows without a conversation are left out; a conversation that is left without
    any turn is a member of the root alone. An empty table gives no node; other
    columns are ignored.
    """
    rows = prefixes(shared(own_turns(ordered(turns))))
    heads = burst(rows, limit)
    flagged = join_checked(rows, heads.withColumn("head", F.lit(True)), KEY, "left")
    stored = cut_lineage(flagged.withColumn("head", F.coalesce("head", F.lit(False))), "trie_parts", "head")
    inner = cut_lineage(swept(stored.where(~F.col("head"))), "trie_nodes")
    tops = inner.where(F.col("q1").isNotNull())
    outer = cut_lineage(head_nodes(stored.where("head"), tops), "trie_outer")
    parents = outer.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"))
    columns = [c for c in _NAMES if c not in ("q1", "q2")]
    hung = join_checked(tops.drop("parent_conv_id"), parents, ["q1", "q2"], "left").withColumnRenamed("above", "parent_conv_id")
    rooted = F.when(F.col("depth") > 0, F.col("above")).alias("parent_conv_id")
    upper = join_checked(outer, parents, ["q1", "q2"], "left").select(
        *[rooted if c == "parent_conv_id" else F.col(c) for c in columns])
    return inner.where(F.col("q1").isNull()).select(columns).unionByName(hung.select(columns)).unionByName(upper)


SQL = r"""
WITH clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, {'role': role, 'text': text} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM clean),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
           lambda crc, byte: list_reduce(range(8), lambda c, i:
             CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, xor(crc, byte)),
           4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM clean)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.t FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.t FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
seqs AS (
  SELECT c.conv_id, coalesce(list(r.t ORDER BY r.part, r.pos) FILTER (r.t IS NOT NULL), []) AS seq
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
members AS (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS depth FROM seqs),
nodes AS (
  SELECT list_slice(seq, 1, depth) AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth), '') AS ends
  FROM members GROUP BY ALL),
hung AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) *
           len(regexp_extract_all(n.prefix[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)),
children AS (
  SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT h.*, coalesce(c.n_children, 0) AS n_children FROM hung h LEFT JOIN children c USING (prefix)),
above AS (SELECT prefix, saved, n_children, unnest(range(depth + 1)) AS k FROM counted),
subtrees AS (
  SELECT list_slice(prefix, 1, k) AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM above GROUP BY 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM counted JOIN subtrees USING (prefix)
"""
