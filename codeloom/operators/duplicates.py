"""Similar blocks of lines inside a file.

A block is `n` consecutive lines (fewer at the end of a file), normalised. A
line is reported when some later, non-overlapping block of the same file is
similar enough to the one that starts there.

How this stays feasible without leaving out a pair:

* a file is cut into tiles of lines; a row is a pair of its tiles, so a very
  long file becomes many bounded rows, dealt over all tasks;
* a block that occurs again, letter by letter, needs no comparison;
* two exact lower bounds of the edit distance run before it: the difference
  in length, and the difference in how often each of some characters occurs;
* the distances of many pairs are computed side by side, in a band as wide as
  the distance allowed, and a block is through at its first partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.functions.arrow import in_pieces
from codeloom.functions.python_source import parsed
from codeloom.operators.smells import SMELL_COLUMNS, smell_struct
from codeloom.settings import Thresholds

# Characters counted, in fields of up to 16; frequent ones have two fields. Any
# choice without the blank gives a valid bound (lines are joined by blanks that
# the counts do not see); this one separates code well.
FREQUENT = "aeinorst_"
COUNTED = FREQUENT + "bcdfghjklmpquvwxyz0123456789=().,:\"'[]"
FIELD = 16
TILE = 2048
PIECE_BYTES = 1 << 21
PAIRS = 1 << 18  # compared by their bounds at once, and gathered for the distances
CELLS = 1 << 19  # of a band, for one step of the distances
CUT = 12  # steps after which pairs that are too far apart already are left out


def block_counts(lines: list[str], ends: np.ndarray, n: int) -> np.ndarray:
    """For each line the character counts of the block starting there; its segment ends before line `ends`.

    A count is a run of one-bits. The number of bits in which two blocks
    differ is the sum of the differences of their counts; a run cut at its
    width can only lower it.
    """
    other, newline = len(COUNTED), len(COUNTED) + 1
    kind = np.full(256, other, dtype=np.int64)
    kind[np.frombuffer(COUNTED.encode(), dtype=np.uint8)] = np.arange(len(COUNTED))
    kind[ord("\n")] = newline
    height, width = len(lines), newline + 1
    data = np.frombuffer("\n".join(lines).encode("utf-8"), dtype=np.uint8)
    row = np.cumsum(data == ord("\n"))
    upto = np.zeros((height + 1, width), dtype=np.int32)
    cells = np.bincount(row * width + kind[data], minlength=height * width)
    np.cumsum(cells.reshape(height, width), axis=0, out=upto[1:])
    first = np.arange(height)
    counts = (upto[np.minimum(first + n, ends)] - upto[first])[:, :other]
    fields = np.zeros((height, -(-(other + len(FREQUENT)) // 4) * 4), dtype=np.int32)
    fields[:, :other] = counts
    fields[:, other:other + len(FREQUENT)] = counts[:, :len(FREQUENT)] - FIELD
    runs = ((1 << np.arange(FIELD + 1)) - 1).astype(np.uint16)
    return runs[np.clip(fields, 0, FIELD)].view(np.uint64)


def distances(texts: list[str], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Edit distances of the pairs texts[a], texts[b], exact where it is at most `most`, else above it.

    The table of a pair is filled by its anti-diagonals, those of many pairs of
    like length together, and only so far off the main diagonal as `most` asks for.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    if not len(codes) or codes.max() < 256:
        codes = codes.astype(np.uint8)
    total = lengths[a] + lengths[b]
    order = np.argsort(total, kind="stable")
    found = np.empty(len(a), dtype=np.int64)
    total = total[order]
    at = 0
    while at < len(order):
        # Pairs of up to a quarter more length share a table.
        stop = int(np.searchsorted(total, total[at] * 5 // 4 + 8, side="right"))
        widest = int(most[order[at:stop]].max())
        stop = min(stop, at + max(1, CELLS // (2 * widest + 3)))
        taken = order[at:stop]
        found[taken] = _band(codes, starts, lengths, a[taken], b[taken], most[taken])
        at = stop
    return found


def _band(codes, starts, lengths, a, b, most) -> np.ndarray:
    """Distances of pairs in ascending order of their total length."""
    total, ends = lengths[a] + lengths[b], lengths[a] - lengths[b]
    last, widest = int(total[-1]), int(most.max())
    kind, far = (np.uint8, 254) if last < 250 else (np.uint16, 65534) if last < 65000 else (np.uint32, 2**32 - 2)

    def table(which):
        """Characters by place and pair; what lies behind a text is never part of its result."""
        place = np.arange(int(lengths[which].max()) + 1)[:, None] + starts[which][None, :]
        return codes[np.minimum(place, len(codes) - 1)]

    left, right = table(a), table(b)
    result = most + 1
    pair = np.arange(len(a))
    # Row c + widest + 1 holds the cell (i, j) with i - j = c of the latest anti-diagonal that has one.
    band = np.full((2 * widest + 3, len(a)), far, dtype=kind)
    band[widest + 1] = 0
    done = 0
    for step in range(last + 1):
        reach = min(step, widest)
        low = -reach + (reach + step) % 2
        # Only cells whose places exist: i = (step + c) / 2 and j = (step - c) / 2.
        low = max(low, step - 2 * (len(right) - 1))
        high = min(reach - (reach + step) % 2, 2 * (len(left) - 1) - step)
        if step and low <= high:
            i, j = (step + low) // 2, (step - low) // 2
            cells = (high - low) // 2 + 1
            rows = slice(low + widest + 1, high + widest + 2, 2)
            below = band[low + widest:high + widest + 1:2, done:]
            above = band[low + widest + 2:high + widest + 3:2, done:]
            best = np.minimum(below, above)
            best += kind(1)
            # The cell before on the same diagonal, where there is one, plus one for another character.
            skip, cut = int(i == 0), int(j - cells + 1 == 0)
            inner = slice(low + 2 * skip + widest + 1, high - 2 * cut + widest + 2, 2)
            if cells - skip - cut > 0:
                x = left[i + skip - 1:i + cells - cut - 1, done:]
                behind = j - cells + cut  # place of the last one's character
                y = right[behind:j - skip, done:][::-1]
                same = band[inner, done:] + (x != y).view(np.uint8)
                np.minimum(best[skip:cells - cut], same, out=best[skip:cells - cut])
            band[rows, done:] = best
        upto = int(np.searchsorted(total, step, side="right"))
        if upto > done:
            ready = np.arange(done, upto)
            result[pair[ready]] = band[ends[ready] + widest + 1, ready]
            done = upto
        if step % CUT == 0 and step > widest and done < len(pair):
            # Whatever comes goes through one of the latest two anti-diagonals, and they only grow.
            open_ = done + np.flatnonzero(band[:, done:].min(axis=0) <= most[done:])
            if 4 * len(open_) < 3 * (len(pair) - done):
                left, right, band = left[:, open_], right[:, open_], band[:, open_]
                pair, total, ends, most, done = pair[open_], total[open_], ends[open_], most[open_], 0
            if not len(pair):
                break
    return result


def _candidates(length, counts, place, n: int, similarity: float, left: range, right: range) -> Iterator[tuple]:
    """Pairs of blocks, left before right, that the bounds cannot tell apart, by ascending left block."""
    b = np.arange(right.start, right.stop)
    rows = max(1, PAIRS // max(1, len(b)))
    for start in range(left.start, left.stop, rows):
        a = np.arange(start, min(start + rows, left.stop))
        ahead = b[np.searchsorted(place[b], place[a[0]] + n):]
        longest = np.maximum(length[a][:, None], length[ahead])
        allowed = np.floor(longest * (1 - similarity) + 1e-6).astype(np.int32)
        apart = np.abs(length[a][:, None] - length[ahead])
        x, y = np.nonzero((apart <= allowed) & (place[ahead] >= place[a][:, None] + n))
        # An edit that keeps the length changes two counts by one, any other edit changes one.
        spare = 2 * allowed[x, y] - apart[x, y]
        x, y = a[x], ahead[y]
        bits = np.zeros(len(x), dtype=np.int32)
        for word in range(counts.shape[1]):
            bits += np.bitwise_count(counts[x, word] ^ counts[y, word])
            if word % 5 == 4 or word == counts.shape[1] - 1:
                near = bits <= spare
                x, y, bits, spare = x[near], y[near], bits[near], spare[near]
        yield x, y


def _similar_to_later(rows: list[tuple], n: int, similarity: float, tile: int) -> list[list[int]]:
    """For each row (left tile's lines, right tile's or None, numbers of both tiles) the lines that are hits."""
    segments, ends, lines = [], [], []
    for first, second, one, two in rows:
        for number, content in ((first, one), (second, two)):
            if content is not None:
                bare = [line.strip() for line in content.split("\n")]
                segments.append((len(lines), len(bare), number * tile))
                lines += ["" if line.startswith("#") else line for line in bare]
                ends += [len(lines)] * len(bare)
    counts = block_counts(lines, np.array(ends, dtype=np.int64), n)
    # The blocks that are not empty, numbered through; those of a segment in a row.
    blocks, texts, place, spans = [], [], [], []
    for start, height, offset in segments:
        begin = len(blocks)
        for i in range(min(height, tile)):
            block = " ".join([line for line in lines[start + i:min(start + i + n, start + height)] if line])
            if block:
                blocks.append(start + i)
                texts.append(block)
                place.append(offset + i)
        spans.append(range(begin, len(blocks)))
    place = np.array(place, dtype=np.int64)
    length = np.array([len(t) for t in texts], dtype=np.int32)
    counts = counts[np.array(blocks, dtype=np.int64)]
    hit = np.zeros(len(blocks), dtype=bool)
    waiting: list[tuple] = []

    def settle():
        """Compare the pairs that wait; a block's further partners only if the ones before are none."""
        a, b = (np.concatenate(p) for p in zip(*waiting))
        waiting.clear()
        take = 16
        while len(a):
            new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            rank = np.arange(len(a)) - np.repeat(new, np.diff(np.append(new, len(a))))
            now = rank < take
            x, y = a[now], b[now]
            used, inverse = np.unique(np.concatenate([x, y]), return_inverse=True)
            longest = np.maximum(length[x], length[y])
            allowed = np.floor(longest * (1 - similarity) + 1e-6).astype(np.int64)
            apart = distances([texts[u] for u in used], inverse[:len(x)], inverse[len(x):], allowed)
            hit[x[(apart <= allowed) & (1.0 - apart / longest >= similarity)]] = True
            rest = ~now & ~hit[a]
            a, b, take = a[rest], b[rest], take * 8

    lefts, used = [], 0
    pairs = 0
    for _, _, _, two in rows:
        left, right = spans[used], spans[used + (two is not None)]
        used += 1 + (two is not None)
        lefts.append(left)
        latest = {texts[k]: place[k] for k in right}
        for k in left:
            hit[k] = latest.get(texts[k], -1) >= place[k] + n
        for a, b in _candidates(length, counts, place, n, similarity, left, right):
            open_ = ~hit[a]
            waiting.append((a[open_], b[open_]))
            pairs += int(open_.sum())
            if pairs > PAIRS:
                settle()
                pairs = 0
    if waiting:
        settle()
    return [place[left.start:left.stop][hit[left.start:left.stop]].tolist() for left in lefts]


def duplicate_lines(files: DataFrame, limits: Thresholds = Thresholds(), tile: int = TILE) -> DataFrame:
    """Path and line of every block with a similar later block."""
    n, similarity = limits.min_duplicate_lines, limits.min_similarity
    # Comparing costs far more than moving, so the parts are asked for by
    # number: AQE would merge them by size and leave the work to few tasks.
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    python = files.filter(F.col("ext") == ".py").select(
        "project", "path", "content", parsed(files).alias("parsed"))
    content = F.when(F.col("parsed"), F.col("content"))
    tiles = F.floor(text.newline_count(F.col("content")) / tile).cast("int")
    numbers = F.flatten(F.transform(F.sequence(F.lit(0), tiles), lambda a: F.transform(
        F.sequence(a, tiles), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    paired = python.withColumns({"content": content, "tiles": tiles}).select(
        "project", "path", "content", "tiles", F.explode(numbers).alias("t"))

    def lines_of_tile(number: str):
        some = F.slice(text.lines_of(F.col("content")), F.col(number) * tile + 1, F.lit(tile + n - 1))
        return F.when(F.col("tiles") == 0, F.col("content")).otherwise(F.array_join(some, "\n"))

    dealt = paired.select("project", "path", "content", "tiles", "t.*").select(
        "project", "path", "first", "second", lines_of_tile("first").alias("one"),
        F.when(F.col("first") < F.col("second"), lines_of_tile("second")).alias("two"),
    ).repartition(parts, "project", "path", "first", "second")

    def search(batches):
        for batch in batches:
            for piece in in_pieces(batch, ["one", "two"], PIECE_BYTES):
                given = piece.to_pydict()
                hits = _similar_to_later(
                    list(zip(given["first"], given["second"], given["one"], given["two"])), n, similarity, tile)
                at = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
                yield pa.RecordBatch.from_arrays([
                    piece.column("project").take(pa.array(at)), piece.column("path").take(pa.array(at)),
                    pa.array([i + 1 for h in hits for i in h], pa.int32()),
                ], ["project", "path", "line"])
            batch = piece = given = None
            pa.default_memory_pool().release_unused()

    kinds = {c: dealt.schema[c].dataType.simpleString() for c in ("project", "path")}
    found = dealt.mapInArrow(search, f"project {kinds['project']}, path {kinds['path']}, line int")
    return found.distinct()  # several pairs of tiles may find the same line


def duplicate_smells(files: DataFrame, limits: Thresholds = Thresholds(), tile: int = TILE) -> DataFrame:
    n = limits.min_duplicate_lines
    lines = duplicate_lines(files, limits, tile)
    smell = smell_struct("duplicate_code", F.col("line"), F.col("line") + (n - 1))
    return lines.withColumn("s", smell).select("project", "path", "line", "s.*").select(SMELL_COLUMNS)
