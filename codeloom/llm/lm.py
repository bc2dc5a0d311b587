"""Language-model scores by a log-bilinear neural model of two levels.

Tokens are lower-cased words and one end per text. The most frequent words are
outputs of their own; all others fall into classes by spelling (first letter,
letters beyond ASCII, closing punctuation), so that outputs stay few and every
word has a probability: that of its class in its context, times its smoothed
share among the class's words. The context is a few previous outputs. Each
context place has a table of vectors; their sum is compared with the vectors of
groups of outputs, and with those of the outputs of the target's group. Groups
hold outputs of like frequency. Both soft maxima are exact, each over some sixty
scores from one matrix product.

Word counts cover all training texts. The vectors are trained by noise
contrastive estimation on both levels, in rounds that share the training texts
among them: in each, every task starts from the same vectors and goes through its
part of the round's texts, and the results are averaged by their number of
examples. Every training text gives its examples once. What a task goes through
depends on the input splits, and scores change with it in the third digit or so.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.text import in_pieces, row_wise, word_table
from codeloom.session import cut_lineage

FIRST, MARKED, CLOSED = 28, 2, 2
CLASSES = FIRST * MARKED * CLOSED
# By a word's first byte and by its last.
_FIRST = np.array([b - 97 if 97 <= b <= 122 else 26 if b < 128 else 27 for b in range(256)], np.int32)
_CLOSING = np.array([b in b".,;:!?" for b in range(256)])
ROWS = ("doc_id long, held_out boolean, n_tokens long, known long, logs double, model double, "
        "tail_words array<string>, tail_classes array<int>, tail_counts array<long>")


@dataclass(frozen=True)
class Settings:
    """Sizes of the model and of its training.

    `head` bounds the words whose counts are sent to the executors; counts of
    all other words are joined.
    """

    words: int = 3983  # with the classes and the end 64 groups
    head: int = 60_000
    places: int = 4
    size: int = 24
    members: int = 64
    noise: int = 16
    batch: int = 1024
    shares: tuple[int, ...] = (1, 3, 12)  # of the training texts, by round
    rate: float = 0.07
    seed: int = 11

    @property
    def outputs(self) -> int:
        return self.words + CLASSES + 1

    @property
    def end(self) -> int:
        """Output of the end; as context it stands for what is before a text."""
        return self.outputs - 1


def spelling_classes(words: pa.Array) -> np.ndarray:
    """The class of each word by its spelling; no word is empty."""
    if not len(words):
        return np.empty(0, np.int32)
    marked = ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    wide = words.cast(pa.large_string())
    _, ends, data = wide.buffers()
    ends = np.frombuffer(ends, np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = np.frombuffer(data, np.uint8)
    return ((_FIRST[data[ends[:-1]]] * MARKED + marked) * CLOSED + _CLOSING[data[ends[1:] - 1]]).astype(np.int32)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, cls, n over all `texts` (text); summed per batch before it is shuffled."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, words, _ = word_table(batch.column("text"))
        sums = np.bincount(codes, minlength=len(words)).astype(np.int64) if len(codes) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([words, pa.array(spelling_classes(words)), pa.array(sums)],
                                          names=["word", "cls", "n"])

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(
        row_wise(count), "word string, cls int, n long")
    return parts.groupBy("word", "cls").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What the executors need to know of the counts."""

    settings: Settings
    head: pa.Array  # frequent words, most frequent first
    head_counts: np.ndarray
    class_tokens: np.ndarray  # per class, without the words that are outputs
    class_words: np.ndarray
    texts: int
    tokens: int
    distinct: int

    @property
    def own(self) -> int:
        """Words that are outputs of their own."""
        return min(self.settings.words, len(self.head))

    def shares(self) -> np.ndarray:
        """Smoothed shares of the outputs in the training texts."""
        counts = np.ones(self.settings.outputs)
        counts[:self.own] += self.head_counts[:self.own]
        counts[self.settings.words:self.settings.end] += self.class_tokens
        counts[self.settings.end] += self.texts
        return counts / counts.sum()

    def outputs_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Output and place in `head` (or -1) of each word."""
        place = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False)
        classes = self.settings.words + spelling_classes(words)
        return np.where((place >= 0) & (place < self.own), place, classes).astype(np.int32), place

    def class_base(self) -> np.ndarray:
        """Denominator of a word's share of its class, one unseen word included."""
        return self.class_tokens + self.class_words + 1.0


def learn_vocabulary(counts: DataFrame, texts: int, settings: Settings) -> Vocabulary:
    """The frequent words and the class sums of stored `counts`.

    The head is all words above a count, found from a histogram of a few hundred
    rows, so that no more than `settings.head` words reach the driver.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    table = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for at, number in table:
        total += number
        if total > settings.head:
            break
        least = at
    rows = [] if least is None else counts.where(step >= least).select("word", "cls", "n").collect()
    rows = sorted(((-r["n"], r["word"], r["cls"]) for r in rows))
    settings = replace(settings, words=min(settings.words, len(rows)))
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["cls"]], words[r["cls"]] = r["n"], r["v"]
    n_words, distinct = int(tokens.sum()), int(words.sum())
    for n, _, cls in rows[:settings.words]:
        tokens[cls] += n
        words[cls] -= 1
    return Vocabulary(settings, pa.array([w for _, w, _ in rows], pa.string()),
                      np.array([-n for n, _, _ in rows], dtype=np.int64), tokens, words,
                      texts, n_words + texts, distinct + (texts > 0))


def windows(codes: np.ndarray, counts: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all tokens with ends, and their contexts: one column per place before the token."""
    places, texts = settings.places, len(counts)
    width = counts + places + 1
    starts = np.cumsum(width) - width
    line = np.full(int(width.sum()), settings.end, np.int32)
    owner = np.repeat(np.arange(texts), counts)
    line[np.arange(len(codes)) + (owner + 1) * places + owner] = codes
    token = np.arange(int(counts.sum()) + texts) + np.repeat(np.arange(texts) + 1, counts + 1) * places
    assert len(token) == 0 or token[-1] == starts[-1] + width[-1] - 1
    return line[token], np.stack([line[token - k] for k in range(1, places + 1)], axis=1)


class Groups:
    """Outputs in groups of like frequency, and noise drawn by frequency from the groups and within them.

    An output has a slot: its group times `members`, plus its place there. Slots
    without an output have no share.
    """

    drawn = 1 << 12  # prepared draws of each kind

    def __init__(self, shares: np.ndarray, members: int, seed: int = 0):
        self.members = members
        self.count = -(-len(shares) // members)
        self.slot = np.empty(len(shares), np.int32)
        self.slot[np.argsort(-shares, kind="stable")] = np.arange(len(shares))
        share = np.zeros(self.count * members)
        share[self.slot] = shares
        share = share.reshape(self.count, members)
        total = share.sum(axis=1)
        within = share / total[:, None]
        with np.errstate(divide="ignore"):
            self.log_groups = np.log(total / total.sum()).astype(np.float32)
            self.log_members = np.maximum(np.log(within), -1e9).astype(np.float32).ravel()
        draw = np.random.default_rng(seed)
        self.group_draws = draw.choice(self.count, self.drawn, p=total / total.sum())
        self.member_draws = np.stack([g * members + draw.choice(members, self.drawn, p=p) for g, p in enumerate(within)])

    def runs(self, slots: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
        """The places of `slots` by group, in order and at most so many together."""
        group = slots // self.members
        if self.count <= 1 << 16:  # numpy sorts short integers by their digits
            group = group.astype(np.uint16)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=self.count)).tolist()
        return [(g, order[at:min(at + most, end)]) for g, (first, end) in enumerate(zip([0, *ends], ends))
                for at in range(first, end, most)]


def _summed(rows: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct `rows`, all below `size`, and the sums of the values at each; `values` repeat as often as rows are longer."""
    seen = np.zeros(size, bool)
    seen[rows] = True
    found = np.flatnonzero(seen)
    rank = np.empty(size, np.intp)
    rank[found] = np.arange(len(found))
    return found, _added(rank.take(rows), np.tile(values, (len(rows) // max(len(values), 1), 1)), len(found))


def _added(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values at each of `size` rows; two neighbouring columns are added at once, as a complex number."""
    values = np.ascontiguousarray(values, np.float32)
    columns = values.shape[1]
    if columns % 2 == 0:
        values = values.view(np.complex64)
    sums = np.zeros((size, values.shape[1]), values.dtype)
    cells = np.arange(sums.size).reshape(sums.shape).take(rows, axis=0)
    np.add.at(sums.reshape(-1), cells.ravel(), values.ravel())
    return sums.view(np.float32).reshape(size, columns)


def _step(values: np.ndarray, square: np.ndarray, moved: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
    """Adaptive step of the named rows or all; where nothing moved, nothing changes. `moved` is overwritten."""
    grown = moved * moved
    grown += square if rows is None else square.take(rows, axis=0)
    if rows is None:
        square[:] = grown
    else:
        square[rows] = grown
    np.sqrt(grown, out=grown)
    moved *= np.float32(rate)
    moved /= grown
    if rows is None:
        values += moved
    else:
        moved += values.take(rows, axis=0)
        values[rows] = moved


@dataclass
class Model:
    """Context tables (place, output, size), vectors and biases of groups and slots, in single precision."""

    groups: Groups
    context: np.ndarray
    heads: np.ndarray
    head_bias: np.ndarray
    vectors: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, shares: np.ndarray, settings: Settings) -> Model:
        """Small random vectors over the shares of the outputs."""
        groups = Groups(shares, settings.members, settings.seed)
        draw = np.random.default_rng(settings.seed)

        def small(*shape):
            return draw.normal(0, 0.1, shape).astype(np.float32)

        size = settings.size
        return cls(groups, small(settings.places, len(shares), size), small(groups.count, size), groups.log_groups.copy(),
                   small(groups.count * groups.members, size), groups.log_members.copy())

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.heads, self.head_bias, self.vectors, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, values: np.ndarray) -> Model:
        """A model of the same shape with other values."""
        ends = np.cumsum([p.size for p in self.parts()])
        values = np.split(values.astype(np.float32), ends[:-1])
        return Model(self.groups, *(v.reshape(p.shape) for v, p in zip(values, self.parts())))

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        """The vector each context expects."""
        total = self.context[0].take(contexts[:, 0], axis=0)
        for place in range(1, contexts.shape[1]):
            total += self.context[place].take(contexts[:, place], axis=0)
        return total

    def log10(self, targets: np.ndarray, contexts: np.ndarray, block: int = 1 << 20) -> np.ndarray:
        """Normalised log10 probability of each target in its context: of its group, and of it in the group."""
        found = np.empty(len(targets), np.float64)
        members = self.groups.members
        for start in range(0, len(targets), block):
            slots = self.groups.slot[targets[start:start + block]]
            for group, rows in self.groups.runs(slots, 4096):  # small enough for the processor's cache
                own = slice(group * members, (group + 1) * members)
                expected = self.predicted(contexts.take(start + rows, axis=0))
                scores = expected @ self.heads.T
                scores += self.head_bias
                logs = _log_share(scores, np.full(len(rows), group))
                scores = expected @ self.vectors[own].T
                scores += self.bias[own]
                logs += _log_share(scores, slots.take(rows) - group * members)
                found[start + rows] = logs / np.log(10)
        return found

    def train(self, targets: np.ndarray, contexts: np.ndarray, settings: Settings, rate: float, seed: int,
              squares: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """One pass of noise contrastive estimation with adaptive steps, whose memory is returned.

        A batch holds targets of one group, so that all but the context tables are
        small dense matrices; batches come in random order. Noise is shared by a batch.
        """
        groups, size, members = self.groups, settings.size, self.groups.members
        draw = np.random.default_rng(seed)
        table = self.context.reshape(-1, size)  # a view: one row per place and output
        # Biases are a last column, met by a one behind each expected vector.
        heads = np.column_stack([self.heads, self.head_bias])
        vectors = np.column_stack([self.vectors, self.bias])
        if squares is None:
            squares = [np.full(x.shape, 1e-2, np.float32) for x in (table, heads, vectors)]
        places = np.arange(settings.places, dtype=np.int32) * np.int32(self.context.shape[1])
        head_offset = np.float32(np.log(settings.noise)) + groups.log_groups
        offset = np.float32(np.log(settings.noise)) + groups.log_members
        slots = groups.slot[targets]
        mixed = draw.permutation(len(targets))
        batches = groups.runs(slots.take(mixed), settings.batch)
        noise = settings.noise
        sign = np.full((1 + 2 * noise, 1), -1, np.float32)  # noise is to be told as noise
        sign[0] = 1
        for k in draw.permutation(len(batches)):
            group, some = batches[k]
            some = mixed.take(some)
            own = slice(group * members, (group + 1) * members)
            cells = (contexts.take(some, axis=0) + places).T.astype(np.intp)
            expected = table.take(cells[0], axis=0)
            for more in cells[1:]:
                expected += table.take(more, axis=0)
            with_one = np.ones((len(some), size + 1), np.float32)
            with_one[:, :-1] = expected
            # The true group, groups as noise and members as noise, one column each.
            far = groups.group_draws[draw.integers(0, groups.drawn, noise)]
            near = groups.member_draws[group, draw.integers(0, groups.drawn, noise)]
            inner, member = vectors[own], slots.take(some) - group * members
            drawn = np.concatenate([heads[group:group + 1], heads.take(far, axis=0), vectors.take(near, axis=0)])
            drawn[0, -1] -= head_offset[group]
            drawn[1:1 + noise, -1] -= head_offset[far]
            drawn[1 + noise:, -1] -= offset[near]
            drawn *= sign
            pulls = _pulls(with_one @ drawn.T)
            # The true member.
            true = inner.take(member, axis=0)
            up = _pulls(np.einsum("ij,ij->i", with_one, true) - offset[own].take(member))[:, None]
            toward = pulls @ drawn[:, :-1]
            toward += up * true[:, :-1]
            moved = np.zeros((groups.count + members, size + 1), np.float32)
            np.add.at(moved, np.concatenate([[group], far, near - group * members + groups.count]),
                      sign * (pulls.T @ with_one))
            moved[groups.count:, :-1] += _added(member, up * expected, members)
            moved[groups.count:, -1] += np.bincount(member, up[:, 0], members)
            _step(heads, squares[1], moved[:groups.count], rate)
            _step(inner, squares[2][own], moved[groups.count:], rate)
            rows, moved = _summed(cells.ravel(), toward, len(table))
            _step(table, squares[0], moved, rate, rows)
        self.heads[:], self.head_bias[:] = heads[:, :-1], heads[:, -1]
        self.vectors[:], self.bias[:] = vectors[:, :-1], vectors[:, -1]
        return squares


def _log_share(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the chosen column's share of a row's exponentials; `scores` are overwritten."""
    own = scores.ravel().take(np.arange(len(scores)) * scores.shape[1] + chosen).astype(np.float64)
    # Mostly all rows fit single precision as they are; if not, those that do not are shifted by their maximum.
    if scores.max(initial=0) > 60 or scores[:, 0].min(initial=0) < -60:
        high = scores.max(axis=1)
        shifted = np.flatnonzero((high > 60) | (high < -60))
        scores[shifted] -= high[shifted, None]
        own[shifted] -= high[shifted]
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], np.float32))


def _pulls(scores: np.ndarray) -> np.ndarray:
    """How far outputs are from being told as what they are: one less the logistic of `scores`, which are overwritten."""
    np.clip(scores, -30, 30, out=scores)
    np.exp(scores, out=scores)
    scores += 1
    return np.divide(1, scores, out=scores)


BLOCK = 4096  # parameters in a row of what tasks send


def train(texts: DataFrame, vocabulary: Vocabulary) -> Model:
    """A model from `texts` (text), in rounds of local passes and averaging.

    The rounds have their texts by a hash of the text, each as many as the settings
    say, the first ones few; together they have all. Tasks send their vectors in
    blocks, which are added up on the executors; the driver gets one of each.
    """
    settings = vocabulary.settings
    model = Model.fresh(vocabulary.shares(), settings)
    part = F.pmod(F.xxhash64(F.lit(settings.seed), F.coalesce("text", F.lit(""))), F.lit(sum(settings.shares)))
    upto = 0
    for number, share in enumerate(settings.shares):
        start = model
        mine = texts.select(F.col("text").cast("string").alias("text")).where((part >= upto) & (part < upto + share))
        upto += share
        rate, seed = settings.rate, settings.seed + number

        def local(batches):
            own, seen, squares = start.filled(start.flat()), 0, None
            for batch in batches:
                for piece in in_pieces(batch, "text", 4 << 20):
                    codes, words, counts = word_table(piece.column("text"))
                    outputs, _ = vocabulary.outputs_of(words)
                    targets, contexts = windows(outputs[codes] if len(codes) else np.empty(0, np.int32), counts, settings)
                    squares = own.train(targets, contexts, settings, rate, seed, squares)
                    seen += len(targets)
                pa.default_memory_pool().release_unused()
            if seen:
                values = own.flat().astype(np.float64) * seen
                for at in range(0, len(values), BLOCK):
                    yield pa.RecordBatch.from_pydict(
                        {"block": [at // BLOCK], "seen": [seen], "sums": [values[at:at + BLOCK].tobytes()]})

        def added(batches):
            sums, seen = {}, {}
            for batch in batches:
                for block, n, values in zip(*(batch.column(c).to_pylist() for c in ("block", "seen", "sums"))):
                    sums[block] = sums.get(block, 0) + np.frombuffer(values)
                    seen[block] = seen.get(block, 0) + n
            for block, values in sums.items():
                yield pa.RecordBatch.from_pydict({"block": [block], "seen": [seen[block]], "sums": [values.tobytes()]})

        schema = "block long, seen long, sums binary"
        means = mine.mapInArrow(local, schema).repartition("block").mapInArrow(added, schema).collect()
        if means:
            model = model.filled(np.concatenate([np.frombuffer(r["sums"]) / r["seen"] for r in sorted(means)]))
    return model


def partial_scores(docs: DataFrame, held_out: Column, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """What a text's head words, classes and contexts give; the other words with their counts."""
    settings = vocabulary.settings

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, words, counts = word_table(batch.column("text"))
        outputs, place = vocabulary.outputs_of(words)
        n_texts = len(counts)
        targets, contexts = windows(outputs[codes] if len(codes) else np.empty(0, np.int32), counts, settings)
        owner = np.repeat(np.arange(n_texts), counts + 1)
        chances = np.bincount(owner, model.log10(targets, contexts), n_texts)
        owner = np.repeat(np.arange(n_texts), counts)
        # Per distinct word: smoothed count, share of the class for head words, whether it is in the head.
        seen = place >= 0
        smooth = np.zeros(len(words))
        smooth[seen] = np.log10(vocabulary.head_counts[place[seen]] + 1.0)
        within = np.zeros(len(words))
        classed = seen & (outputs >= settings.words)
        within[classed] = smooth[classed] - np.log10(vocabulary.class_base()[outputs[classed] - settings.words])
        if len(codes):
            logs = np.bincount(owner, smooth[codes], n_texts)
            chances += np.bincount(owner, within[codes], n_texts)
            known = np.bincount(owner, seen[codes], n_texts)
            rest = np.flatnonzero(~seen[codes])
            pairs, times = np.unique(owner[rest] * len(words) + codes[rest], return_counts=True)
        else:
            logs, known = np.zeros(n_texts), np.zeros(n_texts)
            pairs = times = np.empty(0, np.int64)
        ends = np.append(0, np.cumsum(np.bincount(pairs // max(len(words), 1), minlength=n_texts))).astype(np.int32)
        at = pairs % max(len(words), 1)
        offsets = pa.array(ends)
        trained = vocabulary.texts > 0
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(counts + 1),
             pa.array((known + trained).astype(np.int64)), pa.array(logs + np.log10(vocabulary.texts + 1.0)),
             pa.array(chances), pa.ListArray.from_arrays(offsets, words.take(pa.array(at))),
             pa.ListArray.from_arrays(offsets, pa.array((outputs[at] - settings.words).astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))],
            names=["doc_id", "held_out", "n_tokens", "known", "logs", "model", "tail_words", "tail_classes",
                   "tail_counts"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                         F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(row_wise(score, limit=4 << 20), ROWS)


def scores(docs: DataFrame, training: Column, held_out: Column, settings: Settings = Settings()) -> DataFrame:
    """Unigram and model scores for every row of `docs` (doc_id, text).

    `training` tells the rows learned from, `held_out` is carried to the result.
    Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    both log10 probabilities of the whole text with its end. A null or empty
    text is its end alone. Rows get a number of their own when they are stored,
    so repeated rows and null ids are scored as they come. Without training rows
    the unigram score is 0 and the model knows spelling classes only. An empty
    table gives an empty result; other columns are ignored.
    """
    learned = docs.where(training)
    counts = cut_lineage(word_counts(learned), "word_counts")
    vocabulary = learn_vocabulary(counts, learned.count(), settings)
    model = train(learned, vocabulary)
    rows = cut_lineage(partial_scores(docs, held_out, vocabulary, model)
                       .withColumn("row", F.monotonically_increasing_id()), "partial_scores")
    return _with_tail(rows, counts, vocabulary)


def _with_tail(rows: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add what the words outside the head give; their counts are joined, not sent."""
    sums = F.array(*[F.lit(float(np.log10(x))) for x in vocabulary.class_base()])
    tail = rows.select("row", F.explode(F.arrays_zip("tail_words", "tail_classes", "tail_counts")).alias("t")).select(
        "row", F.col("t.tail_words").alias("word"), F.col("t.tail_classes").alias("class"),
        F.col("t.tail_counts").alias("times"))
    found = tail.join(counts.select("word", "n"), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    per_row = found.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail_logs"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 1) - F.get(sums, F.col("class")))).alias("tail_model"))
    denominator = float(np.log10(vocabulary.tokens + vocabulary.distinct + 1.0))
    zero = F.lit(0.0)
    return rows.drop("tail_words", "tail_classes", "tail_counts").join(per_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("tail_logs", zero) - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("model") + F.coalesce("tail_model", zero)).alias("score"))
