"""Quality rules as a short-circuit cascade.

Every text gets the base counts. Texts that pass the base test go through the
rules in turn and leave at the first that rejects them, so the order decides
the cost but never the verdict. The order is set by a bounded sample: each rule
is timed on it, its rejections are counted, and rules are sorted by rejections
per second.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.text import row_wise

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean")
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"


class Page:
    """One text with its words; costlier views are made on first use."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode()
        self.words = self.data.split()
        self._lines: list[bytes] | None = None
        self._repeats: int | None = None

    @property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @property
    def lines(self) -> list[bytes]:
        """The lines that hold a word, exactly as written."""
        if self._lines is None:
            self._lines = [x for x in self.data.split(b"\n") if x and not x.isspace()]
        return self._lines

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @property
    def n_repeat_words(self) -> int:
        """Words inside a three-word window found twice or more."""
        if self._repeats is None:
            words = self.words
            windows = list(zip(words, words[1:], words[2:]))
            self._repeats = 0
            if len(set(windows)) < len(windows):
                often = {k for k, n in Counter(windows).items() if n > 1}
                upto = 0
                for at, window in enumerate(windows):
                    if window in often:
                        self._repeats += at + 3 - max(at, upto)
                        upto = at + 3
        return self._repeats


@dataclass(frozen=True)
class Rule:
    """A named test; `rejects` says whether a text fails it."""

    name: str
    rejects: Callable[[Page], bool]


_UPPER = re.compile(r"[A-Z]")
_LOWER = re.compile(r"[a-z]")


def standard_rules(symbol_share: float = 0.3, upper_share: float = 0.6, dup_line_share: float = 0.5,
                   least_word: float = 2.0, most_word: float = 20.0, one_word_share: float = 0.4) -> list[Rule]:
    """Rules for texts with words; every bound is a share of the text's own words, lines or letters.

    - `symbols`: more than `symbol_share` symbols per word
    - `capitals`: more than `upper_share` of the ASCII letters are capitals
    - `dup_lines`: more than `dup_line_share` of the lines repeat an earlier one
    - `word_length`: mean word length outside `least_word`..`most_word`
    - `one_word`: one word makes up more than `one_word_share` of all words
    """
    def capitals(page: Page) -> bool:
        upper = len(_UPPER.findall(page.text))
        return upper > upper_share * (upper + len(_LOWER.findall(page.text)))

    def length(page: Page) -> bool:
        mean = page.word_chars / len(page.words)
        return not least_word <= mean <= most_word

    def one_word(page: Page) -> bool:
        return Counter(page.words).most_common(1)[0][1] > one_word_share * len(page.words)

    return [
        Rule("symbols", lambda page: page.n_symbols > symbol_share * len(page.words)),
        Rule("capitals", capitals),
        Rule("dup_lines", lambda page: page.n_dup_lines > dup_line_share * len(page.lines)),
        Rule("word_length", length),
        Rule("one_word", one_word),
    ]


def base_failed(page: Page) -> bool:
    return len(page.words) < 50 or 100 * page.n_repeat_words > 50 * len(page.words)


def order_rules(rules: list[Rule], texts: list[str | None]) -> list[Rule]:
    """Rules by rejections per second on `texts`, highest first; by name where equal."""
    pages = [p for p in map(Page, texts) if not base_failed(p)]
    rated = []
    for rule in rules:
        fresh = [Page(p.text) for p in pages]
        started = time.perf_counter()
        rejected = sum(map(rule.rejects, fresh))
        cost = max(time.perf_counter() - started, 1e-9)
        rated.append((-rejected / cost, rule.name, rule))
    return [rule for _, _, rule in sorted(rated, key=lambda x: x[:2])]


def sampled_texts(docs: DataFrame, rows: int) -> list[str | None]:
    """At most `rows` texts for timing: a Bernoulli draw at twice the needed rate, then a limit."""
    total = docs.count()
    if not total:
        return []
    share = min(1.0, 2 * rows / total)
    picked = docs.select("text").where(F.length("text") < 100_000)
    return [r[0] for r in picked.sample(fraction=share, seed=7).limit(rows).collect()]


def quality(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 300) -> DataFrame:
    """Base counts, base test and verdict for every row of `docs` (doc_id, text).

    `sample_rows` bounds the rows used to order the rules; they change the cost
    only. A null or empty text has no words: all counts are 0, `base_failed` is
    true and `kept` false. Rows are independent, so repeated rows and null ids
    are answered as they come; an empty table gives an empty result, and other
    columns are ignored.
    """
    cascade = order_rules(rules or standard_rules(), sampled_texts(docs, sample_rows))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        def rows() -> Iterator[tuple]:
            for text in batch.column("text").to_pylist():
                page = Page(text)
                failed = base_failed(page)
                kept = not failed and not any(rule.rejects(page) for rule in cascade)
                yield (len(page.words), page.word_chars, page.n_symbols, page.n_dup_lines,
                       page.n_repeat_words, failed, kept)

        columns = list(zip(*rows()))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "kept"]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(row_wise(judge), SCHEMA)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows),
inside AS (SELECT doc_id, count(*) AS n_repeat_words
           FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often WHERE n > 1) GROUP BY doc_id),
most AS (SELECT doc_id, max(n) AS top FROM (
           SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id, x)
         GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(ls) AS n_lines, coalesce(top, 0) AS top, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_letters,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
  FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN most USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
         AND NOT n_symbols > 0.3::DOUBLE * n_words AND NOT upper_letters > 0.6::DOUBLE * letters
         AND NOT n_dup_lines > 0.5::DOUBLE * n_lines AND NOT top > 0.4::DOUBLE * n_words
         AND word_chars / n_words BETWEEN 2 AND 20 AS kept
FROM based
"""
