"""Personal data, plain and disguised, with spans in the source text.

Plain identifiers are matched in the text as it stands. Then transducers
rewrite disguises (look-alike letters, digits of other scripts, spelled digits,
`at` and `dot` in words) piece by piece and note for every rewritten piece which
source characters it came from. The same detectors run over the rewritten text,
and their spans are mapped back through those notes.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.text import row_wise

SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
          "spans string, n_disguised long")
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A number starts where no digit stands before it: a start inside a number fails whenever its head does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, str, int]  # start, kind, end


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each `@`, so that long runs of letters are read once."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end()))
            free = match.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    return found


def small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def plain_spans(text: str) -> list[Span]:
    """Spans of plain identifiers by start, then kind in the order of `KINDS`."""
    spans = [(start, kind, end) for kind in KINDS for start, end in DETECTORS[kind](text)]
    return sorted(spans, key=lambda x: x[0])


# ---- fixed values: look-alike letters and what they pass for
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B",
    "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "У": "Y", "Х": "X", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t",
    "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "。": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
# ---- fixed values: spelled digits
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
# ---- end of fixed values

_ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def _passes_for(char: str) -> str | None:
    """What one source character is rewritten to; None if it stays."""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if char in _ZERO_WIDTH:
        return ""
    digit = unicodedata.digit(char, None)
    if digit is not None and char > "\x7f":
        return str(digit)
    wide = unicodedata.normalize("NFKC", char)
    return wide if wide != char and len(wide) == 1 and wide.isascii() else None


_ODD = re.compile(r"[^\x00-\u024f\u0300-\u036f]|[\xa0\xad\xb2\xb3\xb9\u0131]")
_BRACKETS = r"[\[({<]\x20?(?:{0})\x20?[\])}}>]"
_AT = r"\x20{0,2}" + _BRACKETS.replace("{0}", "at|@|ät|arroba|arobase").replace("}}", "}") + r"\x20{0,2}"
_DOT = r"\x20{0,2}" + _BRACKETS.replace("{0}", r"dot|punkt|punto|point|\.").replace("}}", "}") + r"\x20{0,2}"
_LABEL = r"[a-z0-9-]{1,63}"
_BARE_DOT = r"\x20(?:dot|punkt|punto|point)\x20"
# An `at` in plain words counts only with a disguised dot behind it: "look at example.com" is prose.
_BARE_AT = rf"(?<=[a-z0-9])\x20(?:at|arroba|arobase)\x20(?={_LABEL}(?:{_BARE_DOT}|{_DOT}){_LABEL})"
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_DIGITS = rf"\b(?:{_DIGIT_WORD})(?:[\x20-]{{1,2}}(?:{_DIGIT_WORD}|[0-9]{{1,4}})){{2,40}}\b"
# A local part that ends in a digit is no word of prose, so a plain domain is enough behind it.
_AT_DOMAIN = rf"(?<=[0-9])\x20(?:at|arroba|arobase)\x20(?={_LABEL}(?:\.{_LABEL})+)"
_AT_AFTER_DIGIT = re.compile(r"[0-9]\x20(?:at|arroba|arobase)\x20")
_BRACKETED = re.compile(r"[\[({<]\x20?(?:at|@|ät|arroba|arobase|dot|punkt|punto|point|\.)\x20?[\])}>]")
_DOT_WORDS = (" dot ", " punkt ", " punto ", " point ")
_RULES = re.compile(rf"(?P<at>{_AT}|{_BARE_AT}|{_AT_DOMAIN})|(?P<dot>{_DOT}|(?<=[a-z0-9]){_BARE_DOT}(?={_LABEL}))|(?P<digits>{_DIGITS})",
                    re.I)
# Letters between digits, at most one separator away, that are written for digits.
_LETTER_DIGITS = re.compile(r"[0-9][\x20.-]?([OoIl]+)(?=[\x20.-]?[0-9])")
_DIGIT_LETTERS = str.maketrans("OoIl", "0011")
_WORD_OR_NUMBER = re.compile(r"[^\x20-]+")


@dataclass
class Rewritten:
    """A rewritten text and, for every rewritten piece, where it stands in both texts."""

    text: str
    pieces: list[tuple[int, int, int, int]]  # start and end here, start and end in the source

    def changed(self, start: int, end: int) -> bool:
        at = bisect_right(self.pieces, (start, -1, -1, -1))
        if at and self.pieces[at - 1][1] > start:
            return True
        return at < len(self.pieces) and self.pieces[at][0] < end

    def source(self, position: int, last: bool) -> int:
        """Source offset of a position; inside a piece, the piece's start, or its end if `last`."""
        at = bisect_right(self.pieces, (position, float("inf"), 0, 0)) - 1
        if at < 0:
            return position
        if last and self.pieces[at][0] == position:
            at -= 1
            if at < 0:
                return position
        start, end, left, right = self.pieces[at]
        if position >= end:
            return right + position - end
        return left if not last else right


def _rebuild(text: str, edits: list[tuple[int, int, str]]) -> Rewritten:
    out, pieces, upto, size = [], [], 0, 0
    for start, end, new in edits:
        out.append(text[upto:start])
        size += start - upto
        pieces.append((size, size + len(new), start, end))
        out.append(new)
        size += len(new)
        upto = end
    out.append(text[upto:])
    return Rewritten("".join(out), pieces)


def rewrite_characters(text: str) -> Rewritten:
    """Look-alikes, letters for digits, digits of other scripts, wide forms, characters without width."""
    edits = [(*m.span(1), m[1].translate(_DIGIT_LETTERS)) for m in _LETTER_DIGITS.finditer(text)]
    if not text.isascii():
        for m in _ODD.finditer(text):
            new = _passes_for(m[0])
            if new is not None:
                edits.append((m.start(), m.end(), new))
        edits.sort()
    return _rebuild(text, edits)


def may_hide(text: str) -> bool:
    """Whether any rule for words can apply; far cheaper than trying them all."""
    low = text.lower()
    return (any(w in low for w in _DOT_WORDS) or _BRACKETED.search(low) is not None
            or _AT_AFTER_DIGIT.search(low) is not None
            or not SPELLED.keys().isdisjoint(low.replace("-", " ").split()))


def rewrite_words(text: str) -> Rewritten:
    """`at`, `dot` and runs of spelled digits."""
    edits = []
    if may_hide(text):
        for m in _RULES.finditer(text):
            if m.lastgroup == "digits":
                parts = (w if w[0].isdigit() else SPELLED[w.lower()] for w in _WORD_OR_NUMBER.findall(m[0]))
                edits.append((m.start(), m.end(), "".join(parts)))
            else:
                edits.append((m.start(), m.end(), "@" if m.lastgroup == "at" else "."))
    return _rebuild(text, edits)


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that show only after rewriting and that no plain span of their kind covers wholly."""
    first = rewrite_characters(text)
    second = rewrite_words(first.text)
    if not first.pieces and not second.pieces:
        return []
    taken = {kind: sorted((s, e) for s, k, e in plain if k == kind) for kind in KINDS}
    found = []
    for start, kind, end in plain_spans(second.text):
        left, right = second.source(start, False), second.source(end, True)
        if not second.changed(start, end) and not first.changed(left, right):
            continue
        left, right = first.source(left, False), first.source(right, True)
        # A plain span can be a fragment of the disguised one, up to the first look-alike.
        at = bisect_right(taken[kind], (left, float("inf")))
        if not at or taken[kind][at - 1][1] < right:
            found.append((left, kind, right))
    return found


def joined(spans: list[Span]) -> str:
    order = {kind: at for at, kind in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], order[x[1]], x[2])))


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data for every row of `docs` (doc_id, text).

    The four counts and `base_sha256` are those of plain identifiers; `spans`
    adds the disguised ones, counted by `n_disguised`. Offsets are code points
    of the source text, ends exclusive. A null or empty text has no span: counts
    of 0, the hash of the empty string, empty `spans`. Rows are independent, so
    repeated rows and null ids are answered as they come; an empty table gives
    an empty result; other columns are ignored.
    """
    def detect(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            plain = plain_spans(text or "")
            extra = disguised_spans(text or "", plain)
            kinds = [k for _, k, _ in plain]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(plain).encode()).hexdigest(),
                         joined(plain + extra), len(extra)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(row_wise(detect), SCHEMA)
