"""Column expressions over file text: lines, lengths, keywords, names, chunks.

All of them are built from Spark's own functions and work on one row at a
time, so they need no shuffle. Regular expressions are written in the dialect
of the analysed behaviour, where `\\w`, `\\b` and `\\s` know Unicode, and are
spelled out for the JVM by `unicode_regex`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import settings

# Whitespace as str.strip sees it.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"a-zA-Z0-9_\p{L}\p{N}"
# Line ends as str.splitlines sees them.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def unicode_regex(pattern: str) -> str:
    """Spell out `\\w`, `\\s` and `\\b` with Unicode character classes.

    In the patterns used here a repeated class is always followed by something
    outside it, so giving characters back never helps: the repetitions are
    made possessive, and a leading name is only tried at its first character.
    """
    boundary = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
    head = f"(?<![{WORD}])" if pattern.startswith(r"(\w+)") else ""
    eager = pattern.replace(r"\w+", r"\w++").replace(r"\s+", r"\s++").replace(r"\s*", r"\s*+")
    return head + (
        eager.replace(r"\w", f"[{WORD}]").replace(r"\s", f"[{SPACE}]").replace(r"\b", boundary)
    )


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(col: Column) -> Column:
    return col.rlike(f"^[{SPACE}]*$")


def newline_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))


def lines_of(content: Column) -> Column:
    """Lines split at `\\n` only; a trailing newline yields a last empty line."""
    return F.split(content, "\n", -1)


def split_lines(content: Column) -> Column:
    """Lines split at every line end; no empty line after the last one."""
    parts = F.split(content, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def blank_line_count(content: Column) -> Column:
    """Lines made of whitespace only, in one pass over the text."""
    inner = SPACE.replace(r"\t-\r", r"\t\x0b-\r")
    return F.regexp_count(content, F.lit(rf"(?<![^\n])[{inner}]*+(?![^\n])"))


def max_line_length(content: Column) -> Column:
    return F.array_max(F.transform(lines_of(content), lambda line: F.length(line)))


def average_line_length(content: Column) -> Column:
    newlines = newline_count(content)
    return (F.length(content) - newlines) / (newlines + 1)


def one_decimal(value: Column) -> Column:
    """A non-negative double with one decimal, ties as IEEE rounding has them.

    The fraction is scaled to a whole number, which is exact, and rounded half
    to even there; `format_string` would round the printed digits instead.
    """
    whole = F.floor(value)
    scaled = ((value - whole) * F.lit(float(2**58))).cast("long") * 10
    tenth = F.shiftright(scaled, 58)
    rest = scaled.bitwiseAND(F.lit(2**58 - 1))
    up = (rest > 2**57) | ((rest == 2**57) & (tenth % 2 == 1))
    tenths = whole * 10 + tenth + F.when(up, F.lit(1)).otherwise(F.lit(0))
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def branch_count(content: Column) -> Column:
    """Branch keywords and `&&` / `||` between word characters.

    Each pattern is anchored at word boundaries on both sides, so no two can
    overlap and one alternation counts the same as one pass per pattern.
    """
    bare = [p.removeprefix(r"\b").removesuffix(r"\b") for p in settings.BRANCH_PATTERNS]
    words = "|".join(p for p in bare if p.isalpha())
    signs = "|".join(p for p in bare if not p.isalpha())
    pattern = (
        rf"(?<![{WORD}])(?:{words})(?![{WORD}])|(?<=[{WORD}])(?:{signs})(?=[{WORD}])"
    )
    return F.regexp_count(content, F.lit(pattern))


def keyword_complexity(content: Column) -> Column:
    return (branch_count(content) + 1).cast("double")


def function_names(content: Column) -> Column:
    """Names found by the function patterns, in pattern order, first seen kept."""
    found = [
        F.regexp_extract_all(content, F.lit(unicode_regex(p)), F.lit(group))
        for p, group in settings.FUNCTION_PATTERNS
    ]
    return F.array_distinct(F.concat(*found))


def class_names(content: Column) -> Column:
    found = [
        F.regexp_extract_all(content, F.lit(unicode_regex(p)), F.lit(1))
        for p in settings.CLASS_PATTERNS
    ]
    return F.array_distinct(F.concat(*found))


def normalised_line(line: Column) -> Column:
    """The line without outer whitespace; a comment line becomes empty."""
    bare = strip(line)
    return F.when(bare.startswith("#"), F.lit("")).otherwise(bare)


def chunks_of(content: Column, chunk_size: int) -> Column:
    """Pack lines greedily into chunks of at most `chunk_size` characters.

    Newlines are not counted. A first line that is too long closes an empty
    chunk before its own one, as in the behaviour we reproduce. Only the places
    of the cuts are carried from line to line, and the lines are joined once.
    """
    def packed(lines: Column) -> Column:
        sized = F.transform(lines, lambda line, i: F.struct(F.length(line).alias("n"), i.alias("i")))
        start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("size"))

        def add(state: Column, line: Column) -> Column:
            full = state["size"] + line["n"] > chunk_size
            return F.struct(
                F.when(full, F.array_append(state["cuts"], line["i"])).otherwise(state["cuts"]).alias("cuts"),
                F.when(full, line["n"]).otherwise(state["size"] + line["n"]).alias("size"),
            )

        bounds = F.aggregate(
            sized, start, add, lambda s: F.concat(F.array(F.lit(0)), s["cuts"], F.array(F.size(lines)))
        )

        def joined(b: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.size(b) - 2),
                lambda k: F.array_join(F.slice(lines, F.get(b, k) + 1, F.get(b, k + 1) - F.get(b, k)), "\n"),
            )

        return F.get(F.transform(F.array(bounds), joined), F.lit(0))

    # Bound to a variable, so that the text is split once and not for every chunk.
    return F.get(F.transform(F.array(lines_of(content)), packed), F.lit(0))
