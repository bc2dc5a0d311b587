"""Python entities straight from source text, by expressions.

The text is first masked, in one walk over its tokens (`python_scan`), so that
indentation alone tells the structure: comments are dropped, strings emptied,
and lines that go on with the one before start with a mark that no line of
Python can start with, so they can neither start a statement nor end a block.

A block then is its head line plus every following line that is blank or
indented deeper, which one regular expression with a back-reference states.
Loops in these expressions are possessive: the JVM runs them iteratively, so
long files cannot overflow its stack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.arrow import bounds
from codeloom.functions.python_scan import MARK, masked_text
from codeloom.functions.text import WORD

PIECE_BYTES = 1 << 21
NAME = f"[{WORD}]++"
BRACKETS = r"[(\[{][^()\[\]{}]*+[)\]}]"  # the mask has none within another

HEAD = rf"[ \t]*+(?:(?:async[ \t]++)?+def|class)[ \t]++{NAME}"
# Indentation first, so that it can be referred to; group 1 is the whole block.
_BLOCK = (
    rf"(?md)^(?=(([ \t]*+)(?:(?:async[ \t]++)?+def|class)[ \t]++{NAME}[^\n]*+"
    rf"(?:\n(?:\2[ \t]++[^ \t\n][^\n]*+|{MARK}[^\n]*+|[ \t\f\r]*+(?=\n|\z)))*+))"
)


def _accepts(text: str | None) -> bool:
    """Whether Python accepts the text. The grammar itself is the one thing expressions cannot state."""
    import ast

    try:
        ast.parse(text)
        return text is not None
    except Exception:
        return False


def _text_udf(one: Callable, kind: pa.DataType, spark_type: T.DataType):
    """`one` of each text, null included, as a UDF that holds the results of a few texts at a time."""
    @F.arrow_udf(spark_type)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for batch in batches:
                for start, stop in bounds([batch], PIECE_BYTES):
                    yield pa.array([one(t) for t in batch.slice(start, stop - start).to_pylist()], kind)
                batch = None
                pa.default_memory_pool().release_unused()

    return run


def parses(content: Column) -> Column:
    """Whether Python accepts the text; nothing is accepted for a null."""
    return _text_udf(_accepts, pa.bool_(), T.BooleanType())(content)


def parsed(files: DataFrame) -> Column:
    """The answer of `parses` for each file, taken from the table if it is there."""
    return F.col("parsed") if "parsed" in files.columns else parses(F.col("content"))


def masked(content: Column) -> Column:
    """The mask of a text, null for a null."""
    return _text_udf(lambda t: None if t is None else masked_text(t), pa.string(), T.StringType())(content)


def scanned(files: DataFrame) -> Column:
    """`parsed` and, for a file that Python accepts, `mask`, as a struct from one pass over the text."""
    if "parsed" in files.columns:
        return F.struct("parsed", masked(F.when(F.col("parsed"), F.col("content"))).alias("mask"))

    def both(text):
        accepted = _accepts(text)
        return {"parsed": accepted, "mask": masked_text(text) if accepted else None}

    fields = [("parsed", pa.bool_(), T.BooleanType()), ("mask", pa.string(), T.StringType())]
    return _text_udf(both, pa.struct([f[:2] for f in fields]),
                     T.StructType([T.StructField(f[0], f[2]) for f in fields]))(F.col("content"))


def blocks(mask: Column) -> Column:
    """Text of every def and class block, in source order, nested ones too."""
    found = F.regexp_extract_all(mask, F.lit(_BLOCK), F.lit(1))
    return F.transform(found, lambda b: F.rtrim(b, F.lit(" \t\n\f\r")))


def head_lines(mask: Column) -> Column:
    """Line numbers of the blocks' heads, in the same order as `blocks`."""
    numbers = F.transform(
        F.split(mask, "\n", -1),
        lambda line, i: F.when(line.rlike("^" + HEAD), i + 1),
    )
    return F.filter(numbers, lambda n: n.isNotNull())


def block_kind(block: Column) -> Column:
    return F.when(block.rlike(r"^[ \t]*+class[ \t]"), F.lit("class")).otherwise(F.lit("function"))


def block_name(block: Column) -> Column:
    return F.regexp_extract(block, rf"^[ \t]*+(?:async[ \t]++)?+(?:def|class)[ \t]++({NAME})", 1)


def is_async(block: Column) -> Column:
    return block.rlike(r"^[ \t]*+async[ \t]")


def block_height(block: Column) -> Column:
    """Last line minus first line."""
    return F.length(block) - F.length(F.replace(block, F.lit("\n"), F.lit("")))


def parameter_count(block: Column) -> Column:
    """Positional parameters that may be given by name.

    Those before `/`, the starred ones and those after them do not count.
    """
    signature = F.regexp_extract(
        block,
        rf"^[ \t]*+(?:async[ \t]++)?+def[ \t]++{NAME}[ \t]*+(?:\[(?:[^\[\]]++|{BRACKETS})*+\][ \t]*+)?+({BRACKETS})",
        1,
    )
    flat = F.regexp_replace(signature, rf"\n{MARK}_ ", "")
    inner = F.regexp_replace(F.regexp_extract(flat, r"^\(([\s\S]*)\)$", 1), BRACKETS, "")
    plain = F.regexp_replace(inner, rf"(?<![{WORD}])lambda(?![{WORD}])[^:]*+:", "")
    items = F.filter(F.transform(F.split(plain, ",", -1), lambda p: F.trim(p)), lambda p: p != "")
    slash = F.array_position(items, "/")
    named = F.slice(items, slash.cast("int") + 1, F.greatest(F.size(items), F.lit(1)))
    flags = F.transform(named, lambda p: p.startswith("*"))
    star = F.array_position(flags, True).cast("int")
    return F.when(star > 0, star - 1).otherwise(F.size(named))


def boolean_operators(mask: Column) -> Column:
    """A chain of n operands has n - 1 `and` / `or` tokens."""
    return F.regexp_count(mask, F.lit(rf"(?<![{WORD}])(?:and|or)(?![{WORD}])"))


_GROUP_TRY = (
    r"(?md)^(?=([ \t]*+)try[ \t]*+:[^\n]*+"
    rf"(?:\n(?:\1[ \t]++[^ \t\n][^\n]*+|{MARK}[^\n]*+|[ \t\f\r]*+(?=\n|\z)))*+\n\1except[ \t]*+\*)"
)


def function_complexity(block: Column) -> Column:
    """Branches and loops in a block plus its boolean operators.

    A `try` whose handlers are `except*` is another statement and not counted.
    """
    heads = F.regexp_count(block, F.lit(rf"(?md)^[ \t]*+(?:if|elif|for|while|try)(?![{WORD}])"))
    return heads - F.regexp_count(block, F.lit(_GROUP_TRY)) + boolean_operators(block)


def file_complexity(mask: Column) -> Column:
    """One plus branches, loops, async loops and contexts, handlers, operators."""
    heads = F.regexp_count(
        mask,
        F.lit(
            rf"(?md)^[ \t]*+(?:(?:if|elif|for|while|except)(?![{WORD}])"
            rf"|async[ \t]++(?:for|with)(?![{WORD}]))"
        ),
    )
    return (heads + boolean_operators(mask) + 1).cast("double")


def child_indent(block: Column) -> Column:
    """Indentation of the statements standing directly in a block."""
    return F.regexp_extract(block, r"\n([ \t]++)(?![\n\f\r])", 1)


def direct_statements(block: Column, indent: Column) -> Column:
    """Statements standing directly in a class body, without indentation.

    `indent` must be a plain column: an expression would be evaluated again
    for every line.
    """
    width = F.length(indent)
    below = F.slice(F.split(block, "\n", -1), F.lit(2), F.length(block) + 1)
    direct = F.filter(
        below,
        lambda line: (width > 0) & line.startswith(indent)
        & ~F.substr(line, width + 1, F.lit(1)).isin(" ", "\t", ""),
    )
    inline = F.regexp_extract(
        block,
        rf"^[ \t]*+class[ \t]++{NAME}[ \t]*+(?:{BRACKETS}[ \t]*+)*+:[ \t]*+([^ \t\n][^\n]*)",
        1,
    )
    head = F.when(inline != "", F.array(inline)).otherwise(F.array().cast("array<string>"))
    return F.concat(head, F.transform(direct, lambda line: F.substr(line, width + 1, F.length(line))))


_METHOD = rf"^(?:async[ \t]++)?+def[ \t]++({NAME})"
_PLACE = rf"(?:\*?[{WORD}.]++(?:{BRACKETS}[{WORD}.]*+)*+|{BRACKETS}(?:[{WORD}.]|{BRACKETS})*+)"
_TARGETS = rf"^((?:{_PLACE}(?:[ \t]*+,[ \t]*+{_PLACE})*+[ \t]*+,?+[ \t]*+=(?!=)[ \t]*+)++)"


def method_names(statements: Column) -> Column:
    """Names of the methods among the direct statements of a class."""
    found = F.transform(statements, lambda s: F.regexp_extract(s, _METHOD, 1))
    return F.filter(found, lambda n: n != "")


def assignment_targets(statements: Column) -> Column:
    """Number of targets of the plain assignments among the direct statements."""
    parts = F.flatten(F.transform(statements, lambda s: F.split(s, r";[ \t]*+", -1)))
    chains = F.transform(
        parts,
        lambda s: F.regexp_count(
            F.regexp_replace(F.regexp_extract(s, _TARGETS, 1), BRACKETS, ""), F.lit("=")
        ),
    )
    return F.aggregate(chains, F.lit(0), lambda total, n: total + n)
