"""Prompts, replies of a model, suggestions parsed from them, lint output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import settings
from codeloom.functions import paths, text


def text_chunks(files: DataFrame, chunk_size: int = settings.CHUNK_SIZE) -> DataFrame:
    """Files cut into chunks of whole lines."""
    chunks = text.chunks_of(F.col("content"), chunk_size)
    return files.select("project", "path", "ext", F.posexplode(chunks).alias("chunk_no", "chunk"))


def code_prompt(chunk: Column, language: Column) -> Column:
    head, middle, tail = settings.CODE_PROMPT
    return F.concat(F.lit(head), language, F.lit(middle), chunk, F.lit(tail))


def python_code_prompt(code: Column) -> Column:
    head, tail = settings.PYTHON_CODE_PROMPT
    return F.concat(F.lit(head), code, F.lit(tail))


def summary_prompt(content: Column, file_type: Column) -> Column:
    def filled(parts):
        return F.concat(F.lit(parts[0]), content, F.lit(parts[1]))

    cases = [F.when(file_type == k, filled(v)) for k, v in settings.SUMMARY_PROMPTS.items()]
    return F.coalesce(*cases, filled(settings.DEFAULT_SUMMARY_PROMPT))


def prompts(files: DataFrame, chunk_size: int = settings.CHUNK_SIZE, typed: bool = False) -> DataFrame:
    """All prompts of a corpus: a summary per file, and one per chunk of code.

    `typed` picks the summary prompt by file type; the default asks for the
    general one, as the report does. One pass: a file's prompts are an array
    built from its row.
    """
    wide = {**settings.LANGUAGE_OF_EXTENSION, **settings.EXTRA_LANGUAGES}
    language = paths.language(F.col("ext"))
    kind = paths.language(F.col("ext"), wide) if typed else F.lit(settings.UNKNOWN_LANGUAGE)
    staged = files.select(
        "project", "path", "content", language.alias("language"), kind.alias("file_type"),
        F.when(~paths.is_text_language(language), text.chunks_of(F.col("content"), chunk_size))
        .otherwise(F.array().cast("array<string>")).alias("chunks"),
    )
    summary = F.struct(
        F.lit("summary").alias("kind"), F.lit(-1).alias("chunk_no"),
        summary_prompt(F.col("content"), F.col("file_type")).alias("prompt"),
    )
    code = F.transform(
        "chunks",
        lambda chunk, i: F.struct(
            F.lit("code").alias("kind"), i.alias("chunk_no"),
            code_prompt(chunk, F.col("language")).alias("prompt"),
        ),
    )
    rows = staged.select("project", "path", F.explode(F.concat(F.array(summary), code)).alias("p"))
    return rows.select(
        "project", "path", "p.kind", "p.chunk_no", "p.prompt", F.sha2("p.prompt", 256).alias("prompt_hash")
    )


def complete(prompt_rows: DataFrame, completion) -> DataFrame:
    """Ask each distinct prompt once; `completion` is a string-to-string UDF in pandas or Arrow."""
    distinct = prompt_rows.groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
    return distinct.select("prompt_hash", completion("prompt").alias("response"))


def attach_responses(prompt_rows: DataFrame, responses: DataFrame) -> DataFrame:
    """Each prompt with its response; a missing summary gets the fixed text, missing code none."""
    joined = prompt_rows.select("project", "path", "kind", "chunk_no", "prompt_hash").join(
        responses.select("prompt_hash", "response"), "prompt_hash", "left"
    )
    fallback = F.when(F.col("kind") == "summary", F.lit(settings.NO_SUMMARY_TEXT))
    return joined.withColumn("response", F.coalesce("response", fallback))


_HEADER = r"^- Linha[^:\n]*[\t\x0b-\r\x1c-\x20]([+-]?[0-9]+)[\t\x0b-\r\x1c-\x20]*:"
_PYTHON_HEADER = r"^(?:Linha |Line )"
_PYTHON_FIELD = r"(?mdiu)^(?:original|sugestão|explicação):"


def parse_suggestions(replies: DataFrame, repeat_on_bad_header: bool = False,
                      ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Suggestions in `- Linha N: message` replies, told apart by the columns `ids`.

    A header without a number starts no record: the open one goes on; a number
    beyond 64 bits starts one without a line. With
    `repeat_on_bad_header` the open record also comes out once more for each
    such header, as it did originally.
    """
    lines = F.filter(
        F.transform(text.lines_of(F.col("response")), lambda line: text.strip(line)), lambda line: line != ""
    )
    # One part per record: cut the joined lines in front of each good header.
    cut = rf"(?:^|\n)(?={_HEADER.removeprefix('^')})"
    records = F.filter(F.split(F.array_join(lines, "\n"), cut, -1), lambda part: part.rlike(_HEADER))
    parts = replies.select(*ids, F.posexplode(records).alias("record", "part"))

    def field(name: str) -> Column:
        found = F.regexp_extract_all("part", F.lit(rf"(?md)^{name}:([^\n]*)"), F.lit(1))
        return F.when(F.size(found) > 0, text.strip(F.element_at(found, -1)))

    bad = F.size(F.regexp_extract_all("part", F.lit(r"(?md)^- Linha"), F.lit(0))) - 1
    parsed = parts.select(
        *ids,
        "record",
        F.regexp_extract("part", _HEADER, 1).try_cast("long").alias("line"),
        text.strip(F.regexp_extract("part", r"^[^:]*:([^\n]*)", 1)).alias("message"),
        field("Sugestão").alias("suggested_code"),
        field("Explicação").alias("explanation"),
        bad.alias("bad_headers"),
    )
    if repeat_on_bad_header:
        parsed = parsed.withColumn("bad_headers", F.explode(F.sequence(F.lit(0), F.col("bad_headers"))))
    return parsed.drop("bad_headers")


def file_suggestions(attached: DataFrame) -> DataFrame:
    """Suggestions of each file in the order of its chunks and their records."""
    answered = attached.filter((F.col("kind") == "code") & F.col("response").isNotNull())
    parsed = parse_suggestions(answered, ids=("project", "path", "chunk_no"))
    # Both numbers are 32 bits wide.
    place = F.shiftleft(F.col("chunk_no").cast("long"), 32) + F.col("record")
    return parsed.withColumn("place", place).drop("chunk_no", "record")


def parse_python_suggestions(replies: DataFrame) -> DataFrame:
    """Suggestions in the older format: `Linha N` or `Line N`, then labelled fields.

    Digits of the header make the line number, none make 0. Fields ahead of
    the first header make a record of their own.
    """
    lines = F.filter(
        F.transform(text.lines_of(F.col("response")), lambda line: text.strip(line)), lambda line: line != ""
    )
    cut = rf"(?:^|\n)(?={_PYTHON_HEADER.removeprefix('^')})"
    records = F.filter(
        F.split(F.array_join(lines, "\n"), cut, -1),
        lambda part: part.rlike(_PYTHON_HEADER) | part.rlike(_PYTHON_FIELD),
    )
    parts = replies.select("doc_id", F.posexplode(records).alias("record", "part"))

    def field(name: str) -> Column:
        found = F.regexp_extract_all("part", F.lit(rf"(?mdiu)^{name}:([^\n]*)"), F.lit(1))
        return F.when(F.size(found) > 0, text.strip(F.element_at(found, -1)))

    headed = F.col("part").rlike(_PYTHON_HEADER)
    digits = F.regexp_replace(F.regexp_extract("part", r"^([^:\n]*)", 1), r"\D", "")
    fields = {name: field(label) for name, label in
              (("original_code", "original"), ("suggested_code", "sugestão"), ("explanation", "explicação"))}
    return parts.select(
        "doc_id", "record",
        F.coalesce(F.when(headed, digits.try_cast("long")), F.lit(0).cast("long")).alias("line"),
        *[F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items()],
        F.lit(settings.CONFIDENCE).alias("confidence"),
    )


LINT_SCHEMA = "array<struct<type:string,line:int,message:string,score:double>>"


def lint_messages(outputs: DataFrame) -> DataFrame:
    """Messages of type warning or error, one row each."""
    parsed = F.from_json("raw_json", LINT_SCHEMA)
    kept = F.filter(parsed, lambda m: m["type"].isin("warning", "error"))
    return outputs.select("project", "doc_id", F.explode(kept).alias("m")).select("project", "doc_id", "m.*")


def _lint_rows(parsed: DataFrame) -> DataFrame:
    kept = F.filter("messages", lambda m: m["type"].isin("warning", "error"))
    staged = parsed.withColumn("kept", kept)
    return staged.select(
        "project",
        "doc_id",
        F.coalesce(F.get("messages", F.lit(0))["score"], F.lit(0.0)).alias("score"),
        F.size("kept").alias("warnings_count"),
        F.array_join(
            F.transform("kept", lambda m: F.concat(m["line"].cast("string"), F.lit(":"), m["message"])), ";"
        ).alias("errors"),
    )


def lint_report(outputs: DataFrame) -> DataFrame:
    """Per lint output the first message's score and the warnings and errors."""
    return _lint_rows(outputs.withColumn("messages", F.from_json("raw_json", LINT_SCHEMA)))


def lint_checked(outputs: DataFrame) -> DataFrame:
    """`outputs` with `messages` as in LINT_SCHEMA and `problem`, the reason why there are none.

    A text is read as a variant, so one that is cut short, or is another document
    altogether, is told from an empty list: "empty" (null or blank), "no JSON" (also
    an object that names a field twice), "no list", "no message" (an entry that is no
    object). A field of another type than expected is null in its message, whose
    other fields stay.
    """
    def field(entry: Column, name: str, kind: str) -> Column:
        return F.try_variant_get(entry, f"$.{name}", kind).alias(name)

    entries = F.try_variant_get("_v", "$", "array<variant>")
    staged = outputs.withColumn("_v", F.try_parse_json("raw_json")).withColumn("_entries", entries)
    stray = F.exists("_entries", lambda e: F.try_variant_get(e, "$", "map<string,variant>").isNull())
    problem = (
        F.when(F.col("raw_json").isNull() | text.is_blank(F.col("raw_json")), "empty")
        .when(F.col("_v").isNull(), "no JSON").when(F.col("_entries").isNull(), "no list").when(stray, "no message")
    )
    messages = F.transform("_entries", lambda e: F.struct(
        field(e, "type", "string"), field(e, "line", "int"), field(e, "message", "string"), field(e, "score", "double")))
    return staged.withColumn("problem", problem).withColumn(
        "messages", F.when(F.col("problem").isNull(), messages)).drop("_v", "_entries")


def lint_checked_report(outputs: DataFrame) -> DataFrame:
    """The report of the outputs that could be read."""
    return _lint_rows(lint_checked(outputs).filter(F.col("problem").isNull()))


def lint_quarantine(outputs: DataFrame) -> DataFrame:
    """The outputs that could not be read, as they came, with the reason."""
    return lint_checked(outputs).filter(F.col("problem").isNotNull()).select("project", "doc_id", "problem", "raw_json")
