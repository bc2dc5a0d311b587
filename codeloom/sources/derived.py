"""Analysis inputs derived from the general tables.

The general tables hold prose, orders and events; these projections turn them
into the inputs the operators expect. Each is a row-wise expression of one
table, so the inputs grow with the tables and cost no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import settings
from codeloom.functions import paths
from codeloom.sources.tables import spread, table

DIRECTORIES = ["src", "tests", "docs", "vendor", "node_modules", ".git", "venv", "lib",
               ".github/workflows"]
NAMES = {0: "README.md", 1: "setup.py", 2: "Dockerfile", 3: "app.min.js", 4: "requirements.txt",
         5: ".env"}
EXTENSIONS = [".py", ".js", ".ts", ".java", ".md", ".txt", ".rst", ".ino", ".png", ""]
METHOD_EVERY = 24
RULE_FILES = {
    "": "# made\n*.min.js\nvendor/\n/docs/*\n!/docs/d1*\n*.txt\n!/.github/**/*.txt\n",
    "src": "*.js\n!app.min.js\n",
    "lib": "!*.txt\n**/README.md\nd*5/\n",
    "node_modules": "*\n!README.md\n",
}


def _pick(number: Column, entries: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in entries]), (number % len(entries) + 1).cast("int"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` as a mixed source tree: one file per document."""
    doc = F.col("doc_id")
    plain = F.concat(F.lit("doc_"), doc.cast("string"), _pick(doc, EXTENSIONS))
    name = F.coalesce(*[F.when(doc % 13 == k, F.lit(v)) for k, v in NAMES.items()], plain)
    path = F.concat_ws("/", _pick(doc, DIRECTORIES), F.concat(F.lit("d"), doc.cast("string")), name)
    return _documents(spark, folder).select(
        F.col("source").alias("project"),
        path.alias("path"),
        paths.extension(path).alias("ext"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("text").alias("content"),
    )


def rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ignore rules for every project that `documents` names."""
    made = F.array(*[F.struct(F.lit(b).alias("base"), F.lit(t).alias("rules")) for b, t in RULE_FILES.items()])
    projects = table(spark, folder, "documents").select(F.col("source").alias("project")).distinct()
    return projects.select("project", F.explode(made).alias("r")).select("project", "r.*")


def _statement(piece: Column, k: Column) -> Column:
    """Lines of Python for the k-th sentence of a document."""
    first = F.substring_index(piece, " ", 1)
    last = F.substring_index(piece, " ", -1)
    words = (F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit(""))) + 1)
    count = words.cast("string")
    kind = F.length(piece) % 8
    lit = F.lit
    params = F.substr(lit(", p1, p2, p3, p4, p5, p6, p7"), lit(1), words % 8 * 4)
    return (
        F.when(k % METHOD_EVERY == 0, F.array(
            lit(""),
            F.concat(lit("    "), first, lit("_attr = "), count),
            F.concat(lit("    def "), first, lit("_"), k.cast("string"), lit("(self"), params, lit("):")),
            F.concat(lit("        "), first, lit("_v = "), count),
        ))
        .when(kind == 0, F.array(
            F.concat(lit("        if "), first, lit("_v and "), last, lit("_v:")),
            F.concat(lit("            return "), count),
        ))
        .when(kind == 1, F.array(
            F.concat(lit("        for "), first, lit("_v in "), last, lit("_v:")),
            F.concat(lit("            "), first, lit("_v = "), count),
        ))
        .when(kind == 2, F.array(F.concat(lit("        # "), piece)))
        .when(kind == 3, F.array(F.concat(lit("        "), first, lit("_v = "), last, lit("_v or "), count)))
        .when(kind == 4, F.array(
            F.concat(lit("        while "), first, lit("_v:")), lit("            break"),
        ))
        .when(kind == 5, F.array(
            lit("        try:"),
            F.concat(lit("            "), first, lit('_v = "'), last, lit(' # if and"')),
            lit("        except ValueError:"),
            lit("            pass"),
        ))
        .when(kind == 6, F.array(
            F.concat(lit("        "), first, lit("_v = ["), last, lit("_v for "), last,
                     lit("_v in range("), count, lit(") if "), last, lit("_v]")),
        ))
        .otherwise(F.array(
            lit(""),
            F.concat(lit("        "), first, lit("_v = dict(")),
            F.concat(lit("            a="), last, lit("_v,")),
            lit("        )"),
        ))
    )


def python_files(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` written out as Python modules, sentence by sentence."""
    doc = F.col("doc_id").cast("string")
    # One pass over the text instead of one for each sentence.
    letters = F.regexp_replace(F.lower("text"), "[^a-z.\n]+", " ")
    sentences = F.transform(F.split(letters, r"[.\n]", -1), lambda s: F.trim(s))
    split = _documents(spark, folder).select(
        "doc_id", "source", "lang", F.filter(sentences, lambda s: s != "").alias("pieces")
    )
    body = F.flatten(F.transform("pieces", _statement))
    head = F.array(
        F.concat(F.lit("class Doc"), doc, F.lit(":")),
        F.concat(F.lit('    """docs: '), F.col("lang"), F.lit('"""')),
    )
    fields = F.transform(
        F.sequence(F.lit(0), F.size("pieces") % 20),
        lambda i: F.concat(F.lit("    a"), i.cast("string"), F.lit(" = "), i.cast("string")),
    )
    tail = F.array(
        F.lit(""), F.lit(""),
        F.concat(F.lit("async def run_"), doc, F.lit("(x, y=(1, 2), *rest, flag=True):")),
        F.lit("    def inner(z):"), F.lit("        return z if z else x"), F.lit(""),
        F.lit("    return inner(y)"), F.lit(""),
    )
    data = F.array(
        F.lit(""), F.lit(""), F.concat(F.lit("class Doc"), doc, F.lit("Data:")), F.lit('    kind = "data"'),
    )
    rendered = split.select(
        F.col("source").alias("project"),
        F.concat(F.lit("pkg/doc_"), doc, F.lit(".py")).alias("path"),
        F.array_join(F.concat(head, body, data, fields, tail), "\n").alias("content"),
    )
    return rendered.select(
        "project", "path", F.lit(".py").alias("ext"),
        F.octet_length("content").cast("long").alias("size"), "content",
    )


def lint_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the JSON a lint tool would print about its lines."""
    kinds = ["error", "warning", "refactor", "convention"]
    message = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(
            _pick(F.length(line), kinds).alias("type"),
            (i + 1).alias("line"),
            F.concat(F.lit("len "), F.length(line).cast("string")).alias("message"),
            (F.length(line) % 100 / 10.0).cast("double").alias("score"),
        ),
    )
    return _documents(spark, folder).select(
        F.col("source").alias("project"), "doc_id",
        F.when(F.length("text") % 11 == 0, F.lit("[]")).otherwise(F.to_json(message)).alias("raw_json"),
    )


def broken_lint_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """`lint_outputs`, some of them missing, cut short, wrapped or of strange entries."""
    raw, kind = F.col("raw_json"), F.col("doc_id") % 7
    made = (
        F.when(kind == 2, F.substr(raw, F.lit(1), F.floor(F.length(raw) / 2).cast("int")))
        .when(kind == 3, F.concat(F.lit('{"messages":'), raw, F.lit("}")))
        .when(kind == 4, F.lit('[{"type":"error"},1]')).when(kind != 1, raw)
    )
    return lint_outputs(spark, folder).withColumn("raw_json", made)


def model_replies(spark: SparkSession, folder: str) -> DataFrame:
    """`orders` as replies of a model: records, some broken, some partial."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    bad = F.when(key % 5 == 0, F.lit("- Linha dez: ruim\n  Sugestão: trocar\n")).otherwise(F.lit(""))
    second = F.when(
        key % 3 > 0,
        F.concat(F.lit("- Linha "), (key % 90 + 1).cast("string"), F.lit(": usa "), F.col("o_orderstatus"),
                 F.lit(": sim\n\n  Explicação: prioridade "), F.col("o_orderpriority"), F.lit("\n")),
    ).otherwise(F.lit(""))
    reply = F.concat(
        F.when(key % 7 == 0, F.lit("Claro, segue:\nSugestão: solta\n")).otherwise(F.lit("")),
        F.lit("- Linha "), (key % 40 + 1).cast("string"), F.lit(": nome curto "), text,
        F.lit("\n  Sugestão: total_"), text, F.lit(" = 0\n"),
        bad, second, F.lit("Fim"),
    )
    return spread(table(spark, folder, "orders"), "o_orderkey").select(key.alias("doc_id"), reply.alias("response"))


def python_replies(spark: SparkSession, folder: str) -> DataFrame:
    """`orders` as replies in the older record format."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    reply = F.concat(
        F.when(key % 4 == 0, F.concat(F.lit("Original: solto "), text, F.lit("\n"))).otherwise(F.lit("Olá\n")),
        F.when(key % 2 == 0, F.lit("Linha ")).otherwise(F.lit("Line ")),
        F.when(key % 6 == 0, F.lit("?")).otherwise((key % 70).cast("string")),
        F.lit(":\nORIGINAL: x = "), text, F.lit("\n  sugestão: y = a:b\n"),
        F.when(key % 3 == 0, F.concat(F.lit("Explicação: "), F.col("o_orderpriority"), F.lit("\nLinha 1 a 2: fim\n")))
        .otherwise(F.lit("")),
    )
    return spread(table(spark, folder, "orders"), "o_orderkey").select(key.alias("doc_id"), reply.alias("response"))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """`part` as dependency manifests: two files per part."""
    size = F.col("p_size").cast("string")
    words = F.split("p_name", " ")
    lines = F.concat(
        F.lit("# "), F.col("p_brand"), F.lit("\n"), words[0], F.lit(">="), size, F.lit(".0\n\n  "),
        words[1], F.lit("=="), size, F.lit("\n"),
    )
    package = F.concat(
        F.lit('{"name": "'), F.col("p_type"), F.lit('", "dependencies": {"'), words[0], F.lit('": "^'), size,
        F.lit('", "'), words[1], F.lit('-js": "'), size, F.lit('"}}'),
    )
    return table(spark, folder, "part").select(
        F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("project"),
        F.explode(F.array(
            F.struct(F.lit("requirements.txt").alias("path"), lines.alias("content")),
            F.struct(F.lit("package.json").alias("path"), package.alias("content")),
        )).alias("f"),
    ).select("project", "f.path", "f.content")


def _numbered(events: DataFrame) -> DataFrame:
    number = F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("long")
    return events.withColumn("k", number)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return _numbered(table(spark, folder, "events"))


def accesses(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as an access log; the size of a key changes from access to access, now and then a lot."""
    return accesses_of(table(spark, folder, "events"))


def accesses_of(events: DataFrame) -> DataFrame:
    return _numbered(events).select(
        "event_id",
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("key"),
        "ts",
        (F.col("k") * 37 + F.col("event_id") % 7 * 10 + 100
         + F.when(F.col("event_id") % 97 == 0, 20000).otherwise(0)).alias("size"),
        (F.col("event_type") == "view").alias("hit"),
        F.col("event_type").alias("cache_type"),
    )


def task_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as attempts of tasks, four consecutive events per task."""
    return _events(spark, folder).select(
        F.floor(F.col("event_id") / 4).alias("task"),
        (F.col("event_id") % 4).alias("attempt"),
        F.col("event_type").alias("task_name"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.col("ts").alias("started"),
        F.timestamp_add("MICROSECOND", F.round(F.col("value") * 1000000).cast("long"), F.col("ts")).alias("done"),
        F.col("value").alias("seconds"),
        (F.col("event_type") == "view").alias("cache_hit"),
        "event_id",
    )


def gauge_points(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as gauge settings."""
    return _events(spark, folder).select(
        F.col("event_type").alias("metric"), F.concat(F.lit("core_"), F.col("k").cast("string")).alias("label"),
        "value", "ts", "event_id",
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as analysis requests, some empty, some for unknown projects."""
    path = (
        F.when(F.col("event_type") == "error", F.lit(""))
        .when(F.col("value") > 200, F.concat(F.lit("gone"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")))
    )
    return table(spark, folder, "events").select("event_id", path.alias("path"), "ts")


def known_projects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("source").alias("path")).distinct()


def partial_results(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as partial results of projects, one map entry per row."""
    return _events(spark, folder).select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("COMPLETED")).alias("status"),
        F.create_map(F.concat(F.lit("k"), F.col("k").cast("string")), F.col("value").cast("string")).alias("result"),
        F.concat(F.lit("value "), F.col("value").cast("string")).alias("error"),
        F.col("event_id").alias("ord"),
    )


def stored_results(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as writes to the result store, of two key versions."""
    return stored_results_of(table(spark, folder, "events"))


def stored_results_of(events: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/p/"), F.col("k").cast("string"))
    return _numbered(events).select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project"),
        path.alias("path"),
        F.when(F.col("event_type") == "signup", F.lit(1)).otherwise(F.lit(2)).alias("version"),
        F.col("value").alias("data"),
        "ts", "event_id",
    )


def domain_events(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as domain events of workspaces."""
    return domain_events_of(table(spark, folder, "events"))


def domain_events_of(events: DataFrame) -> DataFrame:
    kinds = {"signup": "workspace.created", "purchase": "changes.applied", "view": "analysis.started",
             "click": "analysis.completed", "error": "analysis.failed"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()])
    return events.select(
        "event_id", kind.alias("type"), F.concat(F.lit("ws"), F.col("user_id").cast("string")).alias("workspace_id"),
        F.col("props").alias("payload"), "ts",
    )


SUBSCRIPTIONS = [
    {"url": "https://hooks.example/all", "event_types": settings.DOMAIN_EVENT_TYPES},
    {"url": "https://hooks.example/done", "event_types": ["analysis.completed", "analysis.failed"]},
    {"url": "https://hooks.example/none", "event_types": []},
]


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as the files touched by pull requests."""
    number = F.col("quality") * 2 + F.col("toxic")
    sources = table(spark, folder, "documents").select("doc_id", F.col("source").alias("project"))
    return table(spark, folder, "labels").join(sources, "doc_id").select(
        number.alias("pr"), "project",
        F.concat(F.lit("pkg/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.md5(F.concat(F.lit("commit"), number.cast("string"))).alias("commit_id"),
    )


def prompt_answers(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """Answers to the prompts of labelled documents, one per distinct prompt."""
    quality = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    numbered = asked.withColumn("doc_id", F.regexp_extract("path", r"/d(\d+)/", 1).try_cast("long"))
    answer = F.when(F.col("kind") == "summary", F.concat(F.lit("resumo "), F.col("quality"))).otherwise(
        F.concat(F.lit("- Linha "), (F.col("chunk_no") + 1).cast("string"), F.lit(": trecho de "),
                 F.length("prompt").cast("string"), F.lit(" letras\n  Explicação: nota "), F.col("quality"))
    )
    return numbered.join(quality, "doc_id").groupBy("prompt_hash").agg(F.max(answer).alias("response"))
