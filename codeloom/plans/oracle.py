"""SQL twins of the queries, for DuckDB over the same tables.

They are written independently of the Spark side where the two dialects allow:
entities come from joins over a line table, folds from recursive queries.
"""

from __future__ import annotations

from codeloom import settings
from codeloom.plans import catalog
from codeloom.sources import derived


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + _list(values)[1:-1] + ")"


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _language(ext: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in settings.LANGUAGE_OF_EXTENSION.items())
    return f"CASE {ext} {whens} ELSE 'Unknown' END"


_NAME = "CASE doc_id % 13 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in derived.NAMES.items()) + \
    f" ELSE 'doc_' || doc_id || {_list(derived.EXTENSIONS)}[doc_id % 10 + 1] END"

TEXT_FILES = rf"""
text_paths AS (
  SELECT source AS project, text AS content,
         {_list(derived.DIRECTORIES)}[doc_id % 9 + 1] || '/d' || doc_id || '/' || {_NAME} AS path
  FROM documents),
text_files AS (
  SELECT project, path, lower(regexp_extract(path, '[^./][^/]*?(\.[^./]*)$', 1)) AS ext,
         strlen(content)::BIGINT AS size, content
  FROM text_paths)
"""

ELIGIBLE = f"""
eligible AS (
  SELECT * FROM text_files
  WHERE ext NOT IN {_in(settings.BINARY_EXTENSIONS)} AND NOT contains('/' || path, '/.git/')
    AND size <= {settings.MAX_FILE_BYTES})
"""

PY_FILES = r"""
py_pieces AS (
  SELECT doc_id, source, lang,
         list_filter(
           list_transform(regexp_split_to_array(text, '[.\n]'),
                          lambda s: trim(regexp_replace(lower(s), '[^a-z]+', ' ', 'g'))),
           lambda s: s <> '') AS pieces
  FROM documents),
py_rows AS (
  SELECT doc_id, unnest(pieces) AS p, generate_subscripts(pieces, 1) - 1 AS k FROM py_pieces),
py_parts AS (
  SELECT doc_id, k, p, split_part(p, ' ', 1) AS a, split_part(p, ' ', -1) AS z,
         len(string_split(p, ' ')) AS n, length(p) % 8 AS kind
  FROM py_rows),
py_body AS (
  SELECT doc_id, string_agg(
    CASE WHEN k % 24 = 0 THEN
           E'\n    ' || a || '_attr = ' || n || E'\n    def ' || a || '_' || k || '(self'
           || substr(', p1, p2, p3, p4, p5, p6, p7', 1, 4 * (n % 8)) || '):' || E'\n        ' || a || '_v = ' || n
         WHEN kind = 0 THEN '        if ' || a || '_v and ' || z || E'_v:\n            return ' || n
         WHEN kind = 1 THEN '        for ' || a || '_v in ' || z || E'_v:\n            ' || a || '_v = ' || n
         WHEN kind = 2 THEN '        # ' || p
         WHEN kind = 3 THEN '        ' || a || '_v = ' || z || '_v or ' || n
         WHEN kind = 4 THEN '        while ' || a || E'_v:\n            break'
         WHEN kind = 5 THEN E'        try:\n            ' || a || '_v = "' || z
              || E' # if and"\n        except ValueError:\n            pass'
         WHEN kind = 6 THEN '        ' || a || '_v = [' || z || '_v for ' || z || '_v in range(' || n
              || ') if ' || z || '_v]'
         ELSE E'\n        ' || a || E'_v = dict(\n            a=' || z || E'_v,\n        )' END,
    E'\n' ORDER BY k) AS body
  FROM py_parts GROUP BY doc_id),
py_files AS (
  SELECT source AS project, 'pkg/doc_' || doc_id || '.py' AS path, '.py' AS ext,
         'class Doc' || doc_id || E':\n    ' || repeat('"', 3) || 'docs: ' || lang || repeat('"', 3) || coalesce(E'\n' || body, '')
         || E'\n\n\nclass Doc' || doc_id || E'Data:\n    kind = "data"'
         || list_aggregate(list_transform(range(0, len(pieces) % 20 + 1),
                                          lambda i: E'\n    a' || i || ' = ' || i), 'string_agg', '')
         || E'\n\n\nasync def run_' || doc_id || E'(x, y=(1, 2), *rest, flag=True):\n    def inner(z):\n'
         || E'        return z if z else x\n\n    return inner(y)\n' AS content
  FROM py_pieces LEFT JOIN py_body USING (doc_id))
"""

# Lines without strings and comments, entities with their span.
PY_LINES = PY_FILES + r""",
py_raw AS (
  SELECT project, path, unnest(string_split(content, chr(10))) AS raw,
         generate_subscripts(string_split(content, chr(10)), 1) AS ln
  FROM py_files),
py_lines AS (
  SELECT *, length(t) - length(ltrim(t, ' ')) AS ind, trim(t) <> '' AS filled,
         len(regexp_extract_all(t, '\b(and|or)\b')) AS bools,
         regexp_matches(t, '^ *(if|elif|for|while|try)\b')::INT AS branch,
         regexp_matches(t, '^ *(if|elif|for|while|except)\b')::INT AS branch2
  FROM (SELECT *, regexp_replace(regexp_replace(raw, '"[^"]*"', '""', 'g'), '#.*$', '') AS t FROM py_raw)),
py_heads AS (
  SELECT project, path, ln, ind, t,
         CASE WHEN regexp_matches(t, '^ *class ') THEN 'class' ELSE 'function' END AS kind,
         regexp_extract(t, '(?:def|class) (\w+)', 1) AS name,
         regexp_matches(t, '^ *async ') AS is_async
  FROM py_lines WHERE regexp_matches(t, '^ *(async )?(def|class) \w')),
py_stops AS (
  SELECT h.path, h.ln, min(l.ln) AS stop
  FROM py_heads h JOIN py_lines l ON l.path = h.path AND l.ln > h.ln AND l.filled AND l.ind <= h.ind
  GROUP BY ALL),
py_spans AS (
  SELECT h.*, s.stop FROM py_heads h LEFT JOIN py_stops s USING (path, ln)),
py_entities AS (
  SELECT h.project, h.path, h.kind, h.name, h.ln AS start_line, h.is_async,
         max(l.ln) FILTER (l.filled) AS end_line,
         CASE WHEN h.kind = 'function' THEN sum(l.bools + l.branch) END AS complexity,
         CASE WHEN h.kind = 'function' THEN
           len(list_filter(string_split(
             regexp_replace(regexp_replace(regexp_extract(any_value(h.t), '\((.*)\):', 1), '\([^()]*\)', ''), ',? ?\*.*', ''),
             ','), lambda x: trim(x) <> '')) END AS params,
         count(*) FILTER (l.ln > h.ln AND h.kind = 'class' AND regexp_matches(l.t, '^    (async )?def \w')) AS n_methods,
         string_agg(regexp_extract(l.t, 'def (\w+)', 1), ',' ORDER BY l.ln)
           FILTER (l.ln > h.ln AND h.kind = 'class' AND regexp_matches(l.t, '^    (async )?def \w')) AS methods,
         count(*) FILTER (l.ln > h.ln AND h.kind = 'class' AND regexp_matches(l.t, '^    (async )?def \w')
                          AND NOT regexp_matches(l.t, '^    (async )?def __')) AS n_public,
         count(*) FILTER (l.ln > h.ln AND h.kind = 'class' AND regexp_matches(l.t, '^    \w+ = ')) AS n_attributes
  FROM py_spans h JOIN py_lines l ON l.path = h.path AND l.ln >= h.ln AND l.ln < coalesce(h.stop, 1e9)
  GROUP BY h.project, h.path, h.kind, h.name, h.ln, h.is_async)
"""


def _smell(kind: str, number: str, test: str) -> str:
    message, severity, suggestion = settings.SMELL_TEXTS[kind]
    shown = _quote(message).replace("%d", f"' || {number} || '") if number else _quote(message)
    return (
        f"SELECT project, path, start_line AS line, '{kind}' AS type, {severity} AS severity, "
        f"{shown} AS message, {_quote(suggestion)} AS suggestion FROM py_entities WHERE {test}"
    )


_HEIGHT = "(end_line - start_line)"
SMELLS = PY_LINES + ",\npy_smells AS (\n" + "\nUNION ALL\n".join([
    _smell("long_method", _HEIGHT, f"kind = 'function' AND {_HEIGHT} > 30"),
    _smell("long_parameter_list", "params", "kind = 'function' AND params > 5"),
    _smell("high_complexity", "complexity", "kind = 'function' AND complexity > 10"),
    _smell("large_class", _HEIGHT, f"kind = 'class' AND {_HEIGHT} > 300"),
    _smell("data_class", "", "kind = 'class' AND n_public = 0"),
    _smell("god_class", "", "kind = 'class' AND (n_methods > 20 OR n_attributes > 15)"),
]) + ")\n"

# Brute force over all pairs of blocks; letter counts spare most distances.
_LETTERS = "aeinorst_ =0"
_COUNTS = ", ".join(
    f"(strlen(t) - strlen(replace(t, '{c}', '')))::SMALLINT AS c{i}" for i, c in enumerate(_LETTERS)
)
_COUNT_DIFFERENCE = " + ".join(f"abs(a.c{i} - b.c{i})" for i in range(len(_LETTERS)))
_MESSAGE, _SEVERITY, _SUGGESTION = settings.SMELL_TEXTS["duplicate_code"]
DUPLICATES = rf"""
dup_lines AS (
  SELECT project, path, list_transform(string_split(content, chr(10)), lambda x:
    CASE WHEN starts_with(trim(x), '#') THEN '' ELSE trim(x) END) AS l FROM py_files),
dup_blocks AS MATERIALIZED (
  SELECT *, length(t) AS n, {_COUNTS} FROM (
    SELECT project, path, i, array_to_string(list_filter(l[i:i + 5], lambda x: x <> ''), ' ') AS t
    FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM dup_lines)) WHERE t <> ''),
dup_pairs AS MATERIALIZED (
  SELECT a.project, a.path, a.i, a.t AS s, b.t, greatest(a.n, b.n) AS m
  FROM dup_blocks a JOIN dup_blocks b ON a.path = b.path AND b.i >= a.i + 6
  WHERE abs(a.n - b.n) <= 0.2 * greatest(a.n, b.n) + 0.001
    AND {_COUNT_DIFFERENCE} <= 0.4 * greatest(a.n, b.n) + 0.001),
py_duplicates AS (
  SELECT DISTINCT project, path, i AS line, 'duplicate_code' AS type, {_SEVERITY} AS severity,
         {_quote(_MESSAGE).replace("%d-%d", "' || i || '-' || (i + 5) || '")} AS message,
         {_quote(_SUGGESTION)} AS suggestion
  FROM dup_pairs WHERE 1.0::DOUBLE - levenshtein(s, t)::DOUBLE / m >= 0.8::DOUBLE)
"""
ALL_SMELLS = SMELLS + "," + DUPLICATES + """,
all_smells AS (SELECT * FROM py_smells UNION ALL SELECT * FROM py_duplicates)
"""

DENSITY = ALL_SMELLS + r""",
py_counts AS (
  SELECT project,
         sum(len(l) - (l[-1] = '')::INT) AS total_lines,
         sum(len(list_filter(l, lambda x: trim(x) = '')) - (l[-1] = '')::INT) AS blank_lines,
         sum(len(list_filter(l, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#')))) AS code_lines
  FROM (SELECT project, string_split(content, chr(10)) AS l FROM py_files) GROUP BY project),
py_totals AS (
  SELECT project, count(*) FILTER (kind = 'function') AS total_functions,
         count(*) FILTER (kind = 'class') AS total_classes FROM py_entities GROUP BY project),
py_severity AS (SELECT project, sum(severity)::BIGINT AS severity FROM all_smells GROUP BY project),
py_density AS (
  SELECT project, total_lines, code_lines, blank_lines, total_functions, total_classes,
         coalesce(severity, 0) AS severity,
         CASE WHEN code_lines > 0 THEN coalesce(severity, 0) / code_lines ELSE 0.0 END AS density
  FROM py_counts LEFT JOIN py_totals USING (project) LEFT JOIN py_severity USING (project))
"""

_WORDS = "regexp_extract_all(content, '[\\p{L}\\p{N}_]+')"
_KEYWORDS = _in(["if", "elif", "else", "for", "while", "do", "switch", "case", "catch", "finally"])
KEYWORD_COUNT = (
    f"(1 + len(list_filter({_WORDS}, lambda w: w IN {_KEYWORDS}))"
    " + len(regexp_extract_all(content, '[\\p{L}\\p{N}_](&&|\\|\\|)[\\p{L}\\p{N}_]')))::DOUBLE"
)


def _first_seen(found: str) -> str:
    return (
        f"SELECT path, coalesce(list_aggregate(list_filter(f, lambda x, i: list_position(f, x) = i), "
        f"'string_agg', ','), '') AS names FROM (SELECT path, {found} AS f FROM py_files)"
    )


_FUNCTIONS = " || ".join(
    f"regexp_extract_all(content, {_quote(p)}, {g})" for p, g in settings.FUNCTION_PATTERNS
)
_CLASSES = " || ".join(f"regexp_extract_all(content, {_quote(p)}, 1)" for p in settings.CLASS_PATTERNS)


def _role_sql() -> str:
    parts = []
    for role, entries in settings.ROLE_PATTERNS.items():
        names = _in([e for e in entries if not e.endswith("/")])
        dirs = " OR ".join(f"contains('/' || path, '/{e}')" for e in entries if e.endswith("/")) or "false"
        parts.append(
            f"SELECT project, path, '{role}' AS role FROM text_files "
            f"WHERE regexp_extract(path, '([^/]*)$', 1) IN {names} OR {dirs}"
        )
    return f"WITH {TEXT_FILES} " + " UNION ALL ".join(parts)


_METRICS = r"""
  len(l) AS total_lines, len(list_filter(l, lambda x: trim(x) = '')) AS blank_lines,
  len(list_filter(l, lambda x: trim(x) <> '')) AS code_lines,
  list_max(list_transform(l, lambda x: length(x))) AS max_line_length,
  list_sum(list_transform(l, lambda x: length(x))) / len(l) AS avg_line_length
"""

# Greedy packing, one line at a time.
CHUNKS = r"""
chunk_lines AS (
  SELECT project, path, unnest(string_split(content, chr(10))) AS line,
         generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM text_files),
packed AS (
  SELECT project, path, ln, line, length(line) AS size, (length(line) > 1000)::INT AS chunk_no
  FROM chunk_lines WHERE ln = 1
  UNION ALL
  SELECT c.project, c.path, c.ln, c.line,
         CASE WHEN p.size + length(c.line) > 1000 THEN length(c.line) ELSE p.size + length(c.line) END,
         p.chunk_no + (p.size + length(c.line) > 1000)::INT
  FROM packed p JOIN chunk_lines c ON c.project = p.project AND c.path = p.path AND c.ln = p.ln + 1),
chunks AS (
  SELECT project, path, chunk_no, string_agg(line, chr(10) ORDER BY ln) AS chunk FROM packed GROUP BY ALL
  UNION ALL
  SELECT project, path, 0, '' FROM packed WHERE ln = 1 AND chunk_no = 1)
"""


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SUMMARY_HEAD, _SUMMARY_TAIL = settings.DEFAULT_SUMMARY_PROMPT
_CODE_HEAD, _CODE_MIDDLE, _CODE_TAIL = settings.CODE_PROMPT
PROMPTS = f"WITH RECURSIVE {TEXT_FILES}, {ELIGIBLE}, {CHUNKS}," + f"""
asked AS (
  SELECT project, path, 'summary' AS kind, -1 AS chunk_no,
         {_sql_text(_SUMMARY_HEAD)} || content || {_sql_text(_SUMMARY_TAIL)} AS prompt
  FROM eligible
  UNION ALL
  SELECT project, path, 'code', chunk_no,
         {_sql_text(_CODE_HEAD)} || {_language('ext')} || {_sql_text(_CODE_MIDDLE)} || chunk || {_sql_text(_CODE_TAIL)}
  FROM chunks JOIN eligible USING (project, path)
  WHERE {_language('ext')} NOT IN {_in(settings.TEXT_LANGUAGES)})
"""

REPLIES = r"""
replies AS (
  SELECT o_orderkey AS doc_id,
    CASE WHEN o_orderkey % 7 = 0 THEN E'Claro, segue:\nSugestão: solta\n' ELSE '' END
    || '- Linha ' || (o_orderkey % 40 + 1) || ': nome curto ' || o_orderkey
    || E'\n  Sugestão: total_' || o_orderkey || E' = 0\n'
    || CASE WHEN o_orderkey % 5 = 0 THEN E'- Linha dez: ruim\n  Sugestão: trocar\n' ELSE '' END
    || CASE WHEN o_orderkey % 3 > 0 THEN '- Linha ' || (o_orderkey % 90 + 1) || ': usa ' || o_orderstatus
         || E': sim\n\n  Explicação: prioridade ' || o_orderpriority || E'\n' ELSE '' END || 'Fim' AS response
  FROM orders),
reply_lines AS (
  SELECT doc_id, trim(unnest(string_split(response, chr(10)))) AS line,
         generate_subscripts(string_split(response, chr(10)), 1) AS pos FROM replies),
reply_marks AS (
  SELECT *, regexp_matches(line, '^- Linha.* [0-9]+:') AS good, starts_with(line, '- Linha') AS head
  FROM reply_lines),
reply_records AS (
  SELECT *, sum(good::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS record FROM reply_marks),
suggestions AS (
  SELECT doc_id, record::INT AS record,
         max(CASE WHEN good THEN regexp_extract(line, '([0-9]+):', 1)::BIGINT END) AS line,
         max(CASE WHEN good THEN trim(regexp_extract(line, ':(.*)$', 1)) END) AS message,
         arg_max(trim(substr(line, 10)), pos) FILTER (starts_with(line, 'Sugestão:')) AS suggested_code,
         arg_max(trim(substr(line, 12)), pos) FILTER (starts_with(line, 'Explicação:')) AS explanation,
         count(*) FILTER (head AND NOT good) AS bad
  FROM reply_records WHERE record >= 0 GROUP BY doc_id, record)
"""

PY_REPLIES = r"""
replies AS (
  SELECT o_orderkey AS doc_id,
    CASE WHEN o_orderkey % 4 = 0 THEN 'Original: solto ' || o_orderkey || E'\n' ELSE E'Olá\n' END
    || CASE WHEN o_orderkey % 2 = 0 THEN 'Linha ' ELSE 'Line ' END
    || CASE WHEN o_orderkey % 6 = 0 THEN '?' ELSE (o_orderkey % 70)::VARCHAR END
    || E':\nORIGINAL: x = ' || o_orderkey || E'\n  sugestão: y = a:b\n'
    || CASE WHEN o_orderkey % 3 = 0 THEN 'Explicação: ' || o_orderpriority || E'\nLinha 1 a 2: fim\n' ELSE '' END
    AS response
  FROM orders),
marks AS (
  SELECT *, regexp_matches(line, '^(Linha |Line )') AS head FROM (
    SELECT doc_id, trim(unnest(string_split(response, chr(10)))) AS line,
           generate_subscripts(string_split(response, chr(10)), 1) AS pos FROM replies)),
grouped AS (
  SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM marks),
folded AS (
  SELECT doc_id, g, bool_or(head) AS headed,
         coalesce(max(CASE WHEN head THEN
           TRY_CAST(regexp_replace(split_part(line, ':', 1), '[^0-9]', '', 'g') AS BIGINT) END), 0) AS line,
         arg_max(trim(substr(line, 10)), pos) FILTER (starts_with(lower(line), 'original:')) AS original_code,
         arg_max(trim(substr(line, 10)), pos) FILTER (starts_with(lower(line), 'sugestão:')) AS suggested_code,
         arg_max(trim(substr(line, 12)), pos) FILTER (starts_with(lower(line), 'explicação:')) AS explanation
  FROM grouped GROUP BY doc_id, g),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS record FROM folded
  WHERE headed OR original_code IS NOT NULL OR suggested_code IS NOT NULL OR explanation IS NOT NULL)
"""

LINT = r"""
lint AS (
  SELECT source AS project, doc_id,
    CASE WHEN length(text) % 11 = 0 THEN [] ELSE
      list_transform(string_split(text, chr(10)), lambda x, i: {
        'type': ['error', 'warning', 'refactor', 'convention'][length(x) % 4 + 1],
        'line': i, 'message': 'len ' || length(x), 'score': (length(x) % 100 / 10.0)::DOUBLE}) END AS m
  FROM documents)
"""

EVENTS = r"""
ev AS (SELECT *, (props::JSON ->> '$.k')::BIGINT AS k FROM events),
acc AS (SELECT event_id, 'k' || k AS key, ts, k * 37 + event_id % 7 * 10 + 100 + CASE WHEN event_id % 97 = 0 THEN 20000 ELSE 0 END AS size, event_type = 'view' AS hit,
               event_type AS cache_type FROM ev),
att AS (SELECT event_id // 4 AS task, event_id % 4 AS attempt, event_type AS task_name,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
               ts AS started, value AS seconds, event_type = 'view' AS cache_hit, event_id FROM ev),
stored AS (
  SELECT 'analysis_v' || (CASE WHEN event_type = 'signup' THEN 1 ELSE 2 END) || ':src' || (user_id % 20) || ':'
           || sha256('/p/' || k) AS key,
         CASE WHEN event_type = 'signup' THEN 1 ELSE 2 END AS version, 'src' || (user_id % 20) AS project,
         value AS data, ts, event_id FROM ev),
latest AS (SELECT key, any_value(project) AS project, arg_max(data, (ts, event_id)) AS data, max(ts) AS stored_at
           FROM stored WHERE version = 2 GROUP BY key),
last_access AS (SELECT key, max(ts) AS last_ts, arg_max(size, (ts, event_id)) AS size FROM acc GROUP BY key)
"""

_POINT = "(('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::UBIGINT / 4294967296.0)"


def _cohorts() -> str:
    total, reached, whens = sum(c.weight for c in catalog.COHORTS), 0.0, []
    for c in catalog.COHORTS:
        reached += c.weight
        whens.append(f"WHEN {_POINT} * {total!r}::DOUBLE <= {reached!r}::DOUBLE THEN '{c.name}'")
    return f"cohorts AS (SELECT c_custkey AS user_id, CASE {' '.join(whens)} END AS cohort FROM customer)"


def _fanout() -> str:
    kinds = {"signup": "workspace.created", "purchase": "changes.applied", "view": "analysis.started",
             "click": "analysis.completed", "error": "analysis.failed"}
    case = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items()) + " END"
    subs = " UNION ALL ".join(
        f"SELECT '{s['url']}' AS url, unnest({_list(s['event_types'])}) AS type"
        for s in derived.SUBSCRIPTIONS if s["event_types"]
    )
    return (
        f"WITH subs AS ({subs}), e AS (SELECT event_id, {case} AS type, 'ws' || user_id AS workspace_id, "
        "props AS payload FROM events) SELECT event_id, type, workspace_id, payload, url FROM e JOIN subs USING (type)"
    )


def _histogram() -> str:
    bounds = [(str(b), f"seconds <= {b}") for b in settings.DURATION_BUCKETS] + [("+Inf", "true")]
    parts = [
        f"SELECT task_name, '{le}' AS le, count(*) FILTER ({test}) AS observations, count(*) AS total_count, "
        "sum(seconds::DECIMAL(28,6))::DOUBLE AS total_seconds FROM att GROUP BY task_name"
        for le, test in bounds
    ]
    return f"WITH {EVENTS} " + " UNION ALL ".join(parts)


_TTL = settings.RESULT_TTL_SECONDS * 1_000_000
CHAIN = f"""
      t AS (SELECT key, epoch_us(ts) AS t FROM acc),
      nxt AS (SELECT key, t, min(t) OVER (PARTITION BY key ORDER BY t
                RANGE BETWEEN {_TTL + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS u FROM t),
      chain AS (
        SELECT key, min(t) AS t FROM t GROUP BY key
        UNION ALL
        SELECT chain.key, nxt.u FROM chain JOIN nxt ON nxt.key = chain.key AND nxt.t = chain.t
        WHERE nxt.u IS NOT NULL)
"""
_KEY_EVENTS = "SELECT user_id || ':' || props AS key, ts FROM events WHERE event_type = "
_BODY = "message || E'\\n' || suggestion"
_COMMENTS = ALL_SMELLS + r""",
changed AS (SELECT DISTINCT quality * 2 + toxic AS pr, source AS project, 'pkg/doc_' || doc_id || '.py' AS path,
                   md5('commit' || (quality * 2 + toxic)) AS commit_id FROM labels JOIN documents USING (doc_id)),
comments AS (SELECT pr, commit_id, project, path, line, 'RIGHT' AS side, """ + _BODY + r""" AS body
             FROM all_smells JOIN changed USING (project, path))
"""

_REPORT = f"{PY_LINES}, {TEXT_FILES}, {ELIGIBLE}," + rf"""
every AS (@EVERY@),
measured AS (
  SELECT project, path, ext, content, {_language('ext')} AS language, {_METRICS}
  FROM (SELECT *, string_split(content, chr(10)) AS l FROM every)),
py_complexity AS (SELECT path, 1 + sum(bools + branch2) AS complexity FROM py_lines GROUP BY path),
py_names AS (
  SELECT path, count(*) FILTER (regexp_matches(t, '^[ \t]*def[ \t]+\w')) AS functions,
         count(*) FILTER (regexp_matches(t, '^[ \t]*class[ \t]+\w')) AS classes
  FROM py_lines GROUP BY path),
generic AS (
  SELECT path, {KEYWORD_COUNT} AS complexity, len(list_distinct({_FUNCTIONS})) AS functions,
         len(list_distinct({_CLASSES})) AS classes
  -- Prose in a .py file is no Python and falls back to the patterns as well.
  FROM eligible WHERE {_language('ext')} NOT IN ('Text', 'Markdown', 'reStructuredText')),
analysed AS (
  SELECT m.*, coalesce(c.complexity, g.complexity, 0.0)::DOUBLE AS complexity,
         coalesce(n.functions, g.functions, 0) AS functions, coalesce(n.classes, g.classes, 0) AS classes
  FROM measured m LEFT JOIN py_complexity c USING (path) LEFT JOIN py_names n USING (path)
       LEFT JOIN generic g USING (path)),
totals AS (
  SELECT project, count(*) AS f, sum(code_lines) AS l, sum(functions) AS fn, sum(classes) AS cl
  FROM analysed GROUP BY project),
blocks AS (
  SELECT project, 1 AS section, '' AS path, [
    '# Relatório de Análise do Projeto', '', '## Visão Geral', '- Total de arquivos: ' || f,
    '- Total de linhas: ' || l, '- Total de funções: ' || fn, '- Total de classes: ' || cl, '',
    '## Linguagens Utilizadas'] AS b FROM totals
  UNION ALL
  SELECT project, 2, language, ['- ' || language || ': ' || count(*) || ' arquivo(s)'] FROM analysed
  GROUP BY project, language
  UNION ALL
  SELECT project, 3, '', ['', '## Análises de Arquivos', ''] FROM totals
  UNION ALL
  SELECT project, 3, path, [
    '### ' || path, '- Linguagem: ' || language, '- Linhas totais: ' || total_lines,
    '- Linhas em branco: ' || blank_lines, '- Linhas de conteúdo: ' || code_lines,
    '- Tamanho máximo de linha: ' || max_line_length,
    '- Tamanho médio de linha: ' || printf('%.1f', avg_line_length)]
    || CASE WHEN language IN {_in(settings.TEXT_LANGUAGES)} THEN []
       ELSE ['- Complexidade: ' || printf('%.1f', complexity)] END
  FROM analysed),
report AS (
  SELECT project, section, path, generate_subscripts(b, 1) - 1 AS seq, unnest(b) AS line FROM blocks)
"""
_ELIGIBLE_ROWS = "SELECT project, path, ext, content FROM eligible"
REPORT = "WITH " + _REPORT.replace(
    "@EVERY@", f"SELECT project, path, ext, content FROM py_files UNION ALL {_ELIGIBLE_ROWS}"
) + "SELECT * FROM report"
_REPLY = (
    "CASE WHEN kind = 'summary' THEN 'resumo ' || quality ELSE '- Linha ' || (chunk_no + 1) || ': trecho de ' "
    "|| length(prompt) || E' letras\\n  Explicação: nota ' || quality END"
)
FULL_REPORT = PROMPTS + "," + _REPORT.replace("@EVERY@", _ELIGIBLE_ROWS).replace(
    f"{TEXT_FILES}, {ELIGIBLE},", "", 1) + rf""",
answers AS (
  SELECT prompt, max({_REPLY}) AS response
  FROM asked JOIN labels ON doc_id = regexp_extract(path, '/d([0-9]+)/', 1)::BIGINT GROUP BY prompt),
attached AS (SELECT a.*, response FROM asked a LEFT JOIN answers USING (prompt)),
noted AS (SELECT * FROM attached WHERE kind = 'code' AND response IS NOT NULL)
SELECT * FROM report
UNION ALL
SELECT project, 3, path, unnest([100, 101, 102]),
       unnest(['', '#### Resumo do Arquivo', coalesce(response, {_quote(settings.NO_SUMMARY_TEXT)})])
FROM attached WHERE kind = 'summary'
UNION ALL
SELECT project, 3, path, unnest([200, 201]), unnest(['', '#### Sugestões de Melhoria'])
FROM (SELECT DISTINCT project, path FROM noted)
UNION ALL
SELECT project, 3, path, 1000 + chunk_no::BIGINT * 42949672960 + unnest([0, 1]),
       unnest([substr(split_part(response, chr(10), 1), 1), split_part(response, chr(10), 2)])
FROM noted
"""


ORACLE = {
    "files_scan": f"WITH {TEXT_FILES} SELECT project, path, ext, size, md5(content) AS body FROM text_files",
    "eligible_files": f"WITH {TEXT_FILES}, {ELIGIBLE} SELECT project, path, ext, size, "
                      "ext NOT IN ('', '.') AS has_extension FROM eligible",
    "tree_scan": f"WITH {PY_FILES} SELECT project, project || '/' || path AS path, '.py' AS ext, "
                 "strlen(content) AS size, md5(content) AS body, NULL::VARCHAR AS error FROM py_files "
                 "WHERE strlen(content) < 4000 AND project NOT IN ('src3', 'src7')",
    "ignored_by_rules": f"WITH {TEXT_FILES} SELECT DISTINCT project, path FROM (SELECT project, path, "
                        "split_part(path, '/', 1) AS top, split_part(path, '/', -1) AS name, "
                        "split_part(path, '/', -2) AS d FROM text_files) WHERE CASE "
                        "WHEN top IN ('vendor', 'node_modules') THEN true "
                        "WHEN top = 'docs' AND d NOT LIKE 'd1%' OR top = 'lib' AND d LIKE 'd%5' THEN true "
                        "WHEN top = 'src' THEN name LIKE '%.js' AND name <> 'app.min.js' OR name LIKE '%.txt' "
                        "WHEN top = 'lib' THEN name IN ('README.md', 'app.min.js') "
                        "WHEN top = '.github' THEN name = 'app.min.js' "
                        "ELSE name = 'app.min.js' OR name LIKE '%.txt' END",
    "ignored_files": f"WITH {TEXT_FILES} SELECT project, path FROM text_files WHERE path LIKE '%.min.js' "
                     "OR path LIKE 'vendor/%' OR path LIKE '%/vendor/%' OR "
                     + " OR ".join(f"contains('/' || path, '/{d}/')" for d in settings.SKIPPED_DIRECTORIES),
    "file_roles": _role_sql(),
    "language_counts": f"WITH {TEXT_FILES}, {ELIGIBLE} SELECT project, {_language('ext')} AS language, "
                       "count(*) AS files FROM eligible GROUP BY ALL",
    "file_metrics": f"WITH {TEXT_FILES} SELECT path, {_METRICS} "
                    "FROM (SELECT path, string_split(content, chr(10)) AS l FROM text_files)",
    "line_counts_g1": f"WITH {PY_FILES} SELECT project, path, len(l) - (l[-1] = '')::INT AS total_lines, "
                      "len(list_filter(l, lambda x: trim(x) = '')) - (l[-1] = '')::INT AS blank_lines, "
                      "len(list_filter(l, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS code_lines "
                      "FROM (SELECT project, path, string_split(content, chr(10)) AS l FROM py_files)",
    "keyword_complexity": f"WITH {TEXT_FILES}, {PY_FILES} SELECT path, {KEYWORD_COUNT} AS complexity FROM py_files "
                          f"UNION ALL SELECT path, {KEYWORD_COUNT} AS complexity FROM text_files",
    "function_names": f"WITH {PY_FILES} {_first_seen(_FUNCTIONS)}",
    "class_names": f"WITH {PY_FILES} {_first_seen(_CLASSES)}",
    "project_totals": f"WITH {PY_LINES} SELECT f.project, f.n AS total_files, f.lines AS total_lines, "
                      "e.fn AS total_functions, e.cl AS total_classes FROM "
                      "(SELECT project, count(DISTINCT path) AS n, count(*) FILTER (trim(raw) <> '') AS lines "
                      "FROM py_lines GROUP BY project) f JOIN (SELECT project, "
                      "count(*) FILTER (kind = 'function' AND NOT is_async) AS fn, "
                      "count(*) FILTER (kind = 'class') AS cl FROM py_entities GROUP BY project) e USING (project)",
    "project_sizes": f"WITH {TEXT_FILES} SELECT project, bytes, "
                     "CASE WHEN bytes < 1000000 THEN 3600 ELSE 600 END AS ttl_seconds, "
                     "bytes > 5000000 AS needs_partitioning FROM (SELECT project, sum(size) AS bytes FROM text_files "
                     "WHERE contains(regexp_extract(path, '([^/]*)$', 1), '.') GROUP BY project)",
    "dependencies": "SELECT 'part' || p_partkey AS project, 'Python' AS language, unnest(["
                    "split_part(p_name, ' ', 1) || '>=' || p_size || '.0', split_part(p_name, ' ', 2) || '==' || p_size"
                    "]) AS dependency FROM part UNION ALL SELECT 'part' || p_partkey, 'JavaScript', "
                    "unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || '-js']) FROM part",
    "lines": f"WITH {TEXT_FILES} SELECT project, path, generate_subscripts(l, 1) AS line_no, "
             "unnest(list_transform(l, lambda x: length(x) - length(ltrim(x, E' \\t')))) AS indent, unnest(l) AS text "
             "FROM (SELECT project, path, string_split(content, chr(10)) AS l FROM text_files)",
    "code_entities": f"WITH {PY_LINES} SELECT path, kind, name, start_line, end_line, is_async, params "
                     "FROM py_entities",
    "function_complexity": f"WITH {PY_LINES} SELECT path, name, start_line, complexity FROM py_entities "
                           "WHERE kind = 'function'",
    "file_complexity_py": f"WITH {PY_LINES} SELECT project, path, (1 + sum(bools + branch2))::DOUBLE AS complexity "
                          "FROM py_lines GROUP BY project, path",
    "class_members": f"WITH {PY_LINES} SELECT project, path, name, start_line, n_methods, "
                     "n_public AS n_public_methods, n_attributes, coalesce(methods, '') AS methods "
                     "FROM py_entities WHERE kind = 'class'",
    "entity_smells": f"WITH {SMELLS} SELECT * FROM py_smells",
    "duplicate_blocks": f"WITH {PY_FILES}, {DUPLICATES} SELECT * FROM py_duplicates",
    "smells": f"WITH {ALL_SMELLS} SELECT * FROM all_smells",
    "project_json": f"""WITH {DENSITY}
      SELECT project, 'metrics' AS kind, to_json({{'total_lines': total_lines::BIGINT,
        'total_functions': total_functions, 'total_classes': total_classes, 'code_lines': code_lines::BIGINT,
        'blank_lines': blank_lines::BIGINT, 'complexity': density}})::VARCHAR AS json FROM py_density
      UNION ALL
      SELECT project, 'smell', to_json({{'type': type, 'file': path, 'line': line, 'message': message,
        'severity': severity, 'suggestion': suggestion}})::VARCHAR FROM all_smells""",
    "smell_density": f"WITH {DENSITY} SELECT * FROM py_density",
    "report_lines": REPORT,
    "report_with_replies": FULL_REPORT,
    "prompts_g1": f"WITH {PY_FILES} SELECT path, {_sql_text(settings.PYTHON_CODE_PROMPT[0])} || content || "
                  f"{_sql_text(settings.PYTHON_CODE_PROMPT[1])} AS prompt FROM py_files",
    "text_chunks": f"WITH RECURSIVE {TEXT_FILES}, {CHUNKS} SELECT project, path, chunk_no, chunk FROM chunks",
    "prompts": PROMPTS + "SELECT project, path, kind, chunk_no, prompt FROM asked",
    "attach_responses": PROMPTS + rf""", answered AS (
      SELECT {_sql_text(_SUMMARY_HEAD)} || text || {_sql_text(_SUMMARY_TAIL)} AS prompt,
             'resumo ' || max(quality) AS response
      FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
    SELECT project, path, kind, chunk_no, sha256(prompt) AS prompt_hash,
           coalesce(response, CASE WHEN kind = 'summary' THEN {_quote(settings.NO_SUMMARY_TEXT)} END) AS response
    FROM asked LEFT JOIN answered USING (prompt)""",
    "parse_suggestions": f"WITH {REPLIES} SELECT * EXCLUDE (bad) FROM suggestions",
    "parse_suggestions_repeated": f"WITH {REPLIES} SELECT doc_id, record, line, message, suggested_code, explanation "
                                  "FROM (SELECT *, unnest(range(0, bad + 1)) FROM suggestions)",
    "parse_suggestions_g1": f"WITH {PY_REPLIES} SELECT doc_id, record, line, "
                            "coalesce(original_code, '') AS original_code, "
                            "coalesce(suggested_code, '') AS suggested_code, "
                            "coalesce(explanation, '') AS explanation, 0.8::DOUBLE AS confidence FROM kept",
    "lint_report": f"WITH {LINT} SELECT project, doc_id, coalesce(m[1].score, 0.0)::DOUBLE AS score, "
                   "len(w) AS warnings_count, coalesce(list_aggregate(list_transform(w, "
                   "lambda x: x.line || ':' || x.message), 'string_agg', ';'), '') AS errors FROM "
                   "(SELECT *, list_filter(m, lambda x: x.type IN ('warning', 'error')) AS w FROM lint)",
    "lint_checked_report": f"WITH {LINT} SELECT project, doc_id, coalesce(m[1].score, 0.0)::DOUBLE AS score, "
                   "len(w) AS warnings_count, coalesce(list_aggregate(list_transform(w, "
                   "lambda x: x.line || ':' || x.message), 'string_agg', ';'), '') AS errors FROM "
                   "(SELECT *, list_filter(m, lambda x: x.type IN ('warning', 'error')) AS w FROM lint WHERE doc_id % 7 NOT IN (1, 2, 3, 4))",
    "lint_quarantine": f"WITH {LINT} SELECT project, doc_id, ['empty', 'no JSON', 'no list', 'no message'][doc_id % 7] "
                       "AS problem, CASE doc_id % 7 WHEN 2 THEN length(raw) // 2 WHEN 3 THEN length(raw) + 13 "
                       "WHEN 4 THEN 20 END AS n_chars FROM (SELECT *, to_json(m)::VARCHAR AS raw FROM lint) "
                       "WHERE doc_id % 7 BETWEEN 1 AND 4",
    "lint_warnings": f"WITH {LINT} SELECT x.type AS type, count(*) AS warnings FROM "
                     "(SELECT unnest(m) AS x FROM lint) WHERE x.type IN ('warning', 'error') GROUP BY ALL",
    "result_keys": f"WITH {TEXT_FILES} SELECT path, 'analysis_v2:' || sha256(path) AS plain_key, "
                   "'analysis_v2:' || project || ':' || sha256(path) AS project_key FROM text_files",
    "request_status": f"""WITH r AS (
      SELECT event_id, CASE WHEN event_type = 'error' THEN '' WHEN value > 200 THEN 'gone' || user_id
                       ELSE 'src' || (user_id % 20) END AS path FROM events)
    SELECT event_id, path,
           CASE WHEN path = '' OR path NOT IN (SELECT source FROM documents) THEN 'ERROR' ELSE 'COMPLETED' END AS status,
           CASE WHEN path = '' THEN {_quote(settings.EMPTY_PATH_MESSAGE)}
                WHEN path NOT IN (SELECT source FROM documents) THEN {_quote(settings.MISSING_PATH_MESSAGE)} || path
                ELSE {_quote(settings.DONE_MESSAGE)} END AS message FROM r""",
    "review_comments": f"WITH {_COMMENTS} SELECT * FROM comments",
    "review_headers": f"WITH {_COMMENTS} SELECT pr, arg_min(commit_id, (project, path, line)) AS commit_id, "
                      f"{_quote(settings.REVIEW_BODY)} AS body, 'COMMENT' AS event, count(*) AS comments "
                      "FROM comments GROUP BY pr",
    "event_fanout": _fanout(),
    "new_keys": f"SELECT key, min(ts) AS first_ts, count(*) AS requests FROM ({_KEY_EVENTS}'click') "
                f"WHERE key NOT IN (SELECT key FROM ({_KEY_EVENTS}'purchase')) GROUP BY key",
    "new_keys_bitset": f"SELECT key, min(c.ts) AS first_ts, count(*) AS requests FROM ({_KEY_EVENTS}'click') c "
                       f"ANTI JOIN ({_KEY_EVENTS}'purchase') s USING (key) GROUP BY key",
    "cohort_assignment": f"WITH {_cohorts()} SELECT * FROM cohorts",
    "cohort_shares": f"WITH {_cohorts()} SELECT cohort, count(*) AS users, "
                     "count(*) / (SELECT count(*) FROM customer) AS share FROM cohorts GROUP BY cohort",
    "latest_result": f"WITH {EVENTS} SELECT key, data, stored_at FROM latest",
    "live_results": f"WITH {EVENTS} SELECT key, data, stored_at FROM latest WHERE stored_at + INTERVAL "
                    f"{catalog.LIVE_SECONDS} SECOND >= (SELECT max(ts) FROM stored)",
    "focused_files": f"WITH {TEXT_FILES} SELECT project, path FROM text_files WHERE "
                     + " OR ".join(f"starts_with(path, '{d}')" for d in catalog.FOCUS),
    "completed_prompts": PROMPTS + "SELECT DISTINCT sha256(prompt) AS prompt_hash, "
                                   "'letras: ' || length(prompt) AS response FROM asked",
    "invalidate_project": f"WITH {EVENTS} SELECT key, data FROM latest "
                          f"WHERE project NOT IN {_in(catalog.DROPPED_PROJECTS)}",
    "merge_results": f"WITH {EVENTS} SELECT 'src' || (user_id % 20) AS project, 'result' AS kind, 'k' || k AS key, "
                     "arg_max(value, event_id)::VARCHAR AS value FROM ev WHERE event_type <> 'error' GROUP BY ALL "
                     "UNION ALL SELECT 'src' || (user_id % 20), 'error', event_id::VARCHAR, 'value ' || value FROM ev "
                     "WHERE event_type = 'error'",
    "duration_histogram": _histogram(),
    "task_counters": f"WITH {EVENTS} SELECT task_name, count(*) FILTER (status = 'success') AS completed, "
                     "count(*) FILTER (status <> 'success') AS failures, count(*) FILTER (seconds > 300) AS timeouts, "
                     "count(*) FILTER (attempt > 0) AS retries, count(*) FILTER (cache_hit) AS hits, "
                     "count(*) FILTER (NOT cache_hit) AS misses FROM att GROUP BY task_name",
    "task_deadlines": f"WITH {EVENTS}, d AS (SELECT event_id, task, "
                      "round(seconds * 1000000)::BIGINT / 1e6::DOUBLE AS duration FROM att) "
                      "SELECT *, CASE WHEN duration > 300 THEN 'hard' WHEN duration > 240 THEN 'soft' ELSE 'ok' END "
                      "AS deadline FROM d",
    "gauge_last": f"WITH {EVENTS} SELECT event_type AS metric, 'core_' || k AS label, "
                  "arg_max(value, (ts, event_id)) AS value FROM ev GROUP BY ALL",
    "metrics_snapshot": f"WITH {EVENTS} SELECT count(*) FILTER (event_type <> 'error') AS tasks_completed, "
                        "count(*) FILTER (event_type = 'error') AS tasks_failed, "
                        "count(*) FILTER (event_type = 'view') AS cache_hits, "
                        "count(*) FILTER (event_type <> 'view') AS cache_misses, "
                        "arg_max(value, (ts, event_id)) FILTER (event_type = 'signup') AS active_tasks, "
                        "arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS cache_size, "
                        "arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS system_memory, "
                        "0.0::DOUBLE AS system_cpu FROM ev",
    "cache_hit_counts": f"WITH {EVENTS} SELECT cache_type, count(*) FILTER (hit) AS hits, "
                        "count(*) FILTER (NOT hit) AS misses FROM acc GROUP BY ALL",
    "attempt_rollup": f"WITH {EVENTS} SELECT task, arg_max(status, attempt) AS status, count(*) - 1 AS retries "
                      "FROM att WHERE attempt <= 3 GROUP BY task",
    "evict_oldest": f"WITH {EVENTS} SELECT key, last_ts, size, rn FROM (SELECT *, "
                    "row_number() OVER (ORDER BY last_ts, key) AS rn, count(*) OVER () AS n, "
                    "sum(size) OVER () AS used FROM last_access) "
                    f"WHERE used >= {catalog.EVICT_MEMORY} AND rn <= greatest(1, floor(0.1::DOUBLE * n))",
    "recency_budget": f"""WITH {EVENTS},
      puts AS (SELECT key, ts, size, row_number() OVER (ORDER BY ts, event_id) AS place FROM acc),
      steps AS (SELECT *, lag(place) OVER w AS prev_place, lag(size) OVER w AS prev_size,
                       lead(place) OVER w IS NULL AS is_last FROM puts WINDOW w AS (PARTITION BY key ORDER BY place)),
      kept AS (SELECT key, ts, size, place FROM steps WHERE is_last),
      needed AS (
        SELECT k.key, k.size + sum(s.size - CASE WHEN s.prev_place > k.place THEN s.prev_size ELSE 0 END)
               OVER (PARTITION BY k.key ORDER BY s.place) AS bytes
        FROM kept k JOIN steps s ON s.place > k.place),
      peaks AS (SELECT key, max(bytes) AS peak FROM needed GROUP BY key),
      held AS (SELECT k.* FROM kept k LEFT JOIN peaks USING (key) WHERE coalesce(peak, 0) <= {catalog.BUDGET_BYTES})
    SELECT key, ts AS last_ts, size, sum(size) OVER (ORDER BY place DESC) AS running FROM held""",
    "ttl_reuse": f"""WITH RECURSIVE {EVENTS}, {CHAIN},
      c AS (SELECT key, count(*) AS computed FROM chain GROUP BY key)
    SELECT key, computed, n - computed AS reused FROM c JOIN (SELECT key, count(*) AS n FROM t GROUP BY key)
    USING (key)""",
    "compute_points": f"WITH RECURSIVE {EVENTS}, {CHAIN} SELECT key, t FROM chain",
    "stream_ttl_points": f"WITH RECURSIVE {EVENTS}, {CHAIN} SELECT key, t FROM chain",
    "stream_compute_points": f"WITH RECURSIVE {EVENTS}, {CHAIN} SELECT key, t FROM chain",
    "rate_limited": f"WITH {EVENTS} SELECT event_id, task_name, rn FROM (SELECT *, row_number() OVER ("
                    f"PARTITION BY task_name, date_trunc('{catalog.RATE_WINDOW}', started) ORDER BY started, event_id) "
                    f"AS rn FROM att) WHERE rn <= {catalog.RATE_LIMIT}",
    "paced_runs": f"""WITH RECURSIVE {EVENTS},
      runs AS (SELECT event_id, task_name, epoch_us(started) AS t,
                      row_number() OVER (PARTITION BY task_name ORDER BY started, event_id) AS rn FROM att),
      walk AS (
        SELECT event_id, task_name, t, rn, t * {catalog.PACE} AS due FROM runs WHERE rn = 1
        UNION ALL
        SELECT r.event_id, r.task_name, r.t, r.rn,
               greatest(r.t * {catalog.PACE}, w.due + {catalog.PACE_SECONDS * 1_000_000}::BIGINT) AS due
        FROM walk w JOIN runs r ON r.task_name = w.task_name AND r.rn = w.rn + 1)
    SELECT event_id, task_name, (due + {catalog.PACE} - 1) // {catalog.PACE} - t AS waited FROM walk""",
    "key_heat": f"""WITH {EVENTS},
      b AS (SELECT key, epoch_us(ts) // 86400000000 AS x, count(*) AS y FROM acc GROUP BY ALL),
      s AS (SELECT key, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * x)::BIGINT AS sxx,
                   sum(x * y)::BIGINT AS sxy FROM b GROUP BY key),
      h AS (SELECT key, n AS buckets, sy AS accesses,
              CASE WHEN n * sxx - sx * sx = 0 THEN sy / n ELSE
                ((n * sxy - sx * sy) * (n * ((SELECT max(x) FROM b) + 1) - sx) + sy * (n * sxx - sx * sx))
                / (n * (n * sxx - sx * sx)) END AS heat FROM s)
    SELECT *, dense_rank() OVER (ORDER BY heat DESC) AS heat_rank FROM h""",
    "stream_event_fanout": _fanout(),
    "stream_last_access": f"WITH {EVENTS} SELECT key, last_ts FROM last_access",
    "stream_minute_counts": f"WITH {EVENTS} SELECT date_trunc('minute', ts) AS minute, cache_type, "
                            "count(*) AS accesses, count(*) FILTER (hit) AS hits, "
                            "count(*) FILTER (NOT hit) AS misses FROM acc GROUP BY ALL",
    "stream_latest_result": f"WITH {EVENTS} SELECT key, data, stored_at FROM latest",
    "stream_popular_keys": f"WITH {EVENTS} SELECT key, count(*) AS accesses FROM acc GROUP BY key "
                           f"ORDER BY accesses DESC, key LIMIT {catalog.TOP_KEYS}",
    "popular_keys": f"WITH {EVENTS} SELECT key, count(*) AS accesses FROM acc GROUP BY key "
                    f"ORDER BY accesses DESC, key LIMIT {catalog.TOP_KEYS}",
    "popular_keys_bounded": f"WITH {EVENTS} SELECT key, count(*) AS accesses FROM acc GROUP BY key "
                    f"ORDER BY accesses DESC, key LIMIT {catalog.TOP_KEYS}",
}

# The same results, read from the state of a stream.
ORACLE["stream_live_results"] = ORACLE["live_results"]
ORACLE["stream_popular_state"] = ORACLE["popular_keys"]
ORACLE["stream_minutes_closed"] = ORACLE["stream_minute_counts"]

# Column types as the Spark queries give them, where DuckDB's own differ.
_LINE_COLUMNS = ["total_lines", "blank_lines", "code_lines"]
_TYPES = {
    "file_metrics": dict.fromkeys([*_LINE_COLUMNS, "max_line_length"], "INTEGER"),
    "line_counts_g1": dict.fromkeys(_LINE_COLUMNS, "INTEGER"),
    "project_sizes": {"bytes": "BIGINT"},
    "lines": dict.fromkeys(["line_no", "indent"], "INTEGER"),
    "code_entities": dict.fromkeys(["start_line", "end_line", "params"], "INTEGER"),
    "function_complexity": dict.fromkeys(["start_line", "complexity"], "INTEGER"),
    "class_members": dict.fromkeys(
        ["start_line", "n_methods", "n_public_methods", "n_attributes"], "INTEGER"),
    "entity_smells": {"line": "INTEGER"},
    "duplicate_blocks": {"line": "INTEGER"},
    "smells": {"line": "INTEGER"},
    "smell_density": dict.fromkeys(_LINE_COLUMNS, "BIGINT"),
    "report_lines": {"seq": "BIGINT"},
    "report_with_replies": {"seq": "BIGINT"},
    "parse_suggestions_g1": {"record": "INTEGER"},
    "lint_report": {"warnings_count": "INTEGER"},
    "review_comments": {"line": "INTEGER"},
    "recency_budget": {"running": "BIGINT"},
    "rate_limited": {"rn": "INTEGER"},
}
for _name, _columns in _TYPES.items():
    _casts = ", ".join(f"{c}::{t} AS {c}" for c, t in _columns.items())
    ORACLE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE[_name]})"
