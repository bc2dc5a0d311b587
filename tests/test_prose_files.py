"""Text files that end in .py: prose, also where Python happens to accept it."""

import duckdb
import pytest

import __spark_entry__ as entry

PROSE = "Aning### in%%% theawh for&&& das for(x) if*** und."
TABLES = {
    "documents": f"SELECT i::BIGINT AS doc_id, '{PROSE}' AS text, 'en' AS lang, 'src' || i % 2 AS source, "
                 f"{len(PROSE)}::BIGINT AS n_chars FROM range(40) t(i)",
    "labels": "SELECT i::BIGINT AS doc_id, (i % 2)::INT AS quality, 0 AS toxic FROM range(0, 40, 3) t(i)",
}


@pytest.mark.parametrize("name", ["report_lines", "report_with_replies"])
def test_prose_that_python_accepts_is_judged_by_patterns(spark, tmp_path, name):
    con = duckdb.connect()
    for table, rows in TABLES.items():
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    compile(PROSE, "setup.py", "exec")
    df = entry.queries()[name](spark, str(tmp_path))
    ours = sorted(tuple(row) for row in df.select("project", "section", "path", "seq", "line").collect())
    theirs = con.execute(f"SELECT project, section, path, seq, line FROM ({entry.oracle_sql()[name]})").fetchall()
    assert ours == sorted(theirs)
    assert any(r[2] == "tests/d1/setup.py" and r[4] == "- Complexidade: 4.0" for r in ours)
