"""The driver's contract, and queries against their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def values(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def plans():
    from assayer.plans import queries, report_queries, report_sql, rule_queries, rule_sql, sql

    return queries.QUERIES | rule_queries.QUERIES | report_queries.QUERIES, sql.ORACLE_SQL | rule_sql.ORACLE_SQL | report_sql.ORACLE_SQL


def names():
    return sorted(plans()[1])


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    import duckdb

    queries, sql = plans()
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = queries[name](spark, SF)
    want = con.execute(sql[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert values([tuple(r) for r in df.collect()], df.columns) == values(want.fetchall(), columns)


def test_queries_without_the_training_data_folders(tmp_path):
    """The rest works where the subpackage, its tests and perhaps the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for gone in (("assayer/llm",), ("assayer/llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(gone))
        copy.mkdir()
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if (root / name).exists() and name not in gone:
                shutil.copy(root / name, copy)
        shutil.copytree(root / "assayer", copy / "assayer", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'crap_score' in q and set(s) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
