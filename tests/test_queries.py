"""Every registered query of the engine against its DuckDB SQL."""

import glob
import math
import os

import duckdb
import pytest

import millrace.plans.io_queries  # noqa: F401  (registers queries)
from millrace.plans.queries import ORACLE, QUERIES


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in records], key=str)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name in ORACLE:
        cursor = duck.execute(ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, cursor.fetchall())


def test_filters_reach_the_scan(spark, sf, capsys):
    QUERIES["filter_project"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(value,100.0)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan


def test_the_entry_points(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_core_does_not_need_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys\nsys.modules['millrace.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'tumble_aggs' in q and not [n for n in q if n.startswith('op')]\nassert not [m for m in sys.modules if m.startswith('millrace.llm.')]"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
