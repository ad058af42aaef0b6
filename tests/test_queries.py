"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math
import os
import re

import duckdb
import pytest

from tidemark.plans.queries import QUERIES, SQL, entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    r = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert not [t for t in r.types if re.match("DECIMAL|HUGEINT", str(t))]
    at = [r.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, row)) for row in df.collect()) == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())


def test_queries_without_sql_run(spark, sf_dir):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert entry(spark, sf_dir).count() == 5


def test_rest_works_without_the_llm_parts(tmp_path):
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for n in ("__spark_entry__.py", "tidemark"):
        os.symlink(f"{top}/{n}", tmp_path / n) if n.endswith(".py") else None
    (tmp_path / "tidemark").mkdir()
    for n in os.listdir(f"{top}/tidemark"):
        if n not in ("llm", "__pycache__"):
            os.symlink(f"{top}/tidemark/{n}", tmp_path / "tidemark" / n)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 90 and not any(k.startswith('op') and k[2:3].isdigit() or k == 'pipeline' for k in q); assert e.oracle_sql()"
    (tmp_path / "entry.py").write_text(open(f"{top}/__spark_entry__.py").read())
    subprocess.run([sys.executable, "-c", code.replace("__spark_entry__", "entry")], cwd=tmp_path, check=True)
