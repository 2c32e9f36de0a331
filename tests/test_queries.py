"""Every registered query with SQL, against DuckDB on the smallest tables; and the contract's guard."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quasilattice.plans import feature_queries, operator_queries, table_queries, text_queries

DATA = "/root/testdata/sf0.001"
QUERIES = table_queries.QUERIES | text_queries.QUERIES | feature_queries.QUERIES | operator_queries.QUERIES
ORACLE = table_queries.ORACLE_SQL | text_queries.ORACLE_SQL | feature_queries.ORACLE_SQL | operator_queries.ORACLE_SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    same = lambda x: int(x) if isinstance(x, float) and x == int(x) else x  # noqa: E731  pandas makes floats of integers with nulls
    return sorted(str(tuple(None if pd.isna(x) else same(x) for x in row)) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    want, got = duck.execute(ORACLE[name]).df(), QUERIES[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert plain(want) == plain(got)


def test_changed_tables_are_loaded_again(spark, tmp_path):
    orders = [(1, 1, "2-HIGH"), (1, 2, "2-HIGH")]
    for n in (1, 2):
        spark.createDataFrame(orders[:n], "o_custkey long, o_orderkey long, o_orderpriority string").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        assert text_queries.propagate_full(spark, str(tmp_path)).count() == n


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) == set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """As if the subpackage and the pipeline weren't there."""
    code = "import sys; sys.modules['quasilattice.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'natural_key_merge' in q and not any(k.startswith('op1') or k == 'pipeline' for k in q); import quasilattice as m; [getattr(m, n) for n in m.__all__]"
    subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, check=True)
