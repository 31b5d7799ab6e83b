"""Every query runs on the smallest tables, and a SQL twin gives the same rows."""

import os

import duckdb
import numpy as np
import pytest

from tempora.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or (isinstance(x, float) and np.isnan(x)) else float(x) if isinstance(x, (int, float, np.integer, np.floating)) else x
    return sorted(repr([plain(x) for x in r]) for r in df.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    got = catalogue.queries()[name](spark, D).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
        assert rows(got) == rows(c.execute(sql).df())


def test_entry_without_training_package():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "candidate_scores" in e.queries()
