"""Every query with SQL gives the SQL's rows; the others give rows."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from gleanery.plans.catalogue import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for name in os.listdir(SMALL):
        out.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{name}')")
    return out


def as_rows(columns, rows):
    return sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert as_rows(df.columns, rows) == as_rows(want.columns, want.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["score_bins", "stratified_pair_sample"])
def test_scores_at_the_edges_of_bins(spark, tmp_path, name):
    """Vectors of 20 signs have scores a rounding error away from the edges, which the SQL rounds."""
    rng = np.random.default_rng(1)
    signs = [(i, rng.choice([-1.0, 1.0], 20).tolist(), i % 3) for i in range(60)]
    spark.createDataFrame(signs, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
    assert as_rows(got.columns, got.collect()) == as_rows(want.columns, want.fetchall())
