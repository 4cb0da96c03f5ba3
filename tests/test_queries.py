"""Every query of the engine against its SQL."""

import pytest
from compare import connect, rows_of, rows_of_sql, same

from weirflow import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, sf_dir, con, name):
    cols, got = rows_of(queries.QUERIES[name](spark, sf_dir))
    want_cols, want = rows_of_sql(con, queries.SQL[name])
    assert cols == want_cols
    assert len(got) == len(want)
    assert same(got, want)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sweep_counts_its_roots(spark, size):
    at = f"/root/testdata/{size}"
    want = spark.read.parquet(f"{at}/customer.parquet").where("c_custkey % 40 = 1").count()
    assert queries.QUERIES["sweep_report"](spark, at).first().refs_scanned == want
