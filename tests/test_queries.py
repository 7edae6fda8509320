"""Every core query against its DuckDB equivalent on the smallest tables; the others must give rows."""

import glob
import math
import os

import duckdb
import pytest

from simplicia.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, str):
            return v
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")

    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def close(a, b):
    return a == b or (a not in ("null",) and b not in ("null",) and a.lstrip("-")[:1].isdigit() and b.lstrip("-")[:1].isdigit() and abs(float(a) - float(b)) < 2e-5 * max(1, abs(float(a))))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    want = rows(columns, rel.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.fixture
def many_partitions(spark):
    """200 partitions, which adaptive execution joins up as it likes."""
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


UNITED = ["compare_vectors", "dtm_weights", "false_neighbours", "h0_significant", "knn_r2", "selection_counts", "shape_weights", "topk_scan", "weighted_matrix", "window_vectors"]


@pytest.mark.parametrize("name", UNITED)
def test_against_sql_with_many_partitions(spark, duck, many_partitions, name):
    test_against_sql(spark, duck, name)


def test_one_matrix_a_cloud(spark, many_partitions):
    from simplicia.operators import homology
    from simplicia.plans import series

    p = series.pairs(spark, SF)
    m = homology.as_matrices(p, "user_id").collect()
    assert len(m) == p.select("user_id").distinct().count() and all(len(r) == len(x["points"]) for x in m for r in x["points"])
    assert QUERIES["compare_filtrations"](spark, SF).groupBy("filtration").count().select("count").distinct().count() == 1
