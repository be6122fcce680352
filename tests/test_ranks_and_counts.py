"""Ranks with ties across borders, exact percentiles and cubes of distinct counts against DuckDB."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.distinct_cube import distinct_cube
from tidegauge.operators.percentiles import exact_percentiles
from tidegauge.operators.ranks import ranked


def rows_of(df) -> list:
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, 7, 7, 7, rng.randint(0, 40)]), float(rng.randint(0, 10**6)) / 7, rng.choice(["x", "y", None]), rng.choice([None, *"abcdefgh"])) for i in range(1200)]
    rows += [(5000 + i, "flat", 3, 1.5, "z", "a") for i in range(300)] + [(7000, "none", None, None, "y", None), (7001, "one", 1, -0.5, None, None)]
    return spark.createDataFrame(rows, "id long, k string, v long, d double, e string, w string").repartition(4).cache()


@pytest.fixture(scope="module")
def duck(samples):
    con = duckdb.connect()
    con.register("t", samples.toPandas().astype({"v": "Int64"}))
    con.sql("CREATE VIEW u AS SELECT id, k, v, CASE WHEN d = d THEN d END AS d, e, w FROM t")
    return con


@pytest.mark.parametrize("ranges", [1, 3, 25, 200])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks(samples, duck, ranges, descending):
    way = "DESC NULLS LAST" if descending else "NULLS FIRST"
    got = ranked(samples.select("id", "v"), ["v"], ["id"], 11, descending, ranges)
    want = duck.sql(f"""SELECT id, v, row_number() OVER t AS position, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist, ntile(11) OVER t AS ntile
        FROM u WINDOW w AS (ORDER BY v {way}), t AS (ORDER BY v {way}, id)""").df()
    assert got.columns == list(want.columns)
    assert rows_of(got.toPandas().astype({"v": "Int64"})) == rows_of(want)


def test_ranks_of_few_rows(spark, samples):
    one = ranked(samples.where("id = 3"), ["v"], ["id"], 4).collect()
    assert [(r.position, r["rank"], r.dense_rank, r.percent_rank, r.cume_dist, r.ntile) for r in one] == [(1, 1, 1, 0.0, 1.0, 1)]
    assert ranked(samples.limit(0), ["v"], ["id"]).count() == 0
    assert [r.ntile for r in ranked(spark.range(3), ["id"], [], 7, ranges=2).orderBy("id").collect()] == [1, 2, 3]
    equal = ranked(samples.select("id", F.lit(1).alias("v")), ["v"], ["id"], 4, ranges=9)
    assert equal.where("rank = 1 and dense_rank = 1 and cume_dist = 1.0 and percent_rank = 0.0").count() == samples.count()


def test_no_range_of_ranks_holds_a_hot_value(samples):
    """Equal values are dealt over ranges by the tie-breaker, and no window goes over the whole table."""
    plan = ranked(samples, ["v"], ["id"], ranges=20)
    held = [r["count"] for r in samples.repartitionByRange(20, "v", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < 250 < samples.where("v = 7").count()
    assert plan.count() == samples.count()


@pytest.mark.parametrize("few, cuts", [(10_000, 16), (100, 4), (1, 2)])
def test_percentiles(samples, duck, few, cuts):
    shares = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    listed = ", ".join(map(str, shares))
    for value in ("v", "d"):
        got = exact_percentiles(samples, ["k"], value, shares, few, cuts)
        want = duck.sql(f"SELECT k, unnest([{listed}])::DOUBLE AS share, unnest(quantile_disc({value}, [{listed}])) AS {value} FROM u GROUP BY k HAVING count({value}) > 0").df()
        assert got.columns == list(want.columns)
        assert rows_of(got.toPandas()) == rows_of(want.astype({value: float}) if value == "d" else want)
    both = exact_percentiles(samples, ["k", "e"], "d", [0.5], few, cuts)
    assert rows_of(both.toPandas()) == rows_of(duck.sql("SELECT k, e, 0.5::DOUBLE AS share, quantile_disc(d, 0.5) AS d FROM u GROUP BY k, e HAVING count(d) > 0").df())
    overall = exact_percentiles(samples, [], "d", [0.25, 0.75], few, cuts).orderBy("share").collect()
    assert tuple(r.d for r in overall) == duck.sql("SELECT quantile_disc(d, 0.25), quantile_disc(d, 0.75) FROM u").fetchall()[0]


def test_percentiles_of_nothing(samples):
    assert exact_percentiles(samples.limit(0), ["k"], "v", [0.5]).count() == exact_percentiles(samples.limit(0), [], "v", [0.5]).count() == 0
    assert exact_percentiles(samples.where("k = 'none'"), ["k"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("value", ["v", "w", "id"])
def test_cube_of_distinct_counts(samples, duck, value):
    got = distinct_cube(samples, ["k", "e"], value)
    want = duck.sql(f"SELECT k, e, grouping(k, e) AS grouping_id, count(DISTINCT {value}) AS n_distinct FROM u GROUP BY CUBE (k, e)").df()
    assert rows_of(got.toPandas()) == rows_of(want)


def test_cube_beyond_one_bitmap(spark):
    """More values than a bitmap has bits."""
    df = spark.range(70_000).select((F.col("id") % 2).alias("a"), (F.col("id") % 50_000).alias("v"))
    got = {(r.a, r.grouping_id): r.n_distinct for r in distinct_cube(df, ["a"], "v").collect()}
    assert got == {(0, 0): 25_000, (1, 0): 25_000, (None, 1): 50_000}
