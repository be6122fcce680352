"""Interval joins against DuckDB's nested loops."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import interval_join as interval_join_module
from tidegauge.operators.interval_join import interval_join


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)

    def rows(n):
        out = []
        for i in range(n):
            s = rng.choice([None, 0, rng.randint(-1000, 1000), rng.randint(-10**9, 10**9)]) if i % 9 else 500
            e = None if s is None or rng.random() < 0.03 else s + rng.choice([0, 0, 1, 7, rng.randint(0, 300), rng.randint(-5, 10**6), 10**12])
            out.append((i, rng.choice([None, 0, 0, 1, 2]), s, e))
        return out

    left = spark.createDataFrame(rows(300), "a long, k long, s long, e long").repartition(3).cache()
    right = spark.createDataFrame(rows(250), "b long, k long, t long, u long").repartition(2).cache()
    con = duckdb.connect()
    con.register("l", left.toPandas().astype("Int64"))
    con.register("r", right.toPandas().astype("Int64"))
    return left, right, con


@pytest.mark.parametrize("crowded", [4_000_000, 50])
@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_keyed_join(tables, how, closed, crowded):
    left, right, con = tables
    op = "<=" if closed else "<"
    want = con.sql(f"SELECT a, b FROM l {how} JOIN r ON l.k = r.k AND s <= e AND t <= u AND s {op} u AND t {op} e").df()
    got = interval_join(left, right, ("s", "e"), ("t", "u"), ["k"], how, closed, crowded, 7)
    assert got.columns == ["a", "k", "s", "e", "b", "t", "u"]
    assert sorted(((r.a, r.b) for r in got.collect()), key=str) == sorted(((a, None if pd.isna(b) else b) for a, b in want.itertuples(index=False)), key=str) and len(want) > 1000


def test_join_without_a_key_needs_no_nested_loop(tables):
    left, right, con = tables
    theirs = right.drop("k")
    got = interval_join(left, theirs, ("s", "e"), ("t", "u"))
    want = con.sql("SELECT a, b FROM l JOIN r ON s <= u AND t <= e AND s <= e AND t <= u").fetchall()
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_points_in_spans_of_time(spark):
    """Timestamps, dates and fractions; a point is an interval of length 0."""
    con = duckdb.connect()
    points = spark.range(400).select(F.col("id").alias("p"), F.timestamp_micros(F.col("id") * 7_919_000_003 % 10**12).alias("ts"))
    spans = spark.range(60).select(F.col("id").alias("q"), F.timestamp_micros(F.col("id") * 104_729_000_007 % 10**12).alias("opens")).withColumn("closes", F.expr("opens + make_dt_interval(0, q % 7, q)"))
    con.register("points", points.toPandas())
    con.register("spans", spans.toPandas())
    got = interval_join(points, spans, ("ts", "ts"), ("opens", "closes"), closed=False)
    assert sorted((r.p, r.q) for r in got.collect()) == sorted(con.sql("SELECT p, q FROM points, spans WHERE ts < closes AND opens < ts").fetchall()) and got.count() > 100
    days = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    one = spark.range(50).select(F.col("id").alias("x"), days(F.col("id") * 3).alias("f"), days(F.col("id") * 3 + F.col("id") % 5).alias("g"))
    two = spark.range(50).select(F.col("id").alias("y"), days(F.col("id") * 2).alias("h"), days(F.col("id") * 2 + 1).alias("i"))
    assert interval_join(one, two, ("f", "g"), ("h", "i")).count() == one.join(two, F.expr("f <= i and h <= g")).count()
    three = spark.range(40).select((F.col("id") / 4).alias("f"), (F.col("id") / 4 + 0.1).alias("g"))
    four = spark.range(40).select((F.col("id") / 5).alias("h"), (F.col("id") / 5 + 0.1).alias("i"))
    assert interval_join(three, four, ("f", "g"), ("h", "i")).count() == three.join(four, F.expr("f <= i and h <= g")).count()


def test_one_bin_with_all_rows_is_cut(spark, tables):
    """Rows of one and the same interval: the pairs are many, the rows of a cell are not."""
    rows = spark.range(200).select(F.col("id").alias("a"), F.lit(3).alias("s"), F.lit(9).alias("e"))
    got = interval_join(rows, rows.toDF("b", "t", "u"), ("s", "e"), ("t", "u"), crowded=1000, cell=20)
    assert got.count() == got.distinct().count() == 40_000
    assert "__i" in got._jdf.queryExecution().toString()


def test_empty_tables(tables):
    left, right, _ = tables
    assert interval_join(left.limit(0), right, ("s", "e"), ("t", "u"), ["k"]).count() == 0
    assert interval_join(left, right.limit(0), ("s", "e"), ("t", "u"), ["k"], "left").count() == 300


def test_few_candidates_a_pair(spark):
    """Rows that meet in a bin are at most some two for each pair of a point and an interval."""
    points = spark.range(20_000).select(F.col("id").alias("p"), (F.col("id") * 3).alias("at"))
    spans = spark.range(60).select(F.col("id").alias("q"), (F.col("id") * 900).alias("s"), (F.col("id") * 950 + 300 + F.col("id") * 40).alias("e"))
    one, other = interval_join_module._levelled(points, ("at", "at"), [], "a"), interval_join_module._levelled(spans, ("s", "e"), [], "b")
    levels = [interval_join_module._levels(t) for t in (one, other)]
    binned = [interval_join_module._binned(t, other_levels).where(f"__at in ({','.join(map(str, levels[1]))})") for t, other_levels in ((one, levels[1]), (other, levels[0]))]
    candidates = binned[0].join(binned[1].withColumnRenamed("__level", "__level_b"), ["__at", "__bin"]).where("greatest(__level, __level_b) = __at").count()
    pairs = interval_join(points, spans, ("at", "at"), ("s", "e")).count()
    assert pairs == points.join(spans, F.expr("s <= at and at <= e")).count() and candidates < 2.1 * pairs


def test_what_is_shuffled_grows_with_the_rows_not_the_pairs(spark):
    """Crowded rows listed level by level and cell by cell made 182 bytes a row here, and more a row with more rows."""
    n = 40_000
    points = spark.range(n).select(F.col("id").alias("p"), (F.col("id") * 7919 % 1_000_000).alias("at"))
    spans = spark.range(n // 4).select(F.col("id").alias("q"), (F.col("id") * 104_729 % 1_000_000).alias("s")).withColumn("e", F.expr("s + q * 31 % 200000"))
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert interval_join(points, spans, ("at", "at"), ("s", "e")).count() == 31_588_365
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shuffled() - before < 80 * (n + n // 4)


@pytest.mark.parametrize("closed", [True, False])
def test_crowded_intervals_of_both_tables(spark, closed):
    """Several blocks, runs and cells; ends that meet, copies, fractions, values at both ends of the axis, and a column that can't be compared."""
    rng = random.Random(9)

    def rows(n):
        ends = [(s, s + rng.choice([0, 0, 1, 2.5, rng.randint(0, 400)])) for s in (rng.choice([5, rng.randint(0, 2000), rng.randint(0, 2000) + 0.5]) for _ in range(n))]
        return [(i // 2, float(s), float(e)) for i, (s, e) in enumerate(ends)] + [(-1, -8e18, -8e18), (-2, 8e18, 8e18)]

    left = spark.createDataFrame(rows(1500), "a long, s double, e double").withColumn("more", F.create_map(F.lit("x"), "a"))
    right = spark.createDataFrame(rows(1200), "b long, t double, u double")
    op = "<=" if closed else "<"
    want = left.crossJoin(right).where(f"s {op} u and t {op} e").groupBy("a", "b", "s", "t", "e", "u").count()
    got = interval_join(left, right, ("s", "e"), ("t", "u"), closed=closed, crowded=1000, cell=600)
    assert got.columns == ["a", "s", "e", "more", "b", "t", "u"]
    assert {tuple(r) for r in got.groupBy("a", "b", "s", "t", "e", "u").count().collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("crowded", [4_000_000, 50])
def test_times_without_a_zone_in_an_hour_that_a_zone_skips(spark, crowded):
    minutes = lambda c: F.expr(f"timestamp_ntz'2024-03-10 00:00:00' + make_dt_interval(0, 0, {c})")
    points = spark.range(300).toDF("p").withColumn("at", minutes("p"))
    spans = spark.range(300).toDF("q").withColumn("s", minutes("q")).withColumn("e", minutes("q + q % 90"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = interval_join(points, spans, ("at", "at"), ("s", "e"), crowded=crowded, cell=40)
        assert sorted((r.p, r.q) for r in got.collect()) == [(p, q) for p in range(300) for q in range(300) if q <= p <= q + q % 90]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
