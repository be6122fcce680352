"""Windows over split series give what whole series give, however they are cut."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import segments, series


@pytest.fixture(scope="module")
def samples(spark):
    """1,500 samples of nine series and a null one; one series has a third of all rows, some values are null, counters fall."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("hot")).when(n % 29 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), (n % 8).cast("string")))
    value = F.when(n % 5 < 2, ((n * 7919) % 1009).cast("double"))
    ts = F.timestamp_micros(n * 700_000 - (n % 11 == 0).cast("long") * 2_100_000)
    df = spark.range(1500).select(key.alias("series"), n.alias("event_id"), value.alias("value"), ts.alias("ts"), ((n * 7919) % 4001 + n * 20).alias("counter"), F.lit("x").alias("n"))
    return df.repartition(5).cache()


def same(got, want) -> None:
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("parts", [1, 2, 7, 90])
def test_split_series_give_whole_series_results(samples, parts):
    key, order = ["series"], ["event_id"]
    for baseline in ("null", "zero"):
        same(segments.rates(samples, key, order, "counter", "ts", 10.0, baseline, parts), series.rates(samples, key, order, "counter", "ts", 10.0, baseline))
    same(segments.rolling_range(samples, key, order, "value", segments=parts), series.rolling_range(samples, key, order, "value"))
    same(segments.carried_forward(samples, key, order, "value", "carried", parts), series.carried_forward(samples, key, order, "value", "carried"))


@pytest.mark.parametrize("parts", [1, 6, 60])
def test_sums_and_places(samples, parts):
    con = duckdb.connect()
    t = samples.toPandas()
    con.register("t", t)
    want = con.sql("SELECT series, event_id, sum(value) OVER w AS s, row_number() OVER w - 1 AS at FROM t WINDOW w AS (PARTITION BY series ORDER BY event_id ROWS UNBOUNDED PRECEDING)").df()
    want = {(r.series, r.event_id): (None if r.s != r.s else r.s, r.at) for r in want.itertuples()}
    sums = segments.running_sum(samples, ["series"], ["event_id"], "value", "s", parts).collect()
    places = segments.numbered(samples, ["series"], ["event_id"], "at", parts).collect()
    assert {(r.series, r.event_id): r.s for r in sums} == {k: s for k, (s, _) in want.items()} and len(sums) == 1500
    assert {(r.series, r.event_id): r["at"] for r in places} == {k: a for k, (_, a) in want.items()}


def test_one_series_without_a_key(samples):
    same(segments.rolling_range(samples, [], ["event_id"], "value", 20, 11), series.rolling_range(samples, [], ["event_id"], "value", 20))
    same(segments.rolling_range(samples, ["series"], ["event_id"], "value", 1, 3), series.rolling_range(samples, ["series"], ["event_id"], "value", 1))


def test_no_task_holds_more_than_a_segment(samples):
    """A series with a third of the rows is spread over many parts, and a halo adds at most 59 rows to each."""
    cuts = segments.cut(samples, ["series"], ["event_id"], 30)
    held = [r["count"] for r in cuts.rows.groupBy("__part").count().collect()]
    assert len(held) > 20 and max(held) < 120
    extra = segments.with_halo(cuts, 59).where("__halo").groupBy("__part").count().collect()
    assert len(extra) > 5 and max(r["count"] for r in extra) == 59
    assert segments.carries(cuts, {"n": F.count("*")}, {"n": F.sum}).count() <= len(held)


def test_empty_tables(samples):
    none = samples.limit(0)
    assert segments.rates(none, ["series"], ["event_id"], "counter", "ts", segments=4).count() == segments.rolling_range(none, ["series"], ["event_id"], "value").count() == 0
    assert segments.downsampled(none, ["series"], ["event_id"], "value", 5).count() == segments.asof_join(none, none.withColumnRenamed("value", "v"), ["series"], ["ts", "event_id"], ["ts", "event_id"], ["v"]).count() == 0


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("width", [7, 23, 50, 100])
def test_downsampling_in_long_form_is_that_of_arrays(samples, width, exact):
    whole = samples.where("value is not null")
    got = segments.downsampled(whole, ["series"], ["event_id"], "value", width, exact, 9)
    arrays = series.history_arrays(whole, ["series"], ["event_id"], "value", 10_000)
    want = arrays.select("series", F.posexplode(series.downsampled(F.col("values"), width, exact)).alias("idx", "value"))
    same(got, want)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("parts", [1, 5, 40])
def test_asof_join_is_duckdbs(spark, parts, strict):
    n = F.col("id")
    left = spark.range(900).select(F.when(n % 3 == 0, 0).when(n % 50 == 1, F.lit(None)).otherwise(n % 5).alias("k"), n.alias("a"), F.when(n % 40 == 7, F.lit(None)).otherwise(F.timestamp_micros((n * 7919 % 300) * 1_000_000)).alias("lt"))
    right = spark.range(400).select(F.when(n % 50 == 1, F.lit(None)).otherwise(n % 4).alias("k"), n.alias("b"), F.when(n % 30 == 7, F.lit(None)).otherwise(F.timestamp_micros((n * 104729 % 350) * 1_000_000)).alias("rt"), F.when(n % 6 > 0, n * 2).alias("v"))
    con = duckdb.connect()
    con.register("l", left.toPandas())
    con.register("r", right.toPandas())
    once = "(SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k, rt ORDER BY b DESC) = 1)"
    want = con.sql(f"SELECT l.a, r.b, r.v FROM l ASOF LEFT JOIN {once} r ON l.k = r.k AND l.lt {'>' if strict else '>='} r.rt").df()
    want = sorted((a, *(None if pd.isna(x) else int(x) for x in (b, v))) for a, b, v in want.itertuples(index=False))
    got = segments.asof_join(left, right, ["k"], ["lt", "a"], ["rt", "b"], ["b", "v"], strict=strict, segments=parts)
    assert got.columns == ["k", "a", "lt", "b", "v"]
    assert sorted(((r.a, r.b, r.v) for r in got.collect()), key=lambda t: t[0]) == want and len(want) == 900
    near = segments.asof_join(left, right, ["k"], ["lt", "a"], ["rt", "b"], ["b", "rt"], within=F.col("__ts") - F.col("__match_ts") <= F.expr("interval 2 seconds"), strict=strict, segments=parts)
    times = {r.b: r.rt for r in right.collect()}
    close = sum(b is not None and (lt - times[b]).total_seconds() <= 2 for lt, b in ((r.lt, r.b) for r in got.collect()))
    assert 0 < near.where("b is not null").count() == close < near.count()
