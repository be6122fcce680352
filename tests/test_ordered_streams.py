"""Streams over several files whose rows come late, twice or in any order."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import series
from tidegauge.streaming import ordered, rings

SCHEMA = "series long, event_id long, ts timestamp, value double, core string"


def at(c):
    return F.timestamp_micros(c * 1_000_000)


def files(spark, path, batches) -> object:
    """A stream that takes one of the tables a micro-batch, in this order."""
    import os

    for k, df in enumerate(batches):
        df.coalesce(1).write.parquet(f"{path}/in/{k:03}")
        for f in glob.glob(f"{path}/in/{k:03}/*.parquet"):
            os.utime(f, (1_000_000 + k * 100,) * 2)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def rows(spark, items) -> object:
    return spark.createDataFrame(items, "series long, event_id long, s long, value double, core string").select("series", "event_id", at(F.col("s")).alias("ts"), "value", "core")


def test_shuffled_files_give_the_batch_rows(spark, tmp_path):
    """Rows come up to 40 seconds late and in any order; the last file moves the watermark past all of them."""
    n = F.col("id")
    all_ = spark.range(400).select((n % 3).alias("series"), n.alias("event_id"), at(n + 1000).alias("ts"), ((n * 37) % 101).cast("double").alias("value"), F.lit("x").alias("core"))
    turn = F.floor((F.col("event_id") + (F.col("event_id") * 7919) % 40) / 50)
    parts = [all_.where(turn == k).orderBy(F.xxhash64("event_id")) for k in range(9)]
    stream = files(spark, tmp_path, [*parts, rows(spark, [(99, 9999, 5000, 0.0, "x")])])
    got = rings.drained(ordered.in_order(ordered.counted(stream), "60 seconds", per=1000.0), "shuffled")
    counted = ordered.counted(all_)
    rates = series.rates(counted, ["series"], ["ts", "event_id"], "counter", "ts", 1000.0).select("series", "event_id", "rate", "counter_reset")
    rolled = series.rolling_range(counted, ["series"], ["ts", "event_id"], "value").select("series", "event_id", "ring_min", "ring_max", "ring_size")
    want = rates.join(rolled, ["series", "event_id"])
    columns = want.columns
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_late_rows_change_nothing_and_silent_series_begin_anew(spark, tmp_path):
    batches = [
        [(1, 1, 100, 5.0, "x"), (1, 2, 110, 6.0, "x")], [(7, 3, 400, 1.0, "x")], [(1, 4, 105, 99.0, "x"), (1, 5, 420, 8.0, "x")],
        [(7, 6, 900, 1.0, "x")], [(7, 7, 2000, 1.0, "x")], [(1, 8, 2100, 9.0, "x")], [(7, 9, 4000, 1.0, "x")],
    ]
    stream = files(spark, tmp_path, [rows(spark, b) for b in batches])
    got = {r.event_id: r for r in rings.drained(ordered.in_order(ordered.counted(stream), "30 seconds", silent_ms=600_000), "late").collect()}
    assert sorted(got) == [1, 2, 3, 5, 6, 7, 8]  # 4 is late, 9 waits
    assert (got[2].rate, got[5].rate, got[5].ring_size, got[5].ring_min) == (10, 0, 3, 5.0)
    assert (got[8].rate, got[8].ring_size, got[8].counter_reset) == (None, 1, False)


def test_a_row_is_taken_once_the_watermark_is_a_millisecond_past_it(spark, tmp_path):
    """The last watermark is 101 s; the held rows are some packed arrays, not a row of the state each."""
    part = lambda *items: spark.createDataFrame([(k, i, ms, float(i), "x") for k, i, ms in items], "series long, event_id long, ms long, value double, core string").select("series", "event_id", F.timestamp_millis("ms").alias("ts"), "value", "core")
    stream = files(spark, tmp_path, [part((1, 2, 100_999), (1, 1, 100_500), (1, 3, 101_000)), part((7, 9, 131_000))])
    got = rings.drained(ordered.in_order(ordered.counted(stream), "30 seconds"), "millisecond").collect()
    assert [(r.event_id, r.ring_min, r.ring_max, r.ring_size) for r in sorted(got)] == [(1, 1.0, 1.0, 1), (2, 1.0, 2.0, 2)]


def test_sessions_and_windows_drop_late_rows(spark, tmp_path):
    batches = [[(1, 1, 0, 1.0, "a"), (1, 2, 50, 2.0, "a")], [(1, 3, 5000, 3.0, "a")], [(4, 7, 5005, 0.0, "c")], [(1, 4, 90, 9.0, "a"), (2, 5, 5010, 4.0, "b")], [(3, 6, 20_000, 5.0, "a")]]
    stream = files(spark, tmp_path, [rows(spark, b) for b in batches])
    got = {(r.series, r.opens, r.closes, r.n, r.top) for r in rings.drained(ordered.sessions(stream, "100 seconds", "10 seconds"), "sessions").collect()}
    assert got == {(1, 0, 150_000_000, 2, 2.0), (1, 5_000_000_000, 5_100_000_000, 1, 3.0), (2, 5_010_000_000, 5_110_000_000, 1, 4.0), (4, 5_005_000_000, 5_105_000_000, 1, 0.0)}
    closed = {tuple(r) for r in rings.drained(ordered.closed_windows(stream, "1000 seconds", "10 seconds"), "closed").collect()}
    assert closed == {(0, "a", 2, 2.0), (5000, "a", 1, 3.0), (5000, "b", 1, 4.0), (5000, "c", 1, 0.0)}


def test_repeats_are_taken_once(spark, tmp_path):
    batches = [[(1, 1, 0, 1.0, "a"), (1, 1, 0, 1.0, "a"), (1, 2, 5, 2.0, "a")], [(1, 2, 7, 2.0, "a"), (1, 3, 500, 3.0, "a")], [(1, 1, 1, 1.0, "a"), (1, 3, 505, 3.0, "a")]]
    stream = files(spark, tmp_path, [rows(spark, b) for b in batches])
    assert sorted(r.event_id for r in rings.drained(ordered.once(stream, ["event_id"], "60 seconds"), "once").collect()) == [1, 2, 3]


def test_outer_join_within_an_interval_and_its_state(spark, tmp_path):
    """Partners in either order of coming; rows without one once it is ruled out; the state is let go."""
    batches = [
        [(1, 1, 100, 0.0, "L"), (1, 2, 105, 0.0, "R"), (2, 3, 110, 0.0, "L")], [(1, 4, 130, 0.0, "R"), (3, 5, 120, 0.0, "R")], [(9, 6, 1000, 0.0, "L"), (9, 7, 1000, 0.0, "R")], [(8, 11, 1001, 0.0, "L"), (8, 12, 1001, 0.0, "R")],
        [(1, 8, 101, 0.0, "R")], [(9, 9, 9000, 0.0, "L"), (9, 10, 9000, 0.0, "R")],
    ]
    stream = files(spark, tmp_path, [rows(spark, b) for b in batches])
    joined = ordered.joined_within(stream.where("core = 'L'"), stream.where("core = 'R'"), "50 seconds", "20 seconds")
    assert {tuple(r) for r in rings.drained(joined, "outer").collect()} == {(1, 1, 2), (1, 1, 4), (2, 3, None), (3, None, 5), (9, 6, 7), (8, 11, 12), (9, 9, 10)}
    query = joined.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_outer_join_takes_a_series_by_bins_of_time(spark, tmp_path):
    """Partners across the edges of bins come once and no row meets a whole series; null series and ids, two batches."""
    rng = random.Random(8)
    items = [(rng.choice([1, 1, 2, None]), i if i % 40 else None, rng.randint(1, 7000), 0.0, rng.choice("LR")) for i in range(600)]
    items += [(1, 1000 + i, 800 * (i // 4 + 1) + 50 * (i % 2), 0.0, "LR"[i // 2 % 2]) for i in range(24)]
    last = [(9, 9001, 100_000, 0.0, "L"), (9, 9002, 100_000, 0.0, "R")]
    stream = files(spark, tmp_path, [rows(spark, items[::2]), rows(spark, items[1::2]), rows(spark, last)])
    joined = ordered.joined_within(stream.where("core = 'L'"), stream.where("core = 'R'"), "50 seconds", "3 hours")
    assert "FullOuter" not in joined._jdf.queryExecution().logical().toString()
    lefts, rights = ([(n, k, i, t) for n, (k, i, t, _, side) in enumerate(items + last) if side == which] for which in "LR")
    pairs = [(a, b) for a in lefts for b in rights if a[1] == b[1] is not None and a[3] <= b[3] <= a[3] + 50]
    met = {n for pair in pairs for n, *_ in pair}
    want = [(a[1], a[2], b[2]) for a, b in pairs] + [(k, i, None) for n, k, i, _ in lefts if n not in met] + [(k, None, i) for n, k, i, _ in rights if n not in met]
    assert sorted(map(tuple, rings.drained(joined, "bins").collect()), key=str) == sorted(want, key=str) and len(pairs) > 100


@pytest.mark.parametrize("step", ["rows", "commit"])
def test_a_batch_that_runs_again_counts_once(spark, tmp_path, step):
    """The export stops in the middle of its second batch, after its rows or its commit, and goes on from its checkpoint."""
    n = F.col("id")
    part = lambda k: spark.range(k * 100, k * 100 + 100).select((n % 3).alias("series"), n.alias("event_id"), at(n * 2000).alias("ts"), n.cast("double").alias("value"), F.lit("x").alias("core"))
    stream = files(spark, tmp_path, [part(k) for k in range(3)])
    out, state = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def stop(batch, done):
        if (batch, done) == (1, step):
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ordered.export(stream, out, state, "ts", 20, stop)
    assert ordered.exported(spark, out, SCHEMA).count() == (100 if step == "rows" else 200)
    ordered.export(stream, out, state, "ts", 20)
    got = ordered.exported(spark, out, SCHEMA)
    assert sorted(r.event_id for r in got.select("event_id").collect()) == list(range(300))
    assert sorted(r.batch for r in got.select("batch").distinct().collect()) == [0, 1, 2] and got.where("day = to_date(ts)").count() == 300
    sizes = [r["count"] for r in spark.read.parquet(f"{out}/rows").groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 20
