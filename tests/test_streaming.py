"""A stream over several files gives what the batch operators give."""

from pyspark.sql import functions as F

from tidegauge.operators import series
from tidegauge.streaming import rings


def test_ring_over_micro_batches(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 3).alias("series"), F.col("id").alias("event_id"), ((F.col("id") * 37) % 101).cast("double").alias("value"))
    for k in range(3):
        df.where(f"event_id div 100 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    # Files are taken oldest first, so each micro-batch continues the one before it.
    got = rings.drained(rings.rolling_stream(stream), "test-ring").select("series", "event_id", "ring_min", "ring_max", "ring_size")
    want = series.rolling_range(df, ["series"], ["event_id"], "value").select("series", "event_id", "ring_min", "ring_max", "ring_size")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rates_over_micro_batches(spark, tmp_path):
    """The last counter and time of a series carry over; falls and standing time give no rate."""
    df = spark.range(300).select(
        (F.col("id") % 3).alias("series"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 700_000 - (F.col("id") % 11 == 0).cast("long") * 2_100_000).cast("timestamp_ntz").alias("ts"),
        ((F.col("id") * 7919) % 4001 + F.col("id") * 20).alias("counter"),
    )
    for k in range(3):
        df.where(f"event_id div 100 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = rings.drained(rings.rate_stream(stream, 10.0), "test-rates").select("series", "event_id", "rate", "counter_reset")
    want = series.rates(df, ["series"], ["event_id"], "counter", "ts", 10.0).select("series", "event_id", "rate", "counter_reset")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.where("rate is null").count() > 3


def test_a_late_row_leaves_the_rates_after_it_alone(spark, tmp_path):
    import glob
    import os

    row = lambda e, t, c: (1, e, t, c)
    batches = [[row(1, 10, 100), row(3, 30, 500)], [row(2, 20, 120), row(4, 40, 700)], [row(0, 5, 1)], [row(5, 50, 1000)]]
    schema = "series long, event_id long, s long, counter long"
    frame = lambda b: spark.createDataFrame(b, schema).select("series", "event_id", F.timestamp_seconds("s").alias("ts"), "counter")
    for k, b in enumerate(batches):
        frame(b).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in glob.glob(f"{tmp_path}/in/{k}/*.parquet"):
            os.utime(f, (1_000_000 + k * 100,) * 2)
    stream = spark.readStream.schema(frame(batches[0]).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {r.event_id: (r.rate, r.counter_reset) for r in rings.drained(rings.rate_stream(stream, 10.0), "late-rates").collect()}
    assert got == {1: (None, False), 3: (200, False), 2: (None, False), 4: (200, False), 0: (None, False), 5: (300, False)}


def test_streams_without_rows(spark, tmp_path):
    schema = "series long, core string, event_id long, ts timestamp_ntz, value double"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    counters = stream.select("series", "event_id", "ts", F.col("event_id").alias("counter"))
    outs = [
        rings.drained(rings.rolling_stream(stream), "none"), rings.drained(rings.rate_stream(counters), "none"), rings.drained(rings.latest_stream(stream), "none", "complete"),
        rings.drained(rings.tumbling_counts(stream), "none", "complete"),
    ]
    assert [df.count() for df in outs] == [0] * 4


def test_trigger_at_the_settings_interval(spark, tmp_path):
    """A stream that ticks at the update interval takes in files as they come."""
    schema = "series long, event_id long, value double"
    frame = lambda k: spark.createDataFrame([(1, k, float(k))], schema)
    frame(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = rings.every(rings.latest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("ticks"), 500_000_000).start()
    try:
        query.processAllAvailable()
        frame(2).write.parquet(f"{tmp_path}/in/2")
        query.processAllAvailable()
        assert spark.table("ticks").collect()[0].event_id == 2
    finally:
        query.stop()

