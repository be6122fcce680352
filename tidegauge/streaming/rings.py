"""Counter rates and rolling histories over a stream, with the previous counter and the last samples as state per series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.operators.series import HISTORY
from tidegauge.shared import scratch_dir

OUTPUT = "series long, event_id long, value double, ring_min double, ring_max double, ring_size long, change double"
STATE = "last double, ring array<double>"
RATE_OUTPUT = "series long, event_id long, counter long, rate long, counter_reset boolean"
RATE_STATE = "counter long, micros long, event_id long"
#: Files of a micro-batch, so that a backfill isn't one.
FILES_AT_ONCE = 64


def rolling_stream(samples: DataFrame, size: int = HISTORY) -> DataFrame:
    """series, event_id, value, ring_min, ring_max, ring_size, change (to the series' previous value; null for the first).

    ``samples`` is a stream of series, event_id, value. Within a micro-batch rows are taken in order of event_id; a series'
    state is its last ``size`` values. A series' rows of a micro-batch are one set of arrays: its held ring and its new
    values one after the other, of which each row sees a window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("event_id")
        last, ring = state.get if state.exists else (None, [])
        held = np.asarray(ring, float)
        flow = pd.Series(np.concatenate([held, rows["value"].to_numpy(float)]))
        window = flow.rolling(size, min_periods=1)
        low, high = (x.to_numpy()[len(held) :] for x in (window.min(), window.max()))
        sizes = np.minimum(np.arange(len(held) + 1, len(flow) + 1), size)
        change = np.diff(flow.to_numpy()[len(held) :], prepend=np.nan if last is None else last)
        state.update((float(flow.iloc[-1]), flow.to_numpy()[-size:].tolist()))
        yield pd.DataFrame({"series": key[0], "event_id": rows["event_id"].to_numpy(), "value": flow.to_numpy()[len(held) :], "ring_min": low, "ring_max": high, "ring_size": sizes, "change": change})

    return samples.groupBy("series").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def rate_stream(counters: DataFrame, per: float = 1.0) -> DataFrame:
    """series, event_id, counter, rate (whole units in ``per`` seconds), counter_reset, as ``series.rates`` gives them for a table.

    ``counters`` is a stream of series, event_id, ts, counter. A series' state is its last counter, time and event_id. The first
    sample has no rate, nor has one where the counter fell or no time passed. A row that comes after a micro-batch with a later
    event_id of its series has no rate either and leaves the state as it is; ``ordered.in_order`` waits for such rows.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("event_id")
        if state.exists:
            behind = rows["event_id"] < state.get[2]
            if behind.any():
                late, rows = rows[behind], rows[~behind]
                yield pd.DataFrame({"series": key[0], "event_id": late["event_id"].to_numpy(), "counter": late["counter"].to_numpy(np.int64), "rate": pd.array([pd.NA] * len(late), "Int64"), "counter_reset": False})
                if not len(rows):
                    return
        counter, micros = rows["counter"].to_numpy(np.int64), rows["micros"].to_numpy(np.int64)
        first = not state.exists
        held, then = (counter[0], micros[0]) if first else state.get[:2]
        grown, passed = np.diff(counter, prepend=held), np.diff(micros, prepend=then)
        known = (passed > 0) & (grown >= 0)
        known[0] &= not first
        rate = pd.array(np.floor(np.where(known, grown, 0) * per / (np.where(known, passed, 1) / 1e6)).astype(np.int64), "Int64")
        rate[~known] = pd.NA
        state.update((int(counter[-1]), int(micros[-1]), int(rows["event_id"].iloc[-1])))
        yield pd.DataFrame({"series": key[0], "event_id": rows["event_id"].to_numpy(), "counter": counter, "rate": rate, "counter_reset": grown < 0})

    timed = counters.select("series", "event_id", "counter", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return timed.groupBy("series").applyInPandasWithState(step, RATE_OUTPUT, RATE_STATE, "append", GroupStateTimeout.NoTimeout)


def counter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of series, event_id, ts, counter: the gauge stands for a counter that often falls."""
    return sample_stream(spark, sf_dir).select("series", "event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("counter"))


def latest_stream(samples: DataFrame) -> DataFrame:
    """The latest event and value of each series so far, for complete or update mode."""
    return samples.groupBy("series").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("last")).select("series", "last.*")


def tumbling_counts(samples: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Samples and their largest value for each event-time window and core.

    In append mode rows later than ``late`` are left out (``ordered.closed_windows``); in complete mode all windows are kept and none is.
    """
    timed = samples.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", width).alias("w"), "core").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select(F.unix_seconds(F.col("w.start")).alias("start"), "core", "n", "top")


def sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of series, core, event_id, ts, value."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_AT_ONCE).option("pathGlobFilter", "*events*.parquet").parquet(sf_dir)
    return files.select(F.col("user_id").alias("series"), F.col("event_type").alias("core"), "event_id", "ts", "value")


def drained(stream: DataFrame, name: str, mode: str = "append", finish: Callable[[DataFrame], DataFrame] = lambda df: df, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Runs a stream over what is there now and returns all it wrote, from a table in the shared folder.

    In complete mode each micro-batch is the whole table so far. ``each`` turns it into what is shown, a sort for instance,
    which a stream itself can't do; it is written beside the one before, so a reader always finds a whole table, and the last
    one is returned. A stream without any row gives an empty table.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out, shown = f"{base}/out", {"schema": stream.schema, "path": None}
    if mode == "complete":

        def show(df: DataFrame, turn: int) -> None:
            df = each(df)
            df.write.mode("overwrite").parquet(f"{out}/{turn}")
            shown.update(schema=df.schema, path=f"{out}/{turn}")

        writer = stream.writeStream.outputMode("complete").foreachBatch(show)
    else:
        shown["path"] = out
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    query = writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if shown["path"] is None:
        return finish(spark.createDataFrame([], shown["schema"]))
    return finish(spark.read.schema(shown["schema"]).parquet(shown["path"]))


def ranked(latest: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` largest of the latest values with their places, sorted anew for each micro-batch: the table on the screen."""
    top = latest.orderBy(F.desc("value"), "series").limit(rows)
    # Only the rows on the screen meet in one task here.
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "series")))


def every(stream_writer, nanos: int):
    """A processing-time trigger at the settings' update interval."""
    return stream_writer.trigger(processingTime=f"{nanos // 1_000_000} milliseconds")
