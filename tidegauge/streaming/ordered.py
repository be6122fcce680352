"""Streams whose rows may come late or in any order: rows wait for the watermark, which also drops, closes and forgets.

* rates and histories in order of time, whatever micro-batch a row comes with;
* sessions, closed windows and rows that are taken once;
* an outer join of two streams within an interval, by bins of time.

Spark drops a late row by the watermark of the batch before. All of them append: what is written is final. Rows whose time the watermark hasn't passed yet wait in the state, which holds no more than
the rows of the delay (and what the silence of a series or the interval of a join asks for).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.operators.series import HISTORY

ORDERED = "series long, event_id long, value double, counter long, rate long, counter_reset boolean, ring_min double, ring_max double, ring_size long"
#: A row that waits for its turn.
_HELD = np.dtype([("micros", "<i8"), ("event_id", "<i8"), ("value", "<f8"), ("counter", "<i8")])
JOINED = "series long, left_id long, right_id long"
#: A row of a join that waits: its id is ``known`` or null, it is in its ``own`` bin or a neighbour's, it has ``met`` a partner or not.
_WAITING = np.dtype([("micros", "<i8"), ("id", "<i8"), ("known", "?"), ("own", "?"), ("met", "?")])
#: Intervals in a bin of a join, pairs of a frame that is written; rows of a packed array of the state.
BIN_INTERVALS, PAIRS_AT_ONCE, PACKED_ROWS = 16, 250_000, 50_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds a series' rows until the watermark has passed them, then takes them in order of time and event_id.

    State: the rows that wait (a list of packed arrays, one for each micro-batch that brought some), and the last counter, time and
    values (one value). A timer stands at the oldest row that waits; rows are taken when it fires, in the batch that brought them if
    the watermark is that far. Another, ``silent_ms`` after the last row that was taken, forgets the series. Each access to
    the state is a call from the worker to the JVM, so a series' rows go there and back whole.
    """

    def __init__(self, per: float, size: int, silent_ms: int) -> None:
        self.per, self.size, self.silent_ms = per, size, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "packed binary")
        self.last = handle.getValueState("last", "counter long, micros long, ring binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames, watermark = list(rows), timerValues.getCurrentWatermarkInMs()
        come = np.zeros(sum(map(len, frames)), _HELD)
        for name in _HELD.names:
            come[name] = np.concatenate([f[name].to_numpy() for f in frames])
        # Spark drops what the batch before already ruled out; what this one rules out goes here, as later rows may be written.
        come = come[come["micros"] // 1000 >= watermark]
        if len(come):
            self.held.appendList(_packed(come))
            self.handle.registerTimer(int(come["micros"].min()) // 1000)  # fires once the watermark is past it
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark, rows = timerValues.getCurrentWatermarkInMs(), _unpacked(self.held, _HELD)
        passed = rows["micros"] // 1000 < watermark
        if passed.any():
            wait = rows[~passed]
            if len(wait):
                self.held.put(_packed(wait))
                self.handle.registerTimer(int(wait["micros"].min()) // 1000)
            else:
                self.held.clear()
            done = rows[passed]
            yield from self._passed(key, done[np.lexsort([done["event_id"], done["micros"]])])
        elif not len(rows):
            last = self.last.get()
            if last is not None and last[1] // 1000 + self.silent_ms <= watermark:
                self.last.clear()

    def _passed(self, key, done: np.ndarray) -> Iterator[pd.DataFrame]:
        """The results for rows in order, after those taken before; the state is what follows from both."""
        micros, last = done["micros"], self.last.get()
        anew = np.diff(micros, prepend=micros[0] if last is None else last[1]) > self.silent_ms * 1000
        anew[0] |= last is None
        for part in np.split(np.arange(len(done)), np.flatnonzero(anew)):
            if len(part):
                frame, last = self._taken(key, done[part[0] : part[-1] + 1], None if anew[part[0]] else last)
                yield frame
        self.last.update(last)
        self.handle.registerTimer(int(micros[-1]) // 1000 + self.silent_ms)

    def _taken(self, key, rows: np.ndarray, last: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """The result for rows in order after ``last`` (None: anew), and what is last then."""
        micros, counters, values = rows["micros"], rows["counter"], rows["value"]
        counter, then = (counters[0], micros[0]) if last is None else last[:2]
        grown, passed = np.diff(counters, prepend=counter), np.diff(micros, prepend=then)
        known = (passed > 0) & (grown >= 0)
        known[0] &= last is not None
        rate = np.floor(np.where(known, grown, 0) * self.per / (np.where(known, passed, 1) / 1e6)).astype(np.int64)
        ring = np.zeros(0) if last is None else np.frombuffer(last[2], float)
        flow = np.concatenate([ring, values])
        # Each row sees itself and the size - 1 values before it, as many as there are.
        window = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(self.size - 1, np.nan), flow]), self.size)[len(ring) :]
        out = pd.DataFrame({
            "series": key[0], "event_id": rows["event_id"], "value": values, "counter": counters, "rate": pd.arrays.IntegerArray(rate, ~known), "counter_reset": grown < 0,
            "ring_min": np.fmin.reduce(window, axis=1), "ring_max": np.fmax.reduce(window, axis=1), "ring_size": np.minimum(np.arange(len(ring) + 1, len(flow) + 1), self.size),
        })
        return out, (int(counters[-1]), int(micros[-1]), flow[-self.size :].tobytes())

    def close(self) -> None:
        pass


class Joined(StatefulProcessor):
    """Pairs the rows of two streams in a bin of time of a series and holds those that may still have partners.

    A bin also gets the rows of its neighbours that are near enough to meet its own. A pair is written in the bin of its right row,
    a row without a partner in its own bin. Partners are found by binary search in arrays in order of time, so the work is a sort
    and the pairs there are. State: the rows that wait on either side, in packed arrays. A timer stands where the first is ruled out.
    """

    def __init__(self, within: int) -> None:
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left, self.right = (handle.getListState(side, "packed binary") for side in ("left", "right"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)
        come = np.zeros(sum(map(len, frames)), _WAITING)
        for name in ("micros", "id", "known", "own"):
            come[name] = np.concatenate([f[name].to_numpy() for f in frames])
        is_right = np.concatenate([f["is_right"].to_numpy(bool) for f in frames])
        lefts, rights = (_in_time(come[at]) for at in (~is_right, is_right))
        held_lefts, held_rights = _unpacked(self.left, _WAITING), _unpacked(self.right, _WAITING)
        if not key[1]:  # a null series has no partners
            yield from self._pairs(key, lefts, held_rights)
        lefts = _in_time(np.concatenate([held_lefts, lefts]))
        if not key[1]:
            yield from self._pairs(key, lefts, rights)
        yield from self._wait(key, lefts, np.concatenate([held_rights, rights]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._wait(key, _unpacked(self.left, _WAITING), _unpacked(self.right, _WAITING), timerValues.getCurrentWatermarkInMs())

    def _pairs(self, key, lefts: np.ndarray, rights: np.ndarray) -> Iterator[pd.DataFrame]:
        """The pairs of the bin's own right rows, some PAIRS_AT_ONCE a frame; all that meet are marked. ``lefts`` are in order."""
        low = np.searchsorted(lefts["micros"], rights["micros"] - self.within)
        high = np.searchsorted(lefts["micros"], rights["micros"], "right")
        rights["met"] |= high > low
        edges = np.bincount(low, minlength=len(lefts) + 1) - np.bincount(high, minlength=len(lefts) + 1)
        lefts["met"] |= np.cumsum(edges)[: len(lefts)] > 0
        own = np.flatnonzero(rights["own"] & (high > low))
        many = (high - low)[own]
        for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(many) // PAIRS_AT_ONCE)) + 1):
            n, first = many[part], low[own[part]]
            if len(n):
                at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                yield _joined(key, lefts[["id", "known"]][at], rights[["id", "known"]][np.repeat(own[part], n)])

    def _wait(self, key, lefts: np.ndarray, rights: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        """Writes the own rows that are ruled out without a partner; the state is the rows that may have one yet."""
        ends = []
        for state, rows, more in ((self.left, lefts, self.within), (self.right, rights, 0)):
            end = (rows["micros"] + more) // 1000
            gone = end < watermark
            alone = rows[gone & rows["own"] & ~rows["met"]]
            if len(alone):
                none = np.zeros(len(alone), _WAITING)
                yield _joined(key, *((alone, none) if state is self.left else (none, alone)))
            if gone.all():
                state.clear()
            else:
                waiting, ends = rows[~gone], [*ends, end[~gone].min()]
                state.put(_packed(waiting))
        if ends:
            self.handle.registerTimer(int(min(ends)))  # fires once the watermark is past it

    def close(self) -> None:
        pass


def _in_time(rows: np.ndarray) -> np.ndarray:
    return rows[np.argsort(rows["micros"], kind="stable")]


def _packed(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[k : k + PACKED_ROWS].tobytes(),) for k in range(0, len(rows), PACKED_ROWS)]


def _unpacked(state, kind: np.dtype) -> np.ndarray:
    """The rows of a list of packed arrays, as an array that may be changed."""
    return np.frombuffer(b"".join(r[0] for r in state.get()) if state.exists() else b"", kind).copy()


def _joined(key, lefts: np.ndarray, rights: np.ndarray) -> pd.DataFrame:
    ids = {name: pd.arrays.IntegerArray(rows["id"].copy(), ~rows["known"]) for name, rows in (("left_id", lefts), ("right_id", rights))}
    n = len(lefts)
    return pd.DataFrame({"series": pd.arrays.IntegerArray(np.full(n, key[0], np.int64), np.full(n, bool(key[1]))), **ids})


def timed(samples: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """The stream with its time as a timestamp, whose watermark is ``delay`` behind the newest row."""
    return samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def in_order(samples: DataFrame, delay: str = "1 hour", silent_ms: int = 7 * 86_400_000, per: float = 1.0, size: int = HISTORY) -> DataFrame:
    """series, event_id, value, counter, rate, counter_reset, ring_min, ring_max, ring_size of each row once the watermark is past it.

    ``samples`` is a stream of series, event_id, ts, value, counter, of which none may be null; a series' rows may come in any order
    within ``delay``. Rates are whole units in ``per`` seconds as ``series.rates`` gives them, rings those of
    ``series.rolling_range`` in order of time, then event_id. Rows behind the watermark are dropped. A row more
    than ``silent_ms`` after its series' last one begins anew, and the state is let go by then. Needs state in RocksDB, which is set here.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    rows = timed(samples, delay).select("series", "ts", F.unix_micros("ts").alias("micros"), "event_id", "value", "counter")
    return rows.groupBy("series").transformWithStateInPandas(InOrder(per, size, silent_ms), ORDERED, "Append", "EventTime")


def sessions(samples: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """series, opens, closes (microseconds), n, top: runs of samples of a series of which none is ``gap`` after the one before.

    A session is written once the watermark has passed its end, the last sample plus ``gap``; later rows are dropped.
    """
    w = F.session_window("ts", gap).alias("w")
    found = timed(samples, delay).groupBy("series", w).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return found.select("series", F.unix_micros("w.start").alias("opens"), F.unix_micros("w.end").alias("closes"), "n", "top")


def closed_windows(samples: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """start (seconds), core, n, top of each event-time window that the watermark has passed; rows of such windows are dropped."""
    found = timed(samples, delay).groupBy(F.window("ts", width).alias("w"), "core").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return found.select(F.unix_seconds("w.start").alias("start"), "core", "n", "top")


def once(samples: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each ``key`` that comes; repeats that come before the watermark passes it are dropped, and so are late rows."""
    return timed(samples, delay).dropDuplicatesWithinWatermark(key)


def joined_within(left: DataFrame, right: DataFrame, interval: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """series, left_id, right_id: rows of both streams (series, event_id, ts; whole numbers) of which the right one comes at most ``interval`` later.

    Each side also keeps rows without a partner, with null for the other's id, written once the watermark rules a partner out. A
    left row is held for ``interval`` beyond the watermark, a right row until the watermark passes it. Series are cut into
    bins of BIN_INTERVALS intervals, so that a row meets few others than its partners and a long series is many groups. Rows
    without a time are left out. Needs state in RocksDB, which is set here.
    """
    spark = left.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    within = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + interval {interval})").first()[0]
    width = max(BIN_INTERVALS * within, 1_000_000)

    def side(samples: DataFrame, is_right: bool) -> DataFrame:
        rows = timed(samples, delay).where("ts is not null").withColumn("micros", F.unix_micros("ts"))
        own, other = (F.expr(f"({at}) div {width}") for at in ("micros", f"micros - {within}" if is_right else f"micros + {within}"))
        rows = rows.withColumn("home", own).withColumn("bin", F.explode(F.array_distinct(F.array("home", other))))
        whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
        return rows.select(
            whole("series").alias("series"), F.col("series").isNull().alias("no_series"), "bin", "ts", "micros",
            whole("event_id").alias("id"), F.col("event_id").isNotNull().alias("known"), (F.col("bin") == F.col("home")).alias("own"), F.lit(is_right).alias("is_right"),
        )

    rows = side(left, False).unionByName(side(right, True))
    return rows.groupBy("series", "no_series", "bin").transformWithStateInPandas(Joined(within), JOINED, "Append", "EventTime")


def counted(samples: DataFrame) -> DataFrame:
    """The stream with a counter: hundredths of the value, which often falls."""
    return samples.withColumn("counter", F.round(F.col("value") * 100).cast("bigint"))


def export(stream: DataFrame, path: str, checkpoint: str, day: str, rows_per_file: int = 1_000_000, stop=None):
    """Writes a stream to Parquet by day such that a batch that runs again counts once. Returns the query, when all is written.

    A batch's rows go to day=.../batch=<id>, overwritten as a whole if the batch runs again, in files of ``rows_per_file`` rows at
    most. Its commit, path/_commits/batch=<id>, is written last; ``exported`` reads the rows of committed batches only. ``stop``
    is called with (batch id, step) after each step; tests raise there.
    """
    told = stop or (lambda batch, step: None)

    def write(df: DataFrame, batch: int) -> None:
        rows = df.withColumns({"day": F.to_date(F.col(day)), "batch": F.lit(batch)})
        # A day's rows of a batch are spread by a hash of the row, so that none is bound to one task.
        spread = rows.repartition("day", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("day", "batch").parquet(f"{path}/rows")
        told(batch, "rows")
        df.sparkSession.createDataFrame([(batch,)], "batch int").write.mode("overwrite").parquet(f"{path}/_commits/batch={batch}")
        told(batch, "commit")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def exported(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches, with day and batch; ``schema`` is that of the stream's columns."""
    rows = spark.read.schema(f"{schema}, day date, batch int").parquet(f"{path}/rows")
    commits = spark.read.schema("batch int").option("recursiveFileLookup", "true").parquet(f"{path}/_commits")
    return rows.join(F.broadcast(commits.distinct()), "batch")  # one number for each batch
