"""Queries over series and tables of any length: split series, interval and as-of joins, ranks, percentiles, distinct counts.

The kind of an event is the key here: five series, each of a fifth of all samples.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators import percentiles, ranks, segments
from tidegauge.operators.distinct_cube import distinct_cube
from tidegauge.operators.interval_join import interval_join
from tidegauge.plans.catalogue import _GAUGES, _PROC, Query, _g
from tidegauge.plans.panel_catalogue import ORACLE_SQL, QUERIES, _add
from tidegauge.shared import scratch_dir
from tidegauge.sources import tables
from tidegauge.streaming import ordered, rings

__all__ = ["ORACLE_SQL", "QUERIES"]

_CORE, _ID = ["core"], ["event_id"]

# --- split series -----------------------------------------------------------------------------------------------------
_STEPS = f"{_GAUGES}, steps AS (SELECT *, CAST(round(value * 100) AS BIGINT) - 2000 AS step FROM gauges)"
_TOTALS = f"{_STEPS}, totals AS (SELECT *, sum(step) OVER (PARTITION BY core ORDER BY event_id)::BIGINT AS counter FROM steps)"


def _totals(g: DataFrame) -> DataFrame:
    """A counter of each core that now and then falls: the running sum of its steps."""
    return segments.running_sum(g.withColumn("step", F.round(F.col("value") * 100).cast("bigint") - 2000), _CORE, _ID, "step", "counter")


_add("split_running_sum", _g(lambda g: _totals(g).select("core", "event_id", "counter")), f"WITH {_TOTALS} SELECT core, event_id, counter FROM totals")
_add(
    "split_counter_rate",
    _g(lambda g: segments.rates(_totals(g), _CORE, _ID, "counter", "ts", 1000.0).select("core", "event_id", "rate", "counter_reset")),
    f"""
WITH {_TOTALS},
d AS (SELECT core, event_id, counter - lag(counter) OVER w AS dv, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt FROM totals WINDOW w AS (PARTITION BY core ORDER BY event_id))
SELECT core, event_id, CASE WHEN dt > 0 AND dv >= 0 THEN floor(dv * 1000.0::DOUBLE / (dt / 1000000.0::DOUBLE))::BIGINT END AS rate, coalesce(dv < 0, false) AS counter_reset FROM d""",
)
_add(
    "split_ring60",
    _g(lambda g: segments.rolling_range(g, _CORE, _ID, "value").select("core", "event_id", "ring_min", "ring_max", "ring_size")),
    f"""
WITH {_GAUGES}
SELECT core, event_id, min(value) OVER w AS ring_min, max(value) OVER w AS ring_max, count(*) OVER w AS ring_size FROM gauges
WINDOW w AS (PARTITION BY core ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
_add(
    "split_ring60_overall",
    _g(lambda g: segments.rolling_range(g, [], _ID, "value").select("event_id", "ring_min", "ring_max", "ring_size")),
    f"""
WITH {_GAUGES}
SELECT event_id, min(value) OVER w AS ring_min, max(value) OVER w AS ring_max, count(*) OVER w AS ring_size FROM gauges WINDOW w AS (ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
_add(
    "split_locf",
    _g(lambda g: segments.carried_forward(g.withColumn("value", F.when(F.col("series") % 7 == 0, F.col("value"))), _CORE, _ID, "value", "carried").select("core", "event_id", "carried")),
    f"""
WITH {_GAUGES}
SELECT core, event_id, last_value(CASE WHEN series % 7 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY core ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM gauges""",
)
for _exact, _name in ((False, "split_downsample"), (True, "split_downsample_exact")):
    _edge = "i * n // 77" if _exact else "floor(i * (n / 77.0::DOUBLE))"
    _add(
        _name,
        _g(lambda g, exact=_exact: segments.downsampled(g, _CORE, _ID, "value", 77, exact)),
        f"""
WITH {_GAUGES}, placed AS (SELECT core, value, row_number() OVER (PARTITION BY core ORDER BY event_id) - 1 AS pos FROM gauges),
counts AS (SELECT core, count(*) AS n FROM gauges GROUP BY core),
edges AS (SELECT core, i, {_edge} AS low, {_edge.replace("i *", "(i + 1) *")} AS high FROM counts, range(77) r(i) WHERE n > 77)
SELECT core, i::INTEGER AS idx, max(value) AS value FROM placed JOIN edges USING (core) WHERE pos >= low AND pos < high GROUP BY core, i
UNION ALL SELECT core, pos::INTEGER, value FROM placed JOIN counts USING (core) WHERE n <= 77""",
    )
_add(
    "asof_last_error",
    _g(lambda g: segments.asof_join(
        g.where("core = 'click'").select((F.col("series") % 3).alias("rack"), "event_id", "ts"), g.where("core = 'error'").select((F.col("series") % 3).alias("rack"), F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"), F.col("value").alias("error_value")),
        ["rack"], ["ts", "event_id"], ["error_ts", "error_id"], ["error_id", "error_value"],
    ).select("event_id", "rack", "error_id", "error_value")),
    f"""
WITH {_GAUGES}, c AS (SELECT series % 3 AS rack, event_id, ts FROM gauges WHERE core = 'click'),
e AS (SELECT series % 3 AS rack, event_id AS error_id, ts, value AS error_value FROM gauges WHERE core = 'error' QUALIFY row_number() OVER (PARTITION BY series % 3, ts ORDER BY event_id DESC) = 1)
SELECT c.event_id, c.rack, e.error_id, e.error_value FROM c ASOF LEFT JOIN e ON c.rack = e.rack AND c.ts >= e.ts""",
)
_add(
    "asof_recent_error",
    _g(lambda g: segments.asof_join(
        g.where("core != 'error'").select("core", "event_id", "ts"), g.where("core = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts")),
        [], ["ts", "event_id"], ["error_ts", "error_id"], ["error_id"], within=F.col("__ts") - F.col("__match_ts") <= F.expr("interval 5 minutes"), strict=True,
    ).select("event_id", "error_id")),
    f"""
WITH {_GAUGES}, e AS (SELECT event_id AS error_id, ts FROM gauges WHERE core = 'error' QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) = 1)
SELECT g.event_id, CASE WHEN g.ts - e.ts <= INTERVAL 5 MINUTE THEN e.error_id END AS error_id
FROM (SELECT * FROM gauges WHERE core <> 'error') g ASOF LEFT JOIN e ON g.ts > e.ts""",
)

# --- joins of intervals -----------------------------------------------------------------------------------------------
_add(
    "interval_incidents",
    _g(lambda g: interval_join(
        g.where("core != 'error'").select("event_id", "ts"), g.where("core = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("opens"), F.expr("ts + make_dt_interval(0, 0, 0, cast(value as int) * 60)").alias("closes")),
        ("ts", "ts"), ("opens", "closes"),
    ).select("event_id", "error_id")),
    f"""
WITH {_GAUGES}, e AS (SELECT event_id AS error_id, ts AS opens, ts + to_minutes(trunc(value)::BIGINT) AS closes FROM gauges WHERE core = 'error')
SELECT g.event_id, e.error_id FROM gauges g JOIN e ON g.ts >= e.opens AND g.ts <= e.closes WHERE g.core <> 'error'""",
)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, o_orderkey, begins, ends: orders from their date to their last shipment."""
    shipped = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ends"))
    orders = tables.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("begins"))
    return orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def _open_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    other = spans.toDF("o_custkey", "other_key", "other_begins", "other_ends")
    return interval_join(spans, other, ("begins", "ends"), ("other_begins", "other_ends"), ["o_custkey"], closed=False).where("o_orderkey < other_key").select("o_custkey", "o_orderkey", "other_key")


_SPANS = "spans AS (SELECT o_custkey, o_orderkey, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"
_add("interval_open_orders", _open_together, f"WITH {_SPANS} SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other_key FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.s <= a.e AND b.s <= b.e AND a.s < b.e AND b.s < a.e AND a.o_orderkey < b.o_orderkey")
_add(
    "interval_quiet_customers",
    lambda s, d: interval_join(
        tables.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", "o_orderdate"), _spans(s, d).select("o_custkey", F.col("o_orderkey").alias("open_key"), "begins", "ends").where("month(begins) < 7"),
        ("o_orderdate", "o_orderdate"), ("begins", "ends"), ["o_custkey"], "left",
    ).groupBy("o_orderkey").agg(F.count("open_key").alias("open_orders")),
    f"""
WITH {_SPANS} SELECT o.o_orderkey, count(b.o_orderkey) AS open_orders FROM orders o
LEFT JOIN (SELECT * FROM spans WHERE month(s) < 7) b ON o.o_custkey = b.o_custkey AND b.s <= o.o_orderdate AND o.o_orderdate <= b.e WHERE o.o_orderpriority = '1-URGENT' GROUP BY o.o_orderkey""",
)

# --- ranks, percentiles, distinct counts ------------------------------------------------------------------------------
_add(
    "rank_samples",
    _g(lambda g: ranks.ranked(g.withColumn("value", F.floor("value")).select("event_id", "value"), ["value"], ["event_id"], 7, True)),
    f"""
WITH {_GAUGES}, g AS (SELECT event_id, floor(value)::BIGINT AS value FROM gauges)
SELECT event_id, value, row_number() OVER t AS position, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist, ntile(7) OVER t AS ntile
FROM g WINDOW w AS (ORDER BY value DESC), t AS (ORDER BY value DESC, event_id)""",
)
_add(
    "rank_kinds",
    lambda s, d: ranks.ranked(tables.processes(s, d).select("pid", "name", "threads"), ["name", "threads"], ["pid"], 10),
    f"""
WITH {_PROC}
SELECT pid, name, threads, row_number() OVER t AS position, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist, ntile(10) OVER t AS ntile
FROM proc WINDOW w AS (ORDER BY name, threads), t AS (ORDER BY name, threads, pid)""",
)
_add(
    "percentiles_by_core",
    _g(lambda g: percentiles.exact_percentiles(g, ["core"], "value", [0.5, 0.95, 0.99])),
    f"""
WITH {_GAUGES}
SELECT core, unnest([0.5, 0.95, 0.99])::DOUBLE AS share, unnest(quantile_disc(value, [0.5, 0.95, 0.99])) AS value FROM gauges GROUP BY core""",
)
_add(
    "percentiles_overall",
    _g(lambda g: percentiles.exact_percentiles(g, [], "value", [0.01, 0.25, 0.5, 0.75, 0.999], few=500)),
    f"""
WITH {_GAUGES}
SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.999])::DOUBLE AS share, unnest(quantile_disc(value, [0.01, 0.25, 0.5, 0.75, 0.999])) AS value FROM gauges""",
)
_add(
    "distinct_cube",
    lambda s, d: distinct_cube(tables.processes(s, d).withColumn("kib", F.expr("memory div 4096")), ["name", "user", "threads"], "kib"),
    f"""
WITH {_PROC}
SELECT name, "user", threads, grouping(name, "user", threads)::BIGINT AS grouping_id, count(DISTINCT memory // 4096) AS n_distinct FROM proc GROUP BY CUBE (name, "user", threads)""",
)

# --- streams that survive late rows -----------------------------------------------------------------------------------
#: The watermark in the end, in milliseconds: the newest time less the delay.
_MARK = "mark AS (SELECT epoch_ms(max(ts)) - {ms} AS ms FROM events)"


def _stream(f) -> Query:
    return lambda s, d: f(rings.sample_stream(s, d))


_add(
    "stream_in_order",
    _stream(lambda g: rings.drained(ordered.in_order(ordered.counted(g), "6 hours", 60 * 86_400_000, 1000.0), "in-order").select("series", "event_id", "rate", "counter_reset", "ring_min", "ring_max", "ring_size")),
    f"""
WITH {_GAUGES}, {_MARK.format(ms=6 * 3_600_000)}, c AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS counter FROM gauges),
d AS (SELECT series, event_id, ts, counter - lag(counter) OVER w AS dv, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt, min(value) OVER r AS ring_min, max(value) OVER r AS ring_max, count(*) OVER r AS ring_size
  FROM c WINDOW w AS (PARTITION BY series ORDER BY ts, event_id), r AS (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT series, event_id, CASE WHEN dt > 0 AND dv >= 0 THEN floor(dv * 1000.0::DOUBLE / (dt / 1000000.0::DOUBLE))::BIGINT END AS rate, coalesce(dv < 0, false) AS counter_reset, ring_min, ring_max, ring_size
FROM d, mark WHERE epoch_ms(ts) < ms""",
)
_add(
    "stream_sessions",
    _stream(lambda g: rings.drained(ordered.sessions(g.withColumn("series", F.col("series") % 40), "2 hours"), "sessions")),
    f"""
WITH {_GAUGES}, {_MARK.format(ms=3_600_000)}, g AS (SELECT series % 40 AS series, epoch_us(ts) AS t, value FROM gauges),
opened AS (SELECT *, coalesce(t - lag(t) OVER w >= 7200000000, true) AS opens FROM g WINDOW w AS (PARTITION BY series ORDER BY t)),
numbered AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY series ORDER BY t) AS session FROM opened)
SELECT series, min(t) AS opens, max(t) + 7200000000 AS closes, count(*) AS n, max(value) AS top FROM numbered GROUP BY series, session HAVING max(t) + 7200000000 <= (SELECT ms * 1000 FROM mark)""",
)
_add(
    "stream_closed_windows",
    _stream(lambda g: rings.drained(ordered.closed_windows(g), "closed-windows")),
    f"""
WITH {_GAUGES}, {_MARK.format(ms=7_200_000)}, g AS (SELECT epoch_us(ts) // 3600000000 * 3600 AS start, core, value FROM gauges)
SELECT start, core, count(*) AS n, max(value) AS top FROM g GROUP BY start, core HAVING (start + 3600) * 1000 <= (SELECT ms FROM mark)""",
)
_add(
    "stream_once",
    _stream(lambda g: rings.drained(ordered.once(g.unionByName(g), ["event_id"]), "once").select("event_id", "series", "value")),
    "SELECT event_id, user_id AS series, value FROM events",
)
_add(
    "stream_join_outer",
    _stream(lambda g: rings.drained(ordered.joined_within(g.where("core = 'click'").withColumn("series", F.col("series") % 20), g.where("core = 'error'").withColumn("series", F.col("series") % 20), "2 hours"), "join-outer")),
    f"""
WITH {_GAUGES}, a AS (SELECT series % 20 AS series, event_id, ts FROM gauges WHERE core = 'click'), b AS (SELECT series % 20 AS series, event_id, ts FROM gauges WHERE core = 'error'),
mark AS (SELECT least((SELECT epoch_ms(max(ts)) FROM a), (SELECT epoch_ms(max(ts)) FROM b)) - 3600000 AS ms),
pairs AS (SELECT a.series, a.event_id AS left_id, b.event_id AS right_id FROM a JOIN b ON a.series = b.series AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS)
SELECT * FROM pairs
UNION ALL SELECT series, event_id, NULL FROM a, mark WHERE event_id NOT IN (SELECT left_id FROM pairs) AND epoch_ms(ts) + 7200000 < ms
UNION ALL SELECT series, NULL, event_id FROM b, mark WHERE event_id NOT IN (SELECT right_id FROM pairs) AND epoch_ms(ts) < ms""",
)


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{scratch_dir(spark)}/export-{uuid.uuid4().hex}"
    stream = rings.sample_stream(spark, sf_dir).select("event_id", "ts", "value")
    ordered.export(stream, f"{base}/out", f"{base}/state", "ts", 5_000)
    return ordered.exported(spark, f"{base}/out", "event_id long, ts timestamp_ntz, value double").groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("value").alias("top"))


_add("stream_export", _exported, "SELECT ts::DATE::VARCHAR AS day, count(*) AS n, min(event_id) AS first, max(value) AS top FROM events GROUP BY 1")
