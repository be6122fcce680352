"""Every registered query of the main package, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.functions import derived, formatting as fmt, levels
from tidegauge.operators import safety, selection, series, snapshot
from tidegauge.plans import views
from tidegauge.sources import tables
from tidegauge.streaming import rings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ME = "alice"

_GAUGES = "gauges AS (SELECT user_id AS series, event_type AS core, event_id, ts, value FROM events)"
_COUNTERS = f"{_GAUGES}, counters AS (SELECT series, event_id, ts, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY series ORDER BY event_id)::BIGINT AS counter FROM gauges)"
_PROC = """proc AS (SELECT o_orderkey AS pid,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'launchd' WHEN '2-HIGH' THEN 'WindowServer' WHEN '3-MEDIUM' THEN 'editor' WHEN '4-NOT SPECIFIED' THEN '日本語テスト' WHEN '5-LOW' THEN 'helper' ELSE 'unknown' END AS name,
  CASE o_orderstatus WHEN 'F' THEN 'root' WHEN 'O' THEN 'alice' WHEN 'P' THEN '_mbsetupuser' ELSE 'unknown' END AS "user",
  o_totalprice / 5000 AS cpu_percent, CAST(floor(o_totalprice * 1024) AS BIGINT) AS memory, CAST(o_custkey % 64 + 1 AS INTEGER) AS threads,
  o_custkey * 1000 AS io_write_bytes, o_orderkey * 7 AS io_read_bytes FROM orders)"""
_MEM = """
mem AS (SELECT p_partkey AS sample_id, p_size::BIGINT * 1000 * (p_partkey % 7 <> 0)::BIGINT AS total, p_size::BIGINT * 600 AS used, p_size::BIGINT * (300 + p_partkey % 200) AS free, (p_partkey % 5) * 4096 AS swap_total, (p_partkey % 5) * 1024 AS swap_used
FROM part)"""
_LAST = "last AS (SELECT * FROM gauges QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC, event_id DESC) = 1)"
_HIST = """
hist AS (SELECT series, event_id, value, (count(*) OVER (PARTITION BY series) - back)::INTEGER AS idx
FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY event_id DESC) AS back FROM gauges) WHERE back <= 60)"""
_PROTECTED = "(" + ", ".join(f"'{n}'" for n in tables.PROTECTED) + ")"


def _bytes_sql(n: str) -> str:
    out = f"CASE WHEN {n} < 10 THEN '0' || ({n})::BIGINT::VARCHAR ELSE ({n})::BIGINT::VARCHAR END || ' B'"
    for power, suffix in enumerate("KMGTPE", 1):
        f = f"(({n})::DOUBLE / {1024**power}::DOUBLE)"
        one = f"floor({f})::BIGINT::VARCHAR || '.' || least(greatest(floor(({f} - floor({f})) * 10)::BIGINT, 0), 9)::VARCHAR"
        out = f"CASE WHEN {n} >= {1024**power} THEN CASE WHEN {f} < 10 THEN {one} ELSE floor({f} + 0.5)::BIGINT::VARCHAR END || ' {suffix}B' ELSE {out} END"
    return f"({out})"


def _level_sql(x: str, scale) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {t} THEN '{name}'" for t, name in scale[0]) + f" ELSE '{scale[1]}' END"


def _add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _g(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(tables.gauges(spark, d))


def _c(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(tables.counters(spark, d))


def _p(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(tables.processes(spark, d))


def _chosen(spark: SparkSession) -> DataFrame:
    """A fixed set of selected pids, one of which no snapshot has."""
    return spark.createDataFrame([(p,) for p in [1, 3, 57, 99, 100, 120, 200, 300, 500, 700, -5]], "pid long")


_CHOSEN = "chosen AS (SELECT unnest([1, 3, 57, 99, 100, 120, 200, 300, 500, 700, -5])::BIGINT AS pid)"

# --- latest values, sorting, paging ---------------------------------------------------------------------------------
_add("overview", _g(views.overview), f"""
WITH {_GAUGES}, {_LAST}
SELECT series, event_id, value, {_level_sql('value', levels.TEMP_LABEL)} AS severity, {_level_sql('value', levels.LIVE_CPU_COLOR)} AS color, repeat('▓', least(floor(20.0::DOUBLE * (least(greatest(value / 500.0::DOUBLE * 100, 0), 100) / 100.0::DOUBLE)), 20)::INTEGER) || repeat('░', 20 - least(floor(20.0::DOUBLE * (least(greatest(value / 500.0::DOUBLE * 100, 0), 100) / 100.0::DOUBLE)), 20)::INTEGER) AS bar,
{_bytes_sql('floor(value * 1024)')} AS size FROM last ORDER BY value DESC, series LIMIT 8""")
_add("latest_per_series", _g(lambda g: snapshot.latest(g, ["series"], ["ts", "event_id"]).select("series", "event_id", "core", "value")), f"""
WITH {_GAUGES}, {_LAST}
SELECT series, event_id, core, value FROM last""")
_add("latest_value_max_by", _g(lambda g: snapshot.latest_values(g, ["series", "core"], ["value"], "event_id")), f"""
WITH {_GAUGES}
SELECT series, core, arg_max(value, event_id) AS value FROM gauges GROUP BY ALL""")
for _key, _columns in snapshot.KEYS.items():
    for _up in (True, False):
        _spec = snapshot.SortSpec(_key, _up)
        _by = " + ".join(_columns).replace("user", '"user"')
        _add(f"sort_{_key}_{'asc' if _up else 'desc'}", _p(lambda p, s=_spec, c=tuple(dict.fromkeys(("pid", *_columns))): snapshot.with_position(p.select(*c), s.columns()).select("pid", F.col("pos").cast("bigint").alias("pos"))), f"""
WITH {_PROC}
SELECT pid, row_number() OVER (ORDER BY {_by} {'ASC' if _up else 'DESC'}, pid) AS pos FROM proc""")
_add("top8", _p(views.top_table), f"""
WITH {_PROC}
SELECT pid, name || repeat(' ', greatest(30 - length(name), 0)) AS name, cpu_percent,
{_bytes_sql('memory')} AS memory, threads, "user" || repeat(' ', greatest(15 - length("user"), 0)) AS "user"
FROM proc ORDER BY proc.cpu_percent DESC, pid LIMIT 8""")
_add("page", _p(lambda p: snapshot.page(p, snapshot.SortSpec("memory"), 40, 20).select("pid", "memory")), f"WITH {_PROC} SELECT pid, memory FROM proc ORDER BY memory DESC, pid LIMIT 20 OFFSET 40")
_add("process_table", lambda s, d: views.process_table(tables.processes(s, d), _chosen(s), snapshot.SortSpec("name", True), most=50), f"""
WITH {_PROC}, {_CHOSEN}
SELECT pid, CASE WHEN pid IN (SELECT pid FROM chosen) THEN '▶ ' ELSE '' END || name AS name, cpu_percent, {_bytes_sql('memory')} AS memory,
{_bytes_sql('(io_write_bytes + io_read_bytes)')} AS net_io, threads, "user" FROM proc ORDER BY proc.name, pid LIMIT 50""")
_add("user_processes", lambda s, d: views.process_table(tables.processes(s, d), _chosen(s), show_system=False, text="ED").select("pid", "name"), f"""
WITH {_PROC}, {_CHOSEN}
SELECT pid, CASE WHEN pid IN (SELECT pid FROM chosen) THEN '▶ ' ELSE '' END || name AS name FROM proc
WHERE NOT ("user" IN ('root', '_mbsetupuser') OR pid < 100) AND contains(lower(name), 'ed')""")
_add("status_bar", lambda s, d: views.status_bar(tables.processes(s, d), _chosen(s)), f"""
WITH {_PROC}, {_CHOSEN}
SELECT count(*) AS processes, count(*) FILTER (pid IN (SELECT pid FROM chosen)) AS selected, max(cpu_percent) AS top_cpu, max(memory) AS top_memory
FROM proc""")

# --- series ---------------------------------------------------------------------------------------------------------
_add("ring60_minmax", _g(lambda g: series.rolling_range(g, ["series"], ["event_id"], "value").select("series", "event_id", "ring_min", "ring_max", "ring_size")), f"""
WITH {_GAUGES}
SELECT series, event_id, min(value) OVER w AS ring_min, max(value) OVER w AS ring_max, count(*) OVER w AS ring_size FROM gauges
WINDOW w AS (PARTITION BY series ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
_add("ring60_members", _g(lambda g: series.history(g, ["series"], ["event_id"]).select("series", "event_id", "idx", "value")), f"""
WITH {_GAUGES}, {_HIST.replace('count(*) OVER (PARTITION BY series) - back', 'max(back) OVER (PARTITION BY series) - back')}
SELECT series, event_id, idx, value FROM hist""")
_add("core_ring60", _g(lambda g: series.rolling_range(g, ["series", "core"], ["event_id"], "value").select("series", "core", "event_id", "ring_min", "ring_max", "ring_size")), f"""
WITH {_GAUGES}
SELECT series, core, event_id, min(value) OVER w AS ring_min, max(value) OVER w AS ring_max, count(*) OVER w AS ring_size FROM gauges
WINDOW w AS (PARTITION BY series, core ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
_rate = "CASE WHEN dt > 0 AND dv >= 0 THEN floor(dv * {per} / (dt / 1000000.0::DOUBLE))::BIGINT END AS rate, coalesce(dv < 0, false) AS counter_reset"
_add("counter_rate", _c(lambda c: series.rates(c, ["series"], ["event_id"], "counter", "ts", 1000.0).select("series", "event_id", "rate", "counter_reset")), f"""
WITH {_COUNTERS},
d AS (SELECT series, event_id, counter - lag(counter) OVER w AS dv, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt FROM counters
WINDOW w AS (PARTITION BY series ORDER BY event_id))
SELECT series, event_id, {_rate.format(per='1000.0::DOUBLE')} FROM d""")
_add("counter_rate_baseline_zero", _c(lambda c: series.rates(c, ["series"], ["event_id"], "counter", "ts", 1000.0, "zero").select("series", "event_id", "rate")), f"""
WITH {_COUNTERS},
d AS (SELECT series, event_id, counter - lag(counter, 1, 0) OVER w AS dv, epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER w, epoch_us(ts) - 1000000) AS dt
FROM counters WINDOW w AS (PARTITION BY series ORDER BY event_id))
SELECT series, event_id, CASE WHEN dt > 0 AND dv >= 0 THEN floor(dv * 1000.0::DOUBLE / (dt / 1000000.0::DOUBLE))::BIGINT END AS rate FROM d""")
_add("counter_resets", _c(lambda c: series.rates(c.withColumn("counter", F.col("counter") % 100_000), ["series"], ["event_id"], "counter", "ts", 1000.0).groupBy("series").agg(F.count_if("counter_reset").alias("resets"), F.sum("rate").alias("total_rate"))), f"""
WITH {_COUNTERS},
d AS (SELECT series, event_id, counter % 100000 - lag(counter % 100000) OVER w AS dv, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt FROM counters
WINDOW w AS (PARTITION BY series ORDER BY event_id)),
r AS (SELECT series, {_rate.format(per='1000.0::DOUBLE')} FROM d)
SELECT series, count(*) FILTER (counter_reset) AS resets, sum(rate)::BIGINT AS total_rate FROM r GROUP BY series""")
_add("locf", _g(lambda g: series.carried_forward(g.withColumn("value", F.when(F.col("core") != "error", F.col("value"))), ["series"], ["event_id"], "value", "carried").select("series", "event_id", "carried")), f"""
WITH {_GAUGES}
SELECT series, event_id, last_value(CASE WHEN core <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY series ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried
FROM gauges""")
_HIST = _HIST.replace("count(*) OVER (PARTITION BY series) - back", "max(back) OVER (PARTITION BY series) - back")
_DOWN = """
down AS (SELECT h.series, b.j::INTEGER AS idx, max(h.value) AS value FROM hist h JOIN (SELECT series, count(*) AS n FROM hist
GROUP BY series) s USING (series) JOIN (SELECT unnest(range(0, 60)) AS j) b ON b.j < least(s.n, {w})
WHERE CASE WHEN s.n <= {w} THEN h.idx = b.j ELSE h.idx >= floor(b.j * (s.n / {w}.0::DOUBLE)) AND h.idx < floor((b.j + 1) * (s.n / {w}.0::DOUBLE)) END
GROUP BY ALL)"""
_add("downsample_max", _g(lambda g: series.history_arrays(g, ["series"], ["event_id"], "value").select("series", F.posexplode(series.downsampled(F.col("values"), 23)).alias("idx", "value"))), f"""
WITH {_GAUGES}, {_HIST}, {_DOWN.format(w=23)}
SELECT series, idx, value FROM down""")
_add("series_min_max", _g(lambda g: series.value_range(g, ["series"], "value")), f"""
WITH {_GAUGES}
SELECT series, coalesce(min(value), 0.0::DOUBLE) AS low, coalesce(max(value), 1.0::DOUBLE) AS high FROM gauges GROUP BY series""")
_add("global_min_max", _g(lambda g: series.value_range(g, [], "value")), f"WITH {_GAUGES} SELECT coalesce(min(value), 0.0::DOUBLE) AS low, coalesce(max(value), 1.0::DOUBLE) AS high FROM gauges")
_side = """
(SELECT series, value, (max(back) OVER (PARTITION BY series) - back)::INTEGER AS idx
FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY event_id DESC) AS back FROM gauges WHERE core = '{core}') WHERE back <= 60)"""
_add("history_zip_max", _g(lambda g: series.positional_max(series.history(g.where("core = 'view'"), ["series"], ["event_id"]), series.history(g.where("core = 'click'"), ["series"], ["event_id"]), ["series", "idx"], "value")), f"""
WITH {_GAUGES}
SELECT coalesce(a.series, b.series) AS series, coalesce(a.idx, b.idx) AS idx, coalesce(a.value, 0.0::DOUBLE) AS first, coalesce(b.value, 0.0::DOUBLE) AS second, greatest(coalesce(a.value, 0.0::DOUBLE), coalesce(b.value, 0.0::DOUBLE)) AS peak
FROM {_side.format(core='view')} a FULL JOIN {_side.format(core='click')} b ON a.series = b.series AND a.idx = b.idx""")
_scale = "CASE WHEN hi - lo > 0 THEN lo - (hi - lo) * 0.05::DOUBLE ELSE 0.0::DOUBLE END AS l, CASE WHEN hi - lo > 0 THEN hi + (hi - lo) * 0.05::DOUBLE ELSE 1.0::DOUBLE END AS h"
_level = "least(greatest(trunc((value - l) / (CASE WHEN h = l THEN 1.0::DOUBLE ELSE h - l END) * 8)::INTEGER, 0), 8) AS level"
_add("spark_levels", _g(lambda g: series.chart_levels(series.history(g, ["series"], ["event_id"]), ["series"], "value").select("series", "idx", "level")), f"""
WITH {_GAUGES}, {_HIST},
s AS (SELECT *, min(value) OVER (PARTITION BY series) AS lo, max(value) OVER (PARTITION BY series) AS hi FROM hist),
r AS (SELECT *, {_scale} FROM s)
SELECT series, idx, {_level} FROM r""")
_add("shared_spark_levels", _g(lambda g: series.shared_chart_levels(series.history(g, ["series"], ["event_id"]), "value").select("series", "idx", "level")), f"""
WITH {_GAUGES}, {_HIST},
s AS (SELECT *, min(value) OVER () AS lo, max(value) OVER () AS hi FROM hist),
r AS (SELECT *, {_scale} FROM s)
SELECT series, idx, {_level} FROM r""")
_add("view_cpu", _g(views.cpu), f"""
WITH {_GAUGES},
named AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY core) - 1 AS core_id FROM gauges) WHERE core_id < 8),
h AS (SELECT series, core, value, (max(back) OVER (PARTITION BY series, core) - back)::INTEGER AS idx
FROM (SELECT *, row_number() OVER (PARTITION BY series, core ORDER BY event_id DESC) AS back FROM named) WHERE back <= 60),
n AS (SELECT series, core, count(*) AS n FROM h GROUP BY ALL),
down AS (SELECT h.series, h.core, b.j::INTEGER AS idx, max(h.value) AS value FROM h JOIN n USING (series, core)
JOIN (SELECT unnest(range(0, 20)) AS j) b ON b.j < n.n
WHERE CASE WHEN n.n <= 20 THEN h.idx = b.j ELSE h.idx >= floor(b.j * (n.n / 20.0::DOUBLE)) AND h.idx < floor((b.j + 1) * (n.n / 20.0::DOUBLE)) END
GROUP BY ALL),
s AS (SELECT *, min(value) OVER (PARTITION BY series, core) AS lo, max(value) OVER (PARTITION BY series, core) AS hi FROM down),
r AS (SELECT *, {_scale} FROM s)
SELECT series, core, idx, value, {_level} FROM r""")
_add("view_cpu_8_cores", _g(views.cpu), ORACLE_SQL["view_cpu"])
_add("view_network", _c(views.network), f"""
WITH {_COUNTERS},
d AS (SELECT series, event_id, counter, counter - lag(counter) OVER w AS dv, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt FROM counters
WINDOW w AS (PARTITION BY series ORDER BY event_id)),
r AS (SELECT series, event_id, counter, {_rate.format(per='3600000.0::DOUBLE')} FROM d),
m AS (SELECT *, max(rate) OVER (PARTITION BY series ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS peak FROM r
QUALIFY row_number() OVER (PARTITION BY series ORDER BY event_id DESC) = 1)
SELECT series, rate, peak, {_bytes_sql('counter')} AS total,
CASE WHEN counter >= 1e9 THEN counter / 1e9::DOUBLE WHEN counter >= 1e6 THEN counter / 1e6::DOUBLE WHEN counter >= 1e3 THEN counter / 1e3::DOUBLE ELSE counter::DOUBLE END AS scaled, rate / 1048576::DOUBLE AS mega
FROM m""")

# --- functions ------------------------------------------------------------------------------------------------------
_add("format_bytes", _p(lambda p: p.select("pid", fmt.format_bytes(F.col("memory")).alias("size"), fmt.format_bytes(F.col("pid")).alias("small"), fmt.format_bytes(F.col("memory") * 1_000_003).alias("large"), fmt.zero_padded(F.col("threads")).alias("padded"))), f"""
WITH {_PROC}
SELECT pid, {_bytes_sql('memory')} AS size, {_bytes_sql('pid')} AS small, {_bytes_sql('(memory * 1000003)')} AS large,
CASE WHEN threads < 10 THEN '0' ELSE '' END || threads::VARCHAR AS padded FROM proc""")
_add("format_number", _p(lambda p: p.select("pid", fmt.scaled_number(F.col("memory") * F.col("threads")).alias("s")).select("pid", "s.value", "s.suffix")), f"""
WITH {_PROC},
n AS (SELECT pid, memory * threads AS n FROM proc)
SELECT pid, CASE WHEN n >= 1e9 THEN n / 1e9::DOUBLE WHEN n >= 1e6 THEN n / 1e6::DOUBLE WHEN n >= 1e3 THEN n / 1e3::DOUBLE ELSE n::DOUBLE END AS value,
CASE WHEN n >= 1e9 THEN 'B' WHEN n >= 1e6 THEN 'M' WHEN n >= 1e3 THEN 'K' ELSE '' END AS suffix FROM n""")
_add("fixed_texts", _g(lambda g: g.select("event_id", fmt.fixed(F.col("event_id") % 20000 / 1000.0, 2).alias("two"), fmt.fixed(F.col("event_id") % 20000 / 1000.0 - 3).alias("one"), fmt.fixed(F.col("value") * 1.005, 2).alias("odd"))), """
SELECT event_id, printf('%.2f', (event_id % 20000)::DOUBLE / 1000.0::DOUBLE) AS two, printf('%.1f', (event_id % 20000)::DOUBLE / 1000.0::DOUBLE - 3) AS one, printf('%.2f', value * 1.005::DOUBLE) AS odd FROM events""")
_add("number_text", _p(lambda p: p.select("pid", fmt.format_number(F.col("memory") * F.col("threads")).alias("text"), fmt.format_number(F.col("pid") % 3000).alias("small"))), f"""
WITH {_PROC}, n AS (SELECT pid, memory * threads AS n, pid % 3000 AS m FROM proc)
SELECT pid, CASE WHEN n >= 1e9 THEN printf('%.2fB', n / 1e9::DOUBLE) WHEN n >= 1e6 THEN printf('%.2fM', n / 1e6::DOUBLE) WHEN n >= 1e3 THEN printf('%.2fK', n / 1e3::DOUBLE) ELSE n::VARCHAR END AS text,
CASE WHEN m >= 1000 THEN printf('%.2fK', m / 1e3::DOUBLE) ELSE m::VARCHAR END AS small FROM n""")
_add("gauge_texts", _g(lambda g: g.select("event_id", fmt.gauge_text(F.col("value") - 20, 400.0, 10).alias("share"), fmt.gauge_text(F.col("value") - 20, 400.0, 10, "value").alias("raw"), fmt.gauge_text(F.col("value"), 0.0, 10, "none").alias("plain"), fmt.mini_gauge(F.col("value") / 8, "MB", 50.0).alias("mini"), fmt.mini_gauge(F.col("value") * 1000, "", 50.0, 5).alias("bare"))), """
WITH c AS (SELECT event_id, value, value - 20 AS v, least(greatest((value - 20) / 400.0::DOUBLE * 100, 0.0::DOUBLE), 100.0::DOUBLE) AS p, least(greatest(value / 8 / 50.0::DOUBLE * 100, 0.0::DOUBLE), 100.0::DOUBLE) AS q,
  least(greatest(value * 1000 / 50.0::DOUBLE * 100, 0.0::DOUBLE), 100.0::DOUBLE) AS r, least(greatest(value / 1.0::DOUBLE * 100, 0.0::DOUBLE), 100.0::DOUBLE) AS s FROM events),
b AS (SELECT *, least(floor(10.0::DOUBLE * (p / 100.0::DOUBLE)), 10)::INTEGER AS np, least(floor(15.0::DOUBLE * (q / 100.0::DOUBLE)), 15)::INTEGER AS nq, least(floor(5.0::DOUBLE * (r / 100.0::DOUBLE)), 5)::INTEGER AS nr, least(floor(10.0::DOUBLE * (s / 100.0::DOUBLE)), 10)::INTEGER AS ns FROM c)
SELECT event_id, repeat('▓', np) || repeat('░', 10 - np) || printf(' %5.1f%%', p) AS share, repeat('▓', np) || repeat('░', 10 - np) || printf(' %6.1f', v) AS raw, repeat('▓', ns) || repeat('░', 10 - ns) AS plain,
repeat('▓', nq) || repeat('░', 15 - nq) || printf(' %6.1f MB', value / 8) AS mini, repeat('▓', nr) || repeat('░', 5 - nr) || printf(' %6.1f', value * 1000) AS bare FROM b""")
_add("truncate_name", lambda s, d: tables.table(s, d, "customer").select("c_custkey", fmt.truncate(F.col("c_name"), 12).alias("cut"), fmt.truncate(F.col("c_name"), 20).alias("uncut"), fmt.truncate(F.col("c_name"), 3).alias("tiny")), """
SELECT c_custkey, CASE WHEN length(c_name) <= 12 THEN c_name ELSE substring(c_name, 1, 9) || '...' END AS cut, c_name AS uncut, c_name AS tiny
FROM customer""")
_add("bar_cells", _g(lambda g: g.select("event_id", fmt.bar_cells(F.col("value"), 500.0, 20).alias("cells"), fmt.bar(F.col("value"), 300.0, 12).alias("bar"), fmt.percent_of(F.col("value"), 0.0).alias("percent"))), """
WITH c AS (SELECT event_id, value, least(floor(12.0::DOUBLE * (least(greatest(value / 300.0::DOUBLE * 100, 0), 100) / 100.0::DOUBLE)), 12)::INTEGER AS k
FROM events)
SELECT event_id, least(floor(20.0::DOUBLE * (least(greatest(value / 500.0::DOUBLE * 100, 0), 100) / 100.0::DOUBLE)), 20)::INTEGER AS cells, repeat('▓', k) || repeat('░', 12 - k) AS bar, least(greatest(value / 1.0::DOUBLE * 100, 0.0::DOUBLE), 100.0::DOUBLE) AS percent
FROM c""")
_add("colored_gauge", _g(lambda g: g.select("event_id", fmt.colored_gauge(F.col("value"), lambda v: levels.level(v, levels.LIVE_CPU_COLOR), 400.0, 10).alias("g")).select("event_id", "g.*")), f"""
WITH c AS (SELECT event_id, value, least(greatest(value / 400.0::DOUBLE * 100, 0.0::DOUBLE), 100.0::DOUBLE) AS percent FROM events)
SELECT event_id, repeat('▓', least(floor(10.0::DOUBLE * (percent / 100.0::DOUBLE)), 10)::INTEGER) || repeat('░', 10 - least(floor(10.0::DOUBLE * (percent / 100.0::DOUBLE)), 10)::INTEGER) AS bar, percent, {_level_sql('value', levels.LIVE_CPU_COLOR)} AS color
FROM c""")
for _name, _scale_of in (("temp_label", levels.TEMP_LABEL), ("temp_status", levels.TEMP_STATUS), ("temp_color", levels.TEMP_COLOR), ("cpu_color", levels.CPU_COLOR), ("mem_color", levels.MEMORY_COLOR), ("live_cpu_color", levels.LIVE_CPU_COLOR), ("live_mem_color", levels.LIVE_MEMORY_COLOR)):
    _add(_name, _g(lambda g, n=_name, s=_scale_of: g.select("event_id", levels.level(F.col("value"), s).alias(n))), f"SELECT event_id, {_level_sql('value', _scale_of)} AS {_name} FROM events")
_add("temp_estimates", _g(lambda g: derived.temperature_estimates(g, "value").select("event_id", "package", "cores", "gpu", "ane", "battery", "ambient", "fan_rpm", "fan_mode", "available")), """
SELECT event_id, 35 + value * 0.5::DOUBLE AS package, 35 + value * 0.5::DOUBLE + 2 AS cores, 35 + value * 0.3::DOUBLE AS gpu, 35 + value * 0.2::DOUBLE AS ane, 38.0::DOUBLE AS battery, 22.0::DOUBLE AS ambient, (2000 + trunc(value * 40)::INTEGER)::INTEGER AS fan_rpm, 'Auto' AS fan_mode, true AS available
FROM events""")
_add("temp_f", _g(lambda g: g.select("event_id", fmt.in_unit(F.col("value"), F.when(F.col("core") == "view", "F").otherwise("C")).alias("degrees"), fmt.format_temperature(F.col("value"), "F").alias("text"))), """
SELECT event_id,
CASE WHEN event_type = 'view' THEN value * 9 / 5 + 32 ELSE value END AS degrees, round_even(value * 9 / 5 + 32, 0)::BIGINT::VARCHAR || '°F' AS text
FROM events""")
_add("view_temperature", _g(views.temperature), f"""
WITH {_GAUGES},
u AS (SELECT series, arg_max(value, event_id) % 100 AS usage FROM gauges GROUP BY series),
t AS (SELECT *, 35 + usage * 0.5::DOUBLE AS package FROM u)
SELECT series, usage, package, package + 2 AS cores, 35 + usage * 0.3::DOUBLE AS gpu, 35 + usage * 0.2::DOUBLE AS ane, (2000 + trunc(usage * 40)::INTEGER)::INTEGER AS fan_rpm, {_level_sql('package', levels.TEMP_LABEL)} AS label, {_level_sql('package', levels.TEMP_STATUS)} AS status, {_level_sql('package', levels.TEMP_COLOR)} AS color, round_even(package, 0)::BIGINT::VARCHAR || '°C' AS text
FROM t""")
_add("memory_derived", lambda s, d: derived.memory_derived(tables.memory_samples(s, d)), f"""
WITH {_MEM}
SELECT *,
CASE WHEN total > 0 THEN used::DOUBLE / total * 100 END AS pressure, greatest(total - used - free, 0) AS cache, used AS app, 0::BIGINT AS wired, 0::BIGINT AS compressed, 0::BIGINT AS purgeable,
CASE WHEN swap_total > 0 THEN swap_used::DOUBLE / swap_total * 100 ELSE 0.0::DOUBLE END AS swap_percent FROM mem""")
_add("view_memory", lambda s, d: views.memory(tables.memory_samples(s, d)), f"""
WITH {_MEM},
m AS (SELECT *, CASE WHEN total > 0 THEN used::DOUBLE / total * 100 END AS pressure FROM mem)
SELECT sample_id, pressure, greatest(total - used - free, 0) AS cache, used AS app,
CASE WHEN swap_total > 0 THEN swap_used::DOUBLE / swap_total * 100 ELSE 0.0::DOUBLE END AS swap_percent, {_level_sql('coalesce(pressure, 0)', levels.LIVE_MEMORY_COLOR)} AS color,
{_bytes_sql('used')} AS used_text, least(floor(20.0::DOUBLE * (least(greatest(coalesce(pressure, 0) / 100.0::DOUBLE * 100, 0), 100) / 100.0::DOUBLE)), 20)::INTEGER AS cells
FROM m""")
_add("process_defaults", lambda s, d: derived.with_defaults(tables.processes(s, d).withColumns({"name": F.when(F.col("pid") % 3 != 0, F.col("name")), "threads": F.when(F.col("pid") % 5 != 0, F.col("threads")), "cpu_percent": F.when(F.col("pid") % 7 != 0, F.col("cpu_percent"))})).select("pid", "name", "threads", "cpu_percent"), f"""
WITH {_PROC}
SELECT pid, CASE WHEN pid % 3 <> 0 THEN name ELSE 'unknown' END AS name, CASE WHEN pid % 5 <> 0 THEN threads ELSE 0 END AS threads,
CASE WHEN pid % 7 <> 0 THEN cpu_percent ELSE 0.0::DOUBLE END AS cpu_percent FROM proc""")
_add("parsed_int", lambda s, d: tables.table(s, d, "orders").select("o_orderkey", fmt.parsed_int(F.substring("o_orderpriority", 1, 1)).alias("level"), fmt.parsed_int(F.col("o_orderpriority")).alias("none"), fmt.interval_label((F.col("o_custkey") % 6) * 1_000_000_000).alias("label"), fmt.on_off(F.col("o_orderstatus") == "F").alias("flag")), """
SELECT o_orderkey, try_cast(substring(o_orderpriority, 1, 1) AS INTEGER) AS level, try_cast(o_orderpriority AS INTEGER) AS none,
CASE o_custkey % 6 WHEN 2 THEN '2s' WHEN 5 THEN '5s' ELSE '1s' END AS label, CASE WHEN o_orderstatus = 'F' THEN 'ON' ELSE 'OFF' END AS flag
FROM orders""")
_add("clock", _g(lambda g: g.select("event_id", fmt.clock(F.col("ts")).alias("clock"))), "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
_add("bucket_lookup", lambda s, d: tables.table(s, d, "lineitem").groupBy(levels.first_below(F.col("l_quantity"), [(10, "pid"), (20, "name"), (40, "user")], "cpu").alias("column")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("top")), """
SELECT CASE WHEN l_quantity < 10 THEN 'pid' WHEN l_quantity < 20 THEN 'name' WHEN l_quantity < 40 THEN 'user' ELSE 'cpu' END AS "column", count(*) AS n, max(l_quantity) AS top
FROM lineitem GROUP BY 1""")
_add("span_lookup", lambda s, d: tables.table(s, d, "lineitem").groupBy(levels.within(F.col("l_quantity"), [(5, 10, "a"), (10, 30, "b")]).alias("tab")).agg(F.count(F.lit(1)).alias("n")), """
SELECT CASE WHEN l_quantity >= 5 AND l_quantity < 10 THEN 'a' WHEN l_quantity >= 10 AND l_quantity < 30 THEN 'b' END AS tab, count(*) AS n
FROM lineitem GROUP BY 1""")

# --- selection and safety -------------------------------------------------------------------------------------------
_add("select_all", _p(selection.select_all), f"WITH {_PROC} SELECT DISTINCT pid FROM proc")
_add("select_range", _p(lambda p: selection.select_range(p, 20, 77)), f"""
WITH {_PROC},
o AS (SELECT pid, row_number() OVER (ORDER BY cpu_percent DESC, pid) AS pos FROM proc),
e AS (SELECT min(pos) AS a, max(pos) AS b FROM o WHERE pid IN (20, 77))
SELECT pid FROM o, e WHERE pos BETWEEN a AND b""")
_add("select_range_missing", _p(lambda p: selection.select_range(p, 20, -1)), f"WITH {_PROC} SELECT pid FROM proc WHERE false")
_add("select_toggle", lambda s, d: selection.toggled(_chosen(s), tables.processes(s, d).where("pid % 100 = 0").select("pid")), f"""
WITH {_PROC}, {_CHOSEN},
b AS (SELECT pid FROM proc WHERE pid % 100 = 0) (SELECT pid FROM chosen EXCEPT
SELECT pid FROM b) UNION (SELECT pid FROM b EXCEPT
SELECT pid FROM chosen)""")
_add("select_add", lambda s, d: selection.added(_chosen(s), selection.select_range(tables.processes(s, d), 3, 40)), f"""
WITH {_PROC}, {_CHOSEN},
o AS (SELECT pid, row_number() OVER (ORDER BY cpu_percent DESC, pid) AS pos FROM proc),
e AS (SELECT min(pos) AS a, max(pos) AS b FROM o WHERE pid IN (3, 40))
SELECT pid FROM o, e WHERE pos BETWEEN a AND b UNION
SELECT pid FROM chosen""")
_add("process_flags", lambda s, d: safety.flags_by_join(safety.listed_flags(tables.processes(s, d)).drop("is_protected"), tables.process_class(s)).select("pid", "name", "is_system", "is_protected"), f"""
WITH {_PROC}
SELECT pid, name, "user" IN ('root', '_mbsetupuser') OR pid < 100 AS is_system, name IN {_PROTECTED} OR pid = 1 AS is_protected FROM proc""")
_add("kill_lookup", lambda s, d: tables.processes(s, d).join(_chosen(s), "pid").select("pid", "name", "user"), f"WITH {_PROC}, {_CHOSEN} SELECT pid, name, \"user\" FROM proc JOIN chosen USING (pid)")
_CLASS = f"""
cls AS (SELECT *, name IN {_PROTECTED} OR pid < 100 AS protected, NOT (name IN {_PROTECTED} OR pid < 100) AND "user" IN ('root', '_mbsetupuser') AS system, "user" <> '' AND "user" <> 'alice' AS sudo
FROM proc)"""
_add("kill_classes", _p(lambda p: safety.classified(p, ME).select("pid", "protected", "system", "sudo", "label", F.array_join("warnings", " | ").alias("warnings"))), f"""
WITH {_PROC}, {_CLASS}
SELECT pid, protected, system, sudo, CASE WHEN protected THEN 'CRITICAL' WHEN system THEN 'CAUTION' ELSE 'OK' END AS label, concat_ws(' | ',
CASE WHEN protected THEN name || ' (PID ' || pid || ') is a protected system process' WHEN system THEN name || ' (PID ' || pid || ') is a system process (root-owned)' END,
CASE WHEN sudo THEN name || ' (PID ' || pid || ') is owned by ' || "user" || ', may require elevated privileges' END) AS warnings FROM cls""")
_add("kill_confirmation", lambda s, d: safety.confirmation(tables.processes(s, d), _chosen(s), ME), f"""
WITH {_PROC}, {_CHOSEN}, {_CLASS},
w AS (SELECT pid, 1 AS ord,
CASE WHEN protected THEN name || ' (PID ' || pid || ') is a protected system process' ELSE name || ' (PID ' || pid || ') is a system process (root-owned)' END AS text
FROM cls WHERE protected OR system UNION ALL
SELECT pid, 2, name || ' (PID ' || pid || ') is owned by ' || "user" || ', may require elevated privileges' FROM cls WHERE sudo)
SELECT (SELECT count(*) FROM cls JOIN chosen USING (pid)) AS processes, (SELECT bool_or(protected) FROM cls
JOIN chosen USING (pid)) AS has_protected, (SELECT bool_or(system) FROM cls JOIN chosen USING (pid)) AS has_system, (SELECT bool_or(sudo) FROM cls
JOIN chosen USING (pid)) AS requires_sudo, count(*) AS n_warnings, string_agg(text, ' | ' ORDER BY pid, ord) AS warnings FROM w
JOIN chosen USING (pid)""")
_add("kill_plan", lambda s, d: safety.kill_plan(tables.processes(s, d), _chosen(s), ME), f"""
WITH {_PROC}, {_CHOSEN}, {_CLASS}
SELECT pid, CASE WHEN protected THEN 'SKIP_PROTECTED' ELSE 'TERM' END AS action FROM cls JOIN chosen USING (pid)""")
_add("kill_anti", lambda s, d: (lambda p: _chosen(s).join(safety.classified(p, ME).where("protected").select("pid"), "pid", "left_anti").join(p.select("pid"), "pid", "left_semi"))(tables.processes(s, d)), f"""
WITH {_PROC}, {_CHOSEN}, {_CLASS}
SELECT pid FROM chosen JOIN cls USING (pid) WHERE NOT protected""")
_add("kill_validate", _p(lambda p: safety.validated(p, ME).select("pid", "ok", F.size("warnings").alias("n"), F.array_join("warnings", " | ").alias("warnings"))), f"""
WITH {_PROC},
v AS (SELECT *, name IN ('launchd', 'kernel_task', 'init') OR pid = 1 AS critical, name = 'WindowServer' AS important FROM proc)
SELECT pid, NOT critical AS ok, (CASE WHEN critical THEN 1 ELSE important::INTEGER + ("user" = 'root')::INTEGER + ("user" <> 'alice')::INTEGER END)::INTEGER AS n,
CASE WHEN critical THEN 'CRITICAL: This is a core system process. Killing it may cause system instability or kernel panic.' ELSE concat_ws(' | ',
CASE WHEN important THEN 'WARNING: ' || name || ' is an important system service. Killing it may cause unexpected behavior.' END,
CASE WHEN "user" = 'root' THEN 'CAUTION: This process is owned by root. Ensure you have a good reason to terminate it.' END,
CASE WHEN "user" <> 'alice' THEN 'CAUTION: This process is owned by ' || "user" || '. You may not have permission to kill it.' END) END AS warnings
FROM v""")

# --- streams, run over what is there ----------------------------------------------------------------------------------
_add("stream_ring60", lambda s, d: rings.drained(rings.rolling_stream(rings.sample_stream(s, d)), "ring").select("series", "event_id", "ring_min", "ring_max", "ring_size"), ORACLE_SQL["ring60_minmax"])
_add("stream_latest", lambda s, d: rings.drained(rings.latest_stream(rings.sample_stream(s, d)), "latest", "complete"), f"""
WITH {_GAUGES}
SELECT series, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM gauges GROUP BY series""")
_add("stream_windows", lambda s, d: rings.drained(rings.tumbling_counts(rings.sample_stream(s, d)), "windows", "complete"), f"""
WITH {_GAUGES}
SELECT (epoch_us(date_trunc('hour', ts)) // 1000000)::BIGINT AS start, core, count(*) AS n, max(value) AS top FROM gauges GROUP BY ALL""")
