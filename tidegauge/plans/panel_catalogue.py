"""The queries of ``panels`` and of the streams beside them, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import formatting as fmt
from tidegauge.operators import safety, snapshot
from tidegauge.plans import panels
from tidegauge.plans.catalogue import _CHOSEN, _CLASS, _GAUGES, _MEM, _PROC, ME, ORACLE_SQL, QUERIES, Query, _bytes_sql, _chosen
from tidegauge.sources import tables
from tidegauge.streaming import rings


def _add(name: str, run: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = run, sql


_NET = f"""{_GAUGES}, net AS (
  SELECT series, event_id, ts, sum(CAST(round(value * 100) AS BIGINT)) OVER w AS bytes_recv, sum(CAST(round(value * 40) AS BIGINT)) OVER w AS bytes_sent,
         sum(event_id % 97 + 1) OVER w AS packets_recv, sum(event_id % 53 + 1) OVER w AS packets_sent
  FROM gauges WINDOW w AS (PARTITION BY series ORDER BY event_id)),
steps AS (
  SELECT *, bytes_recv - lag(bytes_recv) OVER w AS down, bytes_sent - lag(bytes_sent) OVER w AS up, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt
  FROM net WINDOW w AS (PARTITION BY series ORDER BY event_id)),
rated AS (
  SELECT *, CASE WHEN dt > 0 AND down >= 0 THEN floor(down * 3600000.0::DOUBLE / (dt / 1000000.0::DOUBLE))::BIGINT END AS download,
         CASE WHEN dt > 0 AND up >= 0 THEN floor(up * 3600000.0::DOUBLE / (dt / 1000000.0::DOUBLE))::BIGINT END AS upload
  FROM steps)"""


def _scaled_sql(n: str) -> tuple[str, str]:
    value = f"CASE WHEN {n} >= 1e9 THEN {n} / 1e9::DOUBLE WHEN {n} >= 1e6 THEN {n} / 1e6::DOUBLE WHEN {n} >= 1e3 THEN {n} / 1e3::DOUBLE ELSE {n}::DOUBLE END"
    return value, f"CASE WHEN {n} >= 1e9 THEN 'B' WHEN {n} >= 1e6 THEN 'M' WHEN {n} >= 1e3 THEN 'K' ELSE '' END"


# --- hosts ------------------------------------------------------------------------------------------------------------
_add(
    "host_cpu",
    lambda s, d: panels.cpu_panel(tables.cpu_info(s, d)),
    """
WITH i AS (SELECT s_suppkey AS host, s_suppkey % 3 AS n, 2000.0::DOUBLE + s_suppkey % 150 * 10 AS mhz, (s_suppkey % 8 + 1)::INTEGER AS c FROM supplier),
p AS (SELECT host, CASE WHEN n > 0 THEN mhz ELSE 0.0::DOUBLE END AS frequency_mhz, (c * n)::INTEGER AS threads, (c * n)::INTEGER AS cores FROM i)
SELECT *, 0.0::DOUBLE AS load_1, 0.0::DOUBLE AS load_5, 0.0::DOUBLE AS load_15, frequency_mhz / 1000 AS ghz,
       printf('  %.2f GHz  │  %d cores  │  %d threads', frequency_mhz / 1000, cores, threads) AS line
FROM p""",
)
_add("core_counts", lambda s, d: panels.core_counts(tables.gauges(s, d)), f"WITH {_GAUGES} SELECT series, count(DISTINCT core) AS core_count FROM gauges GROUP BY series")
_add(
    "host_attributes",
    lambda s, d: panels.host(tables.host_info(s, d)),
    """
SELECT lower(n_name) AS hostname, CASE WHEN n_nationkey % 6 <> 0 THEN lower(r_name) ELSE '' END AS os, CASE WHEN n_nationkey % 5 <> 0 THEN 'standalone' ELSE '' END AS platform,
       '24.' || n_nationkey AS kernel, CASE WHEN n_nationkey % 7 <> 0 THEN n_nationkey::BIGINT * 5000 ELSE 0 END AS uptime, 1700000000 - n_nationkey::BIGINT * 5000 AS boot_time
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
)

# --- panels of the overview -------------------------------------------------------------------------------------------
_add(
    "memory_panel",
    lambda s, d: panels.memory_panel(tables.memory_samples(s, d)),
    f"WITH {_MEM} SELECT sample_id, '  ' || {_bytes_sql('used')} || ' / ' || {_bytes_sql('total')} || '  │  ' || {_bytes_sql('swap_used')} || ' swap' AS line FROM mem",
)
_degrees = lambda x: f"round_even({x}, 0)::BIGINT::VARCHAR || '°C'"
_add(
    "temperature_panel",
    lambda s, d: panels.temperature_panel(tables.gauges(s, d)),
    f"""
WITH {_GAUGES}, u AS (SELECT series, arg_max(value, event_id) % 100 AS usage FROM gauges GROUP BY series)
SELECT series, '  CPU: ' || {_degrees('35 + usage * 0.5::DOUBLE')} || '  │  GPU: ' || {_degrees('35 + usage * 0.3::DOUBLE')} || '  │  ANE: ' || {_degrees('35 + usage * 0.2::DOUBLE')} AS heat,
       '  Fan: ' || (2000 + trunc(usage * 40)::INTEGER)::VARCHAR || ' RPM (Auto)' AS fan
FROM u""",
)
_add(
    "temperature_history",
    lambda s, d: panels.temperature_history(tables.gauges(s, d)),
    f"""
WITH {_GAUGES}, t AS (SELECT series, event_id, 35 + value % 100 * 0.5::DOUBLE AS package FROM gauges)
SELECT series, event_id, package, min(package) OVER w AS ring_min, max(package) OVER w AS ring_max, count(*) OVER w AS ring_size
FROM t WINDOW w AS (PARTITION BY series ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
_in, _out = _scaled_sql("packets_recv"), _scaled_sql("packets_sent")
_add(
    "network_panel",
    lambda s, d: panels.network_panel(tables.network_counters(s, d)),
    f"""
WITH {_NET}, last AS (
  SELECT series, coalesce(download, 0) AS download, coalesce(upload, 0) AS upload, bytes_recv::BIGINT AS bytes_recv, bytes_sent::BIGINT AS bytes_sent, packets_recv, packets_sent
  FROM rated QUALIFY row_number() OVER (PARTITION BY series ORDER BY event_id DESC) = 1)
SELECT series, download, upload, download / 1048576::DOUBLE AS download_mega, upload / 1048576::DOUBLE AS upload_mega,
       '  ↓ ' || {_bytes_sql('download')} || '/s    ↑ ' || {_bytes_sql('upload')} || '/s' AS speed,
       '  Total: ↓ ' || {_bytes_sql('bytes_recv')} || '    ↑ ' || {_bytes_sql('bytes_sent')} AS total,
       {_in[0]} AS packets_in, {_in[1]} AS packets_in_suffix, {_out[0]} AS packets_out, {_out[1]} AS packets_out_suffix
FROM last""",
)
_add(
    "upload_history",
    lambda s, d: panels.upload_history(tables.network_counters(s, d)),
    f"""
WITH {_NET}
SELECT series, event_id, upload, max(upload) OVER w AS peak, count(*) OVER w AS ring_size FROM rated WHERE upload IS NOT NULL
WINDOW w AS (PARTITION BY series ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
_side = "SELECT series, {c}::DOUBLE AS v, (max(back) OVER (PARTITION BY series) - back)::INTEGER AS idx FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY event_id DESC) AS back FROM rated WHERE {c} IS NOT NULL) WHERE back <= 60"
_add(
    "speed_history",
    lambda s, d: panels.speed_history(tables.network_counters(s, d)),
    f"""
WITH {_NET}, a AS ({_side.format(c='download')}), b AS ({_side.format(c='upload')})
SELECT coalesce(a.series, b.series) AS series, coalesce(a.idx, b.idx) AS idx, greatest(coalesce(a.v, 0.0::DOUBLE), coalesce(b.v, 0.0::DOUBLE)) / 1048576::DOUBLE AS mega
FROM a FULL JOIN b ON a.series = b.series AND a.idx = b.idx""",
)

# --- processes --------------------------------------------------------------------------------------------------------
_add(
    "process_rows",
    lambda s, d: panels.process_rows(tables.processes(s, d), _chosen(s)),
    f"""
WITH {_PROC}, {_CHOSEN}
SELECT pid, CASE WHEN pid IN (SELECT pid FROM chosen) THEN '▶ ' ELSE '' END || name AS name, printf('%.1f', cpu_percent) AS cpu, {_bytes_sql('memory')} AS memory,
       {_bytes_sql('io_read_bytes')} || '/' || {_bytes_sql('io_write_bytes')} AS recv_sent, threads, "user"
FROM proc""",
)
_add(
    "fixed_decimals",
    lambda s, d: tables.table(s, d, "orders").select("o_orderkey", fmt.fixed(F.col("o_totalprice")).alias("price"), fmt.fixed(F.col("o_custkey") / 20).alias("ties"), fmt.left_padded(fmt.fixed(F.col("o_totalprice") / 3), 12).alias("third")),
    "SELECT o_orderkey, printf('%.1f', o_totalprice) AS price, printf('%.1f', o_custkey / 20.0::DOUBLE) AS ties, printf('%12.1f', o_totalprice / 3) AS third FROM orders",
)
_add(
    "process_attributes",
    lambda s, d: panels.attributes(tables.process_attributes(s, d), tables.connections(s, d)),
    f"""
WITH {_PROC}, n AS (SELECT l_orderkey AS pid, count(*)::INTEGER AS connections FROM lineitem GROUP BY 1)
SELECT pid, name, "user", CASE WHEN pid % 11 <> 0 THEN o_orderstatus ELSE 'unknown' END AS status, CASE WHEN pid % 13 <> 0 THEN epoch_ms(o_orderdate) ELSE 0 END AS create_time,
       CASE WHEN pid % 4 <> 0 THEN o_custkey::INTEGER ELSE 0 END AS parent, CASE WHEN pid % 9 <> 0 THEN (o_totalprice / 7000)::FLOAT::DOUBLE ELSE 0.0::DOUBLE END AS memory_percent,
       threads, coalesce(connections, 0)::INTEGER AS connections
FROM proc JOIN orders ON pid = o_orderkey LEFT JOIN n USING (pid)""",
)
_add(
    "connection_counts",
    lambda s, d: tables.connections(s, d).groupBy("pid").agg(F.count(F.lit(1)).alias("connections")),
    "SELECT l_orderkey AS pid, count(*) AS connections FROM lineitem GROUP BY 1",
)
_add(
    "status_line",
    lambda s, d: panels.status_line(tables.processes(s, d), _chosen(s), tables.memory_samples(s, d), tables.gauges(s, d), snapshot.SortSpec("name", True)),
    f"""
WITH {_PROC}, {_CHOSEN}, {_MEM},
a AS (SELECT count(*) AS processes, count(*) FILTER (pid IN (SELECT pid FROM chosen)) AS selected FROM proc),
b AS (SELECT CASE WHEN sum(total) > 0 THEN sum(used)::DOUBLE / sum(total) * 100 ELSE 0.0::DOUBLE END AS memory FROM mem),
c AS (SELECT value % 100 AS usage, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
SELECT processes, selected, ' Processes: ' || processes || '  │  CPU: ' || printf('%.1f', usage) || '%  │  Memory: ' || printf('%.1f', memory) || '%  │  Update: ' || strftime(ts, '%H:%M:%S')
       || '  │  Mouse: ON │ Sort: name ↑' || CASE WHEN selected > 0 THEN ' │ Selected: ' || selected ELSE '' END AS line
FROM a, b, c""",
)
_add(
    "kill_warnings",
    lambda s, d: safety.warnings(tables.processes(s, d), _chosen(s), ME),
    f"""
WITH {_PROC}, {_CHOSEN}, {_CLASS}, w AS (
  SELECT pid, 0 AS ord, CASE WHEN protected THEN name || ' (PID ' || pid || ') is a protected system process' ELSE name || ' (PID ' || pid || ') is a system process (root-owned)' END AS text
  FROM cls WHERE protected OR system
  UNION ALL
  SELECT pid, (protected OR system)::INTEGER, name || ' (PID ' || pid || ') is owned by ' || "user" || ', may require elevated privileges' FROM cls WHERE sudo)
SELECT pid, ord::INTEGER AS ord, text FROM w JOIN chosen USING (pid)""",
)

# --- streams, run over what is there ----------------------------------------------------------------------------------
_FALLING = "c AS (SELECT user_id AS series, event_id, CAST(round(value * 100) AS BIGINT) AS counter, epoch_us(ts) AS us FROM events)"
_add(
    "stream_rates",
    lambda s, d: rings.drained(rings.rate_stream(rings.counter_stream(s, d), 1000.0), "rates"),
    f"""
WITH {_FALLING}, d AS (SELECT series, event_id, counter, counter - lag(counter) OVER w AS dv, us - lag(us) OVER w AS dt FROM c WINDOW w AS (PARTITION BY series ORDER BY event_id))
SELECT series, event_id, counter, CASE WHEN dt > 0 AND dv >= 0 THEN floor(dv * 1000.0::DOUBLE / (dt / 1000000.0::DOUBLE))::BIGINT END AS rate, coalesce(dv < 0, false) AS counter_reset FROM d""",
)
_add(
    "stream_ranking",
    lambda s, d: rings.drained(rings.latest_stream(rings.sample_stream(s, d)), "ranking", "complete", each=lambda df: rings.ranked(df, 20)),
    f"""
WITH {_GAUGES}, l AS (SELECT series, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM gauges GROUP BY series)
SELECT *, (row_number() OVER (ORDER BY value DESC, series))::INTEGER AS place FROM l ORDER BY value DESC, series LIMIT 20""",
)
_add(
    "stream_changes",
    lambda s, d: rings.drained(rings.rolling_stream(rings.sample_stream(s, d)), "changes").select("series", "event_id", "change"),
    f"WITH {_GAUGES} SELECT series, event_id, value - lag(value) OVER (PARTITION BY series ORDER BY event_id) AS change FROM gauges",
)
