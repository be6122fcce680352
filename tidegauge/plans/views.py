"""Views as queries: each composes operators and returns one small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.functions import derived, formatting as fmt, levels
from tidegauge.operators import safety, selection, series, snapshot


def process_table(processes: DataFrame, selected: DataFrame, spec: snapshot.SortSpec = snapshot.SortSpec(), show_system: bool = True, text: str = "", most: int | None = None) -> DataFrame:
    """The process table: marked and cut names, sizes as text, sorted; optionally without system rows, by text, limited."""
    rows = safety.listed_flags(selection.marked(processes, selected))
    if not show_system:
        rows = rows.where("not is_system")
    if text:
        rows = rows.where(F.lower("name").contains(text.lower()))
    rows = snapshot.sort_processes(rows, spec)
    rows = rows.limit(most) if most else rows
    name = F.concat(F.when(F.col("selected"), "▶ ").otherwise(""), fmt.truncate(F.col("name"), 20))
    return rows.select("pid", name.alias("name"), "cpu_percent", fmt.format_bytes(F.col("memory")).alias("memory"), fmt.format_bytes(F.col("io_write_bytes") + F.col("io_read_bytes")).alias("net_io"), "threads", fmt.truncate(F.col("user"), 12).alias("user"))


def top_table(processes: DataFrame, n: int = 8) -> DataFrame:
    """The busiest processes of the overview, names padded to their columns."""
    top = snapshot.top_processes(processes, n)
    return top.select("pid", fmt.padded(fmt.truncate(F.col("name"), 30), 30).alias("name"), "cpu_percent", fmt.format_bytes(F.col("memory")).alias("memory"), "threads", fmt.padded(fmt.truncate(F.col("user"), 15), 15).alias("user"))


def overview(gauges: DataFrame, n: int = 8) -> DataFrame:
    """The series with the largest latest values: severity, colour, bar and size of each. The flagship query."""
    last = snapshot.latest(gauges, ["series"], ["ts", "event_id"])
    v = F.col("value")
    shown = last.select("series", "event_id", "value", levels.level(v, levels.TEMP_LABEL).alias("severity"), levels.level(v, levels.LIVE_CPU_COLOR).alias("color"), fmt.bar(v, 500.0, 20).alias("bar"), fmt.format_bytes(F.floor(v * 1024).cast("bigint")).alias("size"))
    return shown.orderBy(F.desc("value"), "series").limit(n)


def cpu(gauges: DataFrame, cores: int = 8, width: int = 20) -> DataFrame:
    """Each series' history, downsampled to ``width`` points with chart levels, for its first ``cores`` cores."""
    # Cores are ranked, not samples: one row for each series and core.
    first = gauges.select("series", "core").distinct().withColumn("__rank", F.row_number().over(Window.partitionBy("series").orderBy("core"))).where(F.col("__rank") <= cores).select(F.col("series").alias("__series"), F.col("core").alias("__core"))
    named = gauges.join(first, F.col("series").eqNullSafe(F.col("__series")) & F.col("core").eqNullSafe(F.col("__core")), "left_semi")
    arrays = series.history_arrays(named, ["series", "core"], ["event_id"], "value")
    points = arrays.select("series", "core", F.posexplode(series.downsampled(F.col("values"), width)).alias("idx", "value"))
    return series.chart_levels(points, ["series", "core"], "value")


def memory(samples: DataFrame) -> DataFrame:
    """Memory samples with derived columns, swap share, colour and sizes as text."""
    full = derived.memory_derived(samples)
    pressure = F.coalesce("pressure", F.lit(0.0))
    return full.select("sample_id", "pressure", "cache", "app", "swap_percent", levels.level(pressure, levels.LIVE_MEMORY_COLOR).alias("color"), fmt.format_bytes(F.col("used")).alias("used_text"), fmt.bar_cells(pressure).alias("cells"))


def network(counters: DataFrame) -> DataFrame:
    """The latest rate of each series, its peak over the rolling history, and its total as text."""
    # The last 60 rates need 61 samples of each series; the others go before the shuffle.
    recent = series.recent(counters, ["series"], ["event_id"], series.HISTORY + 1)
    rated = series.rates(recent, ["series"], ["event_id"], "counter", "ts", per=3_600_000.0)
    ringed = series.rolling_range(rated, ["series"], ["event_id"], "rate")
    last = snapshot.latest(ringed, ["series"], ["event_id"])
    return last.select("series", "rate", F.col("ring_max").alias("peak"), fmt.format_bytes(F.col("counter")).alias("total"), fmt.scaled_number(F.col("counter"))["value"].alias("scaled"), derived.mega_per_second(F.col("rate")).alias("mega"))


def temperature(gauges: DataFrame, unit: str = "C") -> DataFrame:
    """Estimated temperatures of each series' latest usage, with label, status, colour and text."""
    usage = snapshot.latest_values(gauges, ["series"], ["value"], "event_id").withColumn("usage", F.col("value") % 100)
    t = derived.temperature_estimates(usage, "usage")
    p = F.col("package")
    return t.select("series", "usage", "package", "cores", "gpu", "ane", "fan_rpm", levels.level(p, levels.TEMP_LABEL).alias("label"), levels.level(p, levels.TEMP_STATUS).alias("status"), levels.level(p, levels.TEMP_COLOR).alias("color"), fmt.format_temperature(p, unit).alias("text"))


def status_bar(processes: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: processes, selected processes, and the busiest one's CPU share."""
    rows = selection.marked(processes, selected)
    return rows.agg(F.count(F.lit(1)).alias("processes"), F.count_if("selected").alias("selected"), F.max("cpu_percent").alias("top_cpu"), F.max("memory").alias("top_memory"))
