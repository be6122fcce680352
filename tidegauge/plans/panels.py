"""Views of hosts as rows: panels of the overview, both directions of the network, histories, attributes of processes and hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import derived, formatting as fmt, levels
from tidegauge.operators import safety, selection, series, snapshot

#: Seconds' share that the network views count rates in.
PER = 3_600_000.0


def cpu_panel(info: DataFrame) -> DataFrame:
    """host, frequency_mhz, ghz, cores, threads, three load averages (0: not known) and the line that shows them.

    Frequency and threads come from the first package, threads times the number of packages; without packages both are 0.
    """
    first = derived.first_of(F.col("packages"))
    rows = info.select(
        "host", F.coalesce(first["mhz"], F.lit(0.0)).alias("frequency_mhz"), F.coalesce(derived.thread_count(first["cores"], F.size("packages")), F.lit(0)).alias("threads"),
        F.coalesce(F.aggregate("packages", F.lit(0), lambda n, p: n + p["cores"]), F.lit(0)).alias("cores"), *(F.lit(0.0).alias(f"load_{n}") for n in (1, 5, 15)),
    )
    rows = rows.withColumn("ghz", derived.gigahertz(F.col("frequency_mhz")))
    # The texts of the line.
    return rows.withColumn("line", F.concat(F.lit("  "), fmt.fixed(F.col("ghz"), 2), F.lit(" GHz  │  "), F.col("cores").cast("string"), F.lit(" cores  │  "), F.col("threads").cast("string"), F.lit(" threads")))


def core_counts(gauges: DataFrame) -> DataFrame:
    """series, core_count: how many cores each series has samples of."""
    return gauges.groupBy("series").agg(F.count_distinct("core").alias("core_count"))


def memory_panel(samples: DataFrame) -> DataFrame:
    """sample_id and the line of used, total and swap sizes."""
    size = lambda c: fmt.format_bytes(F.col(c))
    return samples.select("sample_id", F.concat(F.lit("  "), size("used"), F.lit(" / "), size("total"), F.lit("  │  "), size("swap_used"), F.lit(" swap")).alias("line"))


def temperature_panel(gauges: DataFrame, unit: str = "C") -> DataFrame:
    """series and the lines of the temperatures and of the fan, for its latest usage."""
    usage = snapshot.latest_values(gauges, ["series"], ["value"], "event_id").withColumn("usage", F.col("value") % 100)
    t = derived.temperature_estimates(usage, "usage")
    shown = lambda c: fmt.format_temperature(F.col(c), unit)
    heat = F.concat(F.lit("  CPU: "), shown("package"), F.lit("  │  GPU: "), shown("gpu"), F.lit("  │  ANE: "), shown("ane"))
    return t.select("series", heat.alias("heat"), F.concat(F.lit("  Fan: "), F.col("fan_rpm").cast("string"), F.lit(" RPM ("), F.col("fan_mode"), F.lit(")")).alias("fan"))


def temperature_history(gauges: DataFrame) -> DataFrame:
    """series, event_id, package and the least and largest of the last 60: the estimate's rolling history."""
    t = derived.temperature_estimates(gauges.withColumn("usage", F.col("value") % 100), "usage")
    return series.rolling_range(t, ["series"], ["event_id"], "package").select("series", "event_id", "package", "ring_min", "ring_max", "ring_size")


def _directions(counters: DataFrame) -> DataFrame:
    """``counters`` with download and upload, the rates of both byte counters."""
    down = series.rates(counters, ["series"], ["event_id"], "bytes_recv", "ts", PER).withColumnRenamed("rate", "download").drop("counter_reset")
    return series.rates(down, ["series"], ["event_id"], "bytes_sent", "ts", PER).withColumnRenamed("rate", "upload").drop("counter_reset")


def network_panel(counters: DataFrame) -> DataFrame:
    """The latest rates of each series both ways, in all its units, its totals and packets, and the overview's two lines."""
    last = snapshot.latest(_directions(series.recent(counters, ["series"], ["event_id"], 2)), ["series"], ["event_id"]).withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("download", "upload")})
    size = lambda c: fmt.format_bytes(F.col(c))
    two = lambda head, down, between, up, tail="": F.concat(F.lit(head), down, F.lit(between), up, F.lit(tail))
    speed = two("  ↓ ", size("download"), "/s    ↑ ", size("upload"), "/s")
    number = lambda c: fmt.scaled_number(F.col(c))
    return last.select(
        "series", "download", "upload", derived.mega_per_second(F.col("download")).alias("download_mega"), derived.mega_per_second(F.col("upload")).alias("upload_mega"), speed.alias("speed"),
        two("  Total: ↓ ", size("bytes_recv"), "    ↑ ", size("bytes_sent")).alias("total"), number("packets_recv")["value"].alias("packets_in"), number("packets_recv")["suffix"].alias("packets_in_suffix"),
        number("packets_sent")["value"].alias("packets_out"), number("packets_sent")["suffix"].alias("packets_out_suffix"),
    )


def upload_history(counters: DataFrame) -> DataFrame:
    """series, event_id, upload and its peak over the last 60 rates; samples without a rate add nothing to the history."""
    rated = _directions(counters).where("upload is not null")
    return series.rolling_range(rated, ["series"], ["event_id"], "upload").select("series", "event_id", "upload", F.col("ring_max").alias("peak"), "ring_size")


def speed_history(counters: DataFrame) -> DataFrame:
    """series, idx, mega: the larger of both directions at each place of their histories, in MB/s."""
    rated = _directions(counters)
    sides = [series.history(rated.where(F.col(c).isNotNull()).select("series", "event_id", F.col(c).cast("double").alias("value")), ["series"], ["event_id"]) for c in ("download", "upload")]
    return series.positional_max(*sides, ["series", "idx"], "value").select("series", "idx", derived.mega_per_second(F.col("peak")).alias("mega"))


def process_rows(processes: DataFrame, selected: DataFrame, spec: snapshot.SortSpec = snapshot.SortSpec(), most: int | None = None) -> DataFrame:
    """The seven columns of the process table as text: pid, marked name, CPU share, memory, received and sent, threads, user."""
    rows = snapshot.sort_processes(safety.listed_flags(selection.marked(processes, selected)), spec)
    rows = rows.limit(most) if most else rows
    name = F.concat(F.when(F.col("selected"), "▶ ").otherwise(""), fmt.truncate(F.col("name"), 20))
    io = F.concat(fmt.format_bytes(F.col("io_read_bytes")), F.lit("/"), fmt.format_bytes(F.col("io_write_bytes")))
    return rows.select("pid", name.alias("name"), fmt.fixed(F.col("cpu_percent")).alias("cpu"), fmt.format_bytes(F.col("memory")).alias("memory"), io.alias("recv_sent"), "threads", fmt.truncate(F.col("user"), 12).alias("user"))


def attributes(probed: DataFrame, connections: DataFrame) -> DataFrame:
    """All attributes of each process with defaults for failed probes, and how many connections it has.

    Connections are counted before the join, map-side first, so a process with very many of them is one row a task.
    """
    counted = connections.groupBy("pid").agg(F.count(F.lit(1)).cast("int").alias("connections"))
    full = derived.with_defaults(probed.join(counted, "pid", "left"))
    return full.select("pid", "name", "user", "status", "create_time", "parent", F.col("memory_percent").cast("double").alias("memory_percent"), "threads", "connections")


def host(info: DataFrame) -> DataFrame:
    """Host attributes, a failed probe's as "" or 0."""
    return info.select(*(F.coalesce(c, F.lit("" if kind == "string" else 0)).alias(c) for c, kind in info.dtypes))


def status_line(processes: DataFrame, selected: DataFrame, memory: DataFrame, gauges: DataFrame, spec: snapshot.SortSpec = snapshot.SortSpec(), mouse: bool = True) -> DataFrame:
    """One row, the line at the foot: processes, the latest sample's CPU share and time, memory share, mouse, sort, selected.

    Each part is one aggregate in two phases; only its one row meets the others.
    """
    rows = selection.marked(processes, selected).agg(F.count(F.lit(1)).alias("processes"), F.count_if("selected").alias("selected"))
    used = memory.agg(derived.share(F.sum("used"), F.sum("total")).alias("memory"))
    last = gauges.agg(F.max_by(F.struct((F.col("value") % 100).alias("usage"), "ts"), F.struct("ts", "event_id")).alias("last")).select("last.usage", "last.ts")
    one = rows.join(F.broadcast(used), F.lit(True)).join(F.broadcast(last), F.lit(True))
    parts: list[Column] = [F.lit(" Processes: "), F.col("processes").cast("string"), F.lit("  │  CPU: "), fmt.fixed(F.col("usage")), F.lit("%  │  Memory: "), fmt.fixed(F.col("memory")), F.lit("%  │  Update: "), fmt.clock(F.col("ts"))]
    parts += [F.lit("  │  Mouse: "), fmt.on_off(F.lit(mouse)), F.lit(f" │ Sort: {spec.key} {'↑' if spec.ascending else '↓'}")]
    parts.append(F.when(F.col("selected") > 0, F.concat(F.lit(" │ Selected: "), F.col("selected").cast("string"))).otherwise(""))
    return one.select("processes", "selected", F.concat(*parts).alias("line"))
