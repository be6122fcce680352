"""The telemetry tables as views over the test tables: samples, counters, processes and the process classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Process names by class; critical and important names are protected too.
CRITICAL = ("launchd", "kernel_task", "init")
IMPORTANT = ("loginwindow", "WindowServer", "Finder", "Dock", "SystemUIServer", "coreaudiod", "powerd", "thermald")
PROTECTED = (*CRITICAL, "System", *IMPORTANT, "kernelmanagerd", "syspolicyd", "trustd", "securityd")
SYSTEM_USERS = ("root", "_mbsetupuser")

#: Which names and users stand for the codes of the orders table.
NAMES = {"1-URGENT": "launchd", "2-HIGH": "WindowServer", "3-MEDIUM": "editor", "4-NOT SPECIFIED": "日本語テスト", "5-LOW": "helper"}
USERS = {"F": "root", "O": "alice", "P": "_mbsetupuser"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def process_class(spark: SparkSession) -> DataFrame:
    """name, protected, critical, important: one row for each of the 16 protected names."""
    return spark.createDataFrame([(n, True, n in CRITICAL, n in IMPORTANT) for n in PROTECTED], "name string, protected boolean, critical boolean, important boolean")


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, core, event_id, ts, value: one sample a row; the kind of event stands for the core."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("event_type").alias("core"), "event_id", "ts", "value")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, event_id, ts, counter: a cumulative whole-number counter for each series, in hundredths of the gauge."""
    so_far = Window.partitionBy("series").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.round(F.col("value") * 100).cast("bigint")
    return gauges(spark, sf_dir).select("series", "event_id", "ts", F.sum(step).over(so_far).alias("counter"))


def _named(codes: dict[str, str], column: str):
    out = F.lit("unknown")
    for code, name in codes.items():
        out = F.when(F.col(column) == code, F.lit(name)).otherwise(out)
    return out


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A process snapshot: one row for each order, keyed by pid."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pid"), _named(NAMES, "o_orderpriority").alias("name"), _named(USERS, "o_orderstatus").alias("user"), (F.col("o_totalprice") / 5000).alias("cpu_percent"),
        F.floor(F.col("o_totalprice") * 1024).cast("bigint").alias("memory"), (F.col("o_custkey") % 64 + 1).cast("int").alias("threads"), (F.col("o_custkey") * 1000).alias("io_write_bytes"), (F.col("o_orderkey") * 7).alias("io_read_bytes"),
    )


def memory_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, total, used, free, swap_total, swap_used, derived from parts: some totals are 0 and some shares overlap."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return table(spark, sf_dir, "part").select(p.alias("sample_id"), (size * 1000 * (p % 7 != 0).cast("bigint")).alias("total"), (size * 600).alias("used"), (size * (300 + p % 200)).alias("free"), ((p % 5) * 4096).alias("swap_total"), ((p % 5) * 1024).alias("swap_used"))


def network_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, event_id, ts and four cumulative counters, bytes and packets received and sent, derived from the gauge."""
    so_far = Window.partitionBy("series").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e, steps = F.col("event_id"), {"bytes_recv": F.round(F.col("value") * 100).cast("bigint"), "bytes_sent": F.round(F.col("value") * 40).cast("bigint")}
    steps |= {"packets_recv": e % 97 + 1, "packets_sent": e % 53 + 1}
    return gauges(spark, sf_dir).select("series", "event_id", "ts", *(F.sum(x).over(so_far).alias(n) for n, x in steps.items()))


def cpu_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host and packages, an array of struct(mhz, cores) of 0 to 2 packages: one row for each supplier."""
    k = F.col("s_suppkey")
    one = F.struct((F.lit(2000.0) + k % 150 * 10).alias("mhz"), (k % 8 + 1).cast("int").alias("cores"))
    return table(spark, sf_dir, "supplier").select(k.alias("host"), F.array_repeat(one, (k % 3).cast("int")).alias("packages"))


def host_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hostname, os, platform, kernel, uptime and boot_time (seconds): one row for each nation, some attributes missing."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    rows = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"], "left")
    return rows.select(
        F.lower("n_name").alias("hostname"), F.when(k % 6 != 0, F.lower("r_name")).alias("os"), F.when(k % 5 != 0, F.lit("standalone")).alias("platform"),
        F.concat(F.lit("24."), k.cast("string")).alias("kernel"), F.when(k % 7 != 0, k.cast("bigint") * 5000).alias("uptime"), (F.lit(1_700_000_000) - k.cast("bigint") * 5000).alias("boot_time"),
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, port: one row for each open connection; a line of an order stands for one."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_partkey").alias("port"))


def process_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``processes`` with status, create_time (ms), parent and memory_percent (float), as probed: some probes failed (null)."""
    k = F.col("o_orderkey")
    more = table(spark, sf_dir, "orders").select(
        k.alias("pid"), F.when(k % 11 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 13 != 0, F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("create_time"),
        F.when(k % 4 != 0, F.col("o_custkey").cast("int")).alias("parent"), F.when(k % 9 != 0, (F.col("o_totalprice") / 7000).cast("float")).alias("memory_percent"),
    )
    return processes(spark, sf_dir).join(more, "pid")
