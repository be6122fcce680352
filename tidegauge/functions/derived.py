"""Derived columns of samples: estimates, shares, unit conversions, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def share(part: Column, total: Column, otherwise: Column | None = None) -> Column:
    """part / total in percent; where the total isn't positive, ``otherwise`` (0)."""
    return F.when(total > 0, part.cast("double") / total * 100).otherwise(F.lit(0.0) if otherwise is None else otherwise)


def cache_bytes(total: Column, used: Column, free: Column) -> Column:
    """What is neither used nor free, never below 0."""
    return F.greatest(total - used - free, F.lit(0))


def temperature_estimates(df: DataFrame, usage: str) -> DataFrame:
    """Temperatures, fan speed and fan mode estimated from CPU usage, for hosts without sensors."""
    u = F.col(usage)
    package = 35 + u * 0.5
    return df.withColumns({
        "package": package, "cores": package + 2, "gpu": 35 + u * 0.3, "ane": 35 + u * 0.2, "battery": F.lit(38.0), "ambient": F.lit(22.0),
        "fan_rpm": (2000 + (u * 40).cast("int")).cast("int"), "fan_mode": F.lit("Auto"), "available": F.lit(True),
    })


def memory_derived(df: DataFrame) -> DataFrame:
    """pressure, cache, app, wired, compressed, purgeable and swap_percent of total, used, free, swap_total, swap_used."""
    zero = F.lit(0).cast("bigint")
    return df.withColumns({
        "pressure": share(F.col("used"), F.col("total"), F.lit(None).cast("double")), "cache": cache_bytes(F.col("total"), F.col("used"), F.col("free")), "app": F.col("used"),
        "wired": zero, "compressed": zero, "purgeable": zero, "swap_percent": share(F.col("swap_used"), F.col("swap_total")),
    })


def gigahertz(megahertz: Column) -> Column:
    return megahertz / 1000


def mega_per_second(per_second: Column) -> Column:
    return per_second / (1024 * 1024)


def first_of(values: Column) -> Column:
    """The first element of an array, null if there is none."""
    return F.try_element_at(values, F.lit(1))


def thread_count(cores: Column, packages: Column) -> Column:
    return cores * packages


#: What a failed probe of a process attribute leaves.
DEFAULTS = {"name": "unknown", "user": "unknown", "status": "unknown", "cpu_percent": 0.0, "memory": 0, "memory_percent": 0.0, "threads": 0, "create_time": 0, "parent": 0, "io_write_bytes": 0, "io_read_bytes": 0, "connections": 0}


def with_defaults(df: DataFrame) -> DataFrame:
    """Nulls of process attributes as their defaults; other columns stay."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in DEFAULTS.items() if c in df.columns})
