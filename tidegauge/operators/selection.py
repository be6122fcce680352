"""Sets of selected pids as one-column DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def select_all(df: DataFrame) -> DataFrame:
    return df.select("pid").distinct()


def select_range(df: DataFrame, one: int, other: int) -> DataFrame:
    """The pids between two rows, both included, in order of CPU descending, then pid; none if an end is missing.

    The ends are compared as (order, pid) pairs, so nothing is numbered or sorted.
    """
    place = F.struct((-F.col("cpu_percent")).alias("order"), F.col("pid").alias("id"))
    ends = df.where(F.col("pid").isin(one, other)).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count_distinct("pid").alias("n")).where(F.col("n") == len({one, other}))
    placed = df.select("pid", place.alias("place"))
    return placed.join(F.broadcast(ends), (F.col("place") >= F.col("low")) & (F.col("place") <= F.col("high"))).select("pid").distinct()


def toggled(selected: DataFrame, pids: DataFrame) -> DataFrame:
    """Symmetric difference: what is in exactly one of two sets."""
    return selected.select("pid", F.lit(1).alias("__n")).union(pids.select("pid", F.lit(2).alias("__n"))).distinct().groupBy("pid").agg(F.sum("__n").alias("__n")).where("__n < 3").select("pid")


def added(selected: DataFrame, pids: DataFrame) -> DataFrame:
    return selected.select("pid").union(pids.select("pid")).distinct()


def marked(df: DataFrame, selected: DataFrame) -> DataFrame:
    """``df`` with selected: whether the pid is in the set."""
    return df.join(selected.select("pid").distinct().withColumn("__on", F.lit(True)), "pid", "left").withColumn("selected", F.coalesce("__on", F.lit(False))).drop("__on")
