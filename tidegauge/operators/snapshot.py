"""Latest values, deterministic sorting, top-N, paging and positions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.shared import materialise

#: Sort keys of the process table.
KEYS = {"pid": ["pid"], "name": ["name"], "cpu": ["cpu_percent"], "memory": ["memory"], "threads": ["threads"], "user": ["user"], "network": ["io_write_bytes", "io_read_bytes"]}


@dataclass(frozen=True)
class SortSpec:
    """Sort key and direction; an unknown key sorts by CPU, descending."""

    key: str = "cpu"
    ascending: bool = False

    def columns(self) -> list[Column]:
        """The order, with the pid as tie-breaker."""
        if self.key not in KEYS:
            return SortSpec().columns()
        parts = [F.col(c) for c in KEYS[self.key]]
        value = parts[0] if len(parts) == 1 else parts[0] + parts[1]
        return [value.asc() if self.ascending else value.desc(), F.col("pid").asc()]

    def toggled(self, key: str, from_keyboard: bool = False) -> SortSpec:
        """The same key turns its direction; a new one takes its own: name and user ascending, all others descending."""
        if key == self.key:
            return replace(self, ascending=not self.ascending)
        return SortSpec(key, key in ("name", "user") and not from_keyboard)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; the plan limits each group before the shuffle."""
    turn = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn")


def latest_values(df: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    """The values of each key's last row, by a two-phase aggregate without a sort."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("__last")).select(*key, "__last.*")


def sort_processes(df: DataFrame, spec: SortSpec = SortSpec()) -> DataFrame:
    return df.orderBy(*spec.columns())


def top_processes(df: DataFrame, n: int = 8) -> DataFrame:
    """The busiest processes, whatever the table is sorted by."""
    return df.orderBy(*SortSpec().columns()).limit(n)


def page(df: DataFrame, spec: SortSpec, offset: int, rows: int) -> DataFrame:
    return df.orderBy(*spec.columns()).offset(offset).limit(rows)


def with_position(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Each row's position (from 1) in a total order, without bringing the table into one task.

    The table is dealt by ranges of the order and written once; each range numbers its own rows and adds the sizes of the
    ranges before it. ``order`` must not tie.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "positions")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range comes together here.
    starts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__row", within).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")
