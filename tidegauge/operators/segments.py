"""Windows over series of any length: a series is cut into segments that are worked on side by side.

A table is dealt by ranges of (key, order) and written once, so a part holds whole short series and segments of long ones, and of
all its series only the first can go on from an earlier part. What a segment needs from before it comes in one of two ways:

* the last rows before it (a halo), for functions that look back a bounded number of rows;
* a summary of all segments before it (a carry: a sum, a count, a last value), one row for each part at most, which is broadcast.

Then all segments run in parallel. ``order`` must be total within a key: rows that tie in it have no defined order here either.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.operators import series
from tidegauge.shared import materialise

Step = Callable[[DataFrame, list[str]], DataFrame]


@dataclass(frozen=True)
class Segments:
    """``rows`` has the table's columns and __part; a segment is a key's rows of a part, parts ascend with (key, order)."""

    rows: DataFrame
    key: list[str]
    order: list[str]

    @property
    def within(self) -> list[str]:
        return ["__part", *self.key]

    def same_key(self, prefix: str) -> Column:
        return functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in self.key), F.lit(True))


def cut(df: DataFrame, key: list[str], order: list[str], segments: int | None = None) -> Segments:
    """The table in ``segments`` parts of about as many rows each (by default the session's shuffle partitions)."""
    columns = [F.col(c) for c in (*key, *order)]
    ranged = df.repartitionByRange(segments, *columns) if segments else df.repartitionByRange(*columns)
    return Segments(materialise(ranged.withColumn("__part", F.spark_partition_id()), "segments"), key, order)


def carries(cuts: Segments, summary: dict[str, Column], carry: dict[str, Callable[[str], Column]]) -> DataFrame:
    """__part, __k_<key>, <carry>: for each part whose first series goes on from earlier parts, what these hand on.

    ``summary`` aggregates a segment; ``carry`` combines a summary of the segments before one, as an aggregate. No more rows than
    parts.
    """
    each = cuts.rows.groupBy(*cuts.within).agg(*(c.alias(name) for name, c in summary.items()))
    before = Window.partitionBy(*cuts.key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(c).alias(f"__k_{c}") for c in cuts.key]
    found = each.select("__part", *named, F.count(F.lit(1)).over(before).alias("__before"), *(f(name).over(before).alias(f"__c_{name}") for name, f in carry.items()))
    return found.where("__before > 0").drop("__before")


def with_carry(cuts: Segments, rows: DataFrame, carry: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``carry``, null where nothing goes before a row's segment."""
    joined = rows.join(F.broadcast(carry), "__part", "left")
    kept = [F.when(cuts.same_key("__k_"), F.col(c)).alias(c) for c in carry.columns if c.startswith("__c_")]
    return joined.select(*rows.columns, *kept)


def with_halo(cuts: Segments, size: int) -> DataFrame:
    """The rows, and before each segment the last ``size`` rows of its series, marked by __halo.

    Short segments need rows of several earlier ones: of each, as many as those in between leave open.
    """
    counts = cuts.rows.groupBy(*cuts.within).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*cuts.key).orderBy("__part").rowsBetween(-size, -1)
    near = counts.withColumn("__near", F.reverse(F.collect_list(F.struct("__part", "__n")).over(before))).where(F.size("__near") > 0)
    each = near.select(F.col("__part").alias("__to"), *(F.col(c).alias(f"__k_{c}") for c in cuts.key), F.posexplode("__near").alias("__pos", "__from"))
    nearer = F.coalesce(F.sum("__from.__n").over(Window.partitionBy("__to").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = each.withColumn("__open", size - nearer).where("__open > 0").select("__to", *(f"__k_{c}" for c in cuts.key), F.col("__from.__part").alias("__part"), "__open")
    wanted = materialise(wanted, "halos")  # at most ``size`` rows for each part
    most = wanted.groupBy("__part", *(f"__k_{c}" for c in cuts.key)).agg(F.max("__open").alias("__most"))
    last = cuts.rows.join(F.broadcast(most), "__part").where(cuts.same_key("__k_"))
    back = F.row_number().over(Window.partitionBy(*cuts.within).orderBy(*(F.col(c).desc() for c in cuts.order)))
    tails = last.withColumn("__back", back).where(F.col("__back") <= size).where("__back <= __most").select(*cuts.rows.columns, "__back")
    halo = tails.join(F.broadcast(wanted.select("__part", "__to", "__open")), "__part").where("__back <= __open").drop("__part").withColumnRenamed("__to", "__part")
    return cuts.rows.withColumn("__halo", F.lit(False)).unionByName(halo.select(*cuts.rows.columns).withColumn("__halo", F.lit(True)))


def looking_back(df: DataFrame, key: list[str], order: list[str], rows: int, step: Step, segments: int | None = None) -> DataFrame:
    """``step(table, key)`` over the whole table, for a step whose result for a row depends on ``rows`` rows before it at most."""
    cuts = cut(df, key, order, segments)
    return step(with_halo(cuts, rows), cuts.within).where(~F.col("__halo")).drop("__halo", "__part")


def rates(df: DataFrame, key: list[str], order: list[str], counter: str, ts: str, per: float = 1.0, baseline: str = "null", segments: int | None = None) -> DataFrame:
    """``series.rates`` with no more than a segment of a series in a task."""
    return looking_back(df, key, order, 1, lambda t, k: series.rates(t, k, order, counter, ts, per, baseline), segments)


def rolling_range(df: DataFrame, key: list[str], order: list[str], value: str, size: int = series.HISTORY, segments: int | None = None) -> DataFrame:
    """``series.rolling_range`` with no more than a segment of a series, and ``size`` - 1 rows before it, in a task."""
    if size < 2:
        return series.rolling_range(df, [*key, *order], order, value, size)
    return looking_back(df, key, order, size - 1, lambda t, k: series.rolling_range(t, k, order, value, size), segments)


def _carried_forward(cuts: Segments, value: str, name: str) -> DataFrame:
    last_of = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*cuts.order)))
    carry = carries(cuts, {"last": last_of}, {"last": lambda c: F.last(c, ignorenulls=True)})
    local = series.carried_forward(cuts.rows, cuts.within, cuts.order, value, name)
    return with_carry(cuts, local, carry).withColumn(name, F.coalesce(name, "__c_last")).drop("__c_last")


def carried_forward(df: DataFrame, key: list[str], order: list[str], value: str, name: str, segments: int | None = None) -> DataFrame:
    """``series.carried_forward`` with no more than a segment of a series in a task: the last value of earlier segments is carried."""
    return _carried_forward(cut(df, key, order, segments), value, name).drop("__part")


def running_sum(df: DataFrame, key: list[str], order: list[str], value: str, name: str, segments: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of the key's values so far (null until the first that isn't null)."""
    cuts = cut(df, key, order, segments)
    carry = carries(cuts, {"sum": F.sum(value)}, {"sum": F.sum})
    local = cuts.rows.withColumn(name, F.sum(value).over(Window.partitionBy(*cuts.within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    both = F.coalesce(F.col(name) + F.col("__c_sum"), name, "__c_sum")
    return with_carry(cuts, local, carry).withColumn(name, both).drop("__c_sum", "__part")


def numbered(df: DataFrame, key: list[str], order: list[str], name: str, segments: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's place in its series, from 0."""
    cuts = cut(df, key, order, segments)
    carry = carries(cuts, {"n": F.count(F.lit(1))}, {"n": F.sum})
    local = cuts.rows.withColumn(name, F.row_number().over(Window.partitionBy(*cuts.within).orderBy(*order)).cast("long") - 1)
    return with_carry(cuts, local, carry).withColumn(name, F.col(name) + F.coalesce("__c_n", F.lit(0))).drop("__c_n", "__part")


def downsampled(df: DataFrame, key: list[str], order: list[str], value: str, width: int, exact: bool = False, segments: int | None = None) -> DataFrame:
    """key, idx, value: each series as ``width`` maxima of consecutive buckets, or as it is if it isn't longer.

    The long form of ``series.downsampled``, for series of any length and without arrays: rows are numbered over segments, series
    are counted, and a bucket's maximum is an aggregate in two phases. Edges are floor(i * (n / width)) in floating point, by
    which some lengths leave the newest value in no bucket; with ``exact`` they are whole-number quotients.
    """
    placed = numbered(df, key, order, "__at", segments)
    counts = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).select(*(F.col(c).alias(f"__k_{c}") for c in key), "__n")
    same = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in key), F.lit(True))
    n, at, step = F.col("__n"), F.col("__at"), F.col("__n") / F.lit(float(width))
    if exact:
        idx = F.ceil((at + 1) * width / n) - 1
        edge = lambda i: F.floor(i * n / width)
    else:
        idx = F.floor(at / step)
        edge = lambda i: F.floor(i * step)
    # The quotient can be one off by rounding; the edges decide.
    idx = F.when(at < edge(idx), idx - 1).when(at >= edge(idx + 1), idx + 1).otherwise(idx)
    idx = F.when(n <= width, at).otherwise(idx)
    return placed.join(counts, same).withColumn("idx", idx).where((n <= width) | (F.col("idx") < width)).groupBy(*key, "idx").agg(F.max(value).alias(value)).select(*key, F.col("idx").cast("int").alias("idx"), value)


def asof_join(left: DataFrame, right: DataFrame, key: list[str], left_order: list[str], right_order: list[str], values: list[str], within: Column | None = None, strict: bool = False, segments: int | None = None) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` of its key that isn't later; null where there is none.

    The first column of each order is the time (of one type), the second a unique whole number; of right rows of one time the one
    with the largest number is the last. With ``strict`` a right row must be earlier. ``within`` may judge a match by __ts (the
    left time) and __match_ts; a match that it doesn't accept counts as none. Null keys and times match nothing. ``left`` must not
    have columns of the names in ``values``. Both sides are put in one order and the last right row is carried over segments, so a
    key may hold any share of all rows.
    """
    (lt, lid), (rt, rid) = left_order, right_order
    known = functools.reduce(Column.__and__, (F.col(c).isNotNull() for c in (*key, rt)), F.lit(True))
    row = F.struct(F.col(rt).alias("__match_ts"), *values)
    own = left.select(*key, F.col(lt).alias("__ts"), F.lit(0 if strict else 1).alias("__side"), F.col(lid).cast("long").alias("__id"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(row).schema[0].dataType).alias("__right"))
    other = right.where(known).select(*key, F.col(rt).alias("__ts"), F.lit(1 if strict else 0).alias("__side"), F.col(rid).cast("long").alias("__id"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"), row.alias("__right"))
    found = carried_forward(own.unionByName(other), key, ["__ts", "__side", "__id"], "__right", "__last", segments).where("__left is not null")
    if within is not None:
        found = found.withColumn("__match_ts", F.col("__last.__match_ts")).withColumn("__last", F.when(within, F.col("__last")))
    return found.select("__left.*", *(F.col("__last")[v].alias(v) for v in values))
