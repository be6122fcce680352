"""Exact percentiles by group: histograms that are narrowed until few values are left.

A target is a rank of a group. All targets of a group begin with its whole range of values; a round cuts each range that still holds many
rows at approximate quantiles, counts the rows between and at the cuts exactly, and keeps the one cell that holds the target.
A cut is a cell of its own, so a value that very many rows share ends the search. No round sorts a group or brings one
together: sketches and counts are merged in two phases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.shared import materialise

#: Rows of a range that are listed by value in the end; cuts of a round; the sketch's accuracy.
FEW_ROWS, CUTS, ACCURACY = 10_000, 16, 1_000
#: Ranges up to which their table is broadcast.
FEW_RANGES = 100_000


def _matched(left: DataFrame, right: DataFrame, on: list[str], *more: Column, few: bool = False) -> DataFrame:
    """Both tables' columns where those of ``on`` (null equals null) and ``more`` hold; ``few``: the right one is broadcast."""
    right = right.select(*(F.col(c).alias(f"__r{c}" if c in on else c) for c in right.columns))
    equal = [F.col(c).eqNullSafe(F.col(f"__r{c}")) for c in on]
    return left.join(F.broadcast(right) if few else right, [*equal, *more] or F.lit(True)).drop(*(f"__r{c}" for c in on))


def exact_percentiles(df: DataFrame, key: list[str], value: str, shares: list[float], few: int = FEW_ROWS, cuts: int = CUTS) -> DataFrame:
    """key, share, value: the least value of a group that at least ``share`` of its values don't exceed, for each of ``shares``.

    Shares count to six decimals. Null values don't count; a group without others has no row. NaN is above all numbers.
    """
    keys = [f"__k{i}" for i in range(len(key))]
    held = df.select(*(F.col(c).alias(k) for c, k in zip(key, keys, strict=True)), F.col(value).alias("v")).where("v is not null")
    groups = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("inside"), F.min("v").alias("low"), F.max("v").alias("high")).where("inside > 0")
    wanted = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.lit(1_000_000 - round(s * 1_000_000)).alias("rest")) for s in shares)))
    rank = F.greatest(F.expr("inside - (inside * t.rest) div 1000000"), F.lit(1))
    targets = groups.withColumn("t", wanted).select(*keys, "inside", "low", "high", "t.share", rank.alias("rank"), F.lit(0).cast("long").alias("under"))
    targets, of = materialise(targets, "percentile-targets"), [*keys, "under"]
    wide, within = (F.col("inside") > few) & (F.col("low") < F.col("high")), F.col("v").between(F.col("low"), F.col("high"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    while True:
        ranges = materialise(targets.where(wide).select(*of, "low", "high").distinct(), "percentile-ranges")
        n = ranges.limit(FEW_RANGES + 1).count()
        if not n:
            break
        inside = _matched(held, ranges, keys, within, few=n <= FEW_RANGES).select(*of, "v")
        probs = [i / (cuts + 1) for i in range(1, cuts + 1)]
        borders = materialise(inside.groupBy(*of).agg(F.array_sort(F.array_distinct(F.percentile_approx("v", probs, ACCURACY))).alias("cuts")), "percentile-cuts")
        cell = F.size(F.filter("cuts", lambda c: c < F.col("v"))) * 2 + F.array_contains("cuts", F.col("v")).cast("int")
        placed = _matched(inside, borders, of, few=n <= FEW_RANGES).select(*of, "v", cell.alias("cell"))
        cells = placed.groupBy(*of, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        cells = materialise(cells.withColumn("before", before), "percentile-cells")
        place = F.col("rank") - F.col("under") - F.col("before")
        narrowed = _matched(targets.where(wide).drop("inside", "low", "high"), cells, of, place > 0, place <= F.col("n"))
        narrowed = narrowed.select(*keys, F.col("n").alias("inside"), F.col("least").alias("low"), F.col("most").alias("high"), "share", "rank", (F.col("under") + F.col("before")).alias("under"))
        targets = materialise(narrowed.unionByName(targets.where(~wide)), "percentile-targets")
    done = targets.where("low = high").select(*keys, "share", F.col("low").alias("v"))
    left = targets.where("low < high")
    values = _matched(held, left.select(*of, "low", "high").distinct(), keys, within).groupBy(*of, "v").agg(F.count(F.lit(1)).alias("n"))
    # The values of a range are few here.
    listed = values.withColumn("upto", F.sum("n").over(Window.partitionBy(*of).orderBy("v")) + F.col("under")).drop("n")
    found = _matched(left.select(*of, "share", "rank"), listed, of, F.col("upto") >= F.col("rank")).groupBy(*keys, "share").agg(F.min("v").alias("v"))
    return done.unionByName(found).select(*(F.col(k).alias(c) for c, k in zip(key, keys, strict=True)), "share", F.col("v").alias(value))
