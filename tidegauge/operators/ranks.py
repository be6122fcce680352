"""Ranks over a whole table with ties, without a window over all of it.

The table is dealt by ranges of the order and a tie-breaker and written once, so equal values may stand on both sides of a border and no
value needs one task. Each range ranks its own rows; a table of one row a range says how many rows and values went before,
where a value that goes on from an earlier range began, and where one that goes on into later ranges ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.shared import materialise


def ranked(df: DataFrame, order: list[str], ties: list[str], tiles: int = 4, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with position, rank, dense_rank, percent_rank, cume_dist and ntile (of ``tiles``) over the whole table.

    Rows are equal if they are in ``order``; ``ties`` makes the order total for position and ntile, ascending, and must not tie.
    Nulls come first, or last with ``descending``, and are equal to each other. An empty table gives no rows.
    """
    columns = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    total = [*columns, *map(F.col, ties)]
    dealt = df.repartitionByRange(ranges, *total) if ranges else df.repartitionByRange(*total)
    rows = materialise(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    part = Window.partitionBy("__part")
    peers = part.orderBy(*columns)
    local = {"__rank": F.rank().over(peers), "__dense": F.dense_rank().over(peers), "__place": F.row_number().over(part.orderBy(*total)), "__upto": F.count(F.lit(1)).over(peers.rangeBetween(Window.unboundedPreceding, Window.currentRow))}
    placed = rows.withColumns(local)
    value = F.struct(*order)
    each = placed.groupBy("__part").agg(
        F.count(F.lit(1)).alias("n"), F.max("__dense").alias("values"), F.max("__rank").alias("last_rank"), F.count_if(F.col("__dense") == 1).alias("first_rows"), F.min_by(value, "__place").alias("first"), F.max_by(value, "__place").alias("last")
    )
    # One row for each range comes together here.
    line = Window.orderBy("__part")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    each = each.withColumn("goes_on", F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(line)) & F.lag("n").over(line).isNotNull(), F.lit(False)))
    each = each.withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), "next_goes_on": F.coalesce(F.lead("goes_on").over(line), F.lit(False)), "seen": F.coalesce(F.sum(F.col("values") - F.col("goes_on").cast("int")).over(before), F.lit(0))})
    begins = F.when(~((F.col("values") == 1) & F.col("goes_on")), F.col("start") + F.col("last_rank"))
    ends = F.when(~((F.col("values") == 1) & F.col("next_goes_on")), F.col("start") + F.col("first_rows"))
    each = each.withColumns({"began": F.last(begins, ignorenulls=True).over(before), "until": F.first(ends, ignorenulls=True).over(after), "total": F.sum("n").over(Window.partitionBy())})
    named = [F.col(c).alias(f"__{c}") for c in ("start", "seen", "goes_on", "next_goes_on", "began", "until", "values", "total")]
    both = placed.join(F.broadcast(each.select("__part", *named)), "__part")
    first, last = (F.col("__dense") == 1) & F.col("__goes_on"), (F.col("__dense") == F.col("__values")) & F.col("__next_goes_on")
    size, extra = F.expr(f"__total div {tiles}"), F.expr(f"__total % {tiles}")
    at = F.col("position") - 1
    whole = extra * (size + 1)
    # Where there are fewer rows than tiles, all are within the first, larger ones.
    tile = F.when(at < whole, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - whole) / F.greatest(size, F.lit(1)))) + 1
    out = both.withColumns({"position": F.col("__start") + F.col("__place"), "rank": F.when(first, F.col("__began")).otherwise(F.col("__start") + F.col("__rank")), "dense_rank": F.col("__seen") + F.col("__dense") - F.col("__goes_on").cast("int"), "__end": F.when(last, F.col("__until")).otherwise(F.col("__start") + F.col("__upto"))})
    out = out.withColumns({"percent_rank": F.when(F.col("__total") > 1, (F.col("rank") - 1) / (F.col("__total") - 1)).otherwise(F.lit(0.0)), "cume_dist": F.col("__end") / F.col("__total"), "ntile": tile.cast("long")})
    return out.select(*df.columns, "position", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
