"""Time series: counter rates, rolling history, carrying values forward, downsampling, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Samples that a rolling history keeps.
HISTORY = 60


def _ordered(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def rates(df: DataFrame, key: list[str], order: list[str], counter: str, ts: str, per: float = 1.0, baseline: str = "null") -> DataFrame:
    """``df`` with rate (whole units in ``per`` seconds) and counter_reset.

    The first sample has no rate, or with baseline 'zero' counts from 0 at the series' first time less one second. No rate
    where the counter fell (a reset) or no time passed.
    """
    w = _ordered(key, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    zero = baseline == "zero"
    before = F.lag(counter, 1, 0).over(w) if zero else F.lag(counter).over(w)
    then = F.coalesce(F.lag(micros).over(w), micros - 1_000_000) if zero else F.lag(micros).over(w)
    df = df.withColumns({"__dv": F.col(counter) - before, "__dt": micros - then})
    rate = F.floor((F.col("__dv") * F.lit(per)) / (F.col("__dt") / 1e6)).cast("bigint")
    return df.withColumn("rate", F.when((F.col("__dt") > 0) & (F.col("__dv") >= 0), rate)).withColumn("counter_reset", F.coalesce(F.col("__dv") < 0, F.lit(False))).drop("__dv", "__dt")


def rolling_range(df: DataFrame, key: list[str], order: list[str], value: str, size: int = HISTORY) -> DataFrame:
    """``df`` with ring_min, ring_max and ring_size over each row's last ``size`` samples."""
    w = _ordered(key, order).rowsBetween(1 - size, 0)
    return df.withColumns({"ring_min": F.min(value).over(w), "ring_max": F.max(value).over(w), "ring_size": F.count(F.lit(1)).over(w)})


def _from_last(df: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    back = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= size)


def recent(df: DataFrame, key: list[str], order: list[str], size: int = HISTORY) -> DataFrame:
    """The last ``size`` rows of each key; the plan limits each group before the shuffle."""
    return _from_last(df, key, order, size).drop("__back")


def history(df: DataFrame, key: list[str], order: list[str], size: int = HISTORY) -> DataFrame:
    """The last ``size`` rows of each key, with idx from 0 (oldest) on: a rolling history in long form."""
    last = _from_last(df, key, order, size)
    return last.withColumn("idx", (F.max("__back").over(Window.partitionBy(*key)) - F.col("__back")).cast("int")).drop("__back")


def history_arrays(df: DataFrame, key: list[str], order: list[str], value: str, size: int = HISTORY) -> DataFrame:
    """One row a key: its last ``size`` values as an array, oldest first."""
    long = history(df, key, order, size)
    return long.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("idx", value))).alias("__s")).select(*key, F.transform("__s", lambda s: s[value]).alias("values"))


def appended(values: Column, value: Column, size: int = HISTORY) -> Column:
    """A ring held in an array after one more value."""
    grown = F.array_append(values, value)
    return F.slice(grown, F.greatest(F.size(grown) - size, F.lit(0)) + 1, size)


def carried_forward(df: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the last value that isn't null so far."""
    w = _ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def downsampled(values: Column, width: int, exact: bool = False) -> Column:
    """``width`` maxima of consecutive buckets of an array; an array that isn't longer stays as it is.

    Bucket edges are floor(i * (n / width)) in floating point, by which some lengths leave the newest value in no bucket;
    with ``exact`` they are whole-number quotients, and every value counts.
    """
    n = F.size(values)
    edge = (lambda i: F.floor(i * n / width)) if exact else (lambda i: F.floor(i * (n / F.lit(float(width)))))
    bucket = lambda i: F.array_max(F.slice(values, edge(i).cast("int") + 1, F.greatest((F.least(edge(i + 1), n) - edge(i)).cast("int"), F.lit(1))))
    return F.when(n <= width, values).otherwise(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), bucket))


def value_range(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """low and high of each key; a key without values has 0 and 1."""
    return df.groupBy(*key).agg(F.coalesce(F.min(value), F.lit(0.0)).alias("low"), F.coalesce(F.max(value), F.lit(1.0)).alias("high"))


def chart_scale(low: Column, high: Column) -> tuple[Column, Column]:
    """The range of a chart: 5 % beyond the values on both sides, or 0 to 1 for a flat series."""
    width = high - low
    return F.when(width > 0, low - width * 0.05).otherwise(F.lit(0.0)), F.when(width > 0, high + width * 0.05).otherwise(F.lit(1.0))


def chart_level(value: Column, low: Column, high: Column, levels: int = 8) -> Column:
    """A value as one of ``levels`` + 1 heights of a sparkline."""
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.least(F.greatest(((value - low) / span * levels).cast("int"), F.lit(0)), F.lit(levels))


def chart_levels(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """``df`` with level: the height of each value on its key's own scale."""
    w = Window.partitionBy(*key)
    low, high = chart_scale(F.min(value).over(w), F.max(value).over(w))
    return df.withColumns({"__low": low, "__high": high}).withColumn("level", chart_level(F.col(value), F.col("__low"), F.col("__high"))).drop("__low", "__high")


def shared_chart_levels(df: DataFrame, value: str) -> DataFrame:
    """``df`` with level: the height of each value on one scale for all series; only the two ends of the scale are broadcast."""
    low, high = chart_scale(F.col("__min"), F.col("__max"))
    ends = df.agg(F.min(value).alias("__min"), F.max(value).alias("__max")).select(low.alias("__low"), high.alias("__high"))
    placed = df.join(F.broadcast(ends), F.lit(True))
    return placed.withColumn("level", chart_level(F.col(value), F.col("__low"), F.col("__high"))).drop("__low", "__high")


def positional_max(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Two histories joined by key and idx; a missing side is 0; peak is the larger."""
    left, right = a.select(*key, F.col(value).alias("__a")), b.select(*key, F.col(value).alias("__b"))
    x, y = F.coalesce("__a", F.lit(0.0)), F.coalesce("__b", F.lit(0.0))
    return left.join(right, key, "full").select(*key, x.alias("first"), y.alias("second"), F.greatest(x, y).alias("peak"))


def array_max_by_position(a: Column, b: Column) -> Column:
    """Element-wise larger of two arrays, the shorter one filled with 0."""
    return F.zip_with(a, b, lambda x, y: F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
