"""Joins of two tables of intervals that overlap: by bins of several widths, and where they are crowded by blocks of starts.

Bins: an interval has the level of its length: 4 ** level is no less than a quarter of it, so it touches six bins of that width at most,
and a bin holds few rows beyond those that meet: with points, one to two candidates a pair. Two intervals
meet at the larger of their levels, whatever the other's length is: each row is listed in its bins of its own level and of the
higher levels that the other table has, at most some thirty of them. A pair counts in the bin in which the later of both
begins, so none comes twice, and the ends are compared exactly.

Blocks: keys of which both tables have many rows would list each row many times over and fill single bins. Of each pair that
overlaps, one row starts within the other. So the starts of one table are put in order and cut into blocks of as many rows each, and the
other table's rows are listed in the blocks that they reach into: two for each row at most, and one more for as many pairs as a
block has rows. A block in which very many rows are listed is cut by those too. What is written and shuffled thus grows with the
rows, and with two rows at most for as many pairs as a cell has rows. Within a block starts are packed in runs, and only those runs are opened that a row reaches into.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, IntegralType, MapType, TimestampNTZType, TimestampType, VariantType

from tidegauge.shared import materialise

#: Pairs that the rows of a key could make at most, from which on it is joined by blocks; rows of either table in a cell of a block.
CROWDED_PAIRS, CELL_ROWS = 4_000_000, 8_192
#: Starts packed into one row.
RUN_ROWS = 32
#: Candidates of a task, tasks at most, and cells up to which blocks are cut only to be shared out.
TASK_PAIRS, MOST_TASKS, FEW_CELLS = 100_000_000, 4_096, 256
#: Keys or blocks up to which their table is broadcast.
FEW_BLOCKS = 10_000


def _axis(df: DataFrame, name: str) -> Column:
    """A column as whole numbers in its order; exact where ``_is_whole``."""
    kind = df.schema[name].dataType
    if isinstance(kind, TimestampNTZType):  # not by way of a zone, in which an hour may come twice or not at all
        since = F.col(name) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        return sum(((F.extract(F.lit(unit), since).cast("decimal(20,6)") * micros).cast("long") for unit, micros in (("DAY", 86_400_000_000), ("HOUR", 3_600_000_000), ("MINUTE", 60_000_000), ("SECOND", 1_000_000))), F.lit(0))
    if isinstance(kind, DateType | TimestampType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.floor(F.col(name)).cast("long")


def _is_whole(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, IntegralType | DateType | TimestampType | TimestampNTZType)


def _held(df: DataFrame, side: str, name: str) -> str:
    """The name under which a column of a side is carried through the join."""
    return f"__{side}_{df.columns.index(name)}"


def _levelled(df: DataFrame, span: tuple[str, str], keys: list[str], side: str) -> DataFrame:
    """keys, __a_0, ... or __b_0, ... (the columns), __s, __e, __level of the rows that can overlap anything."""
    start, end = span
    rows = df.select(*keys, *(F.col(f"`{c}`").alias(f"__{side}_{i}") for i, c in enumerate(df.columns)), _axis(df, start).alias("__s"), _axis(df, end).alias("__e"))
    return _with_level(rows.where(" and ".join([f"{_held(df, side, start)} <= {_held(df, side, end)}", "__s is not null and __e is not null", *(f"`{k}` is not null" for k in keys)])))


def _with_level(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__level", F.greatest(F.least(F.ceil(F.log(4.0, F.greatest(F.col("__e").cast("double") - F.col("__s").cast("double"), F.lit(0.0)) + 1)), F.lit(31)) - 1, F.lit(0)).cast("int"))


def _binned(rows: DataFrame, others: list[int]) -> DataFrame:
    """A row for each bin of its own level and of the higher ones among ``others``."""
    higher = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("__level"))
    at = rows.withColumn("__at", F.explode(F.concat(F.array("__level"), higher)))
    bins = F.expr("sequence(shiftright(__s, 2 * __at), shiftright(__e, 2 * __at), 1L)")
    return at.withColumn("__bin", F.explode(bins))


def _levels(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select("__level").distinct().collect())  # 32 at most


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: list[str] | None = None, how: str = "inner", closed: bool = True, crowded: int = CROWDED_PAIRS, cell: int = CELL_ROWS) -> DataFrame:
    """The columns of both tables for all pairs with equal ``keys`` whose intervals overlap.

    ``left_span`` and ``right_span`` name start and end: numbers, dates or timestamps of one type. Overlap means that each starts no
    later than the other ends (with ``closed`` = False: earlier than). Rows with a null key, start or end, or an end before their
    start, overlap nothing. ``how`` is 'inner', or 'left' to keep left rows without a partner, with nulls. Besides ``keys`` the
    tables have no column in common; the keys come once. Two points are intervals of length 0, so points in intervals are found
    too.
    """
    keys = keys or []
    if how == "left":
        left = materialise(left.withColumn("__left_id", F.monotonically_increasing_id()), "interval-left")
    a, b = _levelled(left, left_span, keys, "a"), _levelled(right, right_span, keys, "b")
    ends = [(t, side, c) for t, side, span in ((left, "a", left_span), (right, "b", right_span)) for c in span]
    meets = _meets([_held(*end) for end in ends], closed)
    # The rest of the keys, and those with many rows of both.
    calm, many = _parted(a, b, keys, crowded)
    found = []
    if calm:
        of_a, of_b = map(_levels, calm)
        found.append(_overlapping(_binned(calm[0], of_b), _binned(calm[1], of_a), [*keys, "__at", "__bin"], meets))
    if many:
        if closed and all(_is_whole(t, c) for t, _, c in ends):
            meets = F.lit(True)  # a start within the other row is all that is asked for
        found.append(_starting_within(many[0], many[1], keys, "a", "b", meets, cell))
        longer = many[0].where("__s < __e").withColumn("__s", F.col("__s") + 1)  # rows that start together are found above
        if not longer.isEmpty():
            found.append(_starting_within(many[1], longer, keys, "b", "a", meets, cell))
    pairs = functools.reduce(DataFrame.unionByName, found)
    more = [F.col(_held(right, "b", c)).alias(c) for c in right.columns if c not in keys]
    joined = pairs.select(*(F.col(_held(left, "a", c)).alias(c) for c in left.columns), *more)
    if how != "left":
        return joined
    matched = joined.select("__left_id").distinct()
    alone = left.join(matched, "__left_id", "left_anti")
    return joined.unionByName(alone, allowMissingColumns=True).drop("__left_id")


def _parted(a: DataFrame, b: DataFrame, keys: list[str], crowded: int) -> tuple[list[DataFrame] | None, list[DataFrame] | None]:
    """Both tables' rows of keys that could make ``crowded`` pairs at most, and of those that could make more; None for none."""
    if not keys:
        return (None, [a, b]) if a.count() * b.count() > crowded else ([a, b], None)
    sizes = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("__na")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nb")), keys)
    hot, few = _broadcastable(materialise(sizes.where(F.col("__na") * F.col("__nb") > crowded).select(*keys), "crowded-keys"))
    if few == 0:
        return [a, b], None
    return [t.join(hot, keys, "left_anti") for t in (a, b)], [t.join(hot, keys, "left_semi") for t in (a, b)]


def _broadcastable(written: DataFrame) -> tuple[DataFrame, int]:
    """A written table, to be broadcast if it has few rows, and its rows counted up to that."""
    n = written.limit(FEW_BLOCKS + 1).count()
    return (F.broadcast(written) if n <= FEW_BLOCKS else written), n


def _meets(ends: list[str], closed: bool) -> Column:
    """Whether two rows overlap; ``ends``: start and end of left, then of right."""
    a_start, a_end, b_start, b_end = map(F.col, ends)
    return (a_start <= b_end) & (b_start <= a_end) if closed else (a_start < b_end) & (b_start < a_end)


def _carried(t: DataFrame, side: str) -> list[str]:
    return [c for c in t.columns if c.startswith(f"__{side}_")]


def _here() -> Column:
    """Whether this is the one bin in which a row counts with the other's __level_b and __s_b."""
    return (F.greatest("__level", "__level_b") == F.col("__at")) & (F.expr("shiftright(greatest(__s, __s_b), 2 * __at)") == F.col("__bin"))


def _overlapping(one: DataFrame, other: DataFrame, on: list[str], meets: Column) -> DataFrame:
    """The carried columns of both sides for pairs that ``meets`` holds for, each in one bin."""
    theirs = other.select(*on, *_carried(other, "b"), F.col("__level").alias("__level_b"), F.col("__s").alias("__s_b"))
    return one.select(*on, *_carried(one, "a"), "__level", "__s").join(theirs, on).where(_here() & meets).select(*_carried(one, "a"), *_carried(other, "b"))


def _starting_within(starts: DataFrame, spans: DataFrame, keys: list[str], side: str, other: str, meets: Column, cell: int) -> DataFrame:
    """The carried columns of both for pairs of which the first's __s is one of the second's __s to __e, if ``meets`` holds."""
    block = [*keys, "__i"]
    # In order, many rows of one start are dealt by their columns; only whole copies of a row stay together.
    told = [c for c in _carried(starts, side) if not isinstance(starts.schema[c].dataType, MapType | VariantType)]
    order = [*keys, "__s", "__tie"]
    ordered = starts.select(*keys, *_carried(starts, side), "__s", F.xxhash64(*told).alias("__tie")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    packed = ordered.groupBy(*keys, F.expr(f"__place div {cell}").alias("__i"), F.expr(f"__place % {cell} div {RUN_ROWS}").alias("__run")).agg(
        F.min("__s").alias("__low"), F.max("__s").alias("__high"), F.collect_list(F.struct(*_carried(starts, side), F.col("__s").alias("__start"))).alias("__starts")
    )
    runs = materialise(packed.drop("__run"), "interval-runs")
    held = runs.groupBy(*block).agg(F.min("__low").alias("__s"), F.max("__high").alias("__e"), F.sum(F.size("__starts")).alias("__n"))
    blocks, few = _broadcastable(materialise(_with_level(held), "interval-blocks"))

    # Each row of the other table in the blocks that it reaches into.
    reach = _binned(blocks, _levels(spans)).select(*keys, "__at", "__bin", "__i", F.col("__level").alias("__level_b"), F.col("__s").alias("__s_b"), F.col("__e").alias("__e_b"))
    listed = _binned(spans, _levels(blocks)).join(F.broadcast(reach) if few <= FEW_BLOCKS else reach, [*keys, "__at", "__bin"])
    lists = materialise(listed.where(_here() & F.expr("__s <= __e_b and __s_b <= __e")).select(*block, *_carried(spans, other), "__s", "__e"), "interval-lists")

    # Cells of a block: all of its starts, and some of the rows listed in it; more of them where blocks are few.
    rows = lists.groupBy(*block).agg(F.count(F.lit(1)).alias("__m")).join(blocks, block)
    sizes, _ = _broadcastable(materialise(rows.select(*block, "__m", (F.col("__m") * F.col("__n") + 100 * (F.col("__m") + F.col("__n"))).alias("__work")), "interval-cells"))
    work = sizes.agg(F.sum(F.col("__work").cast("double"))).first()[0] or 0
    tasks = int(min(work // TASK_PAIRS + 1, MOST_TASKS))
    share = max(work / FEW_CELLS, TASK_PAIRS)
    on = [*block, "__j"]
    cells = sizes.select(*block, F.greatest(F.ceil(F.col("__m") / cell), F.ceil(F.col("__work") / share)).cast("int").alias("__cells"))
    one = lists.withColumn("__no", F.monotonically_increasing_id()).join(cells, block).withColumn("__j", F.expr("cast(__no % __cells as int)")).drop("__no", "__cells").repartition(tasks, *on)
    two = runs.join(cells, block).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__cells") - 1))).drop("__cells").repartition(tasks, *on)
    # Run by run: the same starts follow each other, which a column store packs well.
    opened = two.join(one, on).where("__low <= __e and __s <= __high").select(*_carried(spans, other), "__s", "__e", F.inline("__starts"))
    return opened.where(F.expr("__s <= __start and __start <= __e") & meets).select(*_carried(starts, side), *_carried(spans, other))
