"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words give rolling hashes of k consecutive words; of each w consecutive hashes the least is chosen, of equal ones
the rightmost. Two texts that share a run of k + w - 1 words therefore share a chosen hash, and its position tells where.
k-gram hashes and window minima are built by doubling (zip_with over shifted arrays), so a text costs a few linear passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.columns import col
from tidegauge.shared import materialise

#: Words of a gram and grams of a window.
GRAM, WINNOW = 5, 8
#: Low bits of a chosen value that hold the (reversed) position.
POSITION_BITS = 24
#: Cells up to which their table is broadcast (some 60 MB); a larger one is joined by a shuffle.
BROADCAST_RANGES = 500_000
#: Rows that one range of ids holds on average, when documents are put in order.
RANGE_ROWS = 2048


def _shifted(values: Column, by: int, last: Column) -> Column:
    """``values`` from index ``by`` on, ``last`` of them."""
    return F.slice(values, by + 1, last)


def _doubled(df: DataFrame, source: str, out: str, width: int, join) -> DataFrame:
    """Column ``out``: ``join`` over each ``width`` consecutive elements of the array ``source``, by doubling."""
    df, have = df.withColumn(out, F.col(source)), 1
    while have < width:
        step = min(have, width - have)
        n = F.greatest(F.size(out) - step, F.lit(0))
        df = df.withColumn(out, F.zip_with(F.slice(out, 1, n), _shifted(F.col(out), step, n), join(have, step)))
        have += step
    return df


def winnowed(df: DataFrame, text_col: str, out: str, k: int = GRAM, w: int = WINNOW) -> DataFrame:
    """``df`` with ``out``: the text's chosen grams in order of position, each packed into one long (see ``unpacked``).

    Words are runs without white space, all letters lower-cased. A text of fewer than k words is one gram; a null text
    or one without words has no gram. The hash has 64 - POSITION_BITS bits. Words beyond the 2 ** POSITION_BITS-th (a text of
    some 80 MB) have positions modulo this, and a tie across such a border goes to the position that is less far behind it.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn("__hash", F.transform(words, lambda x: F.xxhash64(x)))
    # An ordered combination without overflow errors: xor of a rotated hash, then a scramble.
    turn = lambda x, n: F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))
    df = _doubled(df.withColumn("__n", F.size("__hash")), "__hash", "__gram", k, lambda have, step: lambda a, b: F.xxhash64(a, turn(b, 7 * step)))
    whole = F.when(F.col("__n") > 0, F.array(F.xxhash64(F.col("__hash")))).otherwise(F.col("__gram"))
    df = df.withColumn("__gram", F.when(F.col("__n") < k, whole).otherwise(F.col("__gram")))
    mask = (1 << POSITION_BITS) - 1
    packed = F.transform("__gram", lambda g, i: g.bitwiseAND(F.lit(~mask)).bitwiseOR(F.lit(mask).bitwiseXOR(i.cast("long").bitwiseAND(F.lit(mask)))))
    df = df.withColumn("__packed", packed)
    df = _doubled(df, "__packed", "__least", w, lambda have, step: lambda a, b: F.least(a, b))
    df = df.withColumn("__least", F.when(F.size("__packed").between(1, w - 1), F.array(F.array_min("__packed"))).otherwise(F.col("__least")))
    return df.withColumn(out, F.array_distinct("__least")).drop("__hash", "__n", "__gram", "__packed", "__least")


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def _position(packed: Column) -> Column:
    mask = F.lit((1 << POSITION_BITS) - 1)
    return mask.bitwiseXOR(packed.bitwiseAND(mask)).cast("int")


def unpacked(marks: Column) -> Column:
    """A winnowed column as array<struct<hash long, position int>>."""
    return F.transform(marks, lambda v: F.struct(_hash(v).alias("hash"), _position(v).alias("position")))


def hashes(marks: Column) -> Column:
    """The distinct hashes of a winnowed column, sorted: the set that two texts are compared by."""
    return F.array_sort(F.array_distinct(F.transform(marks, _hash)))


def written(marks: Column) -> Column:
    """A winnowed column as one string, hash:position joined by blanks; empty without grams."""
    return F.array_join(F.transform(marks, lambda m: F.concat_ws(":", F.hex(_hash(m)), _position(m))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets, 0 to 1; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both.cast("double") / either)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINNOW) -> DataFrame:
    """doc_id and ``marks``, array<struct<hash long, position int>>; one row per row."""
    marked = winnowed(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), "text", "marks", k, w)
    return marked.select("doc_id", unpacked(F.col("marks")).alias("marks"))


def _few(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``table`` to be broadcast if it has few rows."""
    rows = table.limit(BROADCAST_RANGES + 1).count() if rows is None else rows
    return F.broadcast(table) if rows <= BROADCAST_RANGES else table


def _crowded(placed: DataFrame, cell: list[str], range_rows: int) -> DataFrame:
    """low, high and parts of each cell that has over four times ``range_rows`` rows: into how many it should be cut."""
    counted = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__low"), F.max("__id").alias("__high"))
    return materialise(counted.where(F.col("__n") > 4 * range_rows).withColumn("__parts", F.ceil(F.col("__n") / range_rows)).drop("__n"), "crowded")


def cells(df: DataFrame, id_col: str, range_rows: int) -> DataFrame:
    """``df`` (with __order) with __range, __sub and __turn, by which it is cut into runs of the order of about ``range_rows`` rows.

    Ids are cut into ranges of equal width, a range into which many ids crowd once more, and an id with very many rows, or the
    null ids, by the hash. Only rows that repeat id and text can't be told apart.
    """
    low, high, n = df.agg(F.min(id_col), F.max(id_col), F.count(F.lit(1))).first()
    low, high = (0, 0) if low is None else (low, high)
    width = max(1, -(-(high - low + 1) * range_rows // max(n, 1)))
    placed = df.withColumn("__id", F.col(id_col).cast("long")).withColumn("__range", F.coalesce(F.expr(f"(__id - {low}L) div {width}L"), F.lit(-1)).cast("long"))
    zero = F.lit(0).cast("long")
    crowded = _crowded(placed, ["__range"], range_rows)
    rows = crowded.limit(BROADCAST_RANGES + 1).count()
    if not rows:
        return placed.withColumns({"__sub": zero, "__turn": zero}).drop("__id")
    placed = placed.join(_few(crowded, rows), "__range", "left")
    step = F.expr("greatest(1L, (__high - __low) div __parts + 1)")
    placed = placed.withColumn("__step", step).withColumn("__sub", F.coalesce(F.expr("(__id - __low) div __step"), zero)).drop("__low", "__high", "__parts", "__step")
    dense = _crowded(placed, ["__range", "__sub"], range_rows).where("__low is null or __low = __high").select("__range", "__sub", "__parts")
    placed = placed.join(_few(dense), ["__range", "__sub"], "left")
    return placed.withColumn("__turn", F.coalesce(F.floor((F.col("__order") / 2.0**64 + 0.5) * F.col("__parts")), zero)).drop("__id", "__parts")


def with_next(df: DataFrame, id_col: str, columns: list[str], range_rows: int = RANGE_ROWS, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``df`` with ``__next``: a struct of ``columns`` of the row that follows in descending id order; the first follows the last.

    Rows are put in order within ``cells``; the first row of each is handed to the one before it too. Rows of one id follow
    each other in the order of a hash of those of ``columns`` that ``df`` has, then of ``columns``; null ids come last. One
    row follows itself. ``prepare`` adds those of ``columns`` that ``df`` hasn't, after the rows to hand on have been picked.
    """
    cell = ["__range", "__sub", "__turn"]
    placed = cells(df.withColumn("__order", F.xxhash64(*(c for c in columns if c in df.columns))), id_col, range_rows)
    known = lambda: F.struct(F.col(id_col).isNotNull(), F.col(id_col), F.bitwise_not("__order"))
    tops = placed.groupBy(*cell).agg(F.max(known()).alias("__top"))
    # Only cells meet in one task here, one row for range_rows documents.
    order = [F.desc("__range"), F.desc("__sub"), F.asc("__turn")]
    where = F.struct(*cell)
    tops = tops.withColumn("__above", F.lag(where).over(Window.orderBy(*order)))
    last = F.last(where).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.withColumn("__above", F.coalesce("__above", last))
    tops = _few(tops.select(*(F.col(c).alias(f"{c}_from") for c in cell), "__top", "__above"))
    same = [placed[c] == tops[f"{c}_from"] for c in cell]
    handed = placed.join(tops, [*same, known().eqNullSafe(F.col("__top"))])
    handed = handed.select(*df.columns, "__order", *(F.col("__above")[c].alias(c) for c in cell), F.lit(True).alias("__lent"))
    lent = prepare(placed.select(*df.columns, "__order", *cell, F.lit(False).alias("__lent"))).unionByName(prepare(handed))
    turn = Window.partitionBy(*cell).orderBy("__lent", F.col(id_col).desc_nulls_last(), "__order", *columns)
    return lent.withColumn("__next", F.lead(F.struct(*columns)).over(turn)).where("not __lent").drop(*cell, "__order", "__lent")


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINNOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of ``docs``.

    The edited text is the text with its last third replaced by as much of the beginning of the next document in descending
    id order (see ``with_next`` for repeated and null ids). A null text counts as empty; an empty text's edit is empty, and
    empty texts are alike. Ids are whole numbers. Other columns are not read. A text is held whole, some thirty bytes a word.
    """
    texts = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    paired = with_next(texts, "doc_id", ["text", "marks"], prepare=lambda df: winnowed(df, "text", "marks", k, w))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - third), F.substring("__next.text", 1, third))
    both = winnowed(paired.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited), "edited", "edited_marks", k, w)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("marks")).alias("fingerprint"), written(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(hashes(F.col("marks")), hashes(F.col("edited_marks"))).alias("near_edited"), likeness(hashes(F.col("marks")), hashes(F.col("__next.marks"))).alias("near_next"),
    )
