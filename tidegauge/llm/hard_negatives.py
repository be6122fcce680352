"""Hard negatives by a vector-approximation file.

Every vector becomes whole numbers (``cells``) and a code of one byte a dimension: the interval of that dimension that holds the
number. The intervals are cut at quantiles of a bounded sample, the outer ones end at the least and the greatest number of all
rows, so the bounds hold for every row. For a block of anchors, tables list the least and the greatest product of an anchor's number
with those of each interval; summed over the dimensions by look-up they bound a row's score from below and above. Only rows
whose bounds may still enter an anchor's first positives, or one of its windows of negatives, are scored exactly.

Anchors are a stated query set: block by block they meet all rows, and each task hands on the few best rows of each anchor.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.columns import col
from tidegauge.shared import materialise

#: Numbers are floor(SCALE * component), held within +-LIMIT, so that sums over 32,768 dimensions fit 64 bits.
SCALE, LIMIT = 256, 1 << 24
#: First rows of an anchor's label; negatives of each; their window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95
#: Intervals of a dimension; numbers of the sample that their borders are fitted on, over all dimensions.
INTERVALS, SAMPLE_NUMBERS = 64, 1 << 20
#: Anchors that are broadcast at once; anchors and rows whose bounds are in memory at once; pairs scored at once.
ANCHORS_AT_ONCE, TABLE_ANCHORS, TABLE_ROWS, PAIRS_AT_ONCE = 4096, 128, 1024, 1 << 15


@dataclass(frozen=True)
class Anchors:
    """A block of anchors, and the least and greatest number of each interval (dimension x interval)."""

    ids: np.ndarray
    labels: np.ndarray
    numbers: np.ndarray
    low: np.ndarray
    high: np.ndarray


def whole_numbers(vectors: pa.Array, dims: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The rows with whole, finite vectors, and their numbers (rows x dims; missing components count as zero)."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = vectors.value_lengths().fill_null(0).to_numpy()
    flat = vectors.flatten()
    owner = np.repeat(np.arange(len(vectors)), lengths)
    bad = np.zeros(len(vectors), bool)
    x = flat.fill_null(np.nan).to_numpy()
    bad[owner[~np.isfinite(x)]] = True
    usable = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & ~bad)
    out = np.zeros((len(vectors), dims), np.int32)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[owner, place] = np.clip(np.floor(scale * np.where(np.isfinite(x), x, 0)), -LIMIT, LIMIT)
    return usable, out[usable]


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    width = dims * np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dims) if width and len(column) else np.zeros((len(column), dims), kind)


def _packed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def number_table(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, dims: int, scale: int = SCALE) -> DataFrame:
    """vec_id, label, cells of the rows that have an id, a label and a whole finite vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, numbers = whole_numbers(batch.column(2), dims, scale)
            take = pa.array(usable)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), _packed(numbers)], names=["vec_id", "label", "cells"])

    known = vectors.select(col(id_col).cast("long").alias("a"), col(label_col).cast("long").alias("b"), col(vector_col).alias("c")).where("a is not null and b is not null and c is not null")
    return known.mapInArrow(run, "vec_id long, label long, cells binary")


def interval_borders(numbers: DataFrame, dims: int, rows: int, intervals: int = INTERVALS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """borders (dims x intervals - 1, quantiles of a sample), and the least and greatest number of each interval over all rows."""
    wanted = max(intervals, SAMPLE_NUMBERS // max(dims, 1))
    every = max(1, rows // wanted)
    sample = numbers.where(F.pmod(F.xxhash64("vec_id", "cells"), F.lit(every)) == 0).limit(2 * wanted).select("cells").toArrow()
    x = _matrix(sample["cells"], dims, np.int32)
    cuts = np.quantile(x, np.arange(1, intervals) / intervals, axis=0, method="nearest").T if len(x) else np.zeros((dims, intervals - 1))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                m = _matrix(batch.column(0), dims, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(m.min(axis=0).astype(np.int64)), pa.array(m.max(axis=0).astype(np.int64))], names=["dim", "low", "high"])

    found = numbers.select("cells").mapInArrow(ends, "dim long, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").toArrow()
    borders = np.ascontiguousarray(cuts, np.int64)
    low = np.maximum(np.c_[found["low"].to_numpy(), borders], found["low"].to_numpy()[:, None])
    high = np.minimum(np.c_[borders - 1, found["high"].to_numpy()], found["high"].to_numpy()[:, None])
    return borders, low, np.maximum(low, high)


def approximation_file(numbers: DataFrame, borders: np.ndarray) -> DataFrame:
    """``numbers`` with codes: the interval of each dimension, one byte each."""
    dims = len(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dims, np.int32)
            codes = np.empty(x.shape, np.uint8)
            for d in range(dims):
                codes[:, d] = np.searchsorted(borders[d], x[:, d], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, _packed(codes)], names=["vec_id", "label", "cells", "codes"])

    return numbers.mapInArrow(run, "vec_id long, label long, cells binary, codes binary")


def bound_tables(block: Anchors, first: int, last: int) -> np.ndarray:
    """dimension x interval x (least products of the anchors, then greatest ones)."""
    x = block.numbers[first:last].astype(np.int64).T[:, None, :]
    one, other = x * block.low[:, :, None], x * block.high[:, :, None]
    out = np.concatenate([np.minimum(one, other), np.maximum(one, other)], axis=2)
    return out.astype(np.int32) if np.abs(out).max(axis=1, initial=0).sum(axis=0).max(initial=0) < 1 << 31 else out


def score_bounds(tables: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score of each row (codes) with each anchor of the tables."""
    both = np.zeros((len(codes), tables.shape[2]), tables.dtype)
    part = np.empty_like(both)
    for d in range(len(tables)):
        np.take(tables[d], codes[:, d], axis=0, out=part)
        both += part
    half = tables.shape[2] // 2
    return both[:, :half], both[:, half:]


def _nth_largest(values: np.ndarray, n: int) -> np.ndarray:
    return np.partition(values, len(values) - n, axis=0)[len(values) - n] if len(values) >= n else np.full(values.shape[1], np.iinfo(values.dtype).min, values.dtype)


class Best:
    """The first ``size`` (score, id) of each slot so far: higher scores first, then smaller ids."""

    def __init__(self, slots: int, size: int) -> None:
        none = np.zeros(0, np.int64)
        self.slots, self.size, self.slot, self.score, self.id, self.more = slots, size, none, none, none, none
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, more: np.ndarray) -> None:
        slot, score, ids, more = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids), (self.more, more)))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        kept = order[rank < self.size]
        self.slot, self.score, self.id, self.more = slot[rank < self.size], score[kept], ids[kept], more[kept]
        full = slot[rank == self.size - 1]
        self.least[full] = score[order[rank == self.size - 1]]


def _scores(block: Anchors, anchor: np.ndarray, numbers: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), np.int64)
    for k in range(0, len(row), PAIRS_AT_ONCE):
        part = slice(k, k + PAIRS_AT_ONCE)
        out[part] = np.einsum("ij,ij->i", numbers[row[part]].astype(np.int64), block.numbers[anchor[part]].astype(np.int64))
    return out


Search = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _over_chunks(batches: Iterator[pa.RecordBatch], block: Anchors, visit: Callable[..., None]) -> None:
    """Calls ``visit`` for all rows and anchors, some rows and some anchors at a time."""
    dims = block.numbers.shape[1]
    for batch in batches:
        for at in range(0, len(batch), TABLE_ROWS):
            part = batch.slice(at, TABLE_ROWS)
            ids, labels = (part.column(k).to_numpy() for k in (0, 1))
            numbers, codes = _matrix(part.column(2), dims, np.int32), _matrix(part.column(3), dims, np.uint8)
            for first in range(0, len(block.ids), TABLE_ANCHORS):
                last = min(first + TABLE_ANCHORS, len(block.ids))
                low, high = score_bounds(bound_tables(block, first, last), codes)
                visit(first, last, ids, labels, numbers, low, high)


def positive_search(block: Anchors, size: int) -> Search:
    """Rows to (anchor, score, vec_id, itself): the task's first ``size`` rows of each anchor's label, the anchor's own row included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids), size)

        def visit(first: int, last: int, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            same = labels[:, None] == block.labels[None, first:last]
            bar = best.least[first:last]
            if (bar == np.iinfo(np.int64).min).any():
                bar = np.maximum(bar, _nth_largest(np.where(same, low, np.iinfo(low.dtype).min), size))
            row, anchor = np.nonzero(same & (high >= bar))
            anchor += first
            itself = (ids[row] == block.ids[anchor]) & (numbers[row] == block.numbers[anchor]).all(axis=1)
            best.add(anchor, _scores(block, anchor, numbers, row), ids[row], itself.astype(np.int64))

        _over_chunks(batches, block, visit)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.slot, best.score, best.id, best.more)], names=["anchor", "score", "vec_id", "itself"])

    return run


def negative_search(block: Anchors, low_end: np.ndarray, high_end: np.ndarray, size: int) -> Search:
    """Rows to (slot, score, vec_id): the task's first ``size`` rows of other labels in each window.

    Window k of anchor a is slot a * windows + k, with scores from low_end[a, k] to high_end[a, k].
    """
    windows = low_end.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(low_end.size, size)

        def visit(first: int, last: int, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            other = labels[:, None] != block.labels[None, first:last]
            may = np.zeros(other.shape, bool)
            bars = best.least.reshape(low_end.shape)
            for k in range(windows):
                a, b = low_end[first:last, k], high_end[first:last, k]
                bar = np.maximum(a, bars[first:last, k])
                if (bars[first:last, k] == np.iinfo(np.int64).min).any():
                    sure = other & (low >= a) & (high <= b)
                    bar = np.maximum(bar, _nth_largest(np.where(sure, low, np.iinfo(low.dtype).min), size))
                may |= other & (high >= bar) & (low <= b)
            row, anchor = np.nonzero(may)
            anchor += first
            score = _scores(block, anchor, numbers, row)
            hit, window = np.nonzero((score[:, None] >= low_end[anchor]) & (score[:, None] <= high_end[anchor]) & (score[:, None] >= bars[anchor]))
            best.add(anchor[hit] * windows + window, score[hit], ids[row[hit]], np.zeros(len(hit), np.int64))

        _over_chunks(batches, block, visit)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.slot, best.score, best.id)], names=["slot", "score", "vec_id"])

    return run


def _positives(found: pa.Table, anchors: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchors x count: the ids, scores and presence of the first rows without one row that is the anchor's own."""
    anchor, score, ids, itself = (found[c].to_numpy() for c in ("anchor", "score", "vec_id", "itself"))
    order = np.lexsort((-itself, ids, -score, anchor))
    anchor, score, ids, itself = anchor[order], score[order], ids[order], itself[order]
    own = np.flatnonzero(itself)
    keep = np.ones(len(anchor), bool)
    keep[own[np.unique(anchor[own], return_index=True)[1]]] = False
    anchor, score, ids = anchor[keep], score[keep], ids[keep]
    rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
    inside = rank < count
    out = tuple(np.zeros((anchors, count), kind) for kind in (np.int64, np.int64, bool))
    for values, target in zip((ids, score, np.ones(len(ids), bool)), out, strict=True):
        target[anchor[inside], rank[inside]] = values[inside]
    return out


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE, anchors_at_once: int = ANCHORS_AT_ONCE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * component), exact; higher ones come first, then smaller ids. An anchor's
    positives are its first ``positives`` other rows of its label; of each, the first ``negatives`` rows of other labels are
    returned with least * positive_score <= 100 * negative_score <= most * positive_score, ranks from 1.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no part. Shorter vectors count as
    filled up with zeros; numbers beyond +-2^24 count as that. Rows that repeat an id are rows of their own, alike rows give alike
    results. Labels are whole numbers. ``is_anchor`` may use the column vec_id. Other columns are not read. No table and no
    anchor: no rows.
    """
    spark = vectors.sparkSession
    dims = vectors.agg(F.max(F.size(col(vector_col)))).head()[0] or 0
    numbers = materialise(number_table(vectors, id_col, vector_col, label_col, dims, scale), "va-numbers")
    rows = numbers.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not rows or dims <= 0:
        return spark.createDataFrame([], schema)
    borders, low, high = interval_borders(numbers, dims, rows)
    file = materialise(approximation_file(numbers, borders), "va-file")
    chosen = materialise(numbers.where(is_anchor).groupBy("vec_id", "label", "cells").agg(F.count(F.lit(1)).alias("copies")), "va-anchors")
    blocks = -(-chosen.count() // anchors_at_once)
    out = []
    for turn in range(blocks):
        held = chosen.where(F.pmod(F.xxhash64("vec_id", "label", "cells"), F.lit(blocks)) == turn).orderBy("vec_id", "label", "cells").toArrow()
        if not len(held):
            continue
        block = Anchors(held["vec_id"].to_numpy(), held["label"].to_numpy(), _matrix(held["cells"], dims, np.int32), low, high)
        out.append(_block_rows(file, block, held["copies"].to_numpy(), positives, negatives, least, most))
    return functools.reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], schema)


def _block_rows(file: DataFrame, block: Anchors, copies: np.ndarray, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """The rows of a block of anchors, written to the shared folder."""
    spark = file.sparkSession
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    sent = spark.sparkContext.broadcast(block)
    near = file.mapInArrow(lambda batches: positive_search(sent.value, positives + 1)(batches), "anchor long, score long, vec_id long, itself long")
    ids, score, there = _positives(near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives + 1).drop("n").toArrow(), len(block.ids), positives)
    low_end, high_end = np.where(there, -(-least * score // 100), 1), np.where(there, most * score // 100, 0)
    windows = spark.sparkContext.broadcast((low_end, high_end))
    far = file.mapInArrow(lambda batches: negative_search(sent.value, *windows.value, negatives)(batches), "slot long, score long, vec_id long")
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= negatives)
    slots = pa.table({"slot": np.flatnonzero(there), "anchor_id": np.repeat(block.ids, positives)[there.ravel()], "positive_id": ids[there], "positive_score": score[there], "copies": np.repeat(copies, positives)[there.ravel()]})
    named = ranked.join(F.broadcast(spark.createDataFrame(slots)), "slot").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    done = materialise(named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "va-rows")
    sent.unpersist()
    windows.unpersist()
    return done


#: What op12 returns, in DuckDB's SQL: all scores of anchors and rows.
OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.c, r.c)::BIGINT AS score
  FROM usable a JOIN usable r ON a.vec_id % 50 = 0 AND a.vec_id != r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 3
"""
