"""Exact removal of byte strings that stand in an earlier document, by suffix arrays of reference blocks.

The least hash of the grams of a window of bytes is its anchor; equal windows have equal anchors, whatever stands around
them. A maximal run of windows with one anchor is a phrase. Anchors are counted over all texts first; the ones that occur
more than once set bits in a bitmap of fixed size, by which a second pass emits phrases only where something can repeat.
An anchor's phrases meet in one block. Where they differ, the parts whose windows may repeat are joined into one text, its
suffix array (grouping construction) brings equal windows together, and each window learns its earliest document. An anchor
that very many texts have is not gathered in one task: Spark finds the earliest document of each of its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.shared import materialise
from tidegauge.llm.columns import col
from tidegauge.llm.suffix_groups import suffix_array
from tidegauge.llm.textbytes import chunks, gram_hashes, mix64, rolling_hashes, span_hashes, window_minima

#: Bytes of a window and of an anchor gram.
WINDOW, GRAM = 50, 16
#: Bits of the anchor bitmap: 16 for each repeated anchor, in these bounds (64 MB at most, whatever the input), and of one row
#: of it on its way to the driver.
BITS_EACH, LEAST_BITS, MOST_BITS, PART_BITS = 16, 1 << 16, 1 << 29, 1 << 16
#: Texts with an anchor from which on its windows are compared by Spark; fewer have some 32 MB of phrases (84 bytes each) at most.
HOT_TEXTS = 400_000
#: Bytes that one suffix array is built over at most, unless one anchor's own parts are longer.
BLOCK_BYTES = 1 << 16
#: Rows up to which a table of ids is broadcast (16 MB); a larger one is joined by a shuffle or not used as a filter.
BROADCAST_IDS = 1_000_000

_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Phrases:
    """The phrases of a chunk: row, anchor, start (byte of the chunk), length in windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, k: int = GRAM) -> None:
        anchor = window_minima(rolling_hashes(_VALUE[data], k), window - k + 1) if len(data) >= window else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = row[: len(anchor)] == row[window - 1 :] if len(anchor) else np.zeros(0, bool)
        edge = np.r_[True, (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (row[1 : len(anchor)] != row[: max(len(anchor) - 1, 0)])] if len(anchor) else inside
        self.start = np.flatnonzero(edge & inside)
        stop = np.flatnonzero(np.r_[edge[1:] | ~inside[1:], True] & inside) + 1 if len(anchor) else self.start
        self.length, self.row, self.anchor = stop - self.start, row[self.start], anchor[self.start]


def repeated_anchors(texts: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """anchor, n: the anchors that more than one text has, and how many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                found = Phrases(data, offsets, window, k)
                one = np.unique(mix64(found.anchor ^ mix64(found.row.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(found.anchor[one].view(np.int64))], names=["anchor"])

    return texts.select("text").mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def anchor_bits(repeated: DataFrame) -> np.ndarray:
    """A bitmap with the bit of each anchor set. Chance bits only add work later. Tasks set the bits, the driver joins parts."""
    bits, wanted = LEAST_BITS, BITS_EACH * repeated.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            number, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in np.unique(number).tolist():
                parts.setdefault(part, np.zeros(PART_BITS, bool))[place[number == part]] = True
        rows = [np.packbits(x, bitorder="little").tobytes() for x in parts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(rows, pa.binary())], names=["part", "bits"])

    place = F.col("anchor").bitwiseAND(F.lit(bits - 1))
    placed = repeated.select(F.expr(f"cast((anchor & {bits - 1}L) div {PART_BITS} as int)").alias("part"), F.pmod(place, F.lit(PART_BITS)).cast("int").alias("place"))
    # A task holds the parts that fall to it, 64 KB each while it sets bits.
    table = placed.repartition(max(1, min(bits // PART_BITS, 256)), "part").mapInArrow(run, "part int, bits binary").toArrow()
    out = np.zeros(bits // 64, np.uint64)
    for part, held in zip(table["part"].to_pylist(), table["bits"].to_pylist(), strict=True):
        out[part * PART_BITS // 64 : (part + 1) * PART_BITS // 64] = np.frombuffer(held, np.uint64)
    return out


def _phrase_rows(texts: DataFrame, bits, window: int, k: int, with_bytes: bool) -> DataFrame:
    """anchor, phrase (a hash of its bytes), doc_id and, with bytes: many, raw, once a chunk with the least id; without: short, first, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        mask = np.uint64(len(held) * 64 - 1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, data, offsets in chunks(batch.column(1)):
                found = Phrases(data, offsets, window, k)
                at = found.anchor & mask
                take = np.flatnonzero((held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                start, length, row, anchor = found.start[take], found.length[take], found.row[take], found.anchor[take]
                name = span_hashes(data, start, start + length + window - 1)
                doc = ids[first + row]
                if with_bytes:
                    order = np.lexsort((doc, name, anchor))
                    keep = order[np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (name[order][1:] != name[order][:-1])]] if len(order) else order
                    flat = data.tobytes()
                    raw = [flat[a : a + n + window - 1] for a, n in zip(start[keep].tolist(), length[keep].tolist(), strict=True)]
                    more = [pa.array(np.bincount(np.cumsum(np.r_[False, (anchor[order][1:] != anchor[order][:-1]) | (name[order][1:] != name[order][:-1])]), minlength=len(keep)) > 1 if len(order) else [], pa.bool_()), pa.array(raw, pa.binary())]
                else:
                    keep = np.arange(len(take))
                    more = [batch.column(2).take(pa.array(first + row)), pa.array(start - offsets[row], pa.int32()), pa.array(length, pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[keep].view(np.int64)), pa.array(name[keep].view(np.int64)), pa.array(doc[keep], pa.int64()), *more], names=names)

    names = ["anchor", "phrase", "doc_id", *(["many", "raw"] if with_bytes else ["short", "first", "length"])]
    return texts.select("doc_id", "text", "short").mapInArrow(run, "anchor long, phrase long, doc_id long, " + ("many boolean, raw binary" if with_bytes else "short long, first int, length int"))


def earlier_windows(parts: list[bytes], docs: list[int], window: int) -> list[np.ndarray]:
    """For each part, the least id of ``docs`` over the parts that hold its window, window by window; parts differ.

    The parts are joined with a separator that no window holds. Suffixes that share a window stand next to each other in the
    suffix array.
    """
    sizes = np.array([len(p) for p in parts])
    text = np.zeros(int(sizes.sum()) + len(parts), np.uint16)
    begin = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    text[np.arange(len(text)) != (begin + sizes)[owner]] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    order = suffix_array(text)
    room = (begin + sizes)[owner[order]] - order
    order = order[room >= window]
    same = np.ones(max(len(order) - 1, 0), bool)
    for t in range(window):
        same &= text[order[1:] + t] == text[order[:-1] + t]
    heads = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(np.array(docs, np.int64)[owner[order]], heads) if len(order) else np.zeros(0, np.int64)
    out = np.zeros(len(text), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[heads, len(order)]))
    return [out[b : b + s - window + 1] for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _mark(rows: list[tuple[int, int, int, bool, bytes]], window: int) -> list[tuple[int, int, int, bytes | None]]:
    """(anchor, phrase, its least id, marks) of whole blocks' rows (anchor, phrase, least id, many, bytes), sorted by anchor.

    ``marks`` has a bit for each window of the phrase that stands in a document before the least id, or is null for none.
    Phrases of one document without a mark are left out.
    """
    count: dict[int, int] = {}
    for r in rows:
        count[r[0]] = count.get(r[0], 0) + 1
    mixed = [r for r in rows if count[r[0]] > 1]
    marks: dict[tuple[int, int], np.ndarray] = {}
    if mixed:
        # Only windows that another phrase of the block may hold go into a suffix array.
        data = np.frombuffer(b"".join(r[4] for r in mixed), np.uint8)
        sizes = np.array([len(r[4]) for r in mixed])
        offsets = np.r_[0, np.cumsum(sizes)]
        owner = np.repeat(np.arange(len(mixed)), sizes)
        whole = rolling_hashes(_VALUE[data], window)
        at = np.flatnonzero(owner[: len(whole)] == owner[window - 1 :])
        code = mix64(whole[at] ^ mix64(np.array([r[0] for r in mixed], np.int64).view(np.uint64)[owner[at]]))
        _, back, times = np.unique(code, return_inverse=True, return_counts=True)
        at = at[times[back] > 1]
        if len(at):
            edges = np.flatnonzero(np.r_[True, owner[at][1:] != owner[at][:-1]])
            lows, highs = at[edges], at[np.r_[edges[1:], len(at)] - 1]
            hulls: dict[bytes, list[tuple[int, int]]] = {}
            raw = data.tobytes()
            for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
                k = int(owner[low])
                hulls.setdefault(raw[low : high + window], []).append((k, low - int(offsets[k])))
            parts, docs, held = [], [], 0
            pending = list(hulls.items())
            for n, (part, places) in enumerate(pending):
                parts.append((part, places))
                docs.append(min(mixed[k][2] for k, _ in places))
                held += len(part)
                # Hulls come in the order of anchors, so a block is closed only between two anchors.
                closed = n + 1 == len(pending) or (held >= BLOCK_BYTES and mixed[pending[n + 1][1][0][0]][0] != mixed[places[0][0]][0])
                if closed:
                    for (_, where), least in zip(parts, earlier_windows([p for p, _ in parts], docs, window), strict=True):
                        for k, shift in where:
                            earlier = least < mixed[k][2]
                            if earlier.any():
                                marks[mixed[k][:2]] = np.r_[np.zeros(shift, bool), earlier]
                    parts, docs, held = [], [], 0
    out = []
    for anchor, phrase, doc, many, _ in rows:
        own = marks.get((anchor, phrase))
        if many or own is not None:
            out.append((anchor, phrase, doc, None if own is None else np.packbits(own).tobytes()))
    return out


def _parse_blocks(rows: DataFrame, window: int) -> DataFrame:
    """anchor, phrase, least, marks, from phrase rows that come partitioned by anchor and sorted by anchor, phrase, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(marked: list) -> pa.RecordBatch:
            a, p, d, m = zip(*marked, strict=True) if marked else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(d, pa.int64()), pa.array(m, pa.binary())], names=["anchor", "phrase", "least", "marks"])

        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:2] == row[:2]:
                    held[-1] = (*held[-1][:3], True, held[-1][4])
                else:
                    held.append(row)
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield out(_mark(held[:cut], window))
                held = held[cut:]
        yield out(_mark(held, window))

    return rows.mapInArrow(run, "anchor long, phrase long, least long, marks binary")


def _parse_hot(rows: DataFrame, window: int) -> DataFrame:
    """What ``_parse_blocks`` gives, for anchors of very many texts: Spark finds the least id of each window.

    Windows are told apart by a 64-bit hash besides their anchor. Least ids are aggregated before the shuffle, and no task
    holds more than one batch of phrases.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            sizes = np.array([len(r) for r in raw], np.int64)
            owner = np.repeat(np.arange(len(raw)), sizes)
            hashes = gram_hashes(_VALUE[np.frombuffer(b"".join(raw), np.uint8)], window)
            at = np.flatnonzero(owner[: len(hashes)] == owner[window - 1 :]) if len(hashes) else np.zeros(0, np.int64)
            own, place = owner[at], at - (np.cumsum(sizes) - sizes)[owner[at]]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns[:3]), pa.array(hashes[at].view(np.int64)), pa.array(place, pa.int32()), pa.array(sizes[own] - window + 1, pa.int32())], names=["anchor", "phrase", "doc_id", "hash", "place", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for n, places in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                bits = np.zeros(n, np.uint8)
                bits[places.values.to_numpy()] = 1
                marks.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(marks, pa.binary())], names=["anchor", "phrase", "marks"])

    merged = materialise(rows.groupBy("anchor", "phrase").agg(F.min("doc_id").alias("doc_id"), ((F.count(F.lit(1)) > 1) | F.bool_or("many")).alias("many"), F.first("raw").alias("raw")), "hot-phrases")
    windows = merged.select("anchor", "phrase", "doc_id", "raw").mapInArrow(split, "anchor long, phrase long, doc_id long, hash long, place int, n int")
    least = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").drop("last")
    later = windows.join(least, ["anchor", "hash"]).where("least < doc_id").groupBy("anchor", "phrase").agg(F.first("n").alias("n"), F.collect_list("place").alias("places"))
    marks = later.select("anchor", "phrase", "n", "places").mapInArrow(packed, "anchor long, phrase long, marks binary")
    return merged.drop("raw").join(marks, ["anchor", "phrase"], "left").where("many or marks is not null").select("anchor", "phrase", F.col("doc_id").alias("least"), "marks")


def _cut_texts(found: DataFrame, window: int) -> DataFrame:
    """doc_id, short, n_removed, n_spans, sha from doc_id, short, text, spans (first, length, marks or null for all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests = [], [], []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                for first, length, marks in [(s["first"], s["length"], s["marks"]) for s in spans.as_py()]:
                    if marks is None:
                        edge[first] += 1
                        edge[first + length + window - 1] -= 1
                    else:
                        at = first + np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8)))
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()))
                digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "short", "n_removed", "n_spans", "sha"])

    return found.select("doc_id", "short", "text", "spans").mapInArrow(run, "doc_id long, short long, n_removed long, n_spans long, sha string")


def _filtered(df: DataFrame, ids: DataFrame, how: str, needed: bool) -> DataFrame:
    """``df`` with (left_semi) or without (left_anti) the ids: by broadcast if they are few; else shuffled, or not at all."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), "doc_id", how)
    return df.join(ids, "doc_id", how) if needed else df


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = GRAM, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``.

    A byte goes if a string of ``window`` bytes over it also starts in a document with a smaller id. Null texts count as
    empty; texts shorter than ``window`` lose nothing. Rows with a null id are neither earlier nor later than others and
    lose nothing. Rows that repeat id and text are one document; of rows that repeat an id with other texts, none is
    earlier. Ids of another type than whole numbers are refused. Other columns are not read. A text is held whole by one
    worker at a time, some forty bytes a byte.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"dedup_bytes needs whole numbers as ids, {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    text = F.coalesce(col(text_col), F.lit(""))
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("short"))
    rows = materialise(texts.select("doc_id", "short", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "rows")
    long_rows = rows.where((F.col("n_bytes") >= window) & F.col("doc_id").isNotNull())
    least = long_rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("key", "least")
    copies = materialise(long_rows.join(least, "key").where("doc_id > least").select("doc_id", "key").distinct(), "copies")
    # Copies of an earlier text go whole; they needn't be parsed where leaving them out is cheap.
    once = copies.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select("doc_id")
    repeated = long_rows.groupBy("doc_id").agg(F.count_distinct("key").alias("__n")).where("__n > 1").select("doc_id")
    sources = _filtered(texts.where(F.col("doc_id").isNotNull()), once.join(repeated, "doc_id", "left_anti"), "left_anti", False)
    repeated_in = materialise(repeated_anchors(sources, window, k), "anchors")
    bits = spark.sparkContext.broadcast(anchor_bits(repeated_in))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    phrases, hot = _phrase_rows(sources, bits, window, k, True), repeated_in.where(F.col("n") > hot_texts).select("anchor")
    n_hot = hot.limit(BROADCAST_IDS + 1).count()
    if n_hot:
        few = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        phrases, hot_phrases = phrases.join(few, "anchor", "left_anti"), phrases.join(few, "anchor", "left_semi")
    blocks = phrases.repartition(n, "anchor").sortWithinPartitions("anchor", "phrase", "doc_id")
    marked = _parse_blocks(blocks, window)
    if n_hot:
        marked = marked.unionByName(_parse_hot(hot_phrases, window))
    occurrences = _phrase_rows(sources, bits, window, k, False)
    hits = occurrences.join(marked, ["anchor", "phrase"]).where("doc_id > least or marks is not null")
    span = F.struct("first", "length", F.when(F.col("doc_id") == F.col("least"), F.col("marks")).alias("marks"))
    spans = materialise(hits.groupBy("doc_id", "short").agg(F.collect_set(span).alias("spans")), "spans")
    touched = _filtered(sources, spans.select("doc_id").distinct(), "left_semi", False)
    cut = _cut_texts(touched.join(spans, ["doc_id", "short"]), window)
    cut = cut.groupBy("doc_id", "short").agg(F.first("n_removed").alias("n_removed"), F.first("n_spans").alias("n_spans"), F.first("sha").alias("cut_sha"))
    gone = copies.withColumn("gone", F.lit(True))
    out = rows.join(cut, ["doc_id", "short"], "left").join(gone, ["doc_id", "key"], "left")
    whole = F.col("gone").isNotNull()
    return out.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
