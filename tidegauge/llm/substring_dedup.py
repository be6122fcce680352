"""Removal of repeated word windows by relative Lempel-Ziv parsing against blocks of phrases with one anchor.

The least hash of the 4-word grams of a window is its anchor: equal windows have equal anchors, whatever stands around
them. A maximal run of windows with one anchor is a phrase. All phrases of an anchor form its reference block, so whatever a
phrase can share with any document stands in its own block. A block is indexed by a suffix array over its phrases' windows;
each phrase is factored greedily into longest runs that stand at another place of the block too. A factor of n windows is
n + 34 words long: the factors of at least a window become duplicate spans, and at a factor's end the windows across the
boundary are looked up next, as the parse goes on with the window that follows and not with the word behind the factor.

Texts without a shared anchor leave after the first grouping. Equal texts are one text from the start, equal phrases one
phrase, both by map-side aggregation, so copies add nothing to a block. Windows are told apart by 64-bit hashes besides the
64 bits of their anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.shared import materialise
from tidegauge.llm.columns import col
from tidegauge.llm.textbytes import chunks, gram_hashes, mix64, span_hashes, window_minima, words

#: Words of a window and of an anchor gram.
WINDOW, GRAM = 35, 4
#: Bytes of window hashes (copies included) of an anchor beyond which its windows are counted by Spark, not parsed in one task.
BLOCK_BYTES = 1 << 25
#: Rows up to which a table of text keys is broadcast (16 MB); a larger one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def _code(row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """One number for a row of the chunk and an anchor."""
    return mix64(anchor ^ mix64(row.astype(np.uint64) + np.uint64(1)))


class Phrases:
    """The phrases of a chunk of texts: row, anchor, first window (number of its first word), length in windows.

    ``hashes`` holds the windows of all phrases one after the other; ``again`` tells whether the row has the anchor's gram
    at more than one place, without which it can't have a window of that anchor twice.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, k: int = GRAM) -> None:
        starts, ends, row = words(data, offsets)
        value = span_hashes(data, starts, ends)
        grams, self.hashes = gram_hashes(value, k), gram_hashes(value, window)
        at = np.flatnonzero(row[: len(self.hashes)] == row[window - 1 :]) if len(self.hashes) else np.zeros(0, np.int64)
        anchor = window_minima(grams, window - k + 1)[at] if len(at) else np.zeros(0, np.uint64)
        owner, self.hashes = row[at], self.hashes[at]
        new = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)
        heads = np.flatnonzero(np.r_[True, new]) if len(at) else at
        self.row, self.anchor, self.length = owner[heads], anchor[heads], np.diff(np.r_[heads, len(at)])
        self.first = at[heads] - np.searchsorted(row, np.arange(len(offsets) - 1))[self.row]
        inside = np.sort(_code(row[: len(grams)], grams)[row[: len(grams)] == row[k - 1 :]]) if len(grams) else np.zeros(0, np.uint64)
        self.again = np.isin(_code(self.row, self.anchor), inside[1:][inside[1:] == inside[:-1]])


def text_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty), key (MD5) and short (64-bit hash) of the text."""
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.select(col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"), F.xxhash64(text).alias("short"))


def _digests(texts: DataFrame, id_type: str) -> DataFrame:
    """doc_id, key, n_words and the hash of all words joined by one space, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for first, last, data, offsets in chunks(batch.column(2)):
                for r in range(last - first):
                    held = data[offsets[r] : offsets[r + 1]].tobytes().split()
                    counts.append(len(held))
                    digests.append(hashlib.sha256(b" ".join(held)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "key", "n_words", "sha"])

    return texts.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {id_type}, key binary, n_words long, sha string")


def shared_anchors(texts: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """short, anchors: of each text with any, the anchors that another text or another place in the text has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short, seen = batch.column(0).to_numpy(), set()
            for first, last, data, offsets in chunks(batch.column(1)):
                own = short[first:last]
                fresh = np.array([s not in seen and not seen.add(s) for s in own.tolist()], bool)
                found = Phrases(data, offsets, window, k)
                _, one = np.unique(_code(found.row, found.anchor), return_index=True)
                one = one[fresh[found.row[one]]]
                yield pa.RecordBatch.from_arrays([pa.array(found.anchor[one].view(np.int64)), pa.array(own[found.row[one]]), pa.array(found.again[one], pa.bool_())], names=["anchor", "short", "again"])

    rows = texts.select("short", "text").mapInArrow(run, "anchor long, short long, again boolean")
    same = Window.partitionBy("anchor")
    met = rows.withColumn("__low", F.min("short").over(same)).withColumn("__high", F.max("short").over(same)).where("again or __low != __high")
    return met.groupBy("short").agg(F.collect_set("anchor").alias("anchors"))


def _phrase_rows(touched: DataFrame, window: int, k: int) -> DataFrame:
    """key, anchor, phrase (a hash), first, windows (hashes as bytes): the phrases of each text's shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(2)
            for first, last, data, offsets in chunks(batch.column(1)):
                found, lists = Phrases(data, offsets, window, k), shared.slice(first, last - first)
                of = np.repeat(np.arange(last - first), np.diff(lists.offsets.to_numpy()))
                wanted = _code(of, lists.flatten().to_numpy().view(np.uint64))
                take = np.flatnonzero(np.isin(_code(found.row, found.anchor), wanted))
                begin = np.cumsum(found.length) - found.length
                raw = [found.hashes[begin[i] : begin[i] + found.length[i]].tobytes() for i in take.tolist()]
                name = [int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True) for b in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(found.row[take])), pa.array(found.anchor[take].view(np.int64)), pa.array(name, pa.int64()), pa.array(found.first[take], pa.int32()), pa.array(raw, pa.binary())], names=["key", "anchor", "phrase", "first", "windows"])

    return touched.select("key", "text", "anchors").mapInArrow(run, "key binary, anchor long, phrase long, first int, windows binary")


class Factors(NamedTuple):
    """Factors in order: phrase, first window, windows; the phrase and the first window of the reference, another place."""

    phrase: np.ndarray
    start: np.ndarray
    length: np.ndarray
    source: np.ndarray
    source_start: np.ndarray


def longest_matches(values: np.ndarray, owner: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how many values from it on also stand at another place, and that place; matches end with a phrase.

    ``room`` counts the values left in the place's phrase. The places are sorted by doubling; of all other places, a
    neighbour in that order shares the longest run.
    """
    n = len(values)
    ranks, width = [np.unique(values, return_inverse=True)[1]], 1
    while width < room.max(initial=0):
        follows = np.zeros(n, np.int64)
        inside = np.flatnonzero(room > width)
        follows[inside] = ranks[-1][inside + width] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + follows, return_inverse=True)[1])
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    one, other, shared = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
    for level in reversed(range(len(ranks))):
        step = 1 << level
        fits = (shared + step <= room[one]) & (shared + step <= room[other])
        same = ranks[level][np.minimum(one + shared, n - 1)] == ranks[level][np.minimum(other + shared, n - 1)]
        shared += step * (fits & same)
    longest, source = np.zeros(n, np.int64), np.arange(n)
    longest[other], source[other] = shared, one
    better = shared > longest[one]
    longest[one[better]], source[one[better]] = shared[better], other[better]
    return longest, source


def factors(values: np.ndarray, sizes: np.ndarray, block: np.ndarray, copies: np.ndarray) -> Factors:
    """Greedy parses of phrases, each against its own block.

    ``values`` holds the windows of all phrases one after the other; ``sizes``, ``block`` (a number) and ``copies`` describe
    each phrase. A phrase with copies is one factor, whose reference is a copy of it.
    """
    end = np.cumsum(sizes)
    begin, owner = end - sizes, np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values))
    room = end[owner] - place
    longest, source = longest_matches(mix64(values ^ mix64(block.astype(np.uint64))[owner]), owner, room)
    whole = copies[owner] > 1
    longest[whole], source[whole] = room[whole], place[whole]
    following = np.minimum.accumulate(np.where(longest > 0, place, len(values))[::-1])[::-1]
    live, at, found = np.flatnonzero(sizes > 0), begin.copy(), []
    while len(live):
        start = following[at[live]]
        live, start = live[start < end[live]], start[start < end[live]]
        found.append((live, start))
        at[live] = start + longest[start]
        live = live[at[live] < end[live]]
    phrase, start = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (place, place)
    order = np.argsort(start, kind="stable")
    phrase, start = phrase[order], start[order]
    return Factors(phrase, start - begin[phrase], longest[start], owner[source[start]], source[start] - begin[owner[source[start]]])


def covered(found: Factors, sizes: np.ndarray) -> np.ndarray:
    """The windows in factors, for the windows of all phrases one after the other."""
    first = (np.cumsum(sizes) - sizes)[found.phrase] + found.start
    edge = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + found.length, -1)
    return np.cumsum(edge[:-1]) > 0


def _parse_blocks(distinct: DataFrame) -> DataFrame:
    """anchor, phrase, marks (a bit for each window): the phrases with any factor in their block.

    ``distinct`` has anchor, phrase, windows, copies, and comes partitioned and sorted by anchor; besides one batch of rows,
    one block is held at a time.
    """
    names = ["anchor", "phrase", "marks"]

    def parsed(rows: pa.Table) -> pa.RecordBatch:
        raw = rows["windows"].combine_chunks().to_pylist()
        sizes = np.array([len(r) // 8 for r in raw], np.int64)
        found = factors(np.frombuffer(b"".join(raw), np.uint64), sizes, rows["anchor"].to_numpy(), rows["copies"].to_numpy())
        marks, end = covered(found, sizes), np.cumsum(sizes)
        hit = np.unique(found.phrase)
        bits = [np.packbits(marks[end[i] - sizes[i] : end[i]]).tobytes() for i in hit.tolist()]
        kept = rows.select(names[:2]).take(pa.array(hit, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([*(pa.array(c.to_numpy(), pa.int64()) for c in kept.columns), pa.array(bits, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            anchor = held["anchor"].to_numpy()
            closed = np.flatnonzero(anchor != anchor[-1]) if len(anchor) else anchor
            if len(closed):
                yield parsed(held.slice(0, closed[-1] + 1))
                held = held.slice(closed[-1] + 1)
        if held is not None and len(held):
            yield parsed(held)

    return distinct.select("anchor", "phrase", "windows", "copies").mapInArrow(run, "anchor long, phrase long, marks binary")


def _parse_hot(distinct: DataFrame) -> DataFrame:
    """What ``_parse_blocks`` gives, for anchors with more phrases than a task should hold: windows counted by Spark.

    A window that occurs twice lies in some factor, and no other does, so the marks are the same. Counts are aggregated before
    the shuffle and no task holds more than one phrase at a time.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, phrase, raw, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = np.frombuffer(raw, np.int64)
                same = lambda v, n=len(held): pa.array(np.full(n, v, np.int64))
                yield pa.RecordBatch.from_arrays([same(anchor), same(phrase), pa.array(held), pa.array(np.arange(len(held), dtype=np.int32)), same(len(held)), same(copies)], names=["anchor", "phrase", "hash", "at", "n", "copies"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for n, places in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                bits = np.zeros(n, np.uint8)
                bits[places.values.to_numpy()] = 1
                marks.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary())], names=["anchor", "phrase", "marks"])

    windows = distinct.select("anchor", "phrase", "windows", "copies").mapInArrow(split, "anchor long, phrase long, hash long, at int, n long, copies long")
    repeated = windows.groupBy("anchor", "hash").agg(F.sum("copies").alias("times")).where("times > 1").select("anchor", "hash")
    places = windows.join(repeated, ["anchor", "hash"]).groupBy("anchor", "phrase").agg(F.first("n").alias("n"), F.collect_list("at").alias("places"))
    return places.select("anchor", "phrase", "n", "places").mapInArrow(packed, "anchor long, phrase long, marks binary")


def _cut_texts(found: DataFrame, window: int) -> DataFrame:
    """key, n_removed, sha: what stays of each text. ``found``: key, text, spans (first, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests = [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                held = text.as_py().encode().split()
                edge = np.zeros(len(held) + window + 8, np.int64)
                for span in spans.as_py():
                    at = span["first"] + np.flatnonzero(np.unpackbits(np.frombuffer(span["marks"], np.uint8)))
                    at = at[at <= len(held) - window]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                stays = np.cumsum(edge)[: len(held)] == 0
                digests.append(hashlib.sha256(b" ".join([held[i] for i in np.flatnonzero(stays)])).hexdigest())
                removed.append(len(held) - int(stays.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["key", "n_removed", "sha"])

    return found.select("key", "text", "spans").mapInArrow(run, "key binary, n_removed long, sha string")


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of ``docs``; copies of a text are repeated windows too.

    Words are runs without white space, unchanged. Null texts and texts of fewer than ``window`` words lose nothing. Null
    and repeated ids are fine: each row counts as a document. Other columns are not read. A text is held whole by one worker
    at a time, some fifty bytes a character.
    """
    spark = docs.sparkSession
    texts = text_table(docs, id_col, text_col)
    all_rows = materialise(_digests(texts, docs.schema[id_col].dataType.simpleString()), "digests")
    copies = all_rows.where(F.col("n_words") >= window).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    shared = materialise(shared_anchors(texts, window, k), "anchors")
    keys = shared.select("short")
    if shared.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    touched = texts.join(keys, "short", "left_semi").groupBy("key", "short").agg(F.first("text").alias("text"))
    touched = materialise(touched.join(shared, "short").select("key", "text", "anchors"), "touched")
    occurrences = materialise(_phrase_rows(touched, window, k), "phrases")
    distinct = occurrences.groupBy("anchor", "phrase").agg(F.first("windows").alias("windows"), F.count(F.lit(1)).alias("copies"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    hot = materialise(occurrences.groupBy("anchor").agg(F.sum(F.length("windows")).alias("bytes")).where(F.col("bytes") > block_bytes).select("anchor"), "hot-anchors")
    if hot.limit(1).count():
        few = F.broadcast(hot) if hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else hot
        cold, rest = distinct.join(few, "anchor", "left_anti"), _parse_hot(distinct.join(few, "anchor", "left_semi"))
        parsed = _parse_blocks(cold.repartition(n, "anchor").sortWithinPartitions("anchor")).unionByName(rest)
    else:
        parsed = _parse_blocks(distinct.repartition(n, "anchor").sortWithinPartitions("anchor"))
    spans = occurrences.select("key", "anchor", "phrase", "first").join(parsed, ["anchor", "phrase"]).groupBy("key").agg(F.collect_list(F.struct("first", "marks")).alias("spans"))
    cut = _cut_texts(touched.select("key", "text").join(spans, "key"), window)
    out = all_rows.join(cut, "key", "left").join(copies.where("rows > 1"), "key", "left")
    gone = F.col("rows").isNotNull()
    removed = F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    digest = F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(cut["sha"], all_rows["sha"]))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), digest.alias("kept_sha256"))


#: What op4 returns, in DuckDB's SQL.
OP4_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
windows AS (SELECT doc_id, p, array_to_string(a[p + 1 : p + 35], ' ') AS k FROM (SELECT doc_id, a, unnest(range(0, len(a) - 34)) AS p FROM texts)),
hits AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
covered AS (SELECT DISTINCT doc_id, p + unnest(range(0, 35)) AS p FROM hits),
each_word AS (SELECT doc_id, unnest(a) AS word, unnest(range(0, len(a))) AS p FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each_word ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(a)::BIGINT AS n_words, (len(a) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
