"""Periodic runs of words, found on harmonic grids.

For each period p the words at jp and (j+1)p are compared, n/p of them, so some n log n for all periods of a text. A run of
four periods holds three grid points in a row that agree, and the whole block of words from the first of them on agrees with the
next block (compared by hash, which only leaves points out that can't be in a run). What survives is extended both ways by
comparing chunks of words, and grid points within what was found, of the same period or of a divisor, are skipped. Periods are
taken in ranges of a power of two, all texts of a chunk at once: no period of a range is a multiple of another one there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.columns import col
from tidegauge.llm.textbytes import Powers, chunks, span_hashes, words

#: Least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that a task works on at once (a longer text is taken alone), and grid points at once.
CHUNK_BYTES, GRID_POINTS = 1 << 19, 1 << 20

_powers = Powers()
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _agreeing(value: np.ndarray, at: np.ndarray, period: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on in the direction of ``step`` equal the word ``period`` later; ``room`` at most."""
    found, live = np.zeros(len(at), np.int64), np.flatnonzero(room > 0)
    while len(live):
        width = max(32, min(1 << 15, GRID_POINTS // len(live)))
        far = found[live, None] + np.arange(width)
        inside = far < room[live, None]
        place = np.where(inside, at[live, None] + step * far, at[live, None])
        same = inside & (value[place] == value[place + period[live, None]])
        whole = same.all(axis=1)
        found[live] += np.where(whole, width, same.argmin(axis=1))
        live = live[whole]
    return found


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each of ``counts`` repeated as often as it says, and the number of each repeat from 0."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def find_runs(value: np.ndarray, offsets: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period; ``value`` stands for words, text r has offsets[r] to offsets[r + 1].

    A run has ``least_periods`` (3 or more) times its smallest period and ``least_words`` words at least, and no word beside it
    keeps the period.
    """
    n = np.diff(offsets)
    up, down = _powers.upto(len(value) + 1)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * up[:-1], out=total[1:])
    cover_end, cover_period = np.zeros(len(value), np.int64), np.ones(len(value), np.int64)
    none = np.zeros(0, np.int64)
    starts, ends, periods, low = none, none, none, 1
    while True:
        texts = np.flatnonzero(n >= max(least_words, least_periods * low))
        if not len(texts):
            break
        high = np.minimum(2 * low - 1, n[texts] // least_periods)
        owner, nth = _counted(high - low + 1)
        text, period = texts[owner], low + nth
        grid = (n[text] - 1) // period
        block = np.cumsum(grid) // GRID_POINTS
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first, last in _stretches(block):
            t, p, g = text[first:last], period[first:last], grid[first:last]
            pair, j = _counted(g)
            at = offsets[t[pair]] + j * p[pair]
            hit = np.r_[value[at] == value[at + p[pair]], False, False]
            room = np.r_[g[pair] - j, 0, 0]
            kept = np.flatnonzero(hit[:-2] & hit[1:-1] & hit[2:] & (room[:-2] >= 3))
            at, pair = at[kept], pair[kept]
            q = p[pair]
            kept = ~((cover_end[at] > at + q) & (q % cover_period[at] == 0))
            at, pair, q = at[kept], pair[kept], q[kept]
            kept = (total[at + q] - total[at]) * down[at] == (total[at + 2 * q] - total[at + q]) * down[at + q]
            at, pair, q = at[kept], pair[kept], q[kept]
            while len(at):
                head = np.r_[True, (pair[1:] != pair[:-1]) | (at[1:] != at[:-1] + q[1:])]
                a, o, p_ = at[head], t[pair[head]], q[head]
                end = a + _agreeing(value, a, p_, offsets[o + 1] - p_ - a, 1)
                begin = a - _agreeing(value, a - 1, p_, a - offsets[o], -1)
                new.append((begin, end + p_, p_))
                # Points of the same grid within what was found are done; a head is done in any case.
                of = np.cumsum(head) - 1
                open_ = ~head & (at >= end[of])
                at, pair, q = at[open_], pair[open_], q[open_]
        if new:
            s, e, p = (np.concatenate(x) for x in zip(*new, strict=True))
            kept = e - s >= np.maximum(least_words, least_periods * p)
            s, e, p = s[kept], e[kept], p[kept]
            width = len(value) + 1
            kept = ~np.isin(s * width + e, starts * width + ends)
            kept[np.flatnonzero(kept)] = np.isin(np.flatnonzero(kept), np.flatnonzero(kept)[np.unique((s * width + e)[kept], return_index=True)[1]])
            s, e, p = s[kept], e[kept], p[kept]
            order = np.argsort(e, kind="stable")
            run, nth = _counted((e - s)[order])
            place = s[order][run] + nth
            further = e[order][run] > cover_end[place]
            cover_end[place[further]], cover_period[place[further]] = e[order][run][further], p[order][run][further]
            starts, ends, periods = np.r_[starts, s], np.r_[ends, e], np.r_[periods, p]
        low *= 2
    order = np.lexsort((periods, starts))
    return starts[order], (ends - starts)[order], periods[order]


def _stretches(block: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last + 1 of each stretch of equal values."""
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def kept_words(count: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Whether each of ``count`` words stays: no run holds it after that run's first period."""
    turn = np.zeros(count + 1, np.int64)
    np.add.at(turn, starts + periods, 1)
    np.add.at(turn, starts + lengths, -1)
    return np.cumsum(turn[:-1]) == 0


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Per row its words joined by one space."""
    size = ends - starts + 1
    word, nth = _counted(size)
    place = starts[word] + nth
    out = np.where(nth == size[word] - 1, np.uint8(0x20), data[np.minimum(place, len(data) - 1)]) if len(data) else data
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    drop = np.cumsum(size)[last] - 1
    held = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
    held -= held > 0
    offsets = np.r_[0, np.cumsum(held)]
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(np.delete(out, drop).tobytes())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed (the kept words joined by one space).

    Words are runs of anything but white space, numbered from 0. One row per row of ``docs``: rows with a null or repeated id too.
    Null, empty and blank texts have no words, no runs and an empty collapsed text. Other columns are not read. A text is held
    whole by one worker, some 100 bytes for each word, and takes some n log n steps for n words, whatever they repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1), CHUNK_BYTES):
                starts, ends, row = words(data, offsets)
                bounds = np.searchsorted(row, np.arange(last - first + 1))
                s, length, period = find_runs(span_hashes(data, starts, ends), bounds)
                keep = kept_words(len(row), s, length, period)
                of = row[s] if len(s) else np.zeros(0, np.int64)
                lists = np.searchsorted(of, np.arange(last - first + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (s - bounds[of], length, period)], fields=list(_RUN))
                columns = [batch.column(0).slice(first, last - first), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(lists), runs)]
                columns.append(_joined(data, starts[keep], ends[keep], row[keep], last - first).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col), col(text_col)).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: every tenth text, by the CRC-32 of its id, repeats some of its words from a word on to its end.

    Of h = crc32(id in decimals), g = h div 10 and the n words: where h % 10 = 0, word i >= a becomes word a + (i - a) % p, with
    a = g % n and p = 1 + (n - a) div (3 + g % 8). Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.encode(col(id_col).cast("string"), "utf-8"))
    held = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), h.alias("h"))
    w, g, n, a, p = map(F.col, ("w", "g", "n", "a", "p"))
    chosen = held.where("h % 10 = 0").withColumns({"w": F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), "g": F.expr("h div 10")})
    chosen = chosen.withColumn("n", F.coalesce(F.size("w"), F.lit(0))).withColumn("a", F.when(n > 0, g % n).otherwise(0)).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    index = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    text = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(w, index(i))), " ")).otherwise(F.col("text"))
    return held.where("h is null or h % 10 != 0").select("doc_id", "text").unionAll(chosen.select("doc_id", text.alias("text")))


def run_digests(found: DataFrame) -> DataFrame:
    """The columns of op13 from ``periodic_runs``: number of runs, the longest (ties: least start, then period), two digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    start, length, period = -best["start"], best["length"], -best["period"]
    marks = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return marks.withColumn("exponent_milli", F.expr("1000 * length div period"))


#: What op13 returns, in DuckDB's SQL: every period whose grid has four equal words in a row is compared word by word.
OP13_SQL = r"""
WITH ids AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM documents),
repeated AS (SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS cut, h // 10 AS g, CASE WHEN len(o) > 0 THEN h // 10 % len(o) ELSE 0 END AS a FROM ids),
texts AS (
  SELECT doc_id, n, CASE WHEN cut THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE o END AS w FROM repeated),
periods AS (SELECT doc_id, n, w, unnest(range(1, n // 4 + 1)) AS p FROM texts WHERE n >= 6),
probed AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, w, p, unnest(range(0, (n - 1) // p - 2)) AS j FROM periods)
  WHERE w[j * p + 1] = w[j * p + p + 1] AND w[j * p + p + 1] = w[j * p + 2 * p + 1] AND w[j * p + 2 * p + 1] = w[j * p + 3 * p + 1]),
same AS (SELECT doc_id, p, i FROM (SELECT doc_id, p, w, unnest(range(0, n - p)) AS i FROM probed JOIN texts USING (doc_id)) WHERE w[i + 1] = w[i + p + 1]),
islands AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same) GROUP BY doc_id, p, island),
runs AS (SELECT doc_id, s, l, min(p) AS p FROM islands WHERE l >= greatest(6, 4 * p) GROUP BY doc_id, s, l),
listed AS (
  SELECT doc_id, count(*) AS n_runs, max({'l': l, 's': -s, 'p': -p}) AS best, string_agg(concat(s, ',', l, ',', p, chr(10)), '' ORDER BY s, p) AS r FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS c
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM texts) t ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best.s)::BIGINT AS start, best.l::BIGINT AS length, (-best.p)::BIGINT AS period,
  (1000 * best.l // -best.p)::BIGINT AS exponent_milli, sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
