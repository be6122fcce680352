"""Removal of repeated lines by overlapping three-line windows.

Each run of three consecutive lines is hashed to 128 bits. Of the windows with one hash, the first in (doc_id, position)
order stays; each line that any later window covers goes. Only hashes and positions are grouped, with map-side partial
aggregates, so a window that stands in a third of all documents is a few rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.columns import col, fresh
from tidegauge.shared import materialise

WINDOW = 3
#: Repeated windows up to which their first places are broadcast (some 25 MB); more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def _lines(text_col: str) -> Column:
    return F.split(col(text_col), "\n")


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, short (a hash of the text), position, key: the MD5 of each run of ``window`` lines of each non-null text with an id."""
    lines = docs.where(col(id_col).isNotNull() & col(text_col).isNotNull()).select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("short"), _lines(text_col).alias("lines"))
    key = lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, window), "\n").cast("binary")))
    return lines.where(F.size("lines") >= window).select("doc_id", "short", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - window), key)).alias("position", "key"))


def later_windows(windows: DataFrame) -> DataFrame:
    """doc_id, short, positions (sorted): the windows of each text whose key stands earlier, there or in another document.

    A key's first place is one row, aggregated before the shuffle. Few of them are broadcast, so that windows stay where they
    are; many are joined by a shuffle, in which Spark splits the rows of a very common key over tasks.
    """
    place = F.struct("doc_id", "position", "short")
    first = windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("key", "first")
    first = materialise(first, "first-lines")
    if first.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        first = F.broadcast(first)
    later = windows.join(first, "key").where(place != F.col("first"))
    return later.groupBy("doc_id", "short").agg(F.sort_array(F.collect_set("position")).alias("positions"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` cleaned, then two long columns: its lines before, and how many of them went; one row per row.

    The two are called __n_lines and __n_removed, with more underscores in front where ``docs`` has such columns. A null text stays
    null with 0 lines; an empty text is one empty line. Texts of fewer than ``window`` lines don't change. Rows without an id
    neither remove nor lose anything. Rows that repeat id and text are one document; of rows that repeat an id with other
    texts, which is earlier is decided by a hash. A text that loses every line becomes empty. Columns other than the id and
    the text pass through, whatever they are called. A very long text costs one hash a line.
    """
    n_lines, n_removed, other_id, short, cut, split, stays = fresh(docs, "__n_lines", "__n_removed", "other_id", "short", "cut", "split_lines", "kept_lines")
    later = later_windows(materialise(line_windows(docs, id_col, text_col, window), "line-windows"))
    later = later.select(F.col("doc_id").alias(other_id), F.col("short").alias(short), F.col("positions").alias(cut))
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda p: p + window))
    ends = F.concat(cut, F.array(F.size(split)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(split, a + 1, F.greatest(b - a, F.lit(0)))))
    found = docs.join(later, (col(id_col) == F.col(other_id)) & (F.xxhash64(col(text_col)) == F.col(short)), "left").withColumn(split, _lines(text_col))
    found = found.withColumn(stays, F.when(F.col(cut).isNotNull(), kept))
    columns = [F.when(F.col(stays).isNull(), col(c)).otherwise(F.array_join(stays, "\n")).alias(c) if c == text_col else col(c) for c in docs.columns]
    count = F.when(F.col(split).isNull(), 0).otherwise(F.size(split))
    gone = F.when(F.col(stays).isNull(), 0).otherwise(count - F.size(stays))
    return found.select(*columns, count.cast("long").alias(n_lines), gone.cast("long").alias(n_removed))


#: What op2 returns, in DuckDB's SQL.
OP2_SQL = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, p, a[p + 1] || chr(10) || a[p + 2] || chr(10) || a[p + 3] AS k
  FROM (SELECT doc_id, a, unnest(range(0, len(a) - 2)) AS p FROM lines)),
later AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
covered AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS p FROM later),
each_line AS (SELECT doc_id, unnest(a) AS line, unnest(range(0, len(a))) AS p FROM lines),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n
  FROM each_line ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l.a), 0)::BIGINT AS n_lines, (coalesce(len(l.a), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
