"""Language identification by nearest centroid over normalised TF-IDF byte n-grams.

Every text is a vector of hashed 1-, 2- and 3-byte grams of its ASCII-lower-cased UTF-8 (digits and punctuation as one
sign), damped, weighted by inverse document frequency and scaled to length 1. Each language has several centroids, found by
spherical k-means over its training rows. A text gets the language of the closest centroid by cosine; one that is too far
from every centroid is rejected. How far that is depends on the centroid and on how many letters a text has: it is learnt
from the training rows and from pieces cut out of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.columns import col, mapped_in_arrow
from tidegauge.shared import materialise
from tidegauge.llm.textbytes import chunks, fold_ascii

#: Hashed dimensions (a power of two) and centroids a language.
DIMENSIONS, CENTROIDS = 4096, 4
#: Bound of the fit: training rows of each language, and of all together (but one of each language at least).
FIT_ROWS, FIT_TOTAL = 400, 12_800
#: Languages up to which the table of their counts is broadcast.
FEW_LANGUAGES = 100_000
#: Rows and bytes of a chunk: a row takes DIMENSIONS numbers, however short its text is, and a byte some fifty for its grams.
CHUNK_ROWS, CHUNK_BYTES = 64, 1 << 18
#: A text whose cosine to its closest centroid is under this is rejected, however short it is.
REJECT_COSINE = 0.05
#: Learnt bounds: powers of two of letter bytes, pieces of each length cut from a training row, the quantile of their cosines,
#: the part of it that is the bound, and the pieces that a bound needs.
LENGTHS, PIECES, REJECT_SHARE, MARGIN, LEAST_PIECES = 11, 2, 0.005, 0.85, 50

_SIGN = fold_ascii(np.arange(256, dtype=np.uint8)).copy()
for _low, _high in ((0x00, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
    _SIGN[_low:_high] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_ANY_LETTER = re.compile(r"[^\W\d_]")


def gram_counts(data: np.ndarray, offsets: np.ndarray, dims: int = DIMENSIONS) -> np.ndarray:
    """rows x dims: how often each hashed gram occurs in each row; grams of blanks only don't count."""
    rows = len(offsets) - 1
    out = np.zeros(rows * dims, np.float32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    sign = _SIGN[data].astype(np.uint32)
    gram = np.zeros(len(sign), np.uint32)
    for n in (1, 2, 3):
        if len(sign) < n:
            break
        gram = gram[: len(sign) - n + 1] * np.uint32(257) + sign[n - 1 :]
        slot = ((gram + np.uint32(n << 26)) * np.uint32(2654435761)) >> np.uint32(32 - int(dims).bit_length() + 1)
        ok = row[: len(gram)] == row[n - 1 :]
        ok &= (sign[: len(gram)] != 0x20) | (sign[n - 1 :] != 0x20)
        out += np.bincount(row[: len(gram)][ok] * dims + slot[ok], minlength=rows * dims)
    return out.reshape(rows, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped TF x IDF, each row of length 1 (or 0 without grams)."""
    return _unit(np.log1p(counts) * idf).astype(np.float32)


@dataclass(frozen=True)
class CentroidModel:
    """idf: a weight for each dimension; centroids: one unit vector a row; langs: the language of each centroid.

    floors: centroids x LENGTHS, the least cosine of a text by the power of two of its letter bytes.
    """

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floors: np.ndarray | None = None

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the closest centroid and the cosine to it, row by row."""
        cosine = weigh(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)


def length_class(letters: np.ndarray) -> np.ndarray:
    """The power of two of a count of letter bytes, at most LENGTHS - 1."""
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), LENGTHS - 1)


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_SIGN[data] != 0x20)])
    return total[offsets[1:]] - total[offsets[:-1]]


def cut_pieces(text: str, pieces: int = PIECES) -> list[str]:
    """The text and runs of its words of 1, 2, 4, ... bytes, from starts that the text itself decides."""
    words, out = text.split(), [text]
    size, seed = len(text.encode()), zlib.crc32(text.encode())
    for n in (1 << k for k in range(LENGTHS)):
        for turn in range(pieces if n < size else 0):
            start = (seed + 7919 * turn + n) % max(len(words), 1)
            piece = b""
            for word in words[start : start + n]:
                piece += (b" " if piece else b"") + word.encode()
                if len(piece) >= n:
                    out.append(piece[: 2 * n].decode(errors="ignore"))
                    break
    return out


def learnt_floors(own: np.ndarray, length: np.ndarray, score: np.ndarray, centroids: int) -> np.ndarray:
    """centroids x LENGTHS: MARGIN of a low quantile of the scores of each centroid's own pieces of a length.

    It is never above that of all centroids' pieces, as a narrow centroid's pieces say nothing of mixed texts. Without
    enough pieces of a length, it is that of the next shorter length: scores rise with the length.
    """
    out = np.zeros((centroids, LENGTHS))
    for k in range(LENGTHS):
        at = length == k
        if at.sum() < LEAST_PIECES:
            out[:, k] = out[:, k - 1] if k else 0.0
            continue
        out[:, k] = np.quantile(score[at], REJECT_SHARE)
        for c in range(centroids):
            mine = score[at & (own == c)]
            if len(mine) >= LEAST_PIECES:
                out[c, k] = min(out[c, k], np.quantile(mine, REJECT_SHARE))
        out[:, k] *= MARGIN
    return out


def clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds: unit centroids, at most ``k``; the same for the same vectors."""
    seeds = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(vectors)):
        closest = (vectors @ vectors[seeds].T).max(axis=1)
        if closest.min() > 1 - 1e-6:
            break
        seeds.append(int(closest.argmin()))
    centroids = vectors[seeds]
    for _ in range(rounds):
        owner = (vectors @ centroids.T).argmax(axis=1)
        centroids = _unit(np.stack([vectors[owner == j].mean(axis=0) if (owner == j).any() else centroids[j] for j in range(len(centroids))]))
    size = np.bincount((vectors @ centroids.T).argmax(axis=1), minlength=len(centroids))
    return centroids[size >= max(1, 0.02 * len(vectors))].astype(np.float32)


def training_rows(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> DataFrame:
    """lang, text: at most ``rows`` rows of every language, FIT_TOTAL in all or one of each language, chosen by hash.

    Languages are counted first, so that a hash bound leaves little more than that many rows of each before any of them meet,
    and always those of the least hash. Rows with null id, text or language aren't chosen; rows that repeat others count as rows.
    """
    names = [(id_col, "id"), (text_col, "text"), (lang_col, "lang")]
    usable = train.select(*(col(c).alias(n) for c, n in names)).where("id is not null and text is not null and lang is not null")
    usable = usable.withColumn("turn", F.xxhash64("id")).withColumn("share", F.pmod("turn", F.lit(1 << 30)))
    counted = materialise(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("share").alias("least")), "languages")
    languages = counted.count()
    most = max(1, min(rows, FIT_TOTAL // max(languages, 1)))
    few = usable.join(F.broadcast(counted) if languages <= FEW_LANGUAGES else counted, "lang").where((F.col("share") < (most + 6 * most**0.5 + 10) / F.col("n") * (1 << 30)) | (F.col("share") == F.col("least")))
    order = Window.partitionBy("lang").orderBy("turn", "id", "text")
    return few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("lang", "text")


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> CentroidModel:
    """Learns from the rows that ``training_rows`` chooses, the same model for the same table.

    Rows with null text or language teach nothing. No rows at all: a model without centroids, which predicts nothing.
    """
    chosen = materialise(training_rows(train, id_col, text_col, lang_col, rows), "fit-rows")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1), CHUNK_BYTES, CHUNK_ROWS):
                counts = gram_counts(data, offsets).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([c.tobytes() for c in counts], pa.binary())], names=["lang", "counts"])

    got = chosen.mapInArrow(vectors, "lang string, counts binary").toPandas()
    if not len(got):
        return CentroidModel(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [])
    counts = np.stack([np.frombuffer(c, np.float32) for c in got["counts"]])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    weighed, names, parts = weigh(counts, idf), [], []
    for lang in sorted(set(got["lang"])):
        own = weighed[(got["lang"] == lang).to_numpy()]
        own = own[np.lexsort(own.T[:8])]
        parts.append(clustered(own, centroids))
        names += [lang] * len(parts[-1])
    model = CentroidModel(idf, np.concatenate(parts), names)
    shared = train.sparkSession.sparkContext.broadcast(model)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1):
                for _, _, data, offsets in chunks(pa.array([p for p in cut_pieces(text.as_py()) if _ANY_LETTER.search(p)], pa.string()), CHUNK_BYTES, CHUNK_ROWS):
                    own, score = shared.value.nearest(gram_counts(data, offsets))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(length_class(_letters(data, offsets)), pa.int32()), pa.array(score, pa.float32())], names=["own", "length", "score"])

    seen = chosen.mapInArrow(distances, "own int, length int, score float").toPandas()
    return replace(model, floors=learnt_floors(*(seen[c].to_numpy() for c in ("own", "length", "score")), len(names)))


def _judged(texts: pa.Array, model: CentroidModel, reject_cosine: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, language, score, rejected) of runs of rows."""
    names = np.array(model.langs or ["und"], object)
    for first, last, data, offsets in chunks(texts, CHUNK_BYTES, CHUNK_ROWS):
        total = np.concatenate([[0], np.cumsum(_LETTER[_SIGN[data]])])
        has = total[offsets[1:]] > total[offsets[:-1]]
        for k in np.flatnonzero(~has & (np.diff(offsets) > 0)):
            has[k] = bool(_ANY_LETTER.search(texts[first + int(k)].as_py()))
        has &= len(model.langs) > 0
        best, score = model.nearest(gram_counts(data, offsets)) if model.langs else (np.zeros(last - first, int), np.zeros(last - first))
        least = reject_cosine if model.floors is None else np.maximum(model.floors[best, length_class(_letters(data, offsets))], reject_cosine)
        score = np.where(has, score, 0.0)
        yield first, last, np.where(has, names[best], "und"), score, ~has | (score < least)


def predict(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text", reject_cosine: float = REJECT_COSINE) -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per row of ``docs``; other columns are not read.

    ``und`` with score 0 and rejected: null texts, texts without a letter, or a model without centroids. ``score`` is the
    cosine to the closest centroid (0 to 1). A text that is too far away keeps its closest language and is ``rejected``: under
    the model's floor for its centroid and length, or under ``reject_cosine``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, lang, score, rejected in _judged(batch.column(1), shared.value, reject_cosine):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col), col(text_col)).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: CentroidModel, text_col: str = "text", reject_cosine: float = REJECT_COSINE) -> DataFrame:
    """The rows of ``docs`` that ``predict`` wouldn't reject, all columns unchanged; no shuffle.

    Null and empty texts, and texts without a letter, go; so does everything under a model without centroids. Rows are judged
    one by one, so null and repeated ids and any further columns pass through. A text takes time in proportion to its length.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A chunk's rows go out before the next is judged, so that a batch isn't held twice.
            for first, last, *_, rejected in _judged(batch.column(at), shared.value, reject_cosine):
                yield batch.slice(first, last - first).filter(pa.array(~rejected))

    return mapped_in_arrow(docs, run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learnt from the rows that aren't held out, predicted for all."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
