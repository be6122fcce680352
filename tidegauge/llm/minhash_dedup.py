"""Near-duplicates by MinHash bands and sequential Bayesian verification.

Each set of shingles has a signature of MinHash values. Sets that agree on a band of it are candidates. A candidate pair's
values are compared batch by batch: with m of n values equal and an even prior on the similarity s, the posterior chance of
s >= t is that of at most m successes in n + 1 trials of chance t. A pair is given up as soon as that falls below the chosen miss
probability; what survives every batch is verified on the full sets. The values that made no band are compared first, as these
have no bias.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.columns import col
from tidegauge.llm.jaccard_join import Screen, chunks, grouped, named_sets, one_per_node, set_keys, shared_only, shingle_sets
from tidegauge.llm.textbytes import mix64
from tidegauge.shared import materialise

#: Words of a shingle; least similarity in hundredths.
SHINGLE, PERCENT = 5, 85
#: Values that bands are made of, further values, and most values of a band.
BANDED, FURTHER, MOST_VALUES = 200, 56, 8
#: Values compared at once; posterior chance of a link below which a pair is given up.
BATCH, MISS = 32, 1e-9
VALUES = BANDED + FURTHER
_FACTORS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def minhash(row: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
    """rows x VALUES: 16 bits of the least product of each row's tokens with each factor; rows without tokens have zeros.

    ``row`` ascends; tokens are hashes already. Equal bits of different values only keep pairs that could go.
    """
    out = np.zeros((rows, VALUES), np.uint16)
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.empty((VALUES, len(starts)), np.uint16)
        product = np.empty_like(token)
        for i, factor in enumerate(_FACTORS):
            np.multiply(token, factor, out=product)
            least[i] = np.minimum.reduceat(product, starts) >> np.uint64(48)
        out[row[starts]] = least.T
    return out


def signed_sets(docs: DataFrame, k: int = SHINGLE, clashes: tuple[np.ndarray, ...] = (), bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, node, half, signature: each document's set size, the two halves of its set's hash, its MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                row, token = shingle_sets(data, offsets, k)
                size, node, half = set_keys(row, token, last - first, clashes, bits)
                values = minhash(row, token, last - first).astype("<u2")
                at = (np.arange(last - first + 1) * 2 * VALUES).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(size, pa.int64()), pa.array(node), pa.array(half), packed], names=["doc_id", "n_shingles", "node", "half", "values"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, node long, half long, values binary")


def banding(percent: int = PERCENT, miss: float = MISS) -> tuple[int, int]:
    """Bands, and the most values of each with which a pair at the threshold meets in none with a chance of ``miss`` at most.

    For 85 %: 40 bands of five, 6.4e-11.
    """
    t = percent / 100
    width = next((r for r in range(MOST_VALUES, 1, -1) if (1 - t**r) ** (BANDED // r) <= miss), 1)
    return BANDED // width, width


def band_rows(nodes: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """signature, node: a hash of each band of each row of ``nodes`` (node, values)."""
    bands, width = banding(percent, miss)
    return nodes.select(F.explode(F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, substring(values, b * {2 * width} + 1, {2 * width})))")).alias("signature"), "node")


def least_matches(percent: int = PERCENT, miss: float = MISS, batch: int = BATCH) -> np.ndarray:
    """For each batch, the fewest equal values so far with which a pair stays."""
    t, out = percent / 100, []
    for n in range(batch, VALUES + 1, batch):
        chance, m = (1 - t) ** (n + 1), 0
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def _posterior_test(one: np.ndarray, other: np.ndarray, least: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """The rows whose values (rows x VALUES) survive every batch."""
    live, equal = np.arange(len(one)), np.zeros(len(one), np.int64)
    order = np.roll(np.arange(VALUES), FURTHER)
    for turn, fewest in enumerate(least):
        at = order[turn * batch : (turn + 1) * batch]
        equal = equal + (one[np.ix_(live, at)] == other[np.ix_(live, at)]).sum(axis=1)
        stay = equal >= fewest
        live, equal = live[stay], equal[stay]
    return live


def by_posterior(nodes: DataFrame, percent: int = PERCENT, miss: float = MISS) -> Screen:
    """Leaves out pairs whose sizes forbid a link or whose posterior chance of one is below ``miss`` (``nodes``: node, n, values)."""
    least = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(len(batch), VALUES) for k in (2, 3))
            kept = pa.array(_posterior_test(one, other, least))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(kept) for k in (0, 1)], names=["a", "b"])

    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("__n"), F.col("values").alias("__u"))
    other = nodes.select(F.col("node").alias("b"), F.col("n").alias("__m"), F.col("values").alias("__v"))
    near = F.expr(f"100 * least(__n, __m) >= {percent} * greatest(__n, __m)")
    return lambda pairs: pairs.join(other, "b").join(one, "a").where(near).select("a", "b", "__u", "__v").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, miss: float = MISS, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links), kept (it is its own), one row per row of ``docs``.

    Links are confirmed on full sets of ``k``-word shingles: 100 * intersection >= percent * union. One is lost with a chance of
    about ``miss`` a batch, and ``miss`` by the bands, at the threshold, and less above it. Words are runs without white space, A-Z
    lower-cased; a text of fewer words is one shingle. Texts without words, empty and null texts have an empty set, link with
    nothing and are kept. Rows with a null id keep their set size, have no component, link with nothing and are kept. Rows
    that repeat an id keep one row each, and the id's sets are linked through it only if they are similar. Other columns are
    not read. A text is held whole by one worker at a time, some fifty bytes a character.
    """
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    keys, clashes = named_sets(texts, k, bits, signed_sets)
    nodes = materialise(one_per_node(keys, ["values"]), "minhash-nodes")
    shared = materialise(shared_only(band_rows(nodes, percent, miss)), "minhash-bands")
    marks = materialise(nodes.join(shared.select("node").distinct(), "node", "left_semi"), "minhash-marks")
    found = grouped(keys.drop("values"), marks, shared, texts.where("doc_id is not null"), by_posterior(marks, percent, miss), k, percent, clashes, bits)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
