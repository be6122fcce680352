"""Periodic runs and hard negatives against brute force: edges, ties, repeated rows, empty tables, clashing columns."""

import math
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, prose, sha

from tidegauge.llm import hard_negatives, periodic_runs, queries


def runs_of(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period): for every period each maximal stretch of equal words, the least period of a stretch."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i - s + p >= max(6, 4 * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(w: list, runs: list) -> list:
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def planted(doc_id, w: list) -> list:
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \n ", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x\x1cy " * 7, "A a " * 9, "日本 語 " * 8 + "end", "a a a a a a b " * 5, "p " * 9 + "q " * 9]
    for _ in range(120):
        w = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 90))]
        a, p = rng.randrange(len(w)), rng.randint(1, 15)
        out.append("  ".join(w[:a] + [w[a + (i % p)] if a + i % p < len(w) else "z" for i in range(rng.randint(0, 70))] + w[a:]))
    return out + [prose(rng, 3000), prose(rng, 40) + (" " + prose(rng, 7)) * 30]


def test_runs_against_brute_force(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b " * 9, "x", 1), (4, "c d " * 9, "x", 1), (4, "c d " * 9, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, period int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        runs = runs_of(w)
        want.append((i, len(w), runs, " ".join(collapsed(w, runs))))
    assert got == sorted(want, key=str) and any(len(r) > 3 for _, _, r, _ in want)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_query_of_runs_against_brute_force(spark, tmp_path, texts):
    rows = [(7 * i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, h string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        w = planted(i, WORD.findall(t or ""))
        runs = runs_of(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(runs), sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(collapsed(w, runs))))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t, _ in rows)


def test_long_repetitive_texts_take_no_quadratic_time():
    began = time.time()
    for n, want in ((400_000, 1), (400_000, 4000)):
        value = np.zeros(n, np.uint64) if want == 1 else np.tile(np.r_[np.zeros(99, np.uint64), np.uint64(1)], n // 100)
        starts, lengths, periods = periodic_runs.find_runs(value + np.uint64(7), np.array([0, n]))
        assert len(starts) == want + (want > 1) and lengths.max() == n
    assert time.time() - began < 20


# --- hard negatives ---------------------------------------------------------------------------------------------------


def mined(rows: list, positives: int = 5, negatives: int = 3) -> list:
    """The same by scoring everything: rows are (vec_id, label, vector)."""
    usable = [(i, lab, np.array([max(-(2**24), min(2**24, math.floor(256 * x))) for x in v], object)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda u, v: int(sum(a * b for a, b in zip(u, v)))  # noqa: E731, B905  shorter vectors end in zeros
    out = []
    for k, (i, lab, v) in enumerate(usable):
        if i % 50:
            continue
        scored = sorted((-dot(v, u), j, other == lab) for n, (j, other, u) in enumerate(usable) if n != k)
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            inside = [(t, n) for t, n, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def vectors_of(rng: np.random.Generator, n: int, dims: int = 12) -> list:
    centres = rng.normal(size=(4, dims)) * 0.4
    labels = rng.integers(0, 4, n)
    return [(int(i), int(lab), [float(np.float32(x)) for x in 0.8 * centres[lab] + 0.5 * centres[0] + rng.normal(size=dims) * 0.15]) for i, lab in zip(rng.permutation(n) * 5, labels, strict=True)]


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("at_once", [4096, 7])
def test_negatives_against_brute_force(spark, at_once):
    rng = np.random.default_rng(5)
    rows = vectors_of(rng, 700)
    rows += [(50, 1, None), (100, None, [0.5] * 12), (None, 1, [0.5] * 12), (150, 1, [0.5] * 11 + [float("nan")]), (200, 1, [float("inf")] + [0.5] * 11), (250, 2, [None] + [0.5] * 11)]
    rows += [(5003, 1, rows[0][2]), (5005, 2, rows[0][2]), (6000, 3, []), (6050, 2, [0.7, -0.2]), (6100, 0, [0.0] * 12), (6150, 1, [-1e30] + [0.3] * 11)]
    rows += [(9000 + k, k % 3, rows[1][2]) for k in range(120)]  # one vector that many rows have, and ties of every rank
    rows += [rows[3]] * 2 + [(rows[4][0], 3, rows[5][2])]  # repeated rows, a repeated id
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "anchor": F.lit("x"), "cells": F.lit(0)}).repartition(5)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, anchors_at_once=at_once)
    want = mined(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 150


def test_negatives_of_empty_and_label_tables(spark):
    hard = lambda rows: hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).count()
    assert hard([]) == hard([(50, 1, None)]) == hard([(50, 1, [])]) == hard([(1, 1, [1.0]), (2, 2, [0.7])]) == 0
    assert hard([(50, 1, [1.0])]) == hard([(50, 1, [1.0]), (3, 1, [1.0])]) == 0
    assert hard([(50, 1, [1.0]), (3, 1, [1.0]), (4, 2, [0.8])]) == 1


def test_bounds_enclose_every_score_and_spare_most_rows():
    rng = np.random.default_rng(2)
    numbers = rng.integers(-120, 120, (3000, 16)).astype(np.int32)
    borders = np.quantile(numbers, np.arange(1, 64) / 64, axis=0, method="nearest").T.astype(np.int64)
    low = np.maximum(np.c_[numbers.min(axis=0), borders], numbers.min(axis=0)[:, None])
    high = np.maximum(low, np.minimum(np.c_[borders - 1, numbers.max(axis=0)], numbers.max(axis=0)[:, None]))
    codes = np.stack([np.searchsorted(borders[d], numbers[:, d], "right") for d in range(16)], axis=1).astype(np.uint8)
    block = hard_negatives.Anchors(np.arange(40), np.zeros(40, np.int64), numbers[:40], low, high)
    least, most = hard_negatives.score_bounds(hard_negatives.bound_tables(block, 0, 40), codes)
    exact = numbers.astype(np.int64) @ numbers[:40].T.astype(np.int64)
    assert ((least <= exact) & (exact <= most)).all()
    sixth = np.partition(least, -6, axis=0)[-6]
    assert (most >= sixth).mean() < 0.05


def test_query_of_negatives(spark, tmp_path):
    rows = vectors_of(np.random.default_rng(8), 300)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in rows]
    got = queries.op12_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(moved)
    by = defaultdict(set)
    for r in got.collect():
        by[r.anchor_id].add(r.positive_id)
    assert max(map(len, by.values())) <= 5
