"""Vectors and nearest centroids of op8, pattern scores of op9 and likenesses of op3, worked out by hand."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import prose

from tidegauge.llm import fingerprints, language_id, personal_data


def vector_of(text: str, idf) -> np.ndarray:
    """Hashed byte grams of one to three signs (letters lower-cased, bytes beyond ASCII as they are, all else a blank), damped and weighed."""
    signs = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    out = np.zeros(language_id.DIMENSIONS)
    for n in (1, 2, 3):
        for i in range(len(signs) - n + 1):
            gram = 0
            for s in signs[i : i + n]:
                gram = (gram * 257 + s) % 2**32
            if signs[i] != 32 or signs[i + n - 1] != 32:
                out[(gram + (n << 26)) * 2654435761 % 2**32 >> 20] += 1
    out = np.log1p(out) * idf
    return out / max(np.linalg.norm(out), 1e-12)


def test_nearest_centroids_by_hand(spark):
    rng = random.Random(7)
    letters = {"aa": "abcdefgh", "bb": "hijklmnop", "cc": "qrstuvwxyzé"}
    text = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 7))) for _ in range(n))
    train = [(i, text(lang, rng.randint(5, 40)), lang) for i, lang in enumerate(sorted(letters) * 60)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language_id.fit(df, rows=50)
    chosen = [r.text for r in language_id.training_rows(df, rows=50).collect()]
    held = Counter(d for t in chosen for d in np.flatnonzero(vector_of(t, np.ones(language_id.DIMENSIONS))).tolist())
    idf = np.array([math.log((1 + len(chosen)) / (1 + held[d])) + 1 for d in range(language_id.DIMENSIONS)])
    assert len(chosen) == 150 and np.allclose(model.idf, idf, atol=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5) and set(model.langs) == set(letters) and max(Counter(model.langs).values()) <= language_id.CENTROIDS
    tests = [(i, t) for i, t in enumerate([None, "", "12 ?", "日本", "Abc HGF", *(text(lang, n) for lang in letters for n in (1, 3, 30)), text("aa", 20) + " " + text("bb", 10)])]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    for i, t in tests:
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        cosine = model.centroids @ vector_of(t, idf)
        best = int(cosine.argmax())
        assert got[i].lang_pred == model.langs[best] and abs(got[i].score - min(1, max(0, cosine[best]))) < 1e-4
        size = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in t.encode())
        floor = max(model.floors[best][min(int(math.log2(max(size, 1))), language_id.LENGTHS - 1)], language_id.REJECT_COSINE)
        assert got[i].rejected == (got[i].score < floor)


def believed(mentions: list, rounds: int, support: int, precision: float, score: float) -> dict:
    edges = defaultdict(lambda: True)
    for kind, value, family, contexts, inner in mentions:
        for c in contexts:
            edges[value, family, c] &= c in inner
    width = defaultdict(set)
    for (v, _, c), inside in edges.items():
        if not inside:
            width[c].add(v)
    seeds = {(v, k) for k, v, *_ in mentions if k >= 0}
    families = {(k, f) for k, _, f, *_ in mentions if k >= 0}
    known = set(seeds)
    for _ in range(rounds):
        good = {}
        for c, values in width.items():
            for k in range(4):
                n = len({v for v in values if (v, k) in known})
                if n >= support and n / len(values) >= precision:
                    good[c, k] = n / len(values)
        doubt = defaultdict(lambda: 1.0)
        for v, f, c in edges:
            for k in range(4):
                if (c, k) in good and (k, f) in families:
                    doubt[v, k] *= 1 - min(good[c, k], 0.999)
        best = {}
        for (v, k), d in doubt.items():
            if 1 - d >= score and v not in {s for s, _ in seeds}:
                best[v] = max(best.get(v, (-1.0, -9)), (round(1 - d, 9), -k))
        known = seeds | {(v, -k) for v, (_, k) in best.items()}
    return {v: k for v, k in known if v not in {s for s, _ in seeds}}


@pytest.mark.parametrize("seed", range(3))
def test_pattern_scores_by_hand(spark, seed):
    rng = random.Random(seed)
    mentions = []
    for n in range(260):
        kind = rng.choice([-1, -1, 0, 1, 3])
        good = [f"c{k}" for k in range(kind * 4, kind * 4 + 4)] if kind >= 0 else [f"c{rng.randrange(16)}"]
        contexts = rng.sample(good, min(len(good), rng.randint(1, 2))) + [f"x{rng.randrange(30)}"] * (rng.random() < 0.2)
        inner = [c for c in contexts if rng.random() < 0.15] if kind < 0 else []
        mentions.append((kind, f"v{n if rng.random() < 0.9 else rng.randrange(20)}", rng.choice("a9") if kind < 0 else "9" if kind else "@", contexts, inner))
    schema = "kind int, value string, family string, contexts array<string>, inner array<string>"
    got = personal_data.believed_values(spark.createDataFrame(mentions, schema), 3, 3, 0.5, 0.7)
    want = believed(mentions, 3, 3, 0.5, 0.7)
    assert {r.value: r.kind for r in got.collect()} == want and len(want) >= 3


def test_likenesses_by_hand(spark):
    """Both likenesses from the written fingerprints of the text, its edit and the next document."""
    rng = random.Random(2)
    base = prose(rng, 120)
    texts = [None, "", "one two", base, base, base[: len(base) // 2], base + " " + prose(rng, 30), *(prose(rng, rng.randint(1, 200)) for _ in range(12))]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    got = {r.doc_id: r for r in fingerprints.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string").withColumn("marks", F.lit(1))).collect()}
    hashes = lambda written: {m.split(":")[0] for m in written.split()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    order = sorted(got, reverse=True)
    for at, i in enumerate(order):
        own, after = hashes(got[i].fingerprint), hashes(got[order[(at + 1) % len(order)]].fingerprint)
        assert abs(got[i].near_edited - like(own, hashes(got[i].edited_fingerprint))) < 1e-12
        assert abs(got[i].near_next - like(own, after)) < 1e-12
    assert len({round(r.near_edited, 3) for r in got.values()}) > 4
