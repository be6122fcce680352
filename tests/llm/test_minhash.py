"""MinHash near-duplicates, and pairs of crowded groups, against brute force."""

import random

import numpy as np
import pytest
from test_operators import groups_of, prose

from tidegauge.llm import crowded_pairs, minhash_dedup
from tidegauge.llm.textbytes import mix64


def near_texts(rng: random.Random, n: int, words: int) -> list[str]:
    """Chains of edits: some copies fall just under the threshold, some just over it."""
    out, text = [], prose(rng, words).split()
    for _ in range(n):
        text = list(text)
        for _ in range(rng.randint(0, max(1, words // 40))):
            text[rng.randrange(len(text))] = prose(rng, 1)
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    out = [None, "", " \t", "one", "ONE", "one two", "one two three four five six", "a b c d e f g h i j", "x " * 300]
    for words in (8, 15, 40, 90, 200, 700):
        out += near_texts(rng, 12, words)
    passage = prose(rng, 60)
    out += [f"{prose(rng, 10)} {passage} {prose(rng, 10)}" for _ in range(40)] + [f"{passage} {prose(rng, k % 7)}" for k in range(40)]
    out += [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    return out + out[20:30]


@pytest.mark.parametrize("k, percent", [(5, 85), (3, 70)])
def test_groups_against_brute_force(spark, texts, k, percent):
    ids = random.Random(4).sample(range(1, 10_000), len(texts))
    rows = [(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, values string").repartition(4)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(df, k=k, percent=percent).collect()}
    want = groups_of({i: t for i, t, *_ in rows}, k=k, percent=percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items()) and 20 < sum(not r.kept for r in got.values())


def test_null_ids_repeated_ids_and_empty_tables(spark):
    rng = random.Random(8)
    text = prose(rng, 50)
    rows = [(5, text), (3, text + " more"), (None, text), (None, None), (9, text), (9, prose(rng, 30)), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3, False), (3, 3, True), (None, None, True), (None, None, True), (9, 3, False), (9, 9, True), (4, 4, True)], key=str)
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_sets_whose_names_clash_stay_apart(spark, texts):
    rows = list(enumerate(texts[:60]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, bits=6).collect()}
    assert got == {i: c for i, (_, c) in groups_of(dict(rows), k=5).items()}


def test_share_of_equal_values_is_the_similarity():
    rng = np.random.default_rng(1)
    tokens = mix64(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    for common in (100, 700, 1000):
        one, other = tokens[:1500], tokens[1500 - common : 3000 - common]
        values = minhash_dedup.minhash(np.repeat([0, 2], 1500), np.concatenate([one, other]), 3)
        s = common / (3000 - common)
        assert abs((values[0] == values[2]).mean() - s) < 4 * (s * (1 - s) / minhash_dedup.VALUES) ** 0.5 and not values[1].any()


def test_bands_lose_no_link_to_speak_of():
    assert minhash_dedup.banding(85) == (40, 5)
    for percent in (50, 70, 80, 85, 95):
        bands, width = minhash_dedup.banding(percent)
        assert bands * width <= minhash_dedup.BANDED and (1 - (percent / 100) ** width) ** bands <= 1e-9


def test_posterior_bounds():
    """The fewest matches that stay: the posterior chance of a link is the miss probability at least, and below it with one match less."""
    from math import comb

    least = minhash_dedup.least_matches(85, 1e-6)
    for turn, fewest in enumerate(least):
        n = (turn + 1) * minhash_dedup.BATCH
        s = np.linspace(0, 1, 200_001)
        for m, link in ((fewest, True), (fewest - 1, False)):
            weight = comb(n, int(m)) * s**m * (1 - s) ** (n - m)
            assert (weight[s >= 0.85].sum() / weight.sum() >= 1e-6) == link
    assert (np.diff(least) > 0).all()


def test_a_pair_is_given_up_as_soon_as_a_batch_decides():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 16, (2000, minhash_dedup.VALUES)).astype(np.uint16)
    for s, kept in ((0.95, 2000), (0.85, 1998), (0.5, 0)):
        other = np.where(rng.random(one.shape) < s, one, one ^ np.uint16(1))
        live = minhash_dedup._posterior_test(one, other, minhash_dedup.least_matches())
        assert len(live) >= kept if kept else len(live) < 5


def sets_frame(spark, sets: list[set[int]]):
    value = lambda t: int(mix64(np.array([t + 1], np.uint64)).view(np.int64)[0])
    tokens = spark.createDataFrame([(i, value(t)) for i, s in enumerate(sets) for t in s], "node long, token long")
    groups = spark.createDataFrame([(i % 2, i, i // 2 if i < 20 else i, len(s)) for i, s in enumerate(sets) for _ in (0, 1)], "signature long, node long, component long, n long")
    return groups.distinct(), tokens


def pairs_of(spark, sets, percent=85, crowded=8):
    groups, tokens = sets_frame(spark, sets)
    return {(min(r.x, r.y), max(r.x, r.y)) for r in crowded_pairs.open_pairs(groups, tokens, percent, crowded).collect()}, groups.collect()


@pytest.mark.parametrize("percent", [60, 85])
def test_crowded_groups_lose_no_link(spark, percent):
    rng = random.Random(2)
    core, sets = list(range(40)), []
    for _ in range(150):
        s = set(rng.sample(core, rng.randint(30, 40))) | set(rng.sample(range(100, 140), rng.randint(0, 10)))
        sets.append(s)
    got, groups = pairs_of(spark, sets, percent)
    component = {r.node: (r.component, r.signature) for r in groups}
    for i in range(150):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if i % 2 == j % 2 and component[i][0] != component[j][0] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                assert (j, i) in got
    assert all(component[x][0] != component[y][0] for x, y in got)


@pytest.mark.parametrize("common, own", [(56, 20), (56, 11)])
def test_pairs_around_a_passage_grow_no_faster_than_its_texts(spark, common, own):
    """Sets around one passage that don't link: pairs tested stay fewer than sets, however many there are."""
    for n in (200, 400, 800):
        sets = [set(range(common)) | {1000 + i * own + j for j in range(own)} for i in range(n)]
        assert len(pairs_of(spark, sets)[0]) <= n
