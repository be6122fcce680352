"""Each operator against a brute-force version on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import decontamination, fingerprints, jaccard_join, language_id, line_dedup, personal_data, piece_codec, substring_dedup, suffix_dedup, suffix_groups, token_counts
from tidegauge.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0D]+")
VOCAB = [f"{a}{b}{c}" for a in ("th", "er", "on", "an", "Qu", "é") for b in ("in", "at", "ou", "en") for c in ("g", "ly", "ed", ".", "s,")]


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def corpus() -> list[tuple[int, str | None]]:
    """Texts with copies, near copies, shared passages, periodic, unspaced, empty and null ones."""
    rng = random.Random(11)
    base, passage = prose(rng, 120), prose(rng, 45)
    texts = [base, base, None, "", " \n\t ", "one", "one two three", "one two three", "A" * 3000, "ab " * 200, "x " * 90 + prose(rng, 40)]
    for _ in range(6):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    for _ in range(6):
        texts.append("\n".join([prose(rng, rng.randint(5, 60)), passage, prose(rng, rng.randint(5, 60))]))
    texts += [f"first\nsecond\nthird\n{prose(rng, 20)}\nfirst\nsecond\nthird", "first\nsecond\nthird", "\n\n\n\n", prose(rng, 4000), "日本語" * 40 + " 😀 " + base[:300], passage, passage.upper(), base[:200] + "\x00\x1c\x85" + base[200:260]]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(25)]
    return list(zip(rng.sample(range(1, 400), len(texts)), texts, strict=True))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", "s", i, "x", 1.0) for i, t in corpus]
    schema = "doc_id long, text string, lang string, source string, n_tokens long, component_id string, node double"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def nobody(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows_of(df) -> dict:
    got = [r.asDict() for r in df.collect()]
    assert len({r["doc_id"] for r in got}) == len(got)
    return {r["doc_id"]: r for r in got}


# --- 1 token counts
def test_token_counts(docs, corpus, nobody):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = rows_of(token_counts.count_tokens(docs, path))
    for i, text in corpus:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 512)
    assert token_counts.count_tokens(nobody, path).count() == 0


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, split = Tokenizer.from_file(path), token_counts.pre_token_pattern().findall
    table = token_counts.LengthTable({}, library, bound=50)
    rng = random.Random(5)
    signs = [*map(chr, range(0x20, 0x7F)), *"\t\n\r\x1c\x85\xa0　²½Ⅷéñ日本́😀", "'s", "'re", "  "]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 24)))
        assert sum(table[p] for p in split(text)) == len(library.encode(text, add_special_tokens=False).ids)
    with pytest.raises(token_counts._Unassigned):
        table["ᲊ"]


def test_special_strings_and_unassigned_code_points(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b  <|endoftext|>", "<|endoftext|>" * 3, "x ᲊᲊ y"]
    got = rows_of(token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path))
    assert [got[i]["n_tokens"] for i in range(3)] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


# --- 2 line dedup
def test_line_dedup(docs, corpus, nobody):
    got = rows_of(line_dedup.dedup_lines(docs))
    seen, later = set(), defaultdict(set)
    for i, text in sorted(c for c in corpus if c[1] is not None):
        lines = text.split("\n")
        for p in range(len(lines) - 2):
            key = tuple(lines[p : p + 3])
            if key in seen:
                later[i] |= {p, p + 1, p + 2}
            seen.add(key)
    for i, text in corpus:
        lines = text.split("\n") if text is not None else []
        kept = "\n".join(x for p, x in enumerate(lines) if p not in later[i])
        assert got[i]["text"] == (kept if text is not None else None)
        assert (got[i]["__n_lines"], got[i]["__n_removed"]) == (len(lines), len(later[i]))
        assert got[i]["component_id"] == "x"
    assert line_dedup.dedup_lines(nobody).count() == 0


# --- 3 fingerprints
def test_fingerprints(spark, docs, corpus, nobody):
    got = rows_of(fingerprints.edited_and_next(docs))
    order = sorted(((i, t or "") for i, t in corpus), reverse=True)
    prints = {}
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        third = len(text) // 3
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == sha(text[: len(text) - third] + after[:third])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert r["near_next"] == 1 or r["fingerprint"] != got[order[(at + 1) % len(order)][0]]["fingerprint"]
    assert fingerprints.edited_and_next(nobody).count() == 0


def test_winnowing_chooses_the_rightmost_least_hash(spark):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 4, 5, 9, 12, 13, 60)] + ["a b c d e f g h i j k l " * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = fingerprints.fingerprint(df, w=1).collect()
    chosen = {r.doc_id: [(m.hash, m.position) for m in r.marks] for r in fingerprints.fingerprint(df).collect()}
    for r in grams:
        hashes = [m.hash for m in sorted(r.marks, key=lambda m: m.position)]
        width = min(fingerprints.WINNOW, len(hashes))
        want = []
        for a in range(len(hashes) - width + 1):
            best = max(p for p in range(a, a + width) if hashes[p] == min(hashes[a : a + width]))
            want += [(hashes[best], best)] if (hashes[best], best) not in want else []
        assert chosen[r.doc_id] == want


def test_shared_run_shares_a_mark(spark):
    rng = random.Random(4)
    run = prose(rng, fingerprints.GRAM + fingerprints.WINNOW - 1)
    df = spark.createDataFrame([(0, f"{prose(rng, 30)} {run} {prose(rng, 20)}"), (1, f"{prose(rng, 11)} {run}")], "doc_id long, text string")
    a, b = ({m.hash for m in r.marks} for r in fingerprints.fingerprint(df).collect())
    assert a & b


def test_next_across_ranges(spark):
    ids = [5, 6, 7, 100, 1000, 1001, 50_000]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r["__next"].text for r in fingerprints.with_next(df, "doc_id", ["text"], range_rows=2).collect()}
    assert got == {i: str(j) for i, j in zip(reversed(ids), [*reversed(ids[:-1]), ids[-1]], strict=True)}


def test_next_of_crowded_repeated_and_null_ids(spark):
    """Ids in two far clusters, one id and the null id with very many rows: small cells, one cycle through all rows."""
    ids = [*range(60), *range(10**15, 10**15 + 200, 2), *[10**15 + 500] * 150, *[None] * 130]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    sizes = fingerprints.cells(df.withColumn("__order", F.xxhash64("text")), "doc_id", 4).groupBy("__range", "__sub", "__turn").count()
    assert sizes.agg(F.max("count")).first()[0] <= 16
    got = {(r.doc_id, r.text): (r["__next"].doc_id, r["__next"].text) for r in fingerprints.with_next(df, "doc_id", ["text", "doc_id"], range_rows=4).collect()}
    assert len(got) == len(ids) and len(set(got.values())) == len(ids)
    rank = lambda i: -1 if i is None else i
    assert sum(rank(a[0]) < rank(b[0]) for a, b in got.items()) == 1
    at, seen = next(iter(got)), set()
    while at not in seen:
        seen.add(at)
        at = got[at]
    assert len(seen) == len(ids)


# --- 4 substring dedup
def cut_windows(texts: dict, width: int = 35) -> dict:
    held = {i: WORD.findall(t or "") for i, t in texts.items()}
    times = Counter(tuple(w[j : j + width]) for w in held.values() for j in range(len(w) - width + 1))
    out = {}
    for i, w in held.items():
        gone = {p for j in range(len(w) - width + 1) if times[tuple(w[j : j + width])] > 1 for p in range(j, j + width)}
        out[i] = (len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_substring_dedup(docs, corpus, nobody):
    got = rows_of(substring_dedup.dedup_windows(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == cut_windows(dict(corpus))
    assert substring_dedup.dedup_windows(nobody).count() == 0


def test_factors_are_greedy_and_longest():
    """Every factor is the longest run of windows from its place that stands elsewhere in its own block, and has a true reference."""
    rng = random.Random(21)
    for _ in range(60):
        block = np.array(sorted(rng.randrange(3) for _ in range(rng.randint(1, 7))))
        phrases = [[rng.randrange(6) for _ in range(rng.randint(1, 12))] for _ in block]
        copies = np.array([rng.choice((1, 1, 1, 2)) for _ in block])
        sizes = np.array([len(p) for p in phrases])
        found = substring_dedup.factors(np.array([v for p in phrases for v in p], np.uint64), sizes, block, copies)
        want, marks = [], []
        for p, phrase in enumerate(phrases):
            at, gone = 0, [False] * len(phrase)
            while at < len(phrase):
                longest = len(phrase) - at if copies[p] > 1 else 0
                for q, other in enumerate(phrases):
                    for start in range(len(other) if block[q] == block[p] else 0):
                        n = 0
                        while (q, start) != (p, at) and at + n < len(phrase) and start + n < len(other) and phrase[at + n] == other[start + n]:
                            n += 1
                        longest = max(longest, n)
                if longest:
                    want.append((p, at, longest))
                    gone[at : at + longest] = [True] * longest
                at += max(longest, 1)
            marks += gone
        assert list(zip(*(x.tolist() for x in found[:3]), strict=True)) == want
        assert substring_dedup.covered(found, sizes).tolist() == marks
        for p, at, n, q, start in zip(*(x.tolist() for x in found), strict=True):
            assert phrases[p][at : at + n] == phrases[q][start : start + n] and block[p] == block[q]
            assert (p, at) != (q, start) or copies[p] > 1


def test_substring_dedup_of_repetitive_texts(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice("ab") * rng.choice((1, 1, 2)) if i % 2 else rng.choice(("p", "q q")) for _ in range(rng.randint(30, 160))) for i in range(40)}
    got = rows_of(substring_dedup.dedup_windows(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == cut_windows(texts)


def test_large_blocks_are_counted_by_spark(spark, docs, corpus, monkeypatch):
    """No block larger than the bound reaches a task that holds it whole, and rows stay the same."""
    small = rows_of(substring_dedup.dedup_windows(docs))
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "_parse_blocks", lambda distinct: substring_dedup._parse_hot(distinct.where("false")))
        assert rows_of(substring_dedup.dedup_windows(docs, block_bytes=0)) == small
    assert rows_of(substring_dedup.dedup_windows(docs, block_bytes=200)) == small
    assert {i: r["n_removed"] for i, r in small.items()} == {i: n for i, (_, n, *_) in cut_windows(dict(corpus)).items()}


# --- 5 SentencePiece
def test_piece_codec(docs, corpus, nobody):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows_of(piece_codec.encode_decode(docs, path, with_ids=True))
    for i, text in corpus:
        ids = library.encode(text or "")
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
        assert r["ids_sha256"] == sha(",".join(map(str, ids))) and r["decoded_sha256"] == sha(library.decode(ids))
    assert piece_codec.encode_decode(nobody, path).count() == 0


def test_piece_codec_of_odd_texts():
    import sentencepiece

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        spec = f.read()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=spec), piece_codec.Codec(piece_codec.PieceModel.load(spec))
    rng = random.Random(6)
    signs = [*map(chr, range(0x20, 0x7F)), *"\n\t\r\0▁éñ①ﬁ　中あ́​😀", "  ", "   ", "the", "aaa"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["".join(rng.choice("abcinreth") for _ in range(300))]
    for text, (ids, decoded) in zip(texts, codec.run(texts), strict=True):
        want = library.encode(text)
        assert ids == ",".join(map(str, want)) and decoded == library.decode(want)


# --- 6 suffix-array dedup
def test_suffix_array():
    rng = random.Random(1)
    for _ in range(800):
        s = [rng.randint(0, rng.choice((1, 2, 5))) for _ in range(rng.randint(0, 30))]
        assert suffix_groups.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def cut_bytes(texts: dict, width: int = 50) -> dict:
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        windows = [data[j : j + width] for j in range(len(data) - width + 1)]
        gone = np.zeros(len(data) + 1, bool)
        for j, w in enumerate(windows):
            if w in seen:
                gone[j : j + width] = True
        seen |= set(windows)
        gone = gone[:-1]
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(data), int(gone.sum()), runs, sha(np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return out


def check_bytes(df, texts: dict) -> None:
    got = rows_of(suffix_dedup.dedup_bytes(df))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == cut_bytes(texts)


def test_suffix_dedup(docs, corpus, nobody):
    check_bytes(docs, dict(corpus))
    assert suffix_dedup.dedup_bytes(nobody).count() == 0


def test_suffix_dedup_of_repetitive_texts(spark):
    rng = random.Random(9)
    texts = {i: "".join(rng.choice(("ab", "a", "abab" * 9, "cé")) for _ in range(rng.randint(10, 90))) for i in range(40)}
    check_bytes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


def test_hot_anchors_are_compared_by_spark(spark, docs, corpus, monkeypatch):
    """With the bound at one text no phrase that may repeat reaches a block, and rows stay the same; ids must be numbers."""
    with monkeypatch.context() as m:
        m.setattr(suffix_dedup, "_parse_blocks", lambda blocks, window: suffix_dedup._parse_hot(blocks.where("false"), window))
        got = rows_of(suffix_dedup.dedup_bytes(docs, hot_texts=1))
    want = cut_bytes(dict(corpus))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    got = rows_of(suffix_dedup.dedup_bytes(docs, hot_texts=4))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    with pytest.raises(ValueError):
        suffix_dedup.dedup_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


# --- 7 n-gram Jaccard join
def groups_of(texts: dict, k: int = 4, percent: int = 85) -> dict:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def check_groups(df, texts: dict) -> None:
    got = rows_of(jaccard_join.similar_documents(df))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == groups_of(texts)


def test_jaccard_join(docs, corpus, nobody):
    check_groups(docs, dict(corpus))
    assert jaccard_join.similar_documents(nobody).count() == 0


def test_jaccard_join_near_the_threshold(spark):
    """Chains of texts that differ by a few words, of sizes over many bands."""
    rng = random.Random(12)
    texts, i = {}, 0
    for size in (5, 7, 9, 12, 16, 22, 30, 41, 60, 90, 150, 260):
        words = [f"w{rng.randrange(500)}" for _ in range(size + 3)]
        for _ in range(8):
            texts[i] = " ".join(words)
            words = list(words)
            for _ in range(rng.randint(1, max(1, size // 60))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(500)}"
            if rng.random() < 0.5:
                words.append(f"u{rng.randrange(500)}")
            i += 1
    check_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


def test_every_allocation_covers_its_band():
    for percent in (80, 85):
        for b in jaccard_join.bands(percent)[:60]:
            most = max((100 - percent) * (b.high + 100 * b.high // percent) // (100 + percent), 0)
            worth = b.segments * (2 if b.deletions else 1)
            assert b.segments == 0 and most == 0 or worth >= most + 1 + b.spare


def test_jaccard_join_of_texts_around_a_common_passage(spark):
    """Most tokens are common ones; links at 5 words and 80 %."""
    rng = random.Random(31)
    passage, texts = prose(rng, 40), {}
    for i in range(60):
        texts[i] = f"{prose(rng, rng.randint(1, 30))} {passage} {prose(rng, rng.randint(0, 12))}"
        if i % 3 == 2:
            words = texts[i - 1].split()
            words[rng.randrange(len(words))] = f"n{i}"
            texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len(jaccard_join.common_tokens(df, len(texts), 5)) > 20
    got = rows_of(jaccard_join.similar_documents(df, k=5, percent=80))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == groups_of(texts, 5, 80)


def test_jaccard_join_with_nodes_that_clash(spark, docs, corpus):
    """Different sets share most of the nodes of six bits at first."""
    got = rows_of(jaccard_join.similar_documents(docs, bits=6))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == groups_of(dict(corpus))


def test_jaccard_join_of_null_and_repeated_ids(spark):
    rng = random.Random(13)
    a, b = prose(rng, 50), prose(rng, 50)
    df = spark.createDataFrame([(None, a), (None, a), (3, a), (3, b), (3, a), (7, b), (9, f"{a} more")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.similar_documents(df).collect()), key=str)
    assert got == sorted([(None, 47, None)] * 2 + [(3, 47, 3)] * 3 + [(7, 47, 3), (9, 48, 3)], key=str)


def structured(n: int, a: str = "a", b: str = "b") -> str:
    """The word over two letters that polynomial hashes modulo a power of two can't tell from its complement."""
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_regular_structure_are_told_apart(spark, n):
    one, other = structured(n), structured(n, "b", "a")
    texts = {1: one, 2: other, 3: " ".join([one] * 35), 4: " ".join([other] * 35), 5: " ".join(structured(n // 16)), 6: " ".join(structured(n // 16, "b", "a"))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_groups(df, texts)
    got = rows_of(substring_dedup.dedup_windows(df))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == cut_windows(texts)
    check_bytes(df, texts)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (20, 21), (30, 30)] + [(k, k + 1) for k in range(100, 140)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 30: 30} | {k: 100 for k in range(100, 141)}
    assert connected_components(edges.where("a < 0")).count() == 0


# --- 8 language ID
def test_language_id_on_the_held_out_fold(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(df).join(df.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 40")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 100 and right / n > 0.97
    assert got.where("rejected").count() == 0


def test_language_id_edges(spark, nobody):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "123 !?", "fr"), (10**6 + 3, "ж" * 200, None), (None, "the and", "en")], base.schema)
    got = {r.doc_id: r for r in language_id.identify(base.union(more)).collect()}
    assert [got[10**6 + k].lang_pred for k in range(3)] == ["und"] * 3 and all(got[10**6 + k].rejected and got[10**6 + k].score == 0 for k in range(3))
    assert got[10**6 + 3].lang_pred != "und" and got[10**6 + 3].rejected
    assert not got[None].held_out
    assert language_id.identify(nobody).count() == 0
    unlearnt = language_id.identify(base.withColumn("lang", F.lit(None).cast("string")))
    assert unlearnt.where("lang_pred != 'und'").count() == 0


UNKNOWN = {
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "c": 'for (int i = 0; i < n; i++) { struct node *p = malloc(sizeof(*p)); if (!p) return NULL; p->next = head; head = p; } printf("%d\\n", count);',
}


def test_unknown_languages_and_noise_are_rejected(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(df.where(~language_id.held_out()))
    rng = random.Random(8)
    noise = {name: "".join(rng.choice(signs) for _ in range(n)) for n in (200, 2000) for name, signs in ((f"hex {n}", "0123456789abcdef"), (f"base64 {n}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), (f"consonants {n}", "bcdfghjklmnpqrstvwxz   "))}
    strange = spark.createDataFrame(list((UNKNOWN | noise).items()), "doc_id string, text string")
    assert [r.doc_id for r in language_id.predict(strange, model).where("not rejected").collect()] == []
    assert language_id.keep_known(strange, model).count() == 0
    texts = [r.text for r in df.where(language_id.held_out() & (F.length("text") > 200)).select("text").collect()]
    short = [" ".join(t.split()[5 : 5 + n]) for t in texts for n in (1, 2, 4, 8, 16)] + [r.text for r in df.where(language_id.held_out() & (F.length("text") <= 200)).collect()]
    clean = spark.createDataFrame([(k, t) for k, t in enumerate(short) if sum(c.isalpha() for c in t) > 0.7 * len(t)], "doc_id long, text string")
    assert clean.count() > 800 and language_id.predict(clean, model).where("rejected").count() < 0.02 * clean.count()


# --- 9 personal data
EMAIL, IP, CARD, PHONE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text: str) -> list:
    def luhn(d):
        return sum(c if k % 2 == 0 else 2 * c - 9 * (c > 4) for k, c in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15])


def test_base_patterns():
    rng = random.Random(2)
    for _ in range(6000):
        text = "".join(rng.choice("a1.@-+ 19(05.%é@.4") for _ in range(rng.randint(0, 40)))
        assert personal_data.base_spans(text) == plain_spans(text)
    assert personal_data.base_spans("x 4539 1488 0343 6467, 1.2.3.4.5.6.7.8 +1 (523) 555-1055") == plain_spans("x 4539 1488 0343 6467, 1.2.3.4.5.6.7.8 +1 (523) 555-1055")


def test_personal_data(spark, docs, corpus, nobody):
    extra = [(1000 + k, f"{prose(random.Random(k), 6)} reach me at u{k}@mail.example.com or 10.0.{k}.7 now") for k in range(4)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = rows_of(personal_data.find_personal_data(df))
    for i, text in [*corpus, *extra]:
        spans = plain_spans(text or "")
        want = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base"] == want and set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in personal_data.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
    assert personal_data.find_personal_data(nobody).count() == 0


def test_contexts_find_what_the_patterns_miss(spark):
    """Cards that fail the checksum stand where cards always stand; other numbers stand elsewhere."""
    rng = random.Random(7)

    def card(good: bool) -> str:
        while True:
            digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if personal_data.passes_luhn(digits) == good:
                return digits

    texts = [f"{prose(rng, 5)} card-number: {card(True)} {prose(rng, 5)}" for _ in range(30)] + [f"{prose(rng, 4)} serial {card(False)} {prose(rng, 3)}" for _ in range(10)]
    hidden = card(False)
    texts.append(f"{prose(rng, 5)} card-number: {hidden} {prose(rng, 5)}")
    got = rows_of(personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    at = texts[-1].index(hidden)
    assert got[40]["spans"] == f"card:{at}:{at + 16}" and got[40]["base"] == "" and got[40]["added"] == 1
    assert all(r["added"] == 0 for i, r in got.items() if i != 40)


def test_contexts_find_numbers_with_blanks(spark):
    """A phone with too few digits and a grouped card that fails the checksum stand where their kinds always stand."""
    rng = random.Random(11)

    def card(good: bool) -> str:
        while True:
            digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if personal_data.passes_luhn(digits) == good:
                return " ".join(digits[k : k + 4] for k in (0, 4, 8, 12))

    phone = lambda n: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(10 ** (n - 1), 10**n)}"
    texts = [f"{prose(rng, 5)} card-number: {card(True)} {prose(rng, 5)} call-me: {phone(4)} {prose(rng, 5)}" for _ in range(30)]
    texts += [f"{prose(rng, 4)} serial {card(False)} {prose(rng, 3)} lot {phone(2)} {prose(rng, 3)}" for _ in range(10)]
    hidden_card, hidden_phone = card(False), phone(2)
    texts.append(f"{prose(rng, 5)} card-number: {hidden_card} {prose(rng, 5)} call-me: {hidden_phone} {prose(rng, 5)}")
    got = rows_of(personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    places = [(texts[-1].index(v), kind, len(v)) for kind, v in (("card", hidden_card), ("phone", hidden_phone))]
    assert got[40]["spans"] == ",".join(f"{kind}:{a}:{a + n}" for a, kind, n in places) and got[40]["base"] == "" and got[40]["added"] == 2
    assert all(r["added"] == 0 and r["spans"] == r["base"] for i, r in got.items() if i != 40)


def test_recall_of_planted_identifiers_of_every_kind(spark):
    """Identifiers that no base pattern matches, some unlike every seed, stand where most of their kind are seeds."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        while not personal_data.passes_luhn(digits := "4" + number(15)):
            pass
        return digits

    kinds = {
        "email": ("write-to:", lambda: f"{word()}@{word()}.example.org", lambda: f"{word()}@{word()}"),
        "ip": ("from-host:", lambda: f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", lambda: f"10.{rng.randrange(300, 999)}.{rng.randrange(256)}.{rng.randrange(256)}"),
        "card": ("card-number:", card, lambda: f"{number(6)}-{number(5)}"),
        "phone": ("call-me:", lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: f"{number(3)}-{number(4)}"),
    }
    texts, want = [], []
    for kind, (lead, seed, unseen) in kinds.items():
        for k in range(60):
            hidden = k % 12 == 0
            value, head = unseen() if hidden else seed(), f"{prose(rng, rng.randint(2, 9))} {lead} "
            want += [(len(texts), f"{kind}:{len(head)}:{len(head) + len(value)}")] if hidden else []
            texts.append(f"{head}{value} {prose(rng, 4)}")
    for _ in range(40):
        texts.append(f"{prose(rng, 5)} lot {number(9)} {prose(rng, 5)} {word()}@{word()} {prose(rng, 3)}")
    got = rows_of(personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    found = sum(span in got[i]["spans"].split(",") for i, span in want)
    assert found >= 0.9 * len(want), (found, len(want))
    assert sum(r["added"] for r in got.values()) == found and all(got[i]["added"] == 0 for i in range(240, 280))


def test_context_words_are_whole():
    near, far = "w" * 60, "v" * 65
    text = f"{far} {near} ip=1.2.3.4, {near} b"
    at = text.index("1.2.3.4")
    assert personal_data.contexts(text, at, at + 7) == ["L ip", f"LL {near} ip", "R ,", "LR ip ,"]
    assert personal_data.contexts(text, 66 + 61, at + 7) == [f"L {near}", f"LL {personal_data.LONG_WORD} {near}", "R ,", f"LR {near} ,"]
    assert personal_data.contexts(text, 0, 65) == [f"R {near}"] and personal_data.contexts("x", 0, 1) == []


# --- 10 decontamination
def edit_distance(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, docs, corpus, nobody):
    rng = random.Random(10)
    items = [(k, prose(rng, rng.randint(8, 20))) for k in range(8)] + [(90, None), (91, ""), (92, "!!"), (93, "one two")]
    planted = []
    for k, text in items[:8]:
        core = list(decontamination.normalised(text).strip())
        for n, edits in enumerate((0, len(core) // 10, len(core) // 10 + 2)):
            new = list(core)
            for at in rng.sample(range(2, len(new) - 2), edits):
                new[at] = "z"
            planted.append((500 + 10 * k + n, f"{prose(rng, 20)} {''.join(new)} {prose(rng, 20)}"))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.find_items(df, table).collect()}
    want = {}
    for i, text in [*corpus, *planted]:
        flat = decontamination.normalised(text or "")
        for k, item in items[:8] + items[11:]:
            core = decontamination.normalised(item).strip()
            budget = len(core) // 10
            if budget and len(flat) < 1500:
                d = edit_distance(core, flat)
                if d <= budget:
                    want[i, k] = d
            elif not budget and f" {core} " in flat:
                want[i, k] = 0
    assert {k: v for k, v in got.items() if k in want or len(dict([*corpus, *planted])[k[0]] or "") < 1400} == want
    marks = {r.doc_id: r["__contaminated"] for r in decontamination.mark_contaminated(df, table).collect()}
    assert {i for i, m in marks.items() if m} == {i for i, _ in got}
    assert decontamination.find_items(nobody, table).count() == 0 and decontamination.find_items(df, table.where("item_id < 0")).count() == 0
    assert decontamination.mark_contaminated(df, table.where("item_id < 0")).where("__contaminated").count() == 0


def test_items_in_several_blocks(spark):
    table = spark.createDataFrame([(k, f"{w} quick brown fox jumps over the lazy dog number {w}") for k, w in enumerate(("alpha", "bravo", "delta", "gamma"))], "item_id long, text string")
    blocks = list(decontamination.item_blocks(table, "item_id", "text", block_chars=60))
    assert len([b for b in blocks if b]) > 1 and sorted(i for b in blocks for i, _ in b) == [0, 1, 2, 3]
