"""Very long texts, repeated rows, null ids and clashing columns in every operator and stage."""

import random
import time

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import cut_bytes, cut_windows, groups_of, prose, sha

from tidegauge.llm import decontamination, fingerprints, jaccard_join, language_id, line_dedup, personal_data, piece_codec, queries, substring_dedup, suffix_dedup, token_counts

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["meta.lang", "__cut", "__contaminated", "__n_lines", "key", "node"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = prose(rng, 80)
    return [(1, base), (1, base), (1, prose(rng, 30)), (None, base), (None, None), (2, ""), (3, "a\nb\nc\nd"), (3, "a\nb\nc\nd"), (4, f"{base} end")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Rows that repeat ids and texts, null ids, and columns of awkward names."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(1)})
    for c in ODD:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark, rows):
    return spark.createDataFrame([(7, rows[0][1][100:220]), (None, "null id"), (8, None), (9, "")], "item_id long, text string")


def counted(df, *columns) -> list:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_repeated_rows_and_null_ids(docs, rows, items):
    """Each row gives one row, the same for the same text, whatever its id is."""
    import sentencepiece
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    assert counted(token_counts.count_tokens(docs, BYTE_BPE), "doc_id", "n_tokens") == sorted(((i, len(library.encode(t or "").ids)) for i, t in rows), key=str)
    assert counted(piece_codec.encode_decode(docs, PIECE_BPE), "doc_id", "ids_sha256") == sorted(((i, sha(",".join(map(str, pieces.encode(t or ""))))) for i, t in rows), key=str)
    prints = fingerprints.edited_and_next(docs).collect()
    assert sorted((r.doc_id for r in prints), key=str) == sorted((i for i, _ in rows), key=str)
    assert 4 <= len({r.fingerprint for r in prints}) <= len({t or "" for _, t in rows})
    found = personal_data.find_personal_data(docs.withColumn("text", F.concat("text", F.lit(" a@b.cd"))))
    assert counted(found, "doc_id", "n_email") == sorted(((i, int(t is not None)) for i, t in rows), key=str)
    hits = counted(decontamination.find_items(docs, items), "doc_id", "item_id", "distance")
    assert hits == sorted([(1, 7, 0), (1, 7, 0), (None, 7, 0), (4, 7, 0)], key=str)
    assert language_id.identify(docs).count() == len(rows)
    want = cut_windows(dict(enumerate(t for _, t in rows)))
    assert counted(substring_dedup.dedup_windows(docs), "doc_id", "n_removed") == sorted(((i, want[k][1]) for k, (i, _) in enumerate(rows)), key=str)
    assert suffix_dedup.dedup_bytes(docs).count() == jaccard_join.similar_documents(docs).count() == len(rows)


def test_awkward_columns_pass_through(spark, docs, rows, items):
    clean = line_dedup.dedup_lines(docs)
    assert clean.columns == [*docs.columns, "___n_lines", "__n_removed"] and clean.count() == len(rows)
    marked = decontamination.mark_contaminated(docs, items)
    assert marked.columns == [*docs.columns, "___contaminated"] and marked.where("___contaminated").count() == 4
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, docs, "").columns == docs.columns
    model = language_id.fit(docs)
    assert language_id.keep_known(docs, model).columns == docs.columns


def test_very_long_texts(spark, items):
    """Texts of a megabyte, with and without spaces, end in seconds in every operator and give whole results."""
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(9)
    unspaced = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 20))
    spaced = " ".join(rng.choices([prose(rng, 1) for _ in range(30)] + [f"w{k}" for k in range(3000)], k=200_000))
    texts = {1: spaced, 2: unspaced, 3: "a" * (1 << 20), 4: spaced[:500_000] + " tail", 5: "\n".join(["same line"] * 50_000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(4).cache()
    began = time.time()
    pieces, library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: r for r in piece_codec.encode_decode(df, PIECE_BPE).collect()}
    assert all(got[i].ids_sha256 == sha(",".join(map(str, pieces.encode(t)))) for i, t in texts.items())
    got = {r.doc_id: r for r in token_counts.count_tokens(df, BYTE_BPE).collect()}
    assert all(got[i].n_tokens == len(library.encode(texts[i]).ids) for i in (1, 4, 5))
    assert {r.doc_id: r.n_chars for r in fingerprints.edited_and_next(df).collect()} == {i: len(t) for i, t in texts.items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_windows(df).collect()}
    assert got == cut_windows(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_bytes(df).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(t.encode()) for i, t in texts.items()} and got[4][1] >= 500_000 and [got[i][1] for i in (1, 2, 3, 5)] == [0] * 4
    short = {i: t[: 40_000 * i] for i, t in texts.items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(spark.createDataFrame(list(short.items()), "doc_id long, text string")).collect()}
    assert got == cut_bytes(short)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(df).collect()}
    assert got == groups_of(texts)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[5]["__n_removed"] == 49_999 and got[1]["__n_removed"] == 0
    assert personal_data.find_personal_data(df).where("spans != ''").count() == 0
    assert decontamination.find_items(df, items).count() == 0
    assert language_id.identify(df).count() == len(texts)
    assert time.time() - began < 400


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op7_jaccard_join"])
def test_sql_of_operators(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    ours, theirs = queries.QUERIES[name](spark, folder).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    ours, theirs = (d.sort_values("doc_id").reset_index(drop=True)[sorted(theirs.columns)] for d in (ours, theirs))
    assert (ours == theirs).all().all()


def test_personal_data_in_very_long_words_and_numbers(spark):
    """Thousands of zeros in a part of an ip, and megabytes of letters without a blank, beside something to find."""
    zeros, letters = "0" * 5000, "x" * (1 << 20)
    parts = [["1"] * 4 for _ in range(5)]
    for k in range(4):
        parts[k][k] = f"{zeros}7"
    parts[4][2] = "9" * 5000
    rows = [(k, f"at {'.'.join(p)} end") for k, p in enumerate(parts)] + [(5, f"{letters} 5"), (6, f"{letters}@b.cd 10.0.0.1"), (7, f"{letters}7{letters} a@b.cd"), (8, f"0.0.0.{zeros}")]
    began = time.time()
    got = {r.doc_id: r for r in personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_ip for k in range(9)] == [1, 1, 1, 1, 0, 0, 1, 0, 1] and [got[k].n_email for k in (5, 6, 7)] == [0, 1, 1]
    assert got[0].base == f"ip:3:{3 + 5001 + 6}" and got[6].base.startswith(f"email:0:{len(letters) + 5},")
    assert time.time() - began < 60


def test_long_pre_tokens_are_not_kept():
    class Counter:
        def encode(self, piece, add_special_tokens):
            return type("E", (), {"ids": [0] * len(piece)})

    table = token_counts.LengthTable({"a": 1}, Counter())
    assert table["b" * 1000] == 1000 and table["b" * 10] == 10 and set(table) == {"a", "b" * 10}


def test_every_language_is_learnt(spark):
    """Seventy languages of their own letters, one of them with a single id: each is predicted for its own texts."""
    rng = random.Random(6)
    word = lambda k: "".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(4))
    rows = [(1000 * k + j if k else 77, " ".join(word(k) for _ in range(30)), f"l{k}") for k in range(70) for j in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = {r.lang for r in language_id.training_rows(df, rows=5).collect()}
    assert len(chosen) == 70
    model = language_id.fit(df, rows=10)
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(df, model).collect()}
    assert sum((i, lang) in got for i, _, lang in rows) > 0.97 * len(rows)
