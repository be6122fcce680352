"""The corpus pipeline on a small table, and repeated and null ids in the operators that group documents."""

import random

import corpus_pipeline
import pytest
from test_operators import cut_bytes, cut_windows, groups_of, prose

from tidegauge.llm.jaccard_join import similar_documents
from tidegauge.llm.line_dedup import dedup_lines
from tidegauge.llm.substring_dedup import dedup_windows
from tidegauge.llm.suffix_dedup import dedup_bytes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    first = docs.orderBy("doc_id").first()
    line = "The and of that. " + prose(random.Random(3), 90)
    leak = items.orderBy("item_id").first().text
    more = [
        (10_000, None, "en", "x", 0), (10_001, "", "en", "x", 0), (10_002, "12 34", "en", "x", 5), (10_003, first.text, first.lang, "x", first.n_chars),
        (9_999, line, "en", "x", 1), (10_004, line + " The end.", "en", "x", 1), (10_005, f"The and of the that. {leak} Of the and that.", "en", "x", 1), (10_006, "The only one of this kind and that.", "en", "x", 1),
    ]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{out}/documents.parquet")
    items.write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not ids[0] & {10_000, 10_001, 10_002} and 10_006 in ids[0]
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:], strict=False))
    assert not ids[2] & {10_003, 10_004} and {9_999, 10_005} <= ids[2] and 10_004 in ids[1]
    assert 10_005 not in ids[3] and 10_006 in ids[3]
    assert ids[4] == ids[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids[4]


def test_near_copies_of_five_words_and_eighty_percent(spark):
    """Texts that lose 5-word shingles one by one: the stage keeps what brute force keeps, and not what 4 words and 85 % keep."""
    rng, texts = random.Random(4), {}
    for size in (40, 60, 90, 140, 220):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for changes in range(1 + size // 20):
            words = list(base)
            for k in range(changes):
                words[size * (k + 1) // (changes + 1)] = f"v{len(texts)}x{k}"
            texts[len(texts)] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    want, narrow = ({i for i, (_, least) in groups_of(texts, k, percent).items() if i == least} for k, percent in ((5, 80), (4, 85)))
    assert got == want and got < narrow


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, a), (2, b), (2, f"{b} more"), (None, a), (None, None), (3, f"{prose(rng, 5)} {a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted((r.doc_id or 0, r.n_removed) for r in dedup_windows(df).collect())
    want = cut_windows(dict(enumerate(t for _, t in rows)))
    assert whole == sorted((i or 0, want[k][1]) for k, (i, _) in enumerate(rows))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in dedup_bytes(df).collect())
    later = cut_bytes({1: a, 2: "", 3: rows[-1][1]})[3][1]
    assert got == sorted((i or 0, len((t or "").encode()), later if i == 3 else 0) for i, t in rows)
    parts = sorted(((r.doc_id, r.component_id) for r in similar_documents(df).collect()), key=str)
    assert parts == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 1), (None, None), (None, None)]
    assert dedup_lines(df).count() == len(rows)


def test_language_stage_gives_a_batch_back_in_chunks(spark, monkeypatch):
    """A worker holds no second copy of a batch, however many rows it has; no row goes missing between chunks."""
    import numpy as np
    import pyarrow as pa

    from tidegauge.llm import language_id

    monkeypatch.setattr(language_id, "mapped_in_arrow", lambda docs, run, schema: run)
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    model = language_id.CentroidModel(np.ones(language_id.DIMENSIONS, np.float32), np.full((1, language_id.DIMENSIONS), language_id.DIMENSIONS**-0.5, np.float32), ["x"])
    texts = [None if i % 7 == 0 else "12 34" if i % 7 == 1 else f"some words {i}" * (i % 5 + 1) for i in range(1000)]
    out = list(language_id.keep_known(docs, model, reject_cosine=0.0)(iter([pa.record_batch({"doc_id": range(1000), "text": texts})])))
    assert [i for b in out for i in b.column(0).to_pylist()] == [i for i in range(1000) if i % 7 > 1]
    assert max(b.num_rows for b in out) <= 64
