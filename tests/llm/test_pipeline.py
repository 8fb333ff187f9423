"""The pipeline against brute-force versions of its stages."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from blockreach.llm import language
from blockreach.llm.queries import language_model, vocabulary_path
from tests_llm_brute import brute_contamination, brute_near_texts, brute_redacted, brute_spans

SF = "/root/testdata/sf0.001"


def expected(spark, docs, items):
    """Surviving ``doc_id, text`` by stage, from plain Python."""
    kept = [(d, t) for d, t in docs if language.has_letter(t)]
    stages = [kept]
    components = brute_near_texts(dict(kept))
    kept = [(d, t) for d, t in kept if components[d] == d]
    stages.append(kept)
    flags = brute_contamination([t for _, t in kept], items)
    kept = [x for x, f in zip(kept, flags) if not f[4]]
    stages.append(kept)
    stages.append([(d, brute_redacted(t, brute_spans(t)[1])) for d, t in kept])
    return stages


def test_stages_equal_brute_force(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = expected(spark, rows, items)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (name, stage), rows_wanted in zip(corpus_pipeline.STAGES, want):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(rows_wanted), name
        assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    assert len(want[0]) > len(want[1]) > len(want[2]) > 0
    library = Tokenizer.from_file(vocabulary_path())
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(final) == {d for d, _ in want[-1]}
    for d, t in want[-1]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert final[d]["ids"] == ids and final[d]["n_tokens"] == len(ids)
        assert final[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_odd_documents_pass_through_all_stages(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, "the cat is on the mat with the other one", "en", "s", 10, "x"), (900001, None, None, None, None, "x"), (900002, "", None, "s", 0, None), (900003, "123 456", "en", "s", 7, "x")]
        + [(900004, "only a repeated row of the text that is here", "en", "s", 40, "x")] * 3 + [(900005, "the long text " * 20_000, "en", "s", 1, "x")],
        "doc_id long, text string, lang string, source string, n_chars long, component_id string",
    )
    docs = source.withColumn("component_id", F.lit("clash")).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert not {900001, 900002, 900003} & set(ids)
    assert (ids.count(None), ids.count(900004), ids.count(900005)) == (1, 1, 1)


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0
    assert language_model(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0)) is None
