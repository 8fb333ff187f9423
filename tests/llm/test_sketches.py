"""Sketches: contract columns against Python, likeness against true containment, odd rows."""

import hashlib

import numpy as np

from blockreach.llm import sketches as K
from blockreach.llm.queries import op10
from pyspark.sql import functions as F


def edited_text(text, following):
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def test_query_over_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), reverse=True)
    rows = {r["doc_id"]: r for r in op10(spark, folder).collect()}
    assert len(rows) == len(docs)
    by_text = {}
    for (doc_id, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        row = rows[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited_text(text, following).encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        assert by_text.setdefault(text, row["fingerprint"]) == row["fingerprint"]
    # Two thirds of a text stay; texts of some length show it.
    long = [rows[d] for d, t in docs if len(t.split()) >= 100]
    assert 0.55 < np.mean([r["near_edited"] for r in long]) < 0.8
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values()]) > 0.9


def test_sketch_keeps_what_is_below_the_fraction(spark):
    words = " ".join(f"w{i}" for i in range(3000))
    half = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(words, half), ("a b c", "A  B\nC "), ("", None), ("x", "")], "a string, b string")
    a, b = K.sketch(F.col("a")), K.sketch(F.col("b"))
    rows = df.select(a.alias("a"), b.alias("b"), K.sketch(F.col("a"), 1.0).alias("all"), K.likeness(a, b).alias("near"), K.merged(a, b).alias("both")).collect()
    assert len(rows[0]["all"]) == 2996 and 250 < len(rows[0]["a"]) < 500
    unsigned = [h % 2**64 for h in rows[0]["all"]]
    assert sorted(h for h in unsigned if h >> 1 < 2**60) == sorted(h % 2**64 for h in rows[0]["a"])
    assert rows[0]["near"] == 1.0 and rows[0]["both"] == rows[0]["a"]
    assert (rows[1]["near"], rows[2]["near"], rows[3]["near"]) == (1.0, 1.0, 0.0)
    assert len(rows[1]["a"]) == 1 and rows[2]["a"] == []


def test_order_with_ties_nulls_and_repeats(spark):
    texts = [(i, f"text number {i} " * (i % 5 + 1), "clash") for i in range(50)]
    texts += [(7, "same id other text", "clash"), (None, "no id", "clash"), (9, "🙂é" * 5, "clash"), (11, None, "clash"), (12, "", "clash")] + [(20, "again and again", "clash")] * 4
    df = spark.createDataFrame(texts, "doc_id long, text string, k string").repartition(6)
    twin = {r["text"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    ordered = sorted(((d is not None, d or 0, twin[t or ""], t or "") for d, t, _ in texts), reverse=True)
    want = sorted((str(d) if known else "None", hashlib.sha256(edited_text(t, f[3]).encode()).hexdigest(), len(t)) for (known, d, _, t), f in zip(ordered, ordered[1:] + ordered[:1]))
    assert sorted((str(r["doc_id"]), r["edited_sha256"], r["n_chars"]) for r in K.fingerprints(df).collect()) == want
    assert K.fingerprints(df.limit(0)).count() == 0
    one = K.fingerprints(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one[0]["near_next"] == 1.0
