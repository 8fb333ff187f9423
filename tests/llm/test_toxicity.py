"""Toxicity: held-out labels, folding, the automaton against brute force, and odd rows."""

import random
import zlib

import numpy as np

from blockreach.llm import toxicity as X
from blockreach.llm.queries import op2


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op2(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hits = sum(p and y for p, y in held)
    assert hits / sum(p for p, _ in held) > 0.9
    assert hits / sum(y for _, y in held) > 0.85


def test_folding():
    assert X.fold("Іdіоt $tupid l0ser pathétique !!! $$$ a!b") == ["idiot", "stupid", "loser", "pathetique", "aib"]
    assert X.fold(None) == X.fold("") == []


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    lexicon = {"ab ": 2.0, "ab": 0.5, "abc": 3.0, "ca ": 1.0, "bb": 4.0}
    exceptions = ("ab ca", "bb bb")
    matcher = X.Matcher(lexicon, exceptions)
    for _ in range(300):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))]
        weights = [max([w for t, w in lexicon.items() if (word + " ").startswith(t)], default=0.0) for word in words]
        for at in range(len(words) - 1):
            if f"{words[at]} {words[at + 1]}" in exceptions:
                weights[at] = weights[at + 1] = 0.0
        got = matcher.features(" ".join(words))
        assert np.isclose(np.expm1(got[0]), sum(weights)) and got[3] == max(weights, default=0.0)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "you idiot " * 40_000, 1), (None, "you idiot", 1), (4, "fine", None), (4, "fine", None)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 0)], "doc_id long, toxic int")
    sample = X.sample_labelled(df, labels)
    assert sorted((r["toxic"], len(r["text"])) for r in sample.collect()) == [(False, 0), (False, 0), (True, 400_000)]
    model = X.ToxicityModel({"idiot ": 3.0}, (), [1.0, 0.0, 0.0, 1.0, -2.0])
    clash = df.withColumn("score", X.F.lit("clash"))
    scores = [(r["doc_id"], r["predicted"]) for r in X.score_documents(clash, model).collect()]
    assert scores == [(1, 0), (2, 0), (3, 1), (None, 1), (4, 0), (4, 0)]
    empty = X.learn(sample.limit(0))
    assert {r["score"] for r in X.score_documents(df, empty).collect()} == {X.score_of(np.array([[0, 0, 0, 0, 1]]), empty.coefficients)[0]}
    assert X.score_documents(df.limit(0), model).count() == 0


def test_repeated_id_stays_within_the_sample(spark):
    df = spark.range(3000).select(X.F.lit(7).cast("long").alias("doc_id"), X.F.concat(X.F.lit("text "), X.F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    assert X.sample_labelled(df, labels, fit_rows=100).count() == 100
    assert X.sample_labelled(df.withColumn("text", X.F.lit("same")), labels, fit_rows=100).count() == 1


def test_ordinary_pairs_become_exceptions(spark):
    rows = [(f"you are a weasel number {i}", True) for i in range(40)] + [(f"the weasel family of animals {i}", False) for i in range(12)] + [(f"a quiet day {i}", False) for i in range(400)]
    model = X.learn(spark.createDataFrame(rows, "text string, toxic boolean").repartition(3), exceptions=("given phrase",))
    assert "weasel " in model.lexicon and {"given phrase", "the weasel", "weasel family"} <= set(model.exceptions) and "a weasel" not in model.exceptions
    matcher = X.Matcher(model.lexicon, model.exceptions)
    assert matcher.features("look at the weasel")[0] == 0 < matcher.features("you weasel")[0]
