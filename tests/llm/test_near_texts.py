"""Near copies by five-word similarity against all pairs, in one shard and in many; odd rows; very long texts."""

import random

import numpy as np
import pytest

from blockreach.llm import near_texts as N
from tests_llm_brute import brute_near_texts, brute_shingles

SF = "/root/testdata/sf0.01"


def varied(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def families(seed=4):
    """Texts in groups around, above and below the similarity, chains included."""
    rng = random.Random(seed)
    texts = {}
    for family in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200, 500]))]
        for copy in range(rng.randint(1, 8)):
            texts[len(texts)] = varied(rng, words, rng.choice([0, 0, 1, 1, 2, 4]) * max(1, len(words) // 100))
            if copy % 3 == 2:
                words = texts[len(texts) - 1].split()
    hot = [f"h{i}" for i in range(300)]
    for i in range(120):
        texts[1000 + i] = varied(rng, hot, 2 + i % 3)
    return texts


@pytest.mark.parametrize("shard_texts", [512, 16])
def test_groups_equal_brute_force(spark, shard_texts):
    texts = families()
    want = brute_near_texts(texts)
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, key string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in N.near_texts(df, shard_texts=shard_texts).collect()}
    assert got == want
    assert len(set(want.values())) < len(want) - 100


def test_similarity_at_the_limit():
    a = np.arange(45, dtype=np.uint64)
    assert N.alike(a[:40], np.r_[a[:40], a[40:45]]) and N.alike(a[:36], a) and not N.alike(a[:35], a)
    assert N.alike(a[:0], a[:0]) and not N.alike(a[:0], a)
    text = "One two  three\nfour five SIX six"
    assert len(N.shingle_set(text)) == len(brute_shingles(text)) == 3


def test_documents_lose_no_near_copy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_near_texts(texts)
    kept = N.drop_near_texts(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, c in want.items() if d == c)


def test_odd_rows(spark):
    long = "the long text of many words " * 40_000
    rows = [(1, None), (2, ""), (3, " \n"), (None, "alone without id of its own"), (4, "Same Words here"), (5, "same  words here"), (5, "same  words here"), (6, long), (7, long + "end"), (8, "same words here too")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in N.near_texts(df).collect())
    # The repeated sentence has six shingles; the last word adds one.
    assert got == sorted([("1", "1"), ("2", "1"), ("3", "1"), ("None", "None"), ("4", "4"), ("5", "4"), ("5", "4"), ("6", "6"), ("7", "6"), ("8", "8")])
    kept = N.drop_near_texts(df)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "6", "8", "None"]
    assert N.drop_near_texts(df.limit(0)).count() == 0 and N.near_texts(df.limit(0)).count() == 0
