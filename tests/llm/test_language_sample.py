"""The fitting sample of the language model when one text has thousands of copies."""

import random

import numpy as np
from pyspark.sql import functions as F

from blockreach.llm import language


def sampled(spark, rows, total):
    return [(r["text"], r["lang"]) for r in language.sample_labelled(spark.createDataFrame(rows, "text string, lang string"), total).collect()]


def test_copies_of_a_drawn_text_take_one_place(spark):
    texts = spark.range(2000).select(F.concat(F.lit("a text of number "), F.col("id").cast("string")).alias("text"))
    drawn = texts.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30))).first()["text"]
    rows = [(drawn, "en")] * 5000 + [(f"{lang} text {i}", lang) for lang in ("en", "fr") for i in range(300)]
    sample = sampled(spark, rows, 200)
    assert sample.count((drawn, "en")) == 1 and len(sample) == len(set(sample))
    for lang in ("en", "fr"):
        assert 80 <= sum(own == lang for _, own in sample) <= 160


def test_many_languages_keep_a_row_each(spark):
    rows = [(f"text {i} of its own", f"l{i:04}") for i in range(1500)] + [(f"other text {i}", "l0000") for i in range(500)]
    sample = sampled(spark, rows, 100)
    assert len(sample) == 1500 and len({lang for _, lang in sample}) == 1500
    assert language.learn(spark.createDataFrame([], "text string, lang string"), F.lit(True)) is None


def test_long_texts_and_large_alphabets_are_learned(spark):
    rng = random.Random(3)
    scripts = {"large": [chr(0x4E00 + i) for i in range(300)], "small": list("abcdefghij"), "long": list("qrstuvwxyz")}
    rows = []
    for lang, letters in scripts.items():
        for _ in range(12):
            words = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(8_000 if lang == "long" else 60)]
            rows.append((" ".join(words), lang))
    assert min(len(t) for t, lang in rows if lang == "long") > 20_000
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.learn(df, F.col("doc_id") % 3 != 1)
    assert len(model.letters) == 320 and language.Symbols(model.letters).present is None
    assert all(r["lang_pred"] == rows[r["doc_id"]][1] for r in language.identify(df, model).collect())


def test_flags_and_sorted_codes_agree(monkeypatch):
    texts = ["the cat sat", "Ünï çödé 中文 zz", "x"]
    flags = language.Symbols(language.alphabet(texts[:2]))
    monkeypatch.setattr(language, "FLAGS", 0)
    codes = language.Symbols(language.alphabet(texts[:2]))
    dictionary = np.unique(np.concatenate([flags.grams(t) for t in texts[:2]]))
    for text in texts:
        (a, m), (b, n) = flags.presence(text, dictionary), codes.presence(text, dictionary)
        assert (a == b).all() and m == n == len(set(flags.grams(text).tolist()))
