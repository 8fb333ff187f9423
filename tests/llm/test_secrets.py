"""Secrets against a brute-force search with Python's patterns."""

import random

from blockreach.llm import secrets as S
from blockreach.llm.queries import op9
from tests_llm_brute import brute_redacted, brute_spans

def columns(row):
    return tuple(row[c] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans"))


def odd_texts():
    rng = random.Random(8)
    bits = ["token", "PASSWD", "api_key", "apikey", "secret", " = ", ":", "=", '"', "'", "abcdef", "a1b2c3", "x" * 5, "AKIA", "AKIA" + "Q7" * 8, "ASIA" + "Z9" * 8, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "0123456789abcdef" * 2, "https://host.example/x", "10.0.0.1", " é🙂 ", "\n", " ", " words between " * 12, "ſecret=abcdefgh", "toKen=abcdefgh"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "🙂token=abcdefg", "token=token : abcdef", "token: " + "z" * 200_000, ("token=abcdef1 " * 3000)]


def test_spans_equal_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "token=abcdef", 1)] * 2, "doc_id long, text string, base int")
    rows = S.find_secrets(df).collect()
    assert len(rows) == len(texts) + 2
    got = {r["doc_id"]: columns(r) for r in rows}
    linked = 0
    for i, t in enumerate(texts):
        want, spans = brute_spans(t)
        assert got[i] == want, (i, t)
        linked += sum(s[1] in S.WEAK for s in spans)
    assert linked > 50 and got[None][0] == 1
    assert S.find_secrets(df.limit(0)).count() == 0


def test_redaction_equals_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, len(t or ""), "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, key string")
    out = S.redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        text = texts[r["doc_id"]]
        want = text if text is None else brute_redacted(text, brute_spans(text)[1])
        assert r["text"] == want and r["n_chars"] == len(want or "") and r["key"] == "clash"


def test_query_over_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op9(spark, folder).collect()
    assert {r["doc_id"]: columns(r) for r in rows} == {d: brute_spans(t)[0] for d, t in texts.items()}
