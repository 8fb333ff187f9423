"""Ranked search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

from blockreach.llm import ranked_search as rs


def brute(documents, items, top):
    def terms(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    counted = [(i, Counter(terms(t))) for i, t in documents]
    n_docs = sum(bool(c) for _, c in counted)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return out


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def sample(n, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma9", "éa", "日本", "x", "THE", "the"] + [f"w{i}" for i in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + rng.choice([".", "!", "_", ""]) for _ in range(n)]


def test_equals_scoring_every_document(spark):
    texts = [None, "", "...", "alpha" * 3, "the " * 5000, *sample(400)]
    documents = [(i if i != 9 else None, t) for i, t in enumerate(texts + texts[20:60])]
    items = [("q1", "Alpha beta w3 w3"), ("q2", None), ("q3", "unknown"), ("q4", "the THE w1,w2-w5 日本 éa"), ("q4", "the THE w1,w2-w5 日本 éa"), (None, "w7 w8"), ("q5", "x " * 100 + "gamma9")]
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in documents], "doc_id long, text string, item_id string, score int").repartition(7)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id string, text string, doc_id int")
    for top, width, block in ((5, 8, 3), (50, 2048, 1000), (1000, 16, 2)):
        assert rows(rs.search(d, q, top=top, width=width, block_items=block)) == sorted(brute(documents, items, top), key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    q = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert rs.search(d.limit(0), q).count() == rs.search(d, q.limit(0)).count() == rs.search(d.where("doc_id = 2"), q).count() == 0
    assert rows(rs.search(d, q)) == brute([(1, "a b"), (2, None)], [("q", "a")], 50)


def test_few_documents_are_scored_exactly(spark, monkeypatch):
    """The bounds spare most documents, also among many copies."""
    scored = []
    original = rs.Best.add
    monkeypatch.setattr(rs.Best, "add", lambda self, found: (scored.extend(found), original(self, found))[1])
    texts = sample(3000, 7)
    queries = rs.Queries([[b"alpha", b"w3", b"w9"]], {b"alpha": 900, b"w3": 2000, b"w9": 2500}, 2048)
    best, known, places = [rs.Best(10)], rs.defaultdict(rs.count().__next__), rs.np.zeros(0, rs.np.int64)
    for start in range(0, len(texts), 500):
        found = [rs.terms_of(t) for t in texts[start:start + 500]]
        places = rs.search_batch(queries, best, known, places, list(range(start, start + 500)), found, 3000, 60_000)
    assert len(best[0].rows) == 10 and len(scored) < 600
