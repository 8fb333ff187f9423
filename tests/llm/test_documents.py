"""Language, near-duplicates and decontamination against brute force and held-out labels."""

import random
import zlib

import numpy as np

from blockreach.llm import decontaminate, language, simhash
from blockreach.llm.queries import op4, op5, op6
from tests_llm_brute import brute_components, brute_contamination, brute_fingerprint

SF = "/root/testdata/sf0.001"


def documents(spark, folder=SF):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


# language

def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op4(spark, folder).collect()
    assert len(rows) == len(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_language_of_odd_texts(spark):
    model = language.fit([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 5)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the cat " * 5000), (None, "le chat"), (5, "ЖЖЖ"), (5, "ЖЖЖ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    found = [(r["doc_id"], r["lang_pred"]) for r in language.identify(df, model).collect()]
    assert found[:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "fr")]
    assert len(found) == 7 and found[5] == found[6]
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}
    kept = language.keep_identified(df, model, reject_below=0.0)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {4, None, 5}
    assert language.identify(df.limit(0), model).count() == 0
    assert language.learn(df.withColumn("lang", language.F.lit(None).cast("string")), language.F.lit(True)) is None


def test_kernel_counts_common_ngrams():
    symbols = language.Symbols("abc")

    def grams(text):
        padded = f" {text} "
        return {padded[i:i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)}

    for a, b in (("abc", "bca"), ("a b", "ab c"), ("cab", "cab")):
        ga, gb = np.unique(symbols.grams(a)), np.unique(symbols.grams(b))
        assert len(np.intersect1d(ga, gb)) == len(grams(a) & grams(b))
        assert len(ga) == len(grams(a))


# near-duplicates

def test_near_duplicates_equal_brute_force(spark):
    prints = {d: brute_fingerprint(t) for d, t in documents(spark)}
    components = brute_components(prints)
    rows = op5(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{p:016x}", components[d]) for d, p in prints.items()}


def test_links_of_dense_and_chained_fingerprints(spark):
    rng = random.Random(3)
    prints = {}
    for group in range(12):
        at = rng.getrandbits(64)
        for _ in range(40):
            for _ in range(rng.randint(0, 3)):
                at ^= 1 << rng.randrange(64)
            prints[len(prints)] = at
    for _ in range(300):
        prints[len(prints)] = rng.getrandbits(16) << 48
    components = brute_components(prints)
    signed = [(d, p - (1 << 64) if p >> 63 else p) for d, p in prints.items()]
    table = simhash.written(spark.createDataFrame(signed, "doc_id long, fp long"), "test")
    found = {r["fp"]: r["component_id"] for r in simhash.groups(table).collect()}
    assert {d: found[p] for d, p in signed} == components
    # Small shards: hot buckets are split into shard pairs.
    links = simhash.near_links(table.select("fp").distinct(), shard_size=8).collect()
    parent = {p: p for _, p in signed}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for link in links:
        assert ((link["a"] ^ link["b"]) & (1 << 64) - 1)
        parent[root(link["a"])] = root(link["b"])
    groups = {}
    for d, p in signed:
        groups.setdefault(root(p), set()).add(components[d])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(components.values()))


def test_tree_search_finds_all_within_radius():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 400, np.uint64) & np.uint64(0xFFF)
    queries = rng.integers(0, 2**63, 100, np.uint64) & np.uint64(0xFFF)
    found = {(n, int(q)) for n, near in simhash.BKTree(values).search(queries, 2) for q in near}
    # Equal values share the edge 0 and are reached along it.
    want = {(n, q) for n in range(400) for q in range(100) if int(values[n] ^ queries[q]).bit_count() <= 2}
    assert found == want
    tree = simhash.BKTree(values)
    assert {(n, q) for q in range(100) for n in tree.near(int(queries[q]), 2)} == want


def test_more_blocks_for_more_fingerprints():
    for count in (10, 10**8, 10**12):
        choices = simhash.block_choices(count)
        blocks = sorted({r for c in choices for r in c})
        assert sum(w for _, w in blocks) == 64
        for lost in blocks[:3], blocks[-3:]:
            assert any(not set(lost) & set(c) for c in choices)


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "a"), (3, text, "b"), (9, text + " more", "c"), (None, "alone here", "d"), (None, "alone here", "e"), (8, None, "f"), (7, "", "g"), (1, "else entirely different", "h"), (1, "else entirely different", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.drop_near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, "alone here"), (1, "else entirely different"), (3, text), (7, "")]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
    assert sorted(r["component_id"] for r in simhash.near_duplicates(df).collect() if r["component_id"] is not None) == [1, 1, 3, 3, 3, 7, 7]


# decontamination

def columns(rows):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}


def test_contamination_equals_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")[:400]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    got = columns(op6(spark, "/root/testdata/sf0.01").collect())
    want = brute_contamination([t for _, t in docs], items)
    assert [got[d] for d, _ in docs] == want
    assert any(w[4] for w in want)


def test_contamination_of_short_items_in_blocks(spark):
    rng = random.Random(4)
    texts = [None, "", "a", " ".join(rng.choice("ab") for _ in range(4000))] + [" ".join(rng.choice("abcé") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    items = [(1, None), (2, ""), (3, "A"), (3, "A"), (4, "b!a b"), (None, "c é c")] + [(i, " ".join(rng.choice("abcé") for _ in range(rng.randint(1, 15)))) for i in range(10, 40)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(texts, [("" if i is None else i, t) for i, t in items])
    assert columns(decontaminate.contamination(df, bench).collect()) == dict(enumerate(want))
    assert columns(decontaminate.contamination(df, bench, block_bytes=100).collect()) == dict(enumerate(want))
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in enumerate(want) if not w[4]}
    assert not any(r["contaminated"] for r in decontaminate.contamination(df, bench.limit(0)).collect())
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
