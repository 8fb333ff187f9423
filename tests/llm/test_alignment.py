"""Token alignment against both libraries and a pair-by-pair version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from blockreach.llm import alignment as al
from blockreach.llm.queries import op11

PATHS = P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a ", " a", "\n", "a\n", "a\r\nb \r\n  c\t", "x();\r\n y", "Hello, it's World 123  \n\n  next", "<|endoftext|> <s> </s> <unk> <0x41>", "under▁score ▁",
    "Σας İstanbul ﬁ café x\xa0y\x1cz\x85w​ q", "日本語　テキスト🙂🙂 𝟙２ ½", "nul\x00l", "a" * 700 + " " * 300 + "!?" * 200, "same text", "same text", "é" * 300,
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["the", "ing", " ", " ", "  ", "\n", "\r", "é", "日", "🙂", "x", ".", "'s", "12", "Q"]) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def brute(libraries, texts):
    a, b = libraries
    _, symbols = None, {s: i for i, s in enumerate(al.byte_symbols())}
    docs = []
    for text in texts:
        if not text:
            docs.append(([], [], [], []))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        links = [(x, y) for x, (s, e) in enumerate(zip([0, *ends_a], ends_a)) for y, (u, v) in enumerate(zip([0, *ends_b], ends_b)) if s < v and u < e]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([i for i, e in zip(ids_a, ends_a) if low < e <= high], [i for i, e in zip(ids_b, ends_b) if low < e <= high]) for low, high in zip([0, *cuts], cuts)]
        docs.append((ids_a, ids_b, [(ids_a[x], ids_b[y]) for x, y in links], groups))
    counts = Counter(p for *_, links, _ in docs for p in set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for ids_a, ids_b, links, groups in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if shown else "", shown))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def test_equals_all_pairs(spark, libraries):
    texts = ODD + random_texts(120, 3)
    df = spark.createDataFrame([(i if i != 5 else None, t, 7, "clash") for i, t in enumerate(texts)], "doc_id long, text string, chunk int, a string").repartition(5)
    expected = brute(libraries, texts)
    assert expected[12][0] == 0 and expected[8][0] > 0
    for size in (300, al.CHUNK_CHARS):
        rows = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in al.align_documents(df, *PATHS, chunk_chars=size).collect()}
        assert len(rows) == len(texts)
        for i, want in enumerate(expected):
            assert rows[i if i != 5 else None] == want, texts[i]


def test_repeated_ids_and_empty_tables(spark, libraries):
    df = spark.createDataFrame([(1, "same text")] * 3 + [(1, None), (None, "")], "doc_id long, text string")
    rows = al.align_documents(df, *PATHS, with_groups=False).collect()
    assert sorted((r.n_a, r.count_sum) for r in rows) == sorted([(0, 0)] * 2 + [(2, 6)] * 3)
    assert al.align_documents(df.limit(0), *PATHS).count() == al.align_documents(df.where("text is null"), *PATHS).count() - 1 == 0


@pytest.mark.parametrize("steps", [1, 3, 64, 1000])
def test_merge_pieces_are_independent(steps):
    rng = np.random.default_rng(steps)
    for _ in range(60):
        total = int(rng.integers(1, 80))
        a, b = (np.unique(np.r_[rng.integers(1, total + 1, rng.integers(0, 40)), total]) for _ in "ab")
        merged = al.merge_pieces(a, b, steps)
        starts_a, starts_b = np.r_[0, a[:-1]], np.r_[0, b[:-1]]
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if starts_a[x] < b[y] and starts_b[y] < a[x]]
        assert sorted(want) == sorted(zip(merged.pair_a.tolist(), merged.pair_b.tolist()))
        cuts = np.intersect1d(a, b)
        assert merged.group_a.tolist() == np.searchsorted(cuts, a).tolist() and merged.group_b.tolist() == np.searchsorted(cuts, b).tolist()
    assert len(al.merge_pieces(a[:0], b[:0]).pair_a) == 0


def test_query_over_documents(spark, libraries):
    folder = "/root/testdata/sf0.001"
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    short = {i for i, t in documents.items() if len(t or "") < 1500}
    rows = {r.doc_id: r for r in op11(spark, folder).collect()}
    assert rows.keys() == documents.keys()
    for i, want in zip(sorted(short), brute(libraries, [documents[i] for i in sorted(short)])):
        assert (rows[i].n_a, rows[i].n_b, rows[i].n_groups, rows[i].n_links, rows[i].groups_sha256) == (*want[:4], want[6])
