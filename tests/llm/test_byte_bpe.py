"""Byte-level BPE by overlapping chunks against the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from blockreach.llm import byte_bpe as bb
from blockreach.llm.queries import op13

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", " \n\t ", "Hello, it's World 123  \n\n  next", "<|endoftext|> we'll'll 'RE don''t", "Σας İstanbul ﬁ café x\xa0y\x1cz\x85w​ q", "日本語テキスト🙂🙂 𝟙２ ½",
    "a" * 3000 + "b" * 4000, "!?" * 900, " " * 700 + "x" + "\n" * 900, "word  " * 500, "same", "same", "é" * 2000, "it's'" * 400,
]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeé'’s .,!?日本\t\n１2🙂  'll") for _ in range(rng.randint(0, 400))) for _ in range(n)]


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest(), ids, library.decode_bytes(ids)


def test_segments_encode_like_the_library(library):
    encoder = bb.Encoder(bb.load_ranks(RANKS), public_tokenizers.PATTERN)
    encoder.runs.limit = 40
    texts = ODD + random_texts(300)
    for _ in range(2):
        for start in range(0, len(texts), 25):
            for text, ids in zip(texts[start:start + 25], encoder.encode(texts[start:start + 25])):
                assert ids.tolist() == library.encode_ordinary(text or "")


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (50, 50), (bb.CHUNK_CHARS, bb.OVERLAP_CHARS)])
def test_stitched_chunks_equal_the_library(spark, library, chunk, overlap):
    texts = ODD + random_texts(60, 9)
    df = spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(5)
    rows = bb.encode_documents(df, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap).collect()
    assert len(rows) == len(texts)
    by_id = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(texts):
        row = by_id[i if i != 3 else None]
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"], row["ids"], bytes(row["decoded"])) == expected(library, text)


def test_repeated_ids_and_empty_tables(spark, library):
    df = spark.createDataFrame([(1, "long text " * 40)] * 3 + [(None, "long text " * 40), (None, None)], "doc_id long, text string")
    rows = bb.encode_documents(df, RANKS, public_tokenizers.PATTERN, with_text=False, chunk_chars=64, overlap_chars=16).collect()
    n = len(library.encode_ordinary("long text " * 40))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == [("1", n)] * 3 + [("None", 0), ("None", n)]
    assert bb.encode_documents(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_boundaries_that_later_text_may_move_do_not_count():
    pattern = bb.pre_token_pattern(public_tokenizers.PATTERN)
    # The last match ends with the chunk and the one before within the look-ahead.
    assert bb.shared_boundaries(pattern, 100, "ab cd efgh ij'l", 8, 4, False) == ([102], [110])
    assert bb.shared_boundaries(pattern, 100, "ab cd efgh ij'l", 8, 4, True) == ([102], [110, 113, 114, 115])


def test_query_over_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op13(spark, folder).collect()
    assert len(rows) == len(documents) and any(len(t or "") > bb.CHUNK_CHARS for t in documents.values())
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(library, documents[r["doc_id"]])[:3]
