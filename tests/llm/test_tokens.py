"""Byte-pair encoding and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from blockreach.llm import bpe, token_files
from blockreach.llm.queries import END_OF_DOCUMENT, WORD_BPE_SIZE, op1, op3, vocabulary_path

ODD = [
    None, "", " \n\t ", "Hello, it's World 123", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "Σας ΟΔΟΣ İstanbul ﬁ café x\xa0y\x1cz\x85w",
    "don't'S \"'s--'re 𝟙２ ½", "a" * 3000 + "b" * 4000, "!?" * 900, "abcabc" * 1500, "same", "same",
]


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeé'’s .,!?日本\t\n1２🙂<|>") for _ in range(rng.randint(0, 300))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_merge_rounds_equal_the_library(library):
    vocabulary = bpe.load_vocabulary(vocabulary_path())
    texts = ODD + random_texts(200)
    cache = bpe.PieceCache(lambda pieces: bpe.encode_pieces(vocabulary, pieces), limit=50)
    for text, (ids, decoded) in zip(texts, bpe.encode_texts(vocabulary, cache, texts)):
        assert (np.frombuffer(ids, "<u4").tolist(), decoded.decode()) == expected(library, text)


def test_encode_documents_keeps_rows_and_ignores_other_columns(spark, library):
    df = spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    rows = bpe.encode_documents(df, vocabulary_path()).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(ODD):
        ids, decoded = expected(library, text)
        row = by_id[i if i != 3 else None]
        assert (row["n_tokens"], row["ids"], row["decoded"]) == (len(ids), ids, decoded)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), vocabulary_path()).count() == 0


def check_token_files(rows, documents, library):
    start = 0
    for row, (doc_id, text) in zip(sorted(rows, key=lambda r: r["start"]), documents, strict=True):
        ids = expected(library, text)[0] + [END_OF_DOCUMENT]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_queries_over_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    documents = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    check_token_files(op1(spark, folder).collect(), documents, library)
    got = {r["doc_id"]: r for r in op3(spark, folder).collect()}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        ids, decoded = expected(library, text)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_token_files_with_odd_rows(spark, library):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id")] + [(4, "same id")] * 60 + [(7, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    files = token_files.write_token_files(df, token_files.library_encoder(vocabulary_path()), WORD_BPE_SIZE, END_OF_DOCUMENT)
    rows = files.read(files.lookup(files.documents), "ids_crc32 bigint", token_files.crc32_of_ids).collect()
    want = sorted((str(d), zlib.crc32(np.array(expected(library, t)[0] + [END_OF_DOCUMENT], "<u4").tobytes())) for d, t in texts)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()]
    unknown = spark.createDataFrame([(4, 1000), (99, 0)], "doc_id long, copy long")
    assert files.lookup(unknown).count() == 0
    empty = token_files.write_token_files(df.limit(0), token_files.library_encoder(vocabulary_path()), WORD_BPE_SIZE)
    assert empty.read(empty.lookup(empty.documents), "ids_crc32 bigint", token_files.crc32_of_ids).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, np.uint64))
    levels, slots = token_files.build_hash(keys)
    assert sorted(slots) == list(range(len(keys)))
    assert (token_files.find_slots(levels, keys) == slots).all()
    strangers = keys + np.uint64(1)
    found = token_files.find_slots(levels, strangers)
    prints = token_files.fingerprints(keys)[np.argsort(slots)]
    assert (prints[found[found >= 0]] == token_files.fingerprints(strangers)[found >= 0]).sum() == 0


def test_encoded_slices_leave_one_by_one(spark, library, monkeypatch):
    """A task must not hold the results of a whole batch; ``decoded`` alone can be left out."""
    monkeypatch.setattr(bpe, "ENCODED_BYTES", 64)
    texts = random_texts(50)
    captured = {}
    monkeypatch.setattr(bpe, "map_batches", lambda df, schema, make: captured.update(schema=schema, make=make))
    bpe.encode_documents(spark.createDataFrame([(0, "")], "doc_id long, text string"), vocabulary_path(), with_decoded=False)
    assert "decoded string" not in captured["schema"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    parts = list(captured["make"]()(batch))
    assert len(parts) > 5 and all("decoded" not in p.schema.names for p in parts)
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(r["doc_id"], r["ids"]) for r in rows] == [(i, expected(library, t)[0]) for i, t in enumerate(texts)]
