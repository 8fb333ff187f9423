"""Byte-level BPE by overlapping chunks: pre-tokenise in parallel, stitch where boundaries meet, encode the pieces.

A rank file (one token and rank per line) and a pre-token pattern are read, never trained. Texts of at
most ``CHUNK_CHARS`` characters are one chunk. Longer ones are cut into chunks that overlap by
``OVERLAP_CHARS``, and the chunks are spread over the cluster:

1. Each chunk is pre-tokenised from its own first character. The pattern looks only ahead, so as soon as
   two runs share a boundary they agree from there on. Boundaries near the chunk's end, where the text
   ahead is missing, do not count, nor do those after white space, whose matches depend on what follows.
2. The chunk and its successor are stitched at the first boundary that both have in the overlap. Without
   one (a run of characters longer than the overlap) the chunks become one piece.
3. The pieces between stitches are encoded independently; their ids, in order, are those of the text.

Decoding concatenates the tokens' raw bytes. Distinct white-space-led segments of a task are encoded once.

Null and empty texts have no ids and an empty decoding. Repeated rows and ids, also null ones, give a row
each; other columns are ignored; empty tables stay empty. A document's ids pass through one task in
order (its hash needs them so), a piece at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from blockreach.llm.bpe import Vocabulary, gather, merge_words
from blockreach.llm.common import map_batches, text_slices, written

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
LOOK_AHEAD = 4  # characters a pattern may need beyond a match to decide on it
KNOWN_SEGMENTS = 300_000
KNOWN_CHARS = 8_000_000
SPACE = r"\p{White_Space}"
# A segment: white space, then other characters, going on over white space that does not begin with a
# blank. No pre-token crosses from another character into white space, so segments encode on their own.
OTHER_SPACES = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENTS = f"[ {OTHER_SPACES}]*[^ {OTHER_SPACES}]+(?:[{OTHER_SPACES}][ {OTHER_SPACES}]*[^ {OTHER_SPACES}]+)*|[ {OTHER_SPACES}]+"


def pre_token_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with ``\s`` as Unicode white space, as the tokenizer libraries read it."""
    return regex.compile(pattern.replace(r"\s", SPACE))


def load_tokens(path: str) -> list[bytes]:
    """Bytes of the tokens of a rank file, by rank."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def load_ranks(path: str) -> Vocabulary:
    """A vocabulary from a rank file; every pair of tokens that makes up a token merges at that token's rank."""
    tokens = load_tokens(path)
    ranks = {token: i for i, token in enumerate(tokens) if token}
    pairs = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.append((left << 32 | right, rank))
    keys, merged = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    # A merge's rank is the id it makes, so ranks index themselves.
    return Vocabulary(tokens, single, single, np.ascontiguousarray(keys), merged.astype(np.int32), np.arange(len(tokens)), regex.compile(""), {}, None)


class Runs:
    """Runs of ids of the distinct segments seen by a task, in one flat array."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = KNOWN_SEGMENTS) -> None:
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars, self.ids, self.starts = 0, np.zeros(0, np.int64), np.zeros(1, np.int64)

    def numbers(self, segments: list[str]) -> np.ndarray:
        """Number of each segment; new ones are encoded. Forgets old segments first where they are too many."""
        if len(self.number) > self.limit or self.chars > KNOWN_CHARS:
            self.clear()
        known = self.number
        new = [s for s in dict.fromkeys(segments) if s not in known]
        if new:
            ids, sizes = self.encode(new)
            self.chars += sum(map(len, new))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments one after the other, and where each segment's ids end."""
        return gather(self.ids, self.starts[numbers], np.diff(self.starts)[numbers])


def piece_encoder(vocabulary: Vocabulary, pattern: regex.Pattern) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Function from segments to their ids (flat) and numbers of ids: every pre-token is merged on its own."""
    whole = {token: i for i, token in enumerate(vocabulary.token_bytes) if token}

    def encode(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [pattern.findall(s) for s in segments]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for own in found for w in own))}
        words = [w.encode("utf-8", "replace") for w in number]
        ids, starts = merge_words(vocabulary, words) if words else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        sizes = np.diff(starts)
        # A pre-token that is a token is that token, whatever its merges.
        short = {i: whole[w] for i, w in enumerate(words) if w in whole and sizes[i] > 1}
        if short:
            runs = [np.array([short[i]]) if i in short else ids[starts[i]:starts[i + 1]] for i in range(len(words))]
            ids, starts = np.concatenate(runs), np.r_[0, np.cumsum(list(map(len, runs)))]
            sizes = np.diff(starts)
        at = np.fromiter((number[w] for own in found for w in own), np.int64)
        flat, ends = gather(ids, starts[at], sizes[at])
        bounds = np.cumsum([0, *map(len, found)])
        return flat, np.diff(np.r_[0, ends][bounds])

    return encode


class Encoder:
    """Ids of texts, with the segments known to the task."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.runs = Runs(piece_encoder(vocabulary, pre_token_pattern(pattern)))
        self.segments = re.compile(SEGMENTS)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for a, b in text_slices(texts):
            found = [self.segments.findall(t or "") for t in texts[a:b]]
            flat, ends = self.runs.ids_of(self.runs.numbers([s for own in found for s in own]))
            bounds = np.r_[0, ends][np.cumsum([0, *map(len, found)])]
            out += [flat[i:j] for i, j in zip(bounds, bounds[1:])]
        return out


class Digest:
    """Count and hashes of a document's ids, fed piece by piece; with ``with_text`` also the ids and the decoding."""

    def __init__(self, tokens: list[bytes], names: list[bytes], with_text: bool) -> None:
        self.tokens, self.names, self.with_text = tokens, names, with_text
        self.count, self.of_ids, self.of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        self.ids: list[np.ndarray] = []
        self.decoded: list[bytes] = []

    def add(self, ids: np.ndarray) -> None:
        own = ids.tolist()
        if own:
            self.of_ids.update((b" " if self.count else b"") + b" ".join(map(self.names.__getitem__, own)))
            decoded = b"".join(map(self.tokens.__getitem__, own))
            self.of_bytes.update(decoded)
            self.count += len(own)
            if self.with_text:
                self.ids.append(ids)
                self.decoded.append(decoded)

    def row(self) -> dict:
        out = {"n_tokens": self.count, "ids_sha256": self.of_ids.hexdigest(), "decoded_sha256": self.of_bytes.hexdigest()}
        if self.with_text:
            out |= {"ids": np.concatenate([np.zeros(0, np.int64), *self.ids]).tolist(), "decoded": b"".join(self.decoded)}
        return out


def overlapping_chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str, bool]]:
    """``(number, start, characters, last)`` of the chunks of a text."""
    for number, start in enumerate(range(0, len(text), chunk)):
        last = start + chunk >= len(text)
        yield number, start, text[start:start + chunk + overlap], last
        if last:
            return


def shared_boundaries(pattern: regex.Pattern, start: int, text: str, chunk: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """Boundaries of one chunk in the overlap with its predecessor and in that with its successor, as places in the document."""
    stop = len(text) if last else len(text) - LOOK_AHEAD
    head, tail = [], []
    for match in pattern.finditer(text):
        at = match.end()
        if (at <= overlap or at >= chunk) and at <= stop and not text[at - 1].isspace():
            (head if at <= overlap else tail).append(start + at)
    return head, tail


def encode_documents(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """Per row its id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; with ``with_text`` also ``ids`` and the bytes ``decoded``."""
    if not LOOK_AHEAD < overlap_chars <= chunk_chars:
        raise ValueError("The overlap must be longer than the look-ahead and no longer than a chunk.")
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{', ids array<int>, decoded binary' if with_text else ''}"
    size = F.coalesce(F.length("text"), F.lit(0))

    def digests(tokens: list[bytes]) -> Callable[[], Digest]:
        names = [b"%d" % i for i in range(len(tokens))]
        return lambda: Digest(tokens, names, with_text)

    def result(rows: list[tuple[object, Digest]], ids: pa.Array) -> pa.RecordBatch:
        made = pa.Table.from_pylist([d.row() for _, d in rows], pa.schema([
            ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if with_text else [])]))
        return pa.RecordBatch.from_arrays([ids, *[c.combine_chunks() for c in made.columns]], names=["doc_id", *made.column_names])

    def whole():
        vocabulary = load_ranks(ranks_path)
        encoder, new = Encoder(vocabulary, pattern), digests(vocabulary.token_bytes)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for ids in encoder.encode(batch.column(1).to_pylist()):
                digest = new()
                digest.add(ids)
                rows.append((None, digest))
            return result(rows, batch.column(0))

        return step

    short = map_batches(docs.where(size <= chunk_chars), schema, whole)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The key tells rows apart; the written table pins it.
        row = (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                row += 1
                for number, start, own, last in overlapping_chunks(text, chunk_chars, overlap_chars):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), pa.array([row]), pa.array([number]), pa.array([start]), pa.array([last]), pa.array([own])],
                        names=["doc_id", "row", "chunk", "start", "last", "text"])

    chunks = written(docs.where(size > chunk_chars).mapInArrow(cut, f"doc_id {id_type}, row bigint, chunk bigint, start bigint, last boolean, text string"), "chunks")

    def pre_tokenise():
        compiled = pre_token_pattern(pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shared_boundaries(compiled, s, t, chunk_chars, overlap_chars, last) for s, last, t in zip(*(batch.column(c).to_pylist() for c in ("start", "last", "text")))]
            return pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([h for h, _ in found], pa.list_(pa.int64())), pa.array([t for _, t in found], pa.list_(pa.int64()))
            ], names=["row", "chunk", "head", "tail"])

        return step

    bounds = map_batches(chunks.select("row", "chunk", "start", "last", "text"), "row bigint, chunk bigint, head array<bigint>, tail array<bigint>", pre_tokenise)
    order = Window.partitionBy("row").orderBy("chunk")
    stitched = bounds.withColumn("cut", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    stitched = stitched.select("row", "chunk", "cut", F.when(F.col("chunk") == 0, 0).otherwise(F.lag("cut").over(order)).alias("begin"))
    stitched = stitched.withColumn("piece", F.count("begin").over(order))
    pieces = chunks.join(stitched, ["row", "chunk"]).select("doc_id", "row", "piece", "chunk", "start", "begin", "cut", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, open_, held, doc = Encoder(load_ranks(ranks_path), pattern), None, [], None

        def close() -> pa.RecordBatch:
            ids = encoder.encode(["".join(held)])[0]
            return pa.RecordBatch.from_arrays([doc, pa.array([open_[0]]), pa.array([open_[1]]), pa.array([ids.astype("<u4").tobytes()])], names=["doc_id", "row", "piece", "ids"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "piece", "start", "begin", "cut", "text")]
            for i, (row, piece, start, begin, cut_, text) in enumerate(zip(*columns)):
                if open_ != (row, piece):
                    if open_ is not None:
                        yield close()
                    open_, held, doc = (row, piece), [], batch.column("doc_id").slice(i, 1)
                # A chunk without a stitch behind it hands over its own characters up to the next chunk's.
                stop = len(text) if cut_ is None and len(text) <= chunk_chars else chunk_chars if cut_ is None else cut_ - start
                held.append(text[0 if begin is None else begin - start:stop])
        if open_ is not None:
            yield close()

    coded = pieces.repartition("row", "piece").sortWithinPartitions("row", "piece", "chunk").mapInArrow(encode, f"doc_id {id_type}, row bigint, piece bigint, ids binary")

    def hash_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, open_, digest, doc = digests(load_tokens(ranks_path)), None, None, None
        for batch in batches:
            for i, (row, ids) in enumerate(zip(batch.column("row").to_pylist(), batch.column("ids").to_pylist())):
                if row != open_:
                    if digest is not None:
                        yield result([(None, digest)], doc)
                    open_, digest, doc = row, new(), batch.column("doc_id").slice(i, 1)
                digest.add(np.frombuffer(ids, "<u4"))
        if digest is not None:
            yield result([(None, digest)], doc)

    long = coded.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(hash_in_order, schema)
    return short.unionByName(long)
