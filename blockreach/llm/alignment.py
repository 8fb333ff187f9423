"""Alignment of two tokenizers' tokens over the bytes of a text, by merge paths.

Tokenizer A is a byte-level BPE read from JSON and sees a blank and the text; tokenizer B is a piece model
that adds this blank itself. The ends of A's and B's tokens, as byte places, are two sorted lists. Their
merge is cut into pieces of ``STEPS`` steps each: a binary search along every diagonal finds where the
merge crosses it, so all pieces start and end at known places of both lists and are merged independently,
all at once, one step per round. Every step that takes an end emits the pair of tokens then open, which
are the pairs whose byte ranges overlap; where both lists end at one place a group ends. A piece counts
its group ends; sums over the pieces before it number the groups, so groups that cross pieces are whole.

Texts that are null or empty, or whose tokens' bytes differ from blank and text in A or B, have no tokens.
A pair of ids counts in as many documents (rows, repeated ones too) as hold it linked. Tasks work on
chunks of whole documents and emit each chunk's distinct pairs once; counts meet by pair and return to
the chunks that hold it. Null ids and repeated ids give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from blockreach.llm.bpe import Vocabulary, byte_symbols, gather
from blockreach.llm.byte_bpe import KNOWN_CHARS, KNOWN_SEGMENTS, OTHER_SPACES, piece_encoder, pre_token_pattern
from blockreach.llm.common import text_slices, written

STEPS = 64
CHUNK_CHARS = 2_000_000
BLANK = "▁"
# A segment begins with a blank that follows another character than white space: neither tokenizer has a
# token across that place.
SEGMENTS = f"[ {OTHER_SPACES}]*[^ {OTHER_SPACES}]+(?:[{OTHER_SPACES}][ {OTHER_SPACES}]*[^ {OTHER_SPACES}]+)*(?:[{OTHER_SPACES}][ {OTHER_SPACES}]*)?|[ {OTHER_SPACES}]+"


def load_byte_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE without special tokens from JSON."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids: dict[str, int] = model["vocab"]
    value = {s: b for b, s in enumerate(byte_symbols())}
    tokens = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        if all(c in value for c in token):
            tokens[i] = bytes(value[c] for c in token)
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    single = np.array([ids[s] for s in byte_symbols()], np.int64)
    return Vocabulary(tokens, single, single, keys[order], order.astype(np.int32), np.array([ids[a + b] for a, b in merges], np.int64), regex.compile(""), {}, None)


def byte_level_encoder(path: str, pattern: str):
    """Token bytes of A, and a function from segments to ids and their numbers."""
    vocabulary = load_byte_vocabulary(path)
    return vocabulary.token_bytes, piece_encoder(vocabulary, pre_token_pattern(pattern))


def piece_model_encoder(path: str):
    """Token bytes of B, and a function from segments to ids and their numbers.

    No piece joins a blank to a character before it, so segments, which all begin with a blank, encode on
    their own; the model adds this blank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens, joins = [], re.compile(f"[^{BLANK}]{BLANK}")
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if joins.search(piece):
            raise ValueError("A piece joins a blank to the character before it.")
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(BLANK, " ").encode())
    alone = [model.piece_to_id(BLANK)]

    def encode(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = model.encode([s[1:] for s in segments], num_threads=1)
        runs = [run if len(s) > 1 else alone for s, run in zip(segments, runs)]
        return np.fromiter((t for r in runs for t in r), np.int64), np.fromiter(map(len, runs), np.int64, len(runs))

    return tokens, encode


@dataclass
class Tokens:
    """Ids and byte ends of the tokens of many documents, one after the other, and each document's number of tokens."""

    ids: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray


class Side:
    """One tokenizer: the ids of all known segments, one after the other, and which segments come back from them."""

    def __init__(self, tokens: list[bytes], encode) -> None:
        self.tokens, self.encode, self.lengths = tokens, encode, np.array([len(t) for t in tokens], np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.starts, self.fits = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool)

    def learn(self, segments: list[str]) -> None:
        ids, sizes = self.encode(segments)
        known, ends = list(map(self.tokens.__getitem__, ids.tolist())), np.cumsum(np.r_[0, sizes])
        bounds = ends.tolist()
        again = [b"".join(known[i:j]) == s.encode("utf-8", "replace") for s, i, j in zip(segments, bounds, bounds[1:])]
        self.fits, self.starts = np.r_[self.fits, again].astype(bool), np.r_[self.starts, self.starts[-1] + ends[1:]]
        self.ids = np.r_[self.ids, ids]

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.ids, self.starts[numbers], np.diff(self.starts)[numbers])


class Pair:
    """Both tokenizers, with the segments known to the task."""

    def __init__(self, a, b) -> None:
        self.sides, self.segments = (Side(*a), Side(*b)), re.compile(SEGMENTS)
        self.number: dict[str, int] = {}
        self.chars = 0

    def numbers(self, segments: list[str]) -> np.ndarray:
        """Number of each segment. Forgets old segments first where they are too many."""
        known = self.number
        if len(known) > KNOWN_SEGMENTS or self.chars > KNOWN_CHARS:
            known.clear()
            self.chars = 0
            for side in self.sides:
                side.clear()
        new = [s for s in dict.fromkeys(segments) if s not in known]
        if new:
            self.chars += sum(map(len, new))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            for side in self.sides:
                side.learn(new)
        return np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))

    def tokens(self, texts: list[str | None]) -> tuple[Tokens, Tokens]:
        """Tokens of all texts over a common line of bytes; none for a text that does not come back from both."""
        found = [self.segments.findall(" " + t) if t else [] for t in texts]
        bounds = np.cumsum([0, *map(len, found)])
        numbers = self.numbers([s for own in found for s in own])
        bad = np.r_[0, np.cumsum(~(self.sides[0].fits & self.sides[1].fits)[numbers])]
        good = bad[bounds[1:]] == bad[bounds[:-1]]
        numbers, sizes = numbers[np.repeat(good, np.diff(bounds))], np.where(good, np.diff(bounds), 0)
        out = []
        for side in self.sides:
            ids, ends = side.ids_of(numbers)
            out.append(Tokens(ids, np.cumsum(side.lengths[ids]), np.diff(np.r_[0, ends][np.cumsum(np.r_[0, sizes])])))
        return out[0], out[1]


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` lie before each diagonal of the merge of two sorted lists (equal values: ``a`` first)."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # a[middle] is within the first ``diagonal`` values if it does not exceed b[diagonal - 1 - middle].
        before = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonals - 1 - middle, 0, len(b) - 1)])
        low = np.where(before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low


@dataclass
class Merge:
    """Overlapping tokens in order (places in ``a`` and ``b``), and the group of every token."""

    pair_a: np.ndarray
    pair_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def merge_pieces(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> Merge:
    """Merge two ascending lists of ends whose last ends are equal, in independent pieces of ``steps`` steps."""
    starts = np.arange(0, len(a) + len(b), steps)
    i = crossings(a, b, starts)
    j = starts - i
    never = np.iinfo(np.int64).max
    next_a, next_b, taken_a = np.r_[a, never], np.r_[b, never], np.r_[-1, a]
    sizes_a, sizes_b = np.diff(np.r_[i, len(a)]), np.diff(np.r_[j, len(b)])
    pair_a, pair_b = (np.full((len(starts), steps), -1, np.int32) for _ in "ab")
    group_a, group_b, closed = np.zeros(len(a), np.int32), np.zeros(len(b), np.int32), np.zeros(len(starts), np.int32)
    for step in range(steps):
        end_a, end_b = next_a[i], next_b[j]
        takes_b = end_b < end_a
        takes_a = ~takes_b & (end_a < never)
        # An end of b that equals the end of a just taken closes a group; it opens no pair.
        closes = takes_b & (taken_a[i] == end_b)
        emits = np.flatnonzero((takes_a | takes_b) & ~closes)
        pair_a[emits, step], pair_b[emits, step] = i[emits], j[emits]
        group_a[i[takes_a]], group_b[j[takes_b]] = closed[takes_a], closed[takes_b]
        closed += closes
        i, j = i + takes_a, j + takes_b
    # Groups closed in the pieces before; a group that crosses pieces gets one number.
    earlier = np.r_[0, np.cumsum(closed)[:-1]] if len(closed) else closed
    held = pair_a >= 0
    return Merge(pair_a[held], pair_b[held], group_a + np.repeat(earlier, sizes_a), group_b + np.repeat(earlier, sizes_b))


def group_texts(a: Tokens, b: Tokens, merged: Merge, names: list[list[bytes]], n_ids: int) -> list[bytes]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens. ``names`` are ids with each of the marks ``, | , ;``."""
    n_groups = int(merged.group_a[-1]) + 1 if len(merged.group_a) else 0
    count_a, count_b = (np.bincount(g, minlength=n_groups) for g in (merged.group_a, merged.group_b))
    before_b, after_a = np.cumsum(count_b) - count_b, np.cumsum(count_a)
    key = np.empty(len(a.ids) + len(b.ids), np.int64)
    last_a = np.r_[merged.group_a[1:] != merged.group_a[:-1], True][:len(a.ids)]
    last_b = np.r_[merged.group_b[1:] != merged.group_b[:-1], True][:len(b.ids)]
    key[np.arange(len(a.ids)) + before_b[merged.group_a]] = a.ids + n_ids * last_a
    key[np.arange(len(b.ids)) + after_a[merged.group_b]] = b.ids + n_ids * (2 * last_b)
    table = [name for mark in names for name in mark]
    words, bounds = list(map(table.__getitem__, key.tolist())), np.cumsum(np.r_[0, a.sizes + b.sizes]).tolist()
    return [b"".join(words[i:j])[:-1] for i, j in zip(bounds, bounds[1:])]


def align_documents(df: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row its id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; with ``with_groups`` also ``groups``."""
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(byte_level_encoder(byte_path, pattern), piece_model_encoder(piece_path))
        n_ids = max(len(side.tokens) for side in pair.sides)
        names = [[b"%d%s" % (i, mark) for i in range(n_ids)] for mark in (b",", b"|", b";")]
        chunk = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, stop in text_slices(texts, chunk_chars):
                chunk += 1
                a, b = pair.tokens(texts[first:stop])
                merged = merge_pieces(a.ends, b.ends)
                groups = group_texts(a, b, merged, names, n_ids)
                ends_a, n = np.cumsum(a.sizes), stop - first
                open_, close = merged.group_a[np.minimum(ends_a - a.sizes, max(0, len(a.ids) - 1))] if len(a.ids) else np.zeros(n, int), None
                close = merged.group_a[np.maximum(ends_a - 1, 0)] if len(a.ids) else open_
                doc = np.repeat(np.arange(n), a.sizes)[merged.pair_a]
                # Distinct pairs of the chunk, and each document's pairs with their numbers of links.
                codes, place = np.unique(a.ids[merged.pair_a] << 32 | b.ids[merged.pair_b], return_inverse=True)
                links, times = np.unique(doc * max(1, len(codes)) + place, return_counts=True)
                owner, place = np.divmod(links, max(1, len(codes)))
                cuts = np.searchsorted(owner, np.arange(n + 1))
                steps = np.diff(place, prepend=0)
                steps[cuts[:-1][np.diff(cuts) > 0]] = place[cuts[:-1][np.diff(cuts) > 0]]
                rows = {
                    "doc_id": batch.column(0).slice(first, n), "n_a": pa.array(a.sizes), "n_b": pa.array(b.sizes),
                    "n_groups": pa.array(np.where(a.sizes > 0, close - open_ + 1, 0)), "n_links": pa.array(np.bincount(doc, minlength=n)),
                    "groups_sha256": pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
                    "places": pa.array([steps[i:j].astype(np.int32).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                    "times": pa.array([times[i:j].astype(np.int32).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                    "groups": pa.array([g.decode() for g in groups]) if with_groups else pa.nulls(n, pa.string()),
                }
                empty, none = pa.nulls(n, pa.list_(pa.int32())), pa.nulls(1)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), *rows.values(), empty, empty, empty], names=names_)
                if len(codes):
                    held = [pa.array([v.astype(np.int32)]) for v in (codes >> 32, codes & 0xFFFFFFFF, np.bincount(place, minlength=len(codes)))]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[none.cast(v.type) for v in rows.values()], *held], names=names_)

    names_ = ["chunk", "doc_id", *[c for c, _ in counts], "groups_sha256", "places", "times", "groups", "a", "b", "n"]
    lists = "a array<int>, b array<int>, n array<int>"
    aligned = written(docs.mapInArrow(align, f"chunk bigint, doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places binary, times binary, groups string, {lists}"), "aligned")
    pairs = aligned.where("a is not null").select(F.col("chunk").alias("holder"), F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p")).select("holder", "at", "p.*")
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    total = total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))
    known = pairs.drop("n").join(total, ["a", "b"]).select("holder", "at", "n", "best")

    def look_up(held: pa.Table, known: pa.Table) -> pa.Table:
        number, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, bool)
        at = known.column("at").to_numpy()
        number[at], best[at] = known.column("n").to_numpy(), known.column("best").to_numpy()
        n_best, count_sum = [], []
        for places, times in zip(held.column("places").to_pylist(), held.column("times").to_pylist()):
            place, time = np.cumsum(np.frombuffer(places, np.int32), dtype=np.int64), np.frombuffer(times, np.int32).astype(np.int64)
            n_best.append(int(time[best[place]].sum()))
            count_sum.append(int((time * number[place]).sum()))
        out = held.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        out = out.append_column("groups_sha256", held.column("groups_sha256"))
        return out.append_column("groups", held.column("groups")) if with_groups else out

    rows = aligned.where("places is not null").drop("a", "b", "n").groupBy("chunk").cogroup(known.groupBy("holder"))
    schema = f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string{', groups string' if with_groups else ''}"
    return rows.applyInArrow(look_up, schema)
