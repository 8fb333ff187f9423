"""Byte-pair encoding and decoding in batched numpy merge rounds.

A vocabulary file (JSON of a byte-level BPE with word ends) is read, never trained. Texts are cut at
ASCII white space; every distinct piece of a batch is normalised and split into words, and the merges of
all distinct words run together: their symbols lie in one flat array, each round merges the leftmost
lowest-rank pair of every word, and pair ranks are found by binary search over the sorted pair keys.
Results of short pieces are kept in a bounded cache per task.

Null and empty texts, and texts of white space only, have no ids and an empty decoding. Strings of added
tokens count as those tokens. Words of any length are exact: words above ``LONG_WORD`` symbols merge with
a heap, since one merge per round would be quadratic. Repeated rows are repeated in the result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from blockreach.llm.common import array_slices, map_batches

LONG_WORD = 256
CACHE_PIECES = 300_000
# Bytes of text that a task encodes at once.
ENCODED_BYTES = 1_000_000
CACHED_PIECE_BYTES = 64
NO_RANK = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    """Vocabulary with its merges as sorted pair keys ``left << 32 | right``."""

    token_bytes: list[bytes]
    byte_ids: np.ndarray  # id of each byte inside a word
    final_ids: np.ndarray  # id of each byte at the end of a word
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    merged_ids: np.ndarray  # by rank
    words: regex.Pattern
    added: dict[str, int]
    added_pattern: regex.Pattern | None


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file whose normaliser is NFC, white space and lower case."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ids: dict[str, int] = spec["model"]["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    suffix = spec["model"]["end_of_word_suffix"] or ""
    tokens = [""] * (1 + max([*ids.values(), *added.values()]))
    for token, i in [*ids.items(), *added.items()]:
        tokens[i] = token
    merges = spec["model"]["merges"]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
    symbols = byte_symbols()
    return Vocabulary(
        [t.encode() for t in tokens],
        np.array([ids[s] for s in symbols], np.int64),
        np.array([ids[s + suffix] for s in symbols], np.int64),
        keys[order],
        order.astype(np.int32),
        np.array([ids[a + b] for a, b in merges], np.int64),
        # The file's \s is Unicode White_Space; a line feed ends a piece here.
        regex.compile(split.replace(r"\s", r"\p{White_Space}") + "|\n"),
        added,
        regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None,
    )


def pair_rank(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge rank of each pair, ``NO_RANK`` for pairs that never merge."""
    keys = left << 32 | right
    at = np.searchsorted(vocabulary.pair_keys, keys)
    at[at == len(vocabulary.pair_keys)] = 0
    return np.where(vocabulary.pair_keys[at] == keys, vocabulary.pair_ranks[at], NO_RANK)


def merge_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all non-empty ``words`` in one array, and where each word starts (one more entry at the end)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    symbols = vocabulary.byte_ids[data]
    symbols[ends - 1] = vocabulary.final_ids[data[ends - 1]]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_owner = [], []
    long = lengths > LONG_WORD
    if long.any():
        for w in np.flatnonzero(long):
            merged = merge_long_word(vocabulary, symbols[ends[w] - lengths[w]:ends[w]])
            done_symbols.append(merged)
            done_owner.append(np.full(len(merged), w))
        symbols, owner = symbols[~long[owner]], owner[~long[owner]]
    rank = np.full(len(symbols), NO_RANK)
    if len(symbols) > 1:
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = pair_rank(vocabulary, symbols[inside], symbols[inside + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        order = rank.astype(np.int64) << 32 | np.arange(len(rank))
        best = np.minimum.reduceat(order, starts)
        over = best >> 32 == NO_RANK
        if over.any():
            sizes = np.diff(np.r_[starts, len(symbols)])
            finished = np.repeat(over, sizes)
            done_symbols.append(symbols[finished])
            done_owner.append(owner[finished])
            going = ~finished
            shift = np.cumsum(finished)
            at = best[~over] & 0xFFFFFFFF
            at -= shift[at]
            symbols, owner, rank = symbols[going], owner[going], rank[going]
        else:
            at = best & 0xFFFFFFFF
        if not len(at):
            break
        symbols[at] = vocabulary.merged_ids[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        rank[at] = np.where(rank[at + 1] == NO_RANK, NO_RANK, 0)
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        at -= np.arange(len(at))
        # Only the pairs before and after a merged symbol have changed.
        for left in (at - 1, at):
            left = left[(left >= 0) & (left + 1 < len(symbols))]
            left = left[owner[left] == owner[left + 1]]
            rank[left] = pair_rank(vocabulary, symbols[left], symbols[left + 1])
        last = at[(at + 1 == len(symbols)) | (owner[np.minimum(at + 1, len(symbols) - 1)] != owner[at])]
        rank[last] = NO_RANK
    flat, whose = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner])
    order = np.argsort(whose, kind="stable")
    return flat[order], np.r_[0, np.cumsum(np.bincount(whose, minlength=len(words)))]


def merge_long_word(vocabulary: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """The same merges for one long word, in n log n steps."""
    ids, after = symbols.tolist(), list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(pair_rank(vocabulary, symbols[:-1], symbols[1:])) if r != NO_RANK]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i] if ids[i] == left else len(ids)
        if j >= len(ids) or ids[j] != right:
            continue
        ids[i], ids[j] = int(vocabulary.merged_ids[rank]), -1
        after[i] = after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < len(ids):
                pair = np.array([ids[k]]), np.array([ids[after[k]]])
                if (r := int(pair_rank(vocabulary, *pair)[0])) != NO_RANK:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
    return np.array([i for i in ids if i >= 0], np.int64)


class PieceCache:
    """Encodings of white-space-free pieces, made together for all new pieces of a batch."""

    def __init__(self, encode, limit: int = CACHE_PIECES) -> None:
        self.encode, self.limit, self.known, self.long = encode, limit, {}, []

    def lookup(self, pieces: set[bytes]) -> dict[bytes, object]:
        """The encoding of every piece of the batch."""
        known = self.known
        for piece in self.long:
            del known[piece]
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > self.limit:
            self.known = known = {p: known[p] for p in pieces if p in known}
        if new:
            known.update(zip(new, self.encode(new), strict=True))
        self.long = [p for p in new if len(p) > CACHED_PIECE_BYTES]
        return known


def normalise(text: str) -> str:
    """NFC and lower case, character by character (no final-sigma rule)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[tuple[bytes, bytes] | None]:
    """Per piece its ids (little-endian unsigned 32-bit) and its decoding, or None if it has no ids."""
    texts = b"\n".join(pieces).decode("utf-8", "replace").split("\n")
    special = {i for i, t in enumerate(texts) if "<" in t and vocabulary.added_pattern.search(t)} if vocabulary.added_pattern else set()
    # Pieces hold no line feed, so one search over all of them keeps their bounds.
    found = vocabulary.words.findall(normalise("\n".join("" if i in special else t for i, t in enumerate(texts)) if special else "\n".join(texts)))
    number = {w: i for i, w in enumerate(dict.fromkeys(w for w in found if w != "\n"))}
    out: list[tuple[bytes, bytes] | None] = [None] * len(pieces)
    if number:
        ids, starts = merge_words(vocabulary, [w.encode() for w in number])
        flat, bounds = spread(found, number, ids, starts)
        raw, words = flat.astype("<u4").tobytes(), list(map(vocabulary.token_bytes.__getitem__, flat.tolist()))
        out = [(raw[4 * a:4 * b], b" ".join(words[a:b])) if a < b else None for a, b in zip(bounds, bounds[1:])]
    for i in special:
        out[i] = encode_special(vocabulary, texts[i])
    return out


def spread(found: list[str], number: dict[str, int], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Ids of the ``found`` words in their order, and the bounds of the pieces that line feeds part.

    Word ``w`` has the ids from ``starts[number[w]]`` up to the next start.
    """
    occurring = np.array([number.get(w, -1) for w in found], np.int64)
    sizes = np.where(occurring < 0, 0, np.diff(starts)[occurring])
    flat, ends = gather(ids, np.where(occurring < 0, 0, starts[occurring]), sizes)
    return flat, [0, *ends[occurring < 0].tolist(), len(flat)]


def gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``ids[start:start + size]`` one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
    at += np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    return ids[at], ends


def encode_special(vocabulary: Vocabulary, text: str) -> tuple[bytes, bytes]:
    """A piece with strings of added tokens."""
    got: list[tuple[bytes, bytes] | None] = []
    at = 0
    for match in vocabulary.added_pattern.finditer(text):
        token = vocabulary.added[match[0]]
        got += [*encode_pieces(vocabulary, [text[at:match.start()].encode()]), (token.to_bytes(4, "little"), vocabulary.token_bytes[token])]
        at = match.end()
    got += encode_pieces(vocabulary, [text[at:].encode()])
    return b"".join(g[0] for g in got if g), b" ".join(g[1] for g in got if g)


def encode_texts(vocabulary: Vocabulary, cache: PieceCache, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
    """Ids and decoding of each text."""
    pieces = [(t or "").encode("utf-8", "replace").split() for t in texts]
    known = cache.lookup(set().union(*pieces))
    out = []
    for own in pieces:
        got = [g for g in map(known.__getitem__, own) if g is not None]
        out.append((b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])))
    return out


def encode_documents(
    df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, with_decoded: bool | None = None
) -> DataFrame:
    """Per row its id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; with ``with_text`` also ``ids`` and ``decoded``.

    ``with_decoded=False`` leaves out ``decoded`` alone. Only the two named columns are read, so other columns cannot clash.
    """
    id_type = dict(df.dtypes)[id_col]
    with_decoded = with_text if with_decoded is None else with_decoded
    extra = (", ids array<int>" if with_text else "") + (", decoded string" if with_decoded else "")

    def make():
        vocabulary = load_vocabulary(vocabulary_path)
        cache = PieceCache(lambda pieces: encode_pieces(vocabulary, pieces))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            # A slice leaves before the next is read: a task holds the texts and results of one.
            start = 0
            for texts in array_slices(batch.column(1), ENCODED_BYTES):
                coded = encode_texts(vocabulary, cache, texts.to_pylist())
                columns = {
                    "doc_id": batch.column(0).slice(start, len(texts)),
                    "n_tokens": pa.array([len(i) // 4 for i, _ in coded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in coded]),
                    "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for _, d in coded]),
                }
                if with_text:
                    offsets = np.cumsum([0, *(len(i) // 4 for i, _ in coded)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(i for i, _ in coded), "<i4")
                    columns["ids"] = pa.ListArray.from_arrays(offsets, flat)
                if with_decoded:
                    columns["decoded"] = pa.array([d.decode() for _, d in coded])
                start += len(texts)
                yield pa.RecordBatch.from_pydict(columns)

        return step

    return map_batches(
        df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")),
        f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}",
        make,
    )
