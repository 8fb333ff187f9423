"""Token ids in raw binary shards with a minimal perfect hash index for keyed access.

Documents are range partitioned by id; each task encodes its documents and writes one shard: nothing but
their ids, little-endian, 16 bits wide if the vocabulary allows and 32 otherwise. The index maps a
document key to its place. Keys (document id, number of the copy) are dealt to buckets by hash, and each
bucket is one file: a minimal perfect hash over its keys, built level by level (a key takes the bit that
it alone hashes to, the others go to the next level; the slot is the bit's rank), and per slot the key's
fingerprint, shard, offset and length. A lookup evaluates the hash, compares the fingerprint and seeks.

Files are named by task attempt and become part of the data set only through the manifest tables, so a
task that is run twice leaves at worst an unused file. Null texts count as empty; a null id sorts first
and is a key like any other; rows with the same id are told apart by their order (by text hash). Keys whose
64-bit hashes are equal are kept in full beside the slots. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import io
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from blockreach.llm.bpe import gather, spread
from blockreach.llm.common import SLICE_CHARS, array_slices, open_folder, remove, shared_folder

KEYS_PER_BUCKET = 100_000
LEVEL_ROOM = 1.6  # bits per remaining key at each level
MAX_LEVELS = 60
WORD_END = "</w>"
KNOWN_WORDS = 400_000


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of unsigned keys, one function per seed."""
    z = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits stored per slot to reject keys that are not in the index."""
    return (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Level bits of a minimal perfect hash over distinct unsigned 64-bit ``keys``, and each key's slot."""
    levels: list[np.ndarray] = []
    slots = np.full(len(keys), -1, np.int64)
    left, used = np.arange(len(keys)), 0
    while len(left):
        if len(levels) == MAX_LEVELS:
            raise ValueError("Keys are not distinct.")
        size = max(64, int(len(left) * LEVEL_ROOM))
        at = (mix(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = used + np.cumsum(bits)[at[alone]] - 1
        used += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, slots


def find_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 if no level has a bit for it (the key is then not in the index)."""
    slots = np.full(len(keys), -1, np.int64)
    left, used = np.arange(len(keys)), 0
    for number, bits in enumerate(levels):
        at = (mix(keys[left], number) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = used + np.cumsum(bits)[at[hit]] - 1
        used += int(bits.sum())
        left = left[~hit]
    return slots


# Pieces of these characters are unchanged by NFC, and without an apostrophe (which may start a contraction)
# their words are runs of letters, single digits and runs of signs.
PLAIN_PIECE = "^[!-&(-~À-ÖØ-öø-ÿ]+$"
PLAIN_WORDS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\\n]+|\\n")


Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def library_encoder(path: str) -> Callable[[], Encoder]:
    """Encoder of texts with the tokenizers library: the ids of all texts, and where each text ends.

    White space only separates words here, so texts are cut at ASCII white space and the library encodes
    each distinct piece of a batch: plain pieces as their words, all words not yet known in one call, and
    other pieces one by one. Texts that may hold strings of added tokens go to the library whole.
    """

    def make() -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        vocabulary = tokenizer.get_vocab()
        closes = np.zeros(1 + max(vocabulary.values()), bool)
        closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        # Words seen so far by number, their ids one after the other, and where each word's ids start.
        number: dict[str, int] = {}
        known_ids, known_starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

        def encode_plain(pieces: list[str]) -> tuple[np.ndarray, list[int]]:
            nonlocal known_ids, known_starts
            found = PLAIN_WORDS.findall("\n".join(pieces).lower())
            new = [w for w in dict.fromkeys(found) if w not in number and w != "\n"]
            if len(number) + len(new) > KNOWN_WORDS:
                number.clear()
                known_ids, known_starts = known_ids[:0], known_starts[:1]
                new = [w for w in dict.fromkeys(found) if w != "\n"]
            if new:
                ids = np.array(tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(closes[ids]) + 1
                if len(ends) != len(new):
                    raise ValueError("A word is not closed by a word end; the vocabulary is of another kind.")
                number.update(zip(new, range(len(number), len(number) + len(new))))
                known_starts = np.r_[known_starts, ends + len(known_ids)]
                known_ids = np.r_[known_ids, ids]
            return spread(found, number, known_ids, known_starts)

        def encode_whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            coded = [c.ids for c in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for ids in coded for i in ids], np.uint32), np.array([len(ids) for ids in coded], np.int64)

        def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            texts = pc.fill_null(texts, "")
            whole = pc.match_substring(texts, "<|")
            split = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
            coded = split.flatten().dictionary_encode()
            pieces, order = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
            plain = pc.match_substring_regex(coded.dictionary, PLAIN_PIECE).to_numpy(zero_copy_only=False)
            sizes, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
            ids = np.zeros(0, np.uint32)
            if plain.any():
                ids, bounds = encode_plain(pieces[plain].tolist())
                starts[plain], sizes[plain] = bounds[:-1], np.diff(bounds)
            if not plain.all():
                odd, odd_sizes = encode_whole(pieces[~plain].tolist())
                starts[~plain], sizes[~plain] = len(ids) + np.cumsum(odd_sizes) - odd_sizes, odd_sizes
                ids = np.r_[ids, odd]
            flat, piece_ends = gather(ids, starts[order], sizes[order])
            ends = np.r_[0, piece_ends][split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
            if pc.any(whole).as_py():
                at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
                own, own_sizes = encode_whole(texts.take(pa.array(at)).to_pylist())
                flat = np.insert(flat, np.repeat(ends[at], own_sizes), own)
                added = np.zeros(len(ends), np.int64)
                added[at] = own_sizes
                ends = ends + np.cumsum(added)
            return flat, ends

        return encode

    return make


class TokenFiles:
    """A written data set: its folder, and the manifest tables of shards, documents and index buckets."""

    def __init__(self, spark: SparkSession, folder: str, width: int, buckets: int) -> None:
        self.spark, self.folder, self.width, self.buckets = spark, folder, width, buckets

    @property
    def shards(self) -> DataFrame:
        """``shard, file, start, n_docs, n_tokens``; one row per shard."""
        return self.spark.read.parquet(f"{self.folder}/shards")

    @property
    def documents(self) -> DataFrame:
        """``doc_id, copy``: the keys that were written."""
        return self.spark.read.parquet(f"{self.folder}/documents").select("doc_id", "copy")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Places of ``keys (doc_id, copy)``: ``doc_id, copy, shard, at, n_tokens``; unknown keys give no row."""
        folder, id_type = self.folder, dict(keys.dtypes)["doc_id"]

        def find(group: pd.DataFrame) -> pd.DataFrame:
            fs, path = open_folder(folder)
            with fs.open_input_stream(f"{path}/index/{group['file'].iloc[0]}") as file:
                stored = np.load(io.BytesIO(file.read()), allow_pickle=False)
            hashes = group["hash"].to_numpy(np.int64).view(np.uint64)
            bits = np.unpackbits(stored["bits"], count=int(stored["sizes"].sum())).astype(bool)
            slots = find_slots(np.split(bits, np.cumsum(stored["sizes"])[:-1]), hashes)
            known = slots >= 0
            known[known] = stored["fingerprints"][slots[known]] == fingerprints(hashes[known])
            out = group.loc[known, ["doc_id", "copy"]].reset_index(drop=True)
            for name in ("shard", "at", "n_tokens"):
                out[name] = stored[name][slots[known]]
            if len(stored["same_hash"]):  # keys with equal hashes, stored in full
                twins = pd.DataFrame({n: stored[f"same_{n}"] for n in ("hash", "id", "copy", "shard", "at", "n_tokens")})
                mine = group[np.isin(hashes, stored["same_hash"])].assign(id=lambda g: g["doc_id"].astype("string").fillna("null").astype(object))
                exact = mine[["doc_id", "id", "copy"]].merge(twins.drop(columns="hash"), on=["id", "copy"])[list(out.columns)]
                out = pd.concat([out[~np.isin(hashes[known], stored["same_hash"])], exact])
            return out

        files = self.spark.read.parquet(f"{folder}/buckets")
        hashed = keys.select("doc_id", "copy").withColumn("hash", F.xxhash64("doc_id", "copy")).withColumn("bucket", F.pmod("hash", F.lit(self.buckets)))
        return hashed.join(files, "bucket").groupBy("bucket").applyInPandas(find, f"doc_id {id_type}, copy bigint, shard bigint, at bigint, n_tokens bigint")

    def read(self, places: DataFrame, schema: str, digest: Callable[[np.ndarray], tuple]) -> DataFrame:
        """Read the ids at ``places`` from the shards; ``digest`` gives the further columns of ``schema`` per document."""
        folder, width = self.folder, self.width
        names = [part.split()[0] for part in schema.split(",")]
        id_type = dict(places.dtypes)["doc_id"]

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, path = open_folder(folder)
            opened, file = None, None
            for batch in batches:
                rows = batch.to_pydict()
                extra = []
                for name, at, n in zip(rows["file"], rows["at"], rows["n_tokens"]):
                    if name != opened:
                        file, opened = fs.open_input_file(f"{path}/data/{name}"), name
                    ids = np.frombuffer(file.read_at(n * width, at * width), f"<u{width}")
                    extra.append(digest(ids))
                out = {n: batch.column(n) for n in ("doc_id", "copy", "start", "n_tokens")}
                columns = list(zip(*extra)) or [()] * len(names)
                yield pa.RecordBatch.from_pydict(out | {n: pa.array(c) for n, c in zip(names, columns)})

        located = places.join(self.shards.select("shard", "file", "start"), "shard").select(
            "doc_id", "copy", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "file", "at"
        )
        # Neighbours in a shard are read one after the other.
        ordered = located.repartitionByRange("file", "at").sortWithinPartitions("file", "at")
        return ordered.mapInArrow(fetch, f"doc_id {id_type}, copy bigint, start bigint, n_tokens bigint, {schema}")


def write_token_files(
    df: DataFrame, encoder: Callable[[], Encoder], vocabulary_size: int,
    end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> TokenFiles:
    """Encode ``df`` in ascending id order, each document closed by ``end_id``, and write shards and index."""
    spark, id_type = df.sparkSession, dict(df.dtypes)[id_col]
    folder = shared_folder(spark, "token-files")
    width = 2 if vocabulary_size <= 1 << 16 else 4
    fs, path = open_folder(folder)
    for part in ("data", "index"):
        fs.create_dir(f"{path}/{part}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, name = task.partitionId(), f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        fs, path = open_folder(folder)
        out, encode, at, number, last, copy = None, None, 0, 0, object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out, encode = fs.open_output_stream(f"{path}/data/{name}"), encoder()
            keys, copies, counts = batch.column(0).to_pylist(), [], []
            for part in array_slices(batch.column(1), 2 * SLICE_CHARS):
                ids, ends = encode(part)
                sizes = np.diff(ends, prepend=0)
                if end_id is not None:
                    ids, sizes = np.insert(ids, ends, end_id), sizes + 1
                out.write(ids.astype(f"<u{width}").tobytes())
                counts += sizes.tolist()
            for key in keys:
                copy, last = (copy + 1 if key == last else 0), key
                copies.append(copy)
            places = at + np.cumsum(counts) - counts
            at += sum(counts)
            numbers = range(number, number := number + len(keys))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard] * len(keys), pa.int64()), "file": pa.array([name] * len(keys)), "number": pa.array(numbers, pa.int64()),
                "doc_id": batch.column(0), "copy": pa.array(copies, pa.int64()), "at": pa.array(places, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
            })
        if out is not None:
            out.close()

    ordered = (
        df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(write, f"shard bigint, file string, number bigint, doc_id {id_type}, copy bigint, at bigint, n_tokens bigint").write.parquet(f"{folder}/written")
    rows = spark.read.parquet(f"{folder}/written")

    # One row per shard on the driver: where it starts, and copies of its first id in the shards before.
    totals = rows.groupBy("shard", "file").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
        F.min_by("doc_id", "number").alias("first"), F.max_by("doc_id", "number").alias("last"), F.max_by("copy", "number").alias("last_copy"),
    ).orderBy("shard").collect()
    shards, carried, start, before = [], [], 0, None
    for t in totals:
        carry = before[1] if before is not None and before[0] == t["first"] else 0
        before = (t["last"], t["last_copy"] + 1 + (carry if t["first"] == t["last"] else 0))
        shards.append((t["shard"], t["file"], start, t["n_docs"], t["n_tokens"]))
        carried.append((t["shard"], t["first"], carry))
        start += t["n_tokens"]
    spark.createDataFrame(shards, "shard bigint, file string, start bigint, n_docs bigint, n_tokens bigint").write.parquet(f"{folder}/shards")
    if any(c for _, _, c in carried):
        heads = spark.createDataFrame(carried, f"shard bigint, first {id_type}, carry bigint")
        rows = rows.join(heads, "shard").withColumn("copy", F.col("copy") + F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.col("carry")).otherwise(0))
    rows.select("doc_id", "copy", "shard", "at", "n_tokens").write.parquet(f"{folder}/documents")

    buckets = max(1, -(-sum(t["n_docs"] for t in totals) // KEYS_PER_BUCKET))

    def index(group: pd.DataFrame) -> pd.DataFrame:
        hashes = group["hash"].to_numpy(np.int64).view(np.uint64)
        twins = group["hash"].duplicated(keep=False).to_numpy()
        own = group[~twins]
        levels, slots = build_hash(hashes[~twins])
        order = np.argsort(slots)
        stored = {name: own[name].to_numpy(np.int64)[order] for name in ("shard", "at", "n_tokens")}
        stored |= {f"same_{name}": group.loc[twins, name].to_numpy(np.int64) for name in ("copy", "shard", "at", "n_tokens")}
        stored["same_hash"] = hashes[twins]
        stored["same_id"] = group.loc[twins, "doc_id"].astype("string").fillna("null").to_numpy(dtype=str)
        stored["fingerprints"] = fingerprints(hashes[~twins])[order]
        stored["sizes"] = np.array([len(bits) for bits in levels], np.int64)
        stored["bits"] = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
        bucket, content = int(group["bucket"].iloc[0]), io.BytesIO()
        np.savez(content, **stored)
        name = f"bucket-{bucket:06d}-{TaskContext.get().taskAttemptId()}.npz"
        fs, path = open_folder(folder)
        with fs.open_output_stream(f"{path}/index/{name}") as file:
            file.write(content.getvalue())
        return pd.DataFrame({"bucket": [bucket], "file": [name]})

    keyed = spark.read.parquet(f"{folder}/documents").withColumn("hash", F.xxhash64("doc_id", "copy")).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    keyed.groupBy("bucket").applyInPandas(index, "bucket bigint, file string").write.parquet(f"{folder}/buckets")
    remove(spark, f"{folder}/written")
    return TokenFiles(spark, folder, width, buckets)


def crc32_of_ids(ids: np.ndarray) -> tuple[int]:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
