"""Near-duplicate groups by SimHash fingerprints and BK-trees.

A fingerprint is the majority of the bits of a text's word-shingle hashes. Texts link when their
fingerprints differ in at most ``radius`` bits; groups are the connected components of the links.

Only distinct fingerprints are compared. The 64 bits are cut into blocks; two fingerprints within the
radius agree on all but ``radius`` blocks, so every link meets in the bucket of some block choice. A bucket
is cut into shards of at most about ``SHARD_SIZE`` fingerprints; the BK-tree of each shard (children keyed
by their Hamming distance to the parent) meets the query shards of its bucket, and a search follows only
edges whose distance is within the radius of the query's distance to the node. Trees travel to their
buckets with the shuffle, since a broadcast of all trees would grow with the corpus. A shard pair reports
a spanning forest of its links, never all pairs: that loses no link between groups.

Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows keep one row each.
A group's id is its smallest document id; null only if the whole group has no id. Only the id and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from blockreach.llm.common import map_batches, written
from blockreach.operators.graph import connected_components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
SHARD_SIZE = 4096
SMALL_CELL = 48
BUCKET_TARGET = 64  # expected fingerprints per bucket when the bits are even


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a text: ASCII lower case, words between ASCII white space, repeated shingles counted."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: len(words) - shingle_words + 1].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle_words - 1:] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 16_384):
        bits = np.unpackbits(hashes[part:part + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) and ``twin``, a hash of the text that tells rows of one id apart."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(prints.view(np.int64)), "twin": batch.column(2)})

        return step

    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).withColumn("twin", F.xxhash64("text"))
    return map_batches(rows, f"doc_id {dict(df.dtypes)[id_col]}, fp bigint, twin bigint", make)


def block_choices(count: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Bit ranges (shift, width) that make up each bucket key; more blocks, so longer keys, for more fingerprints."""
    blocks = radius + 1
    while blocks < 2 * radius and count >> 64 * (blocks - radius) // blocks > BUCKET_TARGET:
        blocks += 1
    edges = [64 * b // blocks for b in range(blocks + 1)]
    return [[(edges[b], edges[b + 1] - edges[b]) for b in chosen] for chosen in itertools.combinations(range(blocks), blocks - radius)]


class BKTree:
    """A BK-tree over unsigned 64-bit fingerprints."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.plain = plain = values.tolist()
        for i in range(1, len(plain)):
            node = 0
            while True:
                distance = (plain[i] ^ plain[node]).bit_count()
                below = self.children[node].setdefault(distance, i)
                if below == i:
                    break
                node = below

    def near(self, query: int, radius: int) -> Iterator[int]:
        """Nodes within the radius of one query."""
        todo = [0]
        while todo:
            node = todo.pop()
            distance = (query ^ self.plain[node]).bit_count()
            if distance <= radius:
                yield node
            todo += [child for edge, child in self.children[node].items() if -radius <= distance - edge <= radius]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Per node that any query meets: the node and the positions of the queries within the radius, all queries at once."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, asking = todo.pop()
            distance = np.bitwise_count(queries[asking] ^ self.values[node]).astype(np.int64)
            near = asking[distance <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = asking[np.abs(distance - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))


def spanning_links(tree_values: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all values and queries which near pairs connect; fewer than there are values."""
    tree = BKTree(tree_values)
    if len(queries) <= SMALL_CELL:
        # Few values: plain numbers are quicker than arrays of a handful.
        links = [(q, tree.plain[node]) for q in queries.tolist() for node in tree.near(q, radius) if q != tree.plain[node]]
        leader: dict[int, int] = {}

        def root(v: int) -> int:
            while v in leader:
                v = leader[v]
            return v

        kept = []
        for q, v in links:
            x, y = root(q), root(v)
            if x != y:
                leader[y] = x
                kept.append((q, v))
        out = np.array(kept, np.uint64).reshape(-1, 2)
        return out[:, 0], out[:, 1]
    values = np.r_[tree_values, queries]
    labels = np.arange(len(values))
    for node, near in tree.search(queries, radius):
        met = np.r_[labels[node], labels[near + len(tree_values)]]
        if (met != met[0]).any():
            labels[np.isin(labels, met)] = met.min()
    moved = np.flatnonzero((labels != np.arange(len(values))) & (values != values[labels]))
    return values[moved], values[labels[moved]]


def near_links(prints: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Spanning links ``(a, b)`` between the distinct fingerprints ``fp`` of a written table."""
    choices = block_choices(prints.count(), radius)
    keys = [
        F.concat(*[F.lpad(F.hex(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))), 8, "0") for low, width in choice])
        for choice in choices
    ]
    filed = prints.select("fp", F.posexplode(F.array(*keys)).alias("choice", "key"))
    sizes = filed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / shard_size).cast("int")
    cells = (
        filed.join(sizes, ["choice", "key"])
        .withColumn("shards", shards)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select("choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", (F.col("own") <= F.col("other")).alias("in_tree"), (F.col("own") >= F.col("other")).alias("asks"))
        .repartition("choice", "key", "i", "j")
        .sortWithinPartitions("choice", "key", "i", "j")
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A cell holds two shards at most, so one is held at a time.
        def flush(held: list[tuple]) -> pa.RecordBatch:
            prints, in_tree, asks = (np.concatenate(x) for x in zip(*held))
            a, b = spanning_links(prints[in_tree], prints[asks], radius) if in_tree.any() and asks.any() else (prints[:0], prints[:0])
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        held: list[tuple] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = batch.to_pydict()
            cell = list(zip(columns["choice"], columns["key"], columns["i"], columns["j"]))
            fp = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            in_tree, asks = (np.array(columns[c], bool) for c in ("in_tree", "asks"))
            bounds = [0, *[k for k in range(1, len(cell)) if cell[k] != cell[k - 1]], len(cell)]
            for start, end in zip(bounds, bounds[1:]):
                if held and cell[start] != last:
                    yield flush(held)
                    held = []
                held.append((fp[start:end], in_tree[start:end], asks[start:end]))
                last = cell[start]
        if held:
            yield flush(held)

    return cells.mapInArrow(links, "a bigint, b bigint").distinct()


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, component_id`` for every distinct fingerprint of ``prints (doc_id, fp)``."""
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    links = written(near_links(firsts.select("fp"), radius), "links")
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    linked = connected_components(edges, edges.select(F.col("src").alias("node")).distinct()).withColumnRenamed("node", "fp")
    labelled = firsts.join(linked, "fp", "left")
    smallest = labelled.where("component is not null").groupBy("component").agg(F.min("first").alias("component_id"))
    return labelled.join(smallest, "component", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row ``doc_id, fingerprint`` (16 hex digits) and ``component_id``."""
    prints = written(with_fingerprints(df, id_col, text_col), "document-fingerprints")
    return prints.join(groups(prints, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_rows(df: DataFrame, kept: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose id and text hash are in ``kept``, one of those equal in both; ``rows`` holds ``doc_id, twin`` of all."""
    twice = written(rows.groupBy("doc_id", "twin").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "twin"), "repeated")
    keyed = df.withColumn("__twin", F.xxhash64(text_col))

    def same(other: DataFrame):
        return keyed[id_col].eqNullSafe(other["doc_id"]) & keyed["__twin"].eqNullSafe(other["twin"])

    chosen = keyed.join(kept, same(kept), "left_semi")
    if twice.isEmpty():
        return chosen.drop("__twin")
    twins = chosen.join(twice, chosen[id_col].eqNullSafe(twice["doc_id"]) & (chosen["__twin"] == twice["twin"]), "left_semi").dropDuplicates([id_col, "__twin"])
    single = chosen.join(twice, chosen[id_col].eqNullSafe(twice["doc_id"]) & (chosen["__twin"] == twice["twin"]), "left_anti")
    return single.unionByName(twins).drop("__twin")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group stays: that of the smallest id (a null id comes last), then of the smallest text hash.

    Rows equal in id and text are one row. All columns are kept.
    """
    prints = written(with_fingerprints(df, id_col, text_col), "document-fingerprints")
    members = prints.join(groups(prints, radius).withColumnRenamed("component_id", "grp"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("twin"))
    # A null component holds documents without id; their fingerprint tells such groups apart.
    whole = [F.col("grp"), F.when(F.col("grp").isNull(), F.col("fp"))]
    kept = written(members.groupBy(*whole).agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("n")).select("k.doc_id", "k.twin"), "kept")
    return keep_rows(df, kept, prints, id_col, text_col)
