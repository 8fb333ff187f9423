"""Near copies of texts: SimHash fingerprints in BK-trees find candidates, shared word shingles confirm them.

Two texts are near copies when the Jaccard similarity of their sets of five-word shingles is 0.8 or more
(ASCII lower case, words between ASCII white space; a text of fewer words is one shingle). Three bits of
64 see only the closest of such pairs, so the radius is wide here, and buckets come from the texts: minima
of seeded shingle hashes, ``ROWS`` to a band and ``BANDS`` bands. A pair of similarity 0.8 shares a band with
probability 0.9996 and lies within ``RADIUS`` bits with about 0.998; the loss is less for closer pairs.

Texts of one shingle set are one candidate. Within a bucket a BK-tree reports a spanning forest of the
fingerprints within the radius; the components of those links are the sets in which texts are compared. A
set is cut into shards of at most about ``SHARD_TEXTS`` texts or ``SHARD_BYTES`` of shingles, one of its texts
comes to every shard, and a task compares pairs that are not connected yet. What is not connected with that
text afterwards is compared with all shards once more, so no confirmed link between two shards is lost.

Null, empty and blank texts have no shingles and are copies of each other. Repeated rows keep one row each.
Only the id and text columns are read, so other columns cannot clash. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from blockreach.llm.common import map_batches, written
from blockreach.llm.simhash import BKTree, keep_rows, spanning_links
from blockreach.operators.graph import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 18
ROWS, BANDS = 5, 20
BUCKET_SHARD = 4096
SHARD_TEXTS = 512
SHARD_BYTES = 16 << 20
SEED = 42
# Shingles per step of the minima and bit counts.
STEP = 2048


def shingle_set(text: str | None, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: len(words) - words_each + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words_each - 1:] - 1).tolist())], np.uint64))


def band_seeds(rows: int = ROWS, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of the seeded hashes, one per row of each band."""
    rng = np.random.default_rng(SEED)
    return tuple(rng.integers(0, 2**63, (bands, rows, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def band_keys(shingles: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One key per band from the minima of its rows."""
    factors, shifts = seeds
    lowest = np.full(factors.shape[:2], 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), STEP):
        lowest = np.minimum(lowest, (shingles[at:at + STEP] * factors + shifts).min(axis=2))
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), SEED) for part in lowest], np.uint64).view(np.int64)


def set_fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a shingle set: a bit is 1 if set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), STEP):
        counts += np.unpackbits(shingles[at:at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def with_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, twin`` (text hash), ``key`` (of its shingle set), ``fp``, ``n_shingles`` and ``bands``."""

    def make():
        seeds = band_seeds()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {"key": [], "fp": [], "n_shingles": [], "bands": []}
            for text in batch.column(1):
                shingles = shingle_set(text.as_py())
                out["key"].append(hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest())
                out["fp"].append(set_fingerprint(shingles))
                out["n_shingles"].append(len(shingles))
                out["bands"].append(band_keys(shingles, seeds))
            return pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(out["key"]), pa.array(out["fp"], pa.int64()), pa.array(out["n_shingles"], pa.int64()), pa.array(out["bands"], pa.list_(pa.int64())),
            ], ["doc_id", "twin", *out])

        return step

    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).withColumn("twin", F.xxhash64("text"))
    return map_batches(rows, f"doc_id {dict(df.dtypes)[id_col]}, twin bigint, key string, fp bigint, n_shingles bigint, bands array<bigint>", make)


def in_cells(cells: DataFrame, schema: str, work: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """``work`` on the rows of every ``cell``, one cell at a time; those marked ``lead`` come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            names = batch.column("cell").to_pylist()
            cuts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]] + [len(names)]
            for start, end in zip(cuts, cuts[1:]):
                if held and names[start] != last:
                    found.append(work(pa.Table.from_batches(held)))
                    held = []
                held.append(batch.slice(start, end - start))
                last = names[start]
            # Most cells find little, so the cells of a batch give one result.
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
                found = []
        if held:
            yield work(pa.Table.from_batches(held))

    # A stated number of parts, since a cell's cost is in its pairs, not in its bytes.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell", F.desc("lead"), "key").mapInArrow(run, schema)


def candidate_links(reps: DataFrame, radius: int = RADIUS, shard_size: int = BUCKET_SHARD) -> DataFrame:
    """Spanning links ``(a, b)`` of the fingerprints that share a band and lie within the radius."""
    filed = reps.select("fp", F.posexplode("bands").alias("band", "value")).distinct()
    sizes = filed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    cells = (
        filed.join(sizes, ["band", "value"])
        .withColumn("shards", F.ceil(F.col("n") / shard_size).cast("int")).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select(
            F.concat_ws(":", "band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), F.lit(False).alias("lead"), F.col("fp").alias("key"),
            (F.col("own") <= F.col("other")).alias("in_tree"), (F.col("own") >= F.col("other")).alias("asks"),
        )
    )

    def work(rows: pa.Table) -> pa.RecordBatch:
        prints = rows["key"].to_numpy().view(np.uint64)
        in_tree, asks = (rows[c].to_numpy() for c in ("in_tree", "asks"))
        a, b = spanning_links(prints[in_tree], prints[asks], radius) if in_tree.any() and asks.any() else (prints[:0], prints[:0])
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return in_cells(cells, "a bigint, b bigint", work).distinct()


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted shingle sets have at least the Jaccard similarity; two empty sets have."""
    small, large = sorted((len(a), len(b)))
    if not small or small / large < similarity:
        return small == large
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (small + large - shared) >= similarity


def confirmed_links(cells: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` from the first text of each connected part of a cell to its others."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        keys = rows["key"].to_pylist()
        prints = rows["fp"].to_numpy().view(np.uint64)
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]
        asked, asking = (np.flatnonzero(rows[c].to_numpy()) for c in ("in_tree", "asks"))
        labels = np.arange(len(keys))
        if len(asked) and len(asking):
            for node, near in BKTree(prints[asked]).search(prints[asking], radius):
                own = asked[node]
                for other in asking[near]:
                    x, y = labels[own], labels[other]
                    if x != y and (keys[own] == keys[other] or alike(sets[own], sets[other], similarity)):
                        labels[labels == max(x, y)] = min(x, y)
        links = [(keys[first], key) for key, first in zip(keys, labels) if keys[first] != key]
        return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.string()), "b": pa.array([b for _, b in links], pa.string())})

    return in_cells(cells, "a string, b string", work).distinct()


def shards_of(count: Column, shingles: Column, shard_texts: int) -> Column:
    """Shards for so many texts with so many shingles of eight bytes."""
    return F.greatest(F.ceil(count / shard_texts), F.ceil(shingles * 8 / SHARD_BYTES), F.lit(1)).cast("int")


def candidates(df: DataFrame, reps: DataFrame, id_col: str, text_col: str, radius: int, shard_texts: int) -> DataFrame:
    """Shingle sets that have candidates: ``key, fp, component, leader, shards, shard, n_shingles, shingles``."""
    links = written(candidate_links(reps, radius), "candidate-links")
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    linked = connected_components(edges, edges.select(F.col("src").alias("node")).distinct()).withColumnRenamed("node", "fp")
    # Sets of one fingerprint are candidates too.
    placed = reps.drop("bands").join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("all_shingles"), F.min("key").alias("leader")).where("n > 1")
    members = written(
        placed.join(sizes, "component").withColumn("shards", shards_of(F.col("n"), F.col("all_shingles"), shard_texts))
        .withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")).drop("n", "all_shingles"), "candidates",
    )
    texts = df.select(df[id_col].alias("d"), df[text_col].alias("text")).withColumn("t", F.xxhash64("text"))
    found = members.join(texts, (F.col("t") == F.col("first.twin")) & F.col("d").eqNullSafe(F.col("first.doc_id"))).drop("d", "t", "first").dropDuplicates(["key"])
    columns = [c for c in found.columns if c != "text"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(len(columns))], pa.binary())
            return pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], sets], [*columns, "shingles"])

        return step

    types = dict(found.dtypes)
    return map_batches(found.select(*columns, "text"), ", ".join(f"{c} {types[c]}" for c in columns) + ", shingles binary", make)


def similar_sets(df: DataFrame, reps: DataFrame, id_col: str, text_col: str, similarity: float, radius: int, shard_texts: int) -> DataFrame:
    """``key, component`` of every shingle set that has a near copy."""
    members = written(candidates(df, reps, id_col, text_col, radius, shard_texts), "candidate-sets")
    is_lead = F.col("key") == F.col("leader")
    visiting = members.where(is_lead & (F.col("shards") > 1)).withColumn("own", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("shard <> own").drop("own")

    def cell(rows: DataFrame, names: list[str], in_tree: bool, asks: bool) -> DataFrame:
        return rows.select(F.concat_ws(":", *names).alias("cell"), is_lead.alias("lead"), "key", "fp", F.lit(in_tree).alias("in_tree"), F.lit(asks).alias("asks"), "shingles")

    links = written(confirmed_links(cell(members.unionByName(visiting), ["component", "shard"], True, True), similarity, radius), "near-texts")
    # Only sets of several shards can have more links between shards.
    joined = links.select(F.col("a").alias("leader"), F.col("b").alias("key"))
    rest = written(members.where("shards > 1 AND key <> leader").select("component", "key", "leader", "n_shingles").join(joined, ["leader", "key"], "left_anti"), "apart")
    if not rest.isEmpty():
        sizes = rest.groupBy("component").agg(shards_of(F.count(F.lit(1)), F.sum("n_shingles"), shard_texts).alias("others"))
        split = members.join(sizes, "component")
        # The rest, in shards of its own, meets every shard of its set.
        asked = split.join(rest.select("key"), "key", "left_semi").withColumn("other", F.pmod(F.xxhash64("key", F.lit(1)), F.col("others")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        asking = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        names = ["component", "shard", "other"]
        more = confirmed_links(cell(asked, names, True, False).unionByName(cell(asking, names, False, True)), similarity, radius)
        links = links.unionByName(written(more, "near-texts-apart"))
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return connected_components(edges, edges.select(F.col("src").alias("node")).distinct()).withColumnRenamed("node", "key")


def text_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, shard_texts: int = SHARD_TEXTS
) -> tuple[DataFrame, DataFrame]:
    """Features of all rows, and per shingle set its ``key``, ``grp`` and the ``first`` row (null ids come last)."""
    rows = written(with_features(df, id_col, text_col), "text-features")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("twin"))
    reps = written(rows.groupBy("key").agg(F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("fp", "n_shingles", "bands")]), "shingle-sets")
    linked = similar_sets(df, reps, id_col, text_col, similarity, radius, shard_texts)
    return rows, reps.select("key", "first").join(linked, "key", "left").select("key", F.coalesce("component", "key").alias("grp"), "first")


def near_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per row ``doc_id`` and ``component_id``, the smallest id of its group (null only if the whole group has none)."""
    rows, groups = text_groups(df, id_col, text_col, **settings)
    smallest = groups.groupBy("grp").agg(F.min("first.doc_id").alias("component_id"))
    return rows.select("doc_id", "key").join(groups.join(smallest, "grp").select("key", "component_id"), "key").select("doc_id", "component_id")


def drop_near_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each group stays: that of the smallest id (a null id comes last), then of the smallest text hash. All columns are kept."""
    rows, groups = text_groups(df, id_col, text_col, **settings)
    kept = written(groups.groupBy("grp").agg(F.min("first").alias("k")).select("k.doc_id", "k.twin"), "kept")
    return keep_rows(df, kept, rows, id_col, text_col)
