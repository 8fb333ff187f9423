"""Shards of bounded size by extendible hashing. DataFrame functions only.

The directory is indexed by leading bits of a hash of the document key. A bucket splits on one more bit
only while it is over the byte limit, so every shard is the shortest prefix that fits. Bytes are summed
per cell of a fine prefix first, the prefixes above are summed from the cells, and only the rows of cells
that are still over the limit are looked at again with more bits. Cells, prefixes and the directory grow with
the table, so they meet the rows in merge joins and are never broadcast.

Rows of one key share all its bits: such a bucket goes on splitting on bits of a text hash, and identical
rows, which no hash can part, are dealt to numbered overflow pages of as many rows as fit. A single row
above the limit is a shard of its own. Null keys are a key like any other, null and empty texts have no
bytes; an empty table has no shards. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockreach.llm.common import written

SHARD_BYTES = 1 << 20
HASH_BITS = 60
SPARE_BITS = 3  # cells per shard, as a power of two
MORE_BITS = 8  # bits by which cells that are still too large are cut again


def leading_bits(text: Column) -> Column:
    """60 bits from the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def split_buckets(rows: DataFrame, scope: list[str], bits: str, limit: int, first_depth: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows with ``depth`` and ``cell`` of their shard, in parts, and the rows whose ``bits`` are all the same in a bucket over the limit.

    ``scope`` names the columns that part the directories.
    """
    settled: list[DataFrame] = []
    stuck: list[DataFrame] = []
    above, depth, pending = 0, min(first_depth, HASH_BITS), rows
    while True:
        cells = written(
            pending.groupBy(*scope, F.shiftright(bits, HASH_BITS - depth).alias("cell")).agg(
                F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"), (F.min(bits) == F.max(bits)).alias("single")
            ), "cells",
        )
        levels = cells.select(*scope, "cell", "n_bytes", "n", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth"))
        levels = levels.withColumn("at", F.expr(f"shiftright(cell, {depth} - depth)"))
        fitting = levels.groupBy(*scope, "depth", "at").agg(F.sum("n_bytes").alias("total"), F.sum("n").alias("n")).where((F.col("total") <= limit) | (F.col("n") == 1))
        chosen = levels.drop("n_bytes", "n").join(fitting.hint("merge"), [*scope, "depth", "at"]).groupBy(*scope, "cell").agg(F.min(F.struct("depth", "at", "total")).alias("shard"))
        directory = written(cells.select(*scope, "cell", "single").join(chosen.hint("merge"), [*scope, "cell"], "left"), "directory")
        located = pending.withColumn("cell", F.shiftright(bits, HASH_BITS - depth)).join(directory.hint("merge"), [*scope, "cell"])
        settled.append(located.where("shard IS NOT NULL").select(*rows.columns, F.col("shard.depth").alias("depth"), F.col("shard.at").alias("at"), F.col("shard.total").alias("shard_bytes")))
        left = directory.where("shard IS NULL").agg(F.count_if("single").alias("single"), F.count_if(~F.col("single")).alias("more")).first()
        if left["single"]:
            stuck.append(located.where("shard IS NULL AND single").select(*rows.columns))
        if not left["more"]:
            break
        pending = written(located.where("shard IS NULL AND NOT single").select(*rows.columns), "oversized")
        above, depth = depth + 1, min(depth + MORE_BITS, HASH_BITS)
    rest = None
    for part in stuck:
        rest = part if rest is None else rest.unionByName(part)
    return settled, rest


def overflow_pages(rows: DataFrame, limit: int) -> DataFrame:
    """Page numbers for identical rows: counted per input partition first, so no task holds a group."""
    group = ["h1", "h2"]
    rows = written(rows.withColumn("part", F.spark_partition_id()), "identical")
    counts = rows.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))
    # One row per input partition that holds copies.
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    place = F.row_number().over(Window.partitionBy(*group, "part").orderBy("n_bytes")) - 1
    numbered = rows.withColumn("place", place).join(before, [*group, "part"]).withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    per_page = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))), F.lit(1))
    paged = numbered.withColumn("page", F.floor(F.col("place") / per_page))
    totals = paged.groupBy(*group, "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    return paged.join(totals, [*group, "page"])


def shard_rows(df: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_bytes``, its ``shard`` (depth and prefix of the key hash; text hash and page where needed), ``depth`` and ``shard_bytes``."""
    text = F.coalesce(df[text_col], F.lit(""))
    rows = written(df.select(
        df[id_col].alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        leading_bits(F.coalesce(df[id_col].cast("string"), F.lit(""))).alias("h1"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("h2"),
    ), "shard-keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first_depth = max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS
    parts, same_key = split_buckets(rows, [], "h1", limit, first_depth)
    result = None

    def add(part: DataFrame, shard: Column, depth: Column) -> None:
        nonlocal result
        out = part.select("doc_id", "n_bytes", shard.alias("shard"), depth.cast("int").alias("depth"), "shard_bytes")
        result = out if result is None else result.unionByName(out)

    for part in parts:
        add(part, F.concat_ws(":", "depth", "at"), F.col("depth"))
    if same_key is not None:
        parts, identical = split_buckets(written(same_key, "same-key"), ["h1"], "h2", limit, SPARE_BITS)
        for part in parts:
            add(part, F.concat_ws(":", F.lit(HASH_BITS), "h1", "depth", "at"), HASH_BITS + F.col("depth"))
        if identical is not None:
            add(overflow_pages(identical, limit), F.concat_ws(":", F.lit(HASH_BITS), "h1", F.lit(HASH_BITS), "h2", "page"), F.lit(2 * HASH_BITS))
    return result
