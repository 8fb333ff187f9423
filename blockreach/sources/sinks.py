"""Writers: tables, layouts for box predicates, refreshed parts, one-row run records, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockreach.session import ensure_checkpoint_dir


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, by: str | None = "city", csv: bool = True, mode: str = "overwrite") -> None:
    """Write a table as Parquet, partitioned by ``by`` when it has that column, and as CSV beside it."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by and by in df.columns else writer).parquet(f"{path}/parquet")
    if csv:
        df.write.mode(mode).option("header", True).csv(f"{path}/csv")


def write_record(df: DataFrame, figures: dict[str, Column], settings: dict[str, object], path: str) -> None:
    """Write figures aggregated from a table, with fixed settings, as a one-row JSON file."""
    row = df.agg(*[c.alias(n) for n, c in figures.items()])
    row = row.withColumns({k: F.lit(v) for k, v in settings.items()}) if settings else row
    row.coalesce(1).write.mode("overwrite").json(path)  # one row


def write_backbone(blocks: DataFrame, centroids: DataFrame, edges: DataFrame, path: str) -> None:
    """Blocks (nested-array geometry), block points and adjacency as Parquet."""
    for name, df in (("blocks", blocks), ("centroids", centroids), ("adjacency", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


# Positions along each axis of the space-filling curve, as a power of two.
CURVE_BITS = 16


def _apart(value: Column) -> Column:
    """The lower 16 bits of a number with a zero after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return value


def curve_position(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Place of a point along a space-filling curve over ``box`` (minx, miny, maxx, maxy): bits of x and y in turn.

    Points outside count as on the border; null coordinates have no place.
    """
    top = (1 << CURVE_BITS) - 1

    def step(value: Column, low: float, high: float) -> Column:
        share = (value - F.lit(float(low))) / F.lit(float(high - low) or 1.0)
        return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * top).cast("bigint")

    return _apart(step(x, box[0], box[2])).bitwiseOR(F.shiftleft(_apart(step(y, box[1], box[3])), 1))


def write_clustered(df: DataFrame, path: str, group_bytes: int = 16 << 20) -> None:
    """Write a table with box columns (minx, miny, maxx, maxy) as Parquet in the order of a space-filling curve.

    Rows near each other share row groups of about ``group_bytes``, so a box predicate skips those that
    lie elsewhere. Rows without a box come first. An empty table is written with its columns.
    """
    reach = df.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    box = tuple(0.0 if v is None else float(v) for v in reach)
    place = curve_position((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, box)
    rows = df.withColumn("place_", place).repartitionByRange("place_").sortWithinPartitions("place_").drop("place_")
    rows.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def _manifest(df: DataFrame, by: str) -> DataFrame:
    """Rows and an order-free checksum per part of a table, over columns in name order."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("checksum"))


def refresh_parts(df: DataFrame, path: str, by: str = "city") -> None:
    """Replace in ``path`` the parts (cities) that ``df`` holds; other parts stay as they are.

    Spark stages all parts and puts them in place when the whole job has succeeded, so a failed write
    leaves the old parts. Their manifest rows follow the data; :func:`unsettled_parts` names parts
    for which it did not come to that. Doing the same twice gives the same table.
    """
    def put(rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/{folder}")

    put(df, "data")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    put(_manifest(stored.join(df.select(by).distinct(), by, "left_semi"), by), "manifest")


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table written by :func:`refresh_parts`."""
    return spark.read.schema(schema).parquet(f"{path}/data")


def unsettled_parts(spark: SparkSession, path: str, schema: str, by: str = "city") -> DataFrame:
    """Parts whose rows are not those of the manifest."""
    rows = read_parts(spark, path, schema)
    kept = spark.read.schema(f"n_rows bigint, checksum string, {by} {dict(rows.dtypes)[by]}").parquet(f"{path}/manifest")
    now = _manifest(rows, by).withColumnsRenamed({"n_rows": "n_now", "checksum": "checksum_now"})
    return now.join(kept, by, "full").where("n_rows IS DISTINCT FROM n_now OR checksum IS DISTINCT FROM checksum_now").select(by)
