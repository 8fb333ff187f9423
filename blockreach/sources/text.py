"""CSV sources: schedules, job counts, census tables, adjacency, result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from blockreach.functions.naming import STATE_FIPS

# Fixed value: the share of job rows that must lie in the expected state.
JOB_STATE_SHARE = 0.95


def read_text_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A headed CSV with every column as text; ``None`` where the path does not exist."""
    try:
        return spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_schedule_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Requested columns of one schedule file that exist in it; no rows if the file or all columns are absent."""
    table = read_text_table(spark, path)
    present = [] if table is None else [c for c in columns if c in table.columns]
    if not present:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return table.select(*present)


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """One table over several feeds with ``feed_idx`` counting them; missing columns become null."""
    out: DataFrame | None = None
    for i, feed in enumerate(feeds):
        part = feed.withColumn("feed_idx", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def jobs_by_block(rows: DataFrame) -> DataFrame:
    """``(block_id, jobs)`` from workplace rows ``w_geocode, C000``; missing counts are zero."""
    return rows.groupBy(F.col("w_geocode").cast("string").alias("block_id")).agg(
        F.sum(F.coalesce(F.col("C000").try_cast("double"), F.lit(0.0))).alias("jobs")
    )


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job counts by work block from a workplace CSV."""
    return jobs_by_block(spark.read.csv(path, header=True, inferSchema=False).select("w_geocode", "C000"))


def in_state(rows: DataFrame, state: str) -> bool:
    """Whether the rows of a job file lie in a state; unknown states accept, empty files do not."""
    fips = STATE_FIPS.get(state.strip().lower())
    if fips is None:
        return True
    share = rows.agg(F.avg(F.col("w_geocode").startswith(fips).cast("double"))).first()[0]
    return share is not None and share >= JOB_STATE_SHARE


def choose_job_source(
    candidates: dict[str, DataFrame | None], state: str, prefer_state: bool = True
) -> tuple[str, DataFrame]:
    """First usable of the ``state``, ``city`` and ``legacy_city`` job tables, in order of preference."""
    order = ["state", "city", "legacy_city"] if prefer_state else ["city", "legacy_city", "state"]
    rejected = []
    for scope in order:
        rows = candidates.get(scope)
        if rows is None:
            continue
        if in_state(rows, state):
            return scope, rows
        rejected.append(scope)
    raise FileNotFoundError(f"No valid job file found. Checked: {order}; not in state {state}: {rejected}")


def find_job_source(spark: SparkSession, root: str, city: str, state: str, prefer_state: bool = True) -> tuple[str, DataFrame]:
    """Choose among ``state/{state}``, ``city/{city}`` and ``{city}`` below ``root``."""
    folders = {"state": f"{root}/state/{state}", "city": f"{root}/city/{city}", "legacy_city": f"{root}/{city}"}
    return choose_job_source({k: read_first_vintage(spark, f"{v}/wac_JT00_*.csv") for k, v in folders.items()}, state, prefer_state)


def read_first_vintage(spark: SparkSession, pattern: str) -> DataFrame | None:
    """The first file in order of name that matches; ``None`` where none does."""
    try:
        files = spark.read.format("binaryFile").load(pattern).agg(F.min("path")).first()  # names only, no content
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return read_text_table(spark, files[0]) if files[0] else None


def tract_ids(rows: DataFrame) -> DataFrame:
    """Add ``tract_geoid``: GEOID padded on the left to eleven characters."""
    if "GEOID" not in rows.columns:
        raise KeyError("Demographic table is missing GEOID.")
    geoid = F.col("GEOID").cast("string")
    padded = F.when(F.length(geoid) < 11, F.lpad(geoid, 11, "0")).otherwise(geoid)
    return rows.withColumn("tract_geoid", padded)


def census_tracts(rows: DataFrame) -> DataFrame:
    """Add ``tract_geoid`` from GEO_ID; label rows and other geographies have none and are dropped."""
    if "GEO_ID" not in rows.columns:
        raise KeyError("Census table is missing GEO_ID.")
    found = F.regexp_extract("GEO_ID", r"US(\d{11})", 1)
    return rows.withColumn("tract_geoid", F.nullif(found, F.lit(""))).where(F.col("tract_geoid").isNotNull())


def labelled_columns(metadata: DataFrame, label: str = "with a disability") -> DataFrame:
    """Estimate columns (names ending in E) whose label mentions a phrase, in any case."""
    name, text = F.col("Column Name"), F.col("Label")
    return metadata.where(name.endswith("E") & F.lower(text).contains(label.lower())).select("Column Name")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Adjacency pairs with their ids as text."""
    return spark.read.csv(path, header=True, schema="src_block_id string, dst_block_id string")


def pooled_results(results: DataFrame, model: str | None = None, cities: bool = False) -> DataFrame:
    """Test-split rows of a metric table, pooled or per city, labelled by model."""
    rows = results.where((F.col("split") == "test") & ((F.col("city") != "__all__") if cities else (F.col("city") == "__all__")))
    if "experiment" in results.columns:
        rows = rows.where(F.col("experiment") == "pooled_spatial_cv")
    return rows if model is None else rows.withColumn("model", F.lit(model))
