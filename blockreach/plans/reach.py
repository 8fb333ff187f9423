"""Straight-line reachability and opportunity-score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockreach.functions import tags as T
from blockreach.functions.naming import node_id
from blockreach.operators import target as tg
from blockreach.operators.proximity import radius_sums
from blockreach.plans import carriers as C
from blockreach.plans.registry import q6, query, r6, rounded

CATS = T.CATEGORIES
KM = C.RADII_KM


def categorised(spark: SparkSession, folder: str) -> DataFrame:
    df = C.tagged_points(spark, folder)
    leisure = T.tag_value(F.col("other_tags"), "leisure")
    return df.withColumn("category", T.amenity_category(F.col("amenity"), F.col("shop"), leisure)).where(
        F.col("category").isNotNull()
    )


def reach_table(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs and amenities within 1..5 km of every block."""
    origins = C.blocks(spark, folder)
    jobs = tg.reachable_jobs(origins, C.job_sites(spark, folder).where(F.col("jobs") > 0), C.RADII_M)
    amenities = tg.reachable_amenities(origins, categorised(spark, folder), C.RADII_M)
    return origins.select("block_id", "city").join(jobs, "block_id").join(amenities, "block_id")


_D = "sqrt((b.x - d.x) * (b.x - d.x) + (b.y - d.y) * (b.y - d.y))"
JOB_SUMS = ", ".join(f"coalesce(sum(d.jobs) FILTER (WHERE {_D} <= {r}000), 0.0) AS jobs_{r}km" for r in KM)
AMEN_SUMS = ", ".join(
    f"CAST(count(*) FILTER (WHERE d.category = '{c}' AND {_D} <= {r}000) AS DOUBLE) AS amen_{c}_{r}km" for c in CATS for r in KM
)
REACH_SQL = f"""{C.BLOCKS_SQL}, {C.JOBS_SQL}, {C.AMENITIES_SQL},
reach_jobs AS (SELECT b.block_id, {JOB_SUMS} FROM blocks b, jobs d WHERE d.jobs > 0 GROUP BY b.block_id),
reach_amen AS (SELECT b.block_id, {AMEN_SUMS} FROM blocks b, categorised d WHERE d.category IS NOT NULL GROUP BY b.block_id),
reach AS (SELECT b.block_id, b.city, j.* EXCLUDE (block_id), a.* EXCLUDE (block_id)
          FROM blocks b JOIN reach_jobs j ON b.block_id = j.block_id JOIN reach_amen a ON b.block_id = a.block_id)"""

_JOB_OUT = ", ".join(f"{q6(f'jobs_{r}km', 4)} AS jobs_{r}km" for r in KM)
_AMEN_OUT = ", ".join(f"amen_{c}_{r}km" for c in CATS for r in KM)


@query("ag09_reachable_jobs", f"WITH {REACH_SQL} SELECT block_id, {_JOB_OUT} FROM reach_jobs")
def _(spark, folder):
    sites = C.job_sites(spark, folder).where(F.col("jobs") > 0)
    return rounded(tg.reachable_jobs(C.blocks(spark, folder), sites, C.RADII_M), digits=4)


@query("ag10_reachable_amenities", f"WITH {REACH_SQL} SELECT block_id, {_AMEN_OUT} FROM reach_amen")
def _(spark, folder):
    return tg.reachable_amenities(C.blocks(spark, folder), categorised(spark, folder), C.RADII_M)


def _norm_sql(column: str, over: str) -> str:
    return (
        f"CASE WHEN max({column}) OVER {over} > min({column}) OVER {over} THEN ({column} - min({column}) OVER {over}) / "
        f"(max({column}) OVER {over} - min({column}) OVER {over}) ELSE 0.0 END"
    )


def target_sql(over: str) -> str:
    jobs = ", ".join(f"{_norm_sql(f'jobs_{r}km', over)} AS jobs_norm_{r}km" for r in KM)
    amen = ", ".join(
        f"({' + '.join(_norm_sql(f'amen_{c}_{r}km', over) for c in CATS)}) / 5 AS amenity_norm_mean_{r}km" for r in KM
    )
    e = " + ".join(f"jobs_norm_{r}km * {tg.DISTANCE_WEIGHTS[r]}" for r in KM)
    a = " + ".join(f"amenity_norm_mean_{r}km * {tg.DISTANCE_WEIGHTS[r]}" for r in KM)
    return f"""norms AS (SELECT *, {jobs}, {amen} FROM reach),
parts AS (SELECT *, {e} AS E, {a} AS A FROM norms),
target AS (SELECT *, 0.5 * E + 0.5 * A AS Y, 0.6 * E + 0.4 * A AS Y_60_40, 0.4 * E + 0.6 * A AS Y_40_60 FROM parts)"""


_SCORES = ", ".join(f"{q6(c)} AS {c}" for c in ("E", "A", "Y", "Y_60_40", "Y_40_60"))
_NORMS = ", ".join(f"{q6(c)} AS {c}" for r in KM for c in (f"jobs_norm_{r}km", f"amenity_norm_mean_{r}km"))
CITY_TARGET_SQL = f"WITH {REACH_SQL}, {target_sql('(PARTITION BY city)')} SELECT block_id, city, {_SCORES}, {_NORMS}, {_JOB_OUT}, {_AMEN_OUT} FROM target"


@query("ag21_city_target", CITY_TARGET_SQL)
def city_scores(spark, folder):
    df = tg.city_target(reach_table(spark, folder), by=["city"], base=["block_id", "city"])
    return df.select(*[
        r6(F.col(n), 4 if n.startswith("jobs_") and not n.startswith("jobs_norm") else 6).alias(n) if t == "double" else F.col(n)
        for n, t in df.dtypes
    ])


@query("jn13_sites_within_radius", f"WITH {REACH_SQL} SELECT b.block_id, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE {_D} <= {r}000) AS DOUBLE) AS sites_{r}km" for r in KM) + " FROM blocks b, jobs d GROUP BY b.block_id")
def _(spark, folder):
    sites = C.job_sites(spark, folder).withColumn("sites", F.lit(1.0))
    return radius_sums(C.blocks(spark, folder), "block_id", sites, ["sites"], C.RADII_M, lambda m, r: f"{m}_{int(r / 1000)}km")
