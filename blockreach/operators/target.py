"""Opportunity score: reachable jobs and amenities, normalisation, city and cross-city targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from blockreach.functions.numeric import log1p_floor, minmax, row_mean, weighted_sum
from blockreach.functions.tags import CATEGORIES
from blockreach.operators.proximity import radius_sums
from blockreach.session import cut_lineage

# Radii, distance weights and the mixes of the score.
RADII_KM = (1, 2, 3, 4, 5)
DISTANCE_WEIGHTS = {1: 0.30, 2: 0.25, 3: 0.20, 4: 0.15, 5: 0.10}
SCORE_MIXES = {"Y": (0.5, 0.5), "Y_60_40": (0.6, 0.4), "Y_40_60": (0.4, 0.6)}
GLOBAL_VIEWS = ("global_minmax", "global_log_minmax")
CITY_ALIASES = {"E": "E_city_relative", "A": "A_city_relative", "Y": "Y_city_relative"}


def jobs_column(radius_km: int) -> str:
    return f"jobs_{radius_km}km"


def amenity_column(category: str, radius_km: int) -> str:
    return f"amen_{category}_{radius_km}km"


def reachable_jobs(
    origins: DataFrame, sites: DataFrame, radii_m: Sequence[float], origin_id: str = "block_id", by: Sequence[str] = ()
) -> DataFrame:
    """Jobs within each straight-line radius of each origin (``jobs_{r}km``)."""
    return radius_sums(origins, origin_id, sites, ["jobs"], radii_m, lambda m, r: jobs_column(int(r / 1000)), by)


def reachable_amenities(
    origins: DataFrame,
    amenities: DataFrame,
    radii_m: Sequence[float],
    categories: Sequence[str] = CATEGORIES,
    origin_id: str = "block_id",
    by: Sequence[str] = (),
) -> DataFrame:
    """Amenities of each category within each straight-line radius (``amen_{category}_{r}km``)."""
    flags = amenities.select(
        *by, "x", "y", *[(F.col("category") == c).cast("double").alias(c) for c in categories]
    )
    return radius_sums(
        origins, origin_id, flags, categories, radii_m, lambda c, r: amenity_column(c, int(r / 1000)), by
    )


def column_ranges(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), value=F.col) -> DataFrame:
    """Minimum and maximum of every column in one pass (``lo__c``, ``hi__c``), per ``by`` group."""
    stats = [f(value(c)).alias(f"{p}__{c}") for c in columns for f, p in ((F.min, "lo"), (F.max, "hi"))]
    return df.groupBy(*by).agg(*stats)


def normalise(
    df: DataFrame, columns: dict[str, str], by: Sequence[str] = (), value=F.col
) -> DataFrame:
    """Min-max scale ``{source: output}`` over the table, or within each ``by`` group."""
    if not by:
        df = cut_lineage(df)  # read for its extremes, then again for the result
    ranges = column_ranges(df, list(columns), by, value)
    if by:
        joined = df.join(ranges, list(by))
        low, high = (lambda c: F.col(f"lo__{c}")), (lambda c: F.col(f"hi__{c}"))
    else:
        extremes = ranges.first()  # one row
        joined = df
        low = lambda c: F.lit(extremes[f"lo__{c}"]).cast("double")
        high = lambda c: F.lit(extremes[f"hi__{c}"]).cast("double")
    scaled = {out: minmax(value(c).cast("double"), low(c), high(c)) for c, out in columns.items()}
    return joined.withColumns(scaled).drop(*[f"{p}__{c}" for c in columns for p in ("lo", "hi")])


def city_target(
    reach: DataFrame,
    radii_km: Sequence[int] = RADII_KM,
    categories: Sequence[str] = CATEGORIES,
    weights: dict[int, float] = DISTANCE_WEIGHTS,
    by: Sequence[str] = (),
    base: Sequence[str] = ("block_id",),
) -> DataFrame:
    """Employment part E, amenity part A and the three score mixes from reachability columns."""
    sources = {jobs_column(r): f"jobs_norm_{r}km" for r in radii_km}
    sources |= {amenity_column(c, r): f"_norm_{c}_{r}" for c in categories for r in radii_km}
    df = normalise(reach, sources, by)
    df = df.withColumns({
        f"amenity_norm_mean_{r}km": row_mean([F.col(f"_norm_{c}_{r}") for c in categories]) for r in radii_km
    })
    df = df.withColumns({
        "E": weighted_sum({f"jobs_norm_{r}km": weights[r] for r in radii_km}),
        "A": weighted_sum({f"amenity_norm_mean_{r}km": weights[r] for r in radii_km}),
    })
    df = df.withColumns({y: e * F.col("E") + a * F.col("A") for y, (e, a) in SCORE_MIXES.items()})
    order = [
        *base, "E", "A", *SCORE_MIXES,
        *[jobs_column(r) for r in radii_km],
        *[f"jobs_norm_{r}km" for r in radii_km],
        *[f"amenity_norm_mean_{r}km" for r in radii_km],
        *[amenity_column(c, r) for c in categories for r in radii_km],
    ]
    return df.select(*order)


def global_target(
    components: DataFrame,
    view: str,
    radii_km: Sequence[int] = RADII_KM,
    categories: Sequence[str] = CATEGORIES,
    weights: dict[int, float] = DISTANCE_WEIGHTS,
) -> DataFrame:
    """Scores comparable across cities: one min-max scale over all rows, raw or after log1p."""
    if view not in GLOBAL_VIEWS:
        raise ValueError(f"Unsupported global target view: {view}")

    def value(name: str) -> Column:
        column = F.col(name).cast("double")
        return log1p_floor(column) if view == "global_log_minmax" else column

    sources = {jobs_column(r): f"jobs_norm_{view}_{r}km" for r in radii_km}
    sources |= {amenity_column(c, r): f"amen_{c}_norm_{view}_{r}km" for c in categories for r in radii_km}
    df = normalise(components, sources, value=value)
    means = {f"amenity_norm_mean_{view}_{r}km": row_mean([F.col(f"amen_{c}_norm_{view}_{r}km") for c in categories]) for r in radii_km}
    df = df.withColumns(means).withColumns({
        f"E_{view}": weighted_sum({f"jobs_norm_{view}_{r}km": weights[r] for r in radii_km}),
    })
    df = df.withColumn(f"A_{view}", weighted_sum({m: weights[r] for m, r in zip(means, radii_km)}))
    df = df.withColumn(f"Y_{view}", 0.5 * F.col(f"E_{view}") + 0.5 * F.col(f"A_{view}"))
    return df.select("node_id", "city", "block_id", *sources.values(), *means, f"E_{view}", f"A_{view}", f"Y_{view}")


def add_global_columns(
    target: DataFrame, global_targets: DataFrame, key: str = "node_id", promote: bool = False
) -> DataFrame:
    """Left-join global score columns onto a stored target table, replacing any older copies.

    The city-relative scores stay available under ``*_city_relative``; with ``promote`` the main
    E/A/Y become the log-scaled global ones. Running it twice gives the same table.
    """
    new = [c for c in global_targets.columns if c not in {"node_id", "city", "block_id"}]
    out = target.withColumns({
        alias: F.col(c) for c, alias in CITY_ALIASES.items() if c in target.columns and alias not in target.columns
    })
    out = out.drop(*new).join(global_targets.select(key, *new), key, "left")
    if promote:
        out = out.withColumns({c: F.col(f"{c}_global_log_minmax") for c in CITY_ALIASES})
    return out
