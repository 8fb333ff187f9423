"""Feature and target views of a multi-city model table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from blockreach.functions.numeric import log1p_floor
from blockreach.operators.dataset import swap_target
from blockreach.operators.quantiles import join_null_safe, percentile_rank
from blockreach.operators.target import GLOBAL_VIEWS, global_target

# View names, city-context sources, and words marking skewed magnitudes.
FEATURE_VIEWS = ("raw", "log1p", "city_zscore", "raw_plus_city_context", "city_zscore_plus_city_context")
TARGET_VIEWS = ("stored", "city_relative", "global_minmax", "global_log_minmax", "city_rank")
ABLATION_SETS = ("full", "pt", "be", "acs", "pt_be", "full_no_acs_commute")
CONTEXT_SOURCES = (
    "pt_stop_density_per_km2", "pt_route_count", "pt_weekday_departures", "pt_peak_departures",
    "pt_stops_within_800m", "pt_departures_within_800m", "pt_stops_within_2000m", "pt_departures_within_2000m",
    "be_street_length_density_m_per_km2", "be_intersection_density_per_km2", "be_bikeable_street_share",
    "acs_population_density_per_km2", "acs_median_household_income", "acs_poverty_share",
    "acs_zero_vehicle_household_share", "acs_public_transit_commute_share",
)
LOG_WORDS = (
    "count", "density", "departures", "routes", "stops", "length", "income", "rent", "population", "dist_m", "area_m2",
)


def expand(requested: Sequence[str], group: str, members: Sequence[str]) -> list[str]:
    """Requested names in order without repeats, with a group name standing for its members."""
    names = list(members) if group in requested else [n for n in requested if n != group]
    out = list(dict.fromkeys(names))
    if not out:
        raise ValueError("At least one name must be selected.")
    return out


def log_columns(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Magnitude columns to log: named like one, never negative, and exceeding one. All rows count."""
    named = [f for f in features if any(w in f for w in LOG_WORDS)]
    if not named:
        return []
    row = df.agg(*[f(F.col(c)).alias(f"{p}_{c}") for c in named for f, p in ((F.min, "lo"), (F.max, "hi"))]).first()
    return [c for c in named if row[f"lo_{c}"] is not None and row[f"lo_{c}"] >= 0 and row[f"hi_{c}"] > 1]


def city_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of every column per city (``m__c``, ``s__c``)."""
    return df.groupBy("city").agg(*[f(c).alias(f"{p}__{c}") for c in columns for f, p in ((F.avg, "m"), (F.stddev_samp, "s"))])


def city_zscore(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features centred and scaled within their city; zero where a city has no spread."""
    joined = join_null_safe(df, city_moments(df, features), ["city"])
    scaled = {
        c: F.when(F.col(f"s__{c}") > 0, (F.col(c) - F.col(f"m__{c}")) / F.col(f"s__{c}")).otherwise(0.0) for c in features
    }
    return joined.withColumns({c: F.coalesce(v, F.lit(0.0)) for c, v in scaled.items()}).select(*df.columns)


def city_context(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add each city's mean and deviation of the context sources as extra features."""
    sources = [c for c in CONTEXT_SOURCES if c in features]
    if not sources:
        return df, list(features)
    names = [n for c in sources for n in (f"city_mean__{c}", f"city_std__{c}")]
    moments = city_moments(df, sources).select(
        "city",
        *[e for c in sources for e in (F.col(f"m__{c}").alias(f"city_mean__{c}"), F.coalesce(f"s__{c}", F.lit(0.0)).alias(f"city_std__{c}"))],
    )
    return join_null_safe(df, moments, ["city"]).select(*df.columns, *names), [*features, *names]


def feature_view(df: DataFrame, features: Sequence[str], view: str) -> tuple[DataFrame, list[str]]:
    """The table under a feature view, and its feature list."""
    if view == "raw":
        return df, list(features)
    if view == "log1p":
        return df.withColumns({c: log1p_floor(F.col(c)) for c in log_columns(df, features)}), list(features)
    if view == "city_zscore":
        return city_zscore(df, features), list(features)
    if view == "raw_plus_city_context":
        return city_context(df, features)
    if view == "city_zscore_plus_city_context":
        return city_context(city_zscore(df, features), features)
    raise ValueError(f"Unknown feature view: {view}")


def target_view(df: DataFrame, view: str, target: str = "Y", components: DataFrame | None = None, **shape) -> DataFrame:
    """The table with its label under a target view; ``components`` holds raw reachability columns."""
    if view in {"stored", "city_relative"}:
        return df
    if view == "city_rank":
        return percentile_rank(df, target, ["city"], "rank_value").drop(target).withColumnRenamed("rank_value", target)
    if view in GLOBAL_VIEWS:
        return swap_target(df, global_target(components, view, **shape), target, f"Y_{view}")
    raise ValueError(f"Unknown target view: {view}")


def standardise_by_train(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Centre and scale columns by the train rows' mean and population deviation (a zero becomes one).

    Also returns ``{column: (mean, deviation)}`` to undo the scaling of predictions.
    """
    row = df.where("split = 'train'").agg(*[f(c).alias(f"{p}_{c}") for c in columns for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    scale = {c: (float(row[f"m_{c}"]), float(row[f"s_{c}"]) or 1.0) for c in columns}
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()}), scale
