"""Tract demographics: raw census tables to 24 predictors, attached to blocks with imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from blockreach.functions.naming import tract_of
from blockreach.functions.numeric import census_number, safe_divide, sum_present
from blockreach.operators.quantiles import medians

# Predictor names, and the source columns they come from.
ACS_FEATURES = (
    "acs_population", "acs_population_density_per_km2", "acs_median_household_income", "acs_poverty_share",
    "acs_unemployment_share", "acs_white_non_hispanic_share", "acs_black_share", "acs_hispanic_share",
    "acs_asian_share", "acs_age_under_18_share", "acs_age_65_plus_share", "acs_bachelor_or_higher_share",
    "acs_avg_commute_time_min", "acs_commute_60_plus_min_share", "acs_vacant_housing_share",
    "acs_median_contract_rent", "acs_median_age", "acs_zero_vehicle_household_share",
    "acs_public_transit_commute_share", "acs_car_commute_share", "acs_walk_commute_share",
    "acs_bike_commute_share", "acs_work_from_home_share", "acs_disability_share",
)
NUMBERS = {
    "acs_population": "B03002EST1",
    "acs_median_household_income": "B19013EST1",
    "acs_avg_commute_time_min": "B08013_AVG_TTW",
    "acs_median_contract_rent": "B25058EST1",
    "acs_median_age": "B01002_001E",
}
SHARES = {
    "acs_white_non_hispanic_share": "B03002EST3_PCT",
    "acs_black_share": "B03002EST4_PCT",
    "acs_asian_share": "B03002EST6_PCT",
    "acs_hispanic_share": "B03002EST12_PCT",
    "acs_age_under_18_share": "B01001_UNDER17_PCT",
    "acs_age_65_plus_share": "B01001_ABOVE64_PCT",
    "acs_poverty_share": "B17021EST2_PCT",
    "acs_unemployment_share": "B23001_UE_PCT",
    "acs_commute_60_plus_min_share": "B08303_60PLUS_TTW_PCT",
    "acs_vacant_housing_share": "B25002EST3_PCT",
}
RATIOS = {
    "acs_zero_vehicle_household_share": ("B08201_002E", "B08201_001E"),
    "acs_car_commute_share": ("B08301_002E", "B08301_001E"),
    "acs_public_transit_commute_share": ("B08301_010E", "B08301_001E"),
    "acs_bike_commute_share": ("B08301_018E", "B08301_001E"),
    "acs_walk_commute_share": ("B08301_019E", "B08301_001E"),
    "acs_work_from_home_share": ("B08301_021E", "B08301_001E"),
}
DEGREE_COLUMNS = ("BD_25TO34", "GD_25TO34", "BD_35TO44", "GD_35TO44", "BD_45TO64", "GD_45TO64", "BD_65UP", "GD_65UP")
ADULT_COLUMNS = ("AGE_25TO34", "AGE_35TO44", "AGE_45TO64", "AGE_65UP")


def join_tract_tables(demographic: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    """All tract tables side by side; tracts missing from a later table keep nulls."""
    out = demographic
    for table in others:
        fresh = [c for c in table.columns if c == "tract_geoid" or c not in out.columns]
        out = out.join(table.select(*fresh), "tract_geoid", "left")
    return out


def tract_features(tables: DataFrame, disability_columns: Sequence[str]) -> DataFrame:
    """The 24 predictors (nulls where a source is missing) from the joined tract tables.

    Every source column is parsed once, in a projection of its own, which also keeps the generated code short.
    """
    sources = [*NUMBERS.values(), *SHARES.values(), *[s for pair in RATIOS.values() for s in pair], "B03002EST1", "Shape__Area", "B18101_001E"]
    optional = [n for n in (*DEGREE_COLUMNS, *ADULT_COLUMNS, *disability_columns) if n in tables.columns]
    parsed = tables.select("tract_geoid", *[census_number(F.col(n)).alias(n) for n in dict.fromkeys([*sources, *optional])])
    c = F.col
    values = {name: c(src) for name, src in NUMBERS.items()}
    values |= {name: c(src) / 100.0 for name, src in SHARES.items()}
    values |= {name: safe_divide(c(a), c(b)) for name, (a, b) in RATIOS.items()}
    values["acs_population_density_per_km2"] = safe_divide(c("B03002EST1"), c("Shape__Area") / 1e6)
    values["acs_bachelor_or_higher_share"] = safe_divide(
        sum_present(tables.columns, DEGREE_COLUMNS, F.col), sum_present(tables.columns, ADULT_COLUMNS, F.col)
    )
    values["acs_disability_share"] = safe_divide(sum_present(tables.columns, disability_columns, F.col), c("B18101_001E"))
    return parsed.select("tract_geoid", *[values[n].alias(n) for n in ACS_FEATURES])


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median of every column; zero for a column without values."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "column", "value")
    found = {r["column"]: r["m"] for r in medians(long, "value", ["column"], "m").collect()}  # one row per column
    return {c: float(found.get(c) or 0.0) for c in columns}


def impute_medians(df: DataFrame, columns: Sequence[str] = ACS_FEATURES) -> DataFrame:
    """Fill nulls with the column median."""
    return df.na.fill(column_medians(df, columns), list(columns))


def missing_counts(df: DataFrame, columns: Sequence[str] = ACS_FEATURES) -> DataFrame:
    """``(column, n_missing)`` for every column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n_missing")


def attach_to_blocks(block_ids: DataFrame, tracts: DataFrame, columns: Sequence[str] = ACS_FEATURES) -> DataFrame:
    """Tract predictors per block; blocks of an unknown tract get the tract medians."""
    joined = block_ids.select("block_id").withColumn("tract_geoid", tract_of(F.col("block_id"))).join(
        tracts.select("tract_geoid", *columns), "tract_geoid", "left"
    )
    return joined.na.fill(column_medians(tracts, columns), list(columns)).drop("tract_geoid")
