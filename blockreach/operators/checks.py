"""Quality gates. Row rules give a report table; the ``require_*`` forms raise when a rule is broken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Names that would leak the target or the position into the predictors.
TARGET_PREFIXES = ("jobs_", "amen_", "amenity_", "E_", "A_", "Y_")
TARGET_COLUMNS = ("E", "A", "Y", "Y_60_40", "Y_40_60", "x_m", "y_m", "lon", "lat", "split", "spatial_cell")
SPLITS = ("train", "val", "test")


def leaking_columns(features: Sequence[str]) -> list[str]:
    """Feature names that are target ingredients, positions or split labels."""
    return [f for f in features if f in TARGET_COLUMNS or f.startswith(TARGET_PREFIXES)]


def require_no_leakage(features: Sequence[str]) -> None:
    bad = leaking_columns(features)
    if bad:
        raise ValueError(f"Model feature list contains leakage-prone columns: {bad}")


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"{what} is missing columns: {missing}")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, *keys: str, what: str = "table") -> None:
    if not duplicate_keys(df, *keys).isEmpty():
        raise ValueError(f"{what} contains duplicate {', '.join(keys)} values.")


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, n_bad, passed)``; a rule is a row predicate that marks a bad row. One pass for all rules."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n_bad").withColumn("passed", F.col("n_bad") == 0)


def bad_number(name: str) -> Column:
    """True where a value is missing, not a number or infinite."""
    value = F.col(name).try_cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def model_rules(columns: Sequence[str]) -> dict[str, Column]:
    """Rules of a model table: every feature and the target are finite numbers, the split is known."""
    rules = {f"finite:{c}": bad_number(c) for c in columns}
    rules["known_split"] = F.col("split").isNull() | ~F.col("split").isin(list(SPLITS))
    return rules


def missing_splits(df: DataFrame) -> list[str]:
    """Split labels without any row."""
    present = {r[0] for r in df.select("split").where(F.col("split").isin(list(SPLITS))).distinct().collect()}
    return [s for s in SPLITS if s not in present]


def coverage(df: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """``(rule, n_bad, passed)``: rows of ``df`` without a partner in each of the other tables."""
    marked = df.select(key)
    for name, other in others.items():
        marked = marked.join(other.select(key, F.lit(1).alias(f"in_{name}")).distinct(), key, "left")
    return rule_report(marked, {f"covered_by_{n}": F.col(f"in_{n}").isNull() for n in others})


def require_known(df: DataFrame, column: Column, what: str) -> None:
    """Raise when a looked-up value is null, naming a few of the offending rows."""
    bad = df.where(column.isNull()).limit(5).collect()
    if bad:
        raise ValueError(f"{what}: {[tuple(r) for r in bad]}")
