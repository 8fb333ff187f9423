"""Feature families and the model table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from blockreach.functions.naming import FAMILY_PREFIXES, family_name, node_id
from blockreach.operators import checks
from blockreach.session import cut_lineage

# Commuting-behaviour columns left out by one of the feature sets.
COMMUTE_COLUMNS = (
    "acs_avg_commute_time_min", "acs_commute_60_plus_min_share", "acs_public_transit_commute_share",
    "acs_car_commute_share", "acs_walk_commute_share", "acs_bike_commute_share", "acs_work_from_home_share",
)
FEATURE_SETS = {
    "pt": ("pt",), "be": ("be",), "acs": ("acs",),
    "pt_be": ("pt", "be"), "pt_acs": ("pt", "acs"), "be_acs": ("be", "acs"),
}


def combine_features(blocks: DataFrame, *families: DataFrame) -> DataFrame:
    """Feature families side by side, one row per listed block."""
    out = blocks.select("block_id")
    for family in families:
        out = out.join(family, "block_id", "left")
    checks.require_no_leakage([c for c in out.columns if c != "block_id"])
    return out


def feature_set(features: Sequence[str], name: str, reduced: Sequence[str] | None = None) -> list[str]:
    """Columns of a named feature set, in table order (a reduced list keeps its own order)."""
    if name == "full":
        chosen = list(features)
    elif name == "reduced":
        unknown = [f for f in reduced or [] if f not in features]
        if unknown:
            raise ValueError(f"Reduced feature set contains unknown features: {unknown}")
        chosen = list(reduced or [])
    elif name == "full_no_acs_commute":
        chosen = [f for f in features if f not in COMMUTE_COLUMNS]
    elif name in FEATURE_SETS:
        chosen = [f for f in features if family_name(f) in FEATURE_SETS[name]]
    else:
        raise ValueError(f"Unknown feature set: {name}")
    if not chosen:
        raise ValueError(f"Feature set '{name}' selected no columns.")
    return chosen


def family_counts(features: Sequence[str]) -> dict[str, int]:
    """Number of features per family."""
    return {k: sum(f.startswith(p) for f in features) for k, p in FAMILY_PREFIXES.items()}


def near_constant(df: DataFrame, features: Sequence[str], limit: float = 1e-12) -> DataFrame:
    """``(feature, variance)`` of features whose sample variance is at most ``limit``."""
    stats = df.agg(*[F.var_samp(f).alias(f) for f in features])
    return stats.unpivot([], list(features), "feature", "variance").where(F.col("variance") <= limit)


def assemble(
    features: DataFrame,
    target: DataFrame,
    splits: DataFrame,
    feature_columns: Sequence[str],
    target_column: str = "Y",
    validate: bool = True,
) -> DataFrame:
    """Join approved features, the target and the split labels; every feature row must survive."""
    checks.require_no_leakage(feature_columns)
    checks.require_columns(features, ["block_id", *feature_columns], "feature table")
    checks.require_columns(target, ["block_id", target_column], "target table")
    checks.require_columns(splits, ["block_id", "split"], "split table")
    cell = ["spatial_cell"] if "spatial_cell" in splits.columns else []
    numeric = [*feature_columns, target_column]
    sides = [
        table.select(F.col("block_id").cast("string"), *columns, F.lit(True).alias(mark))
        for table, columns, mark in ((features, feature_columns, "in_f"), (target, [target_column], "in_t"), (splits, ["split", *cell], "in_s"))
    ]
    out = sides[0].join(sides[1], "block_id", "full").join(sides[2], "block_id", "full")
    complete = F.col("in_f") & F.col("in_t") & F.col("in_s")
    if validate:
        # Written once; all rules and counts are one pass over it.
        out = cut_lineage(out)
        rules = checks.model_rules(numeric)
        per_block = out.groupBy("block_id").agg(
            F.count(F.lit(1)).alias("copies"), F.count_if("in_f").alias("rows"), F.count_if(complete).alias("whole"),
            *[F.count_if(F.coalesce(complete, F.lit(False)) & F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()],
            *[F.count_if(complete & (F.col("split") == s)).alias(f"split:{s}") for s in checks.SPLITS],
        )
        sums = [n for n in per_block.columns if n not in {"block_id", "copies"}]
        stats = per_block.agg(F.max("copies").alias("copies"), *[F.coalesce(F.sum(f"`{n}`"), F.lit(0)).alias(n) for n in sums]).first()  # one row
        if (stats["copies"] or 0) > 1:
            for table, what in ((features, "Feature table"), (target, "Target table"), (splits, "Split table")):
                checks.require_unique(table, "block_id", what=what)
        if stats["whole"] != stats["rows"]:
            raise ValueError(f"Model dataset has {stats['whole']} rows, expected {stats['rows']}.")
        broken = [name for name in rules if stats[name]]
        if broken:
            raise ValueError(f"Model dataset breaks rules: {broken}")
        absent = [s for s in checks.SPLITS if not stats[f"split:{s}"]]
        if absent:
            raise ValueError(f"Model dataset has no rows for splits: {absent}")
    return out.where(complete).drop("in_f", "in_t", "in_s").withColumns({c: F.col(c).try_cast("double") for c in numeric})


def multi_city(tables: dict[str, DataFrame], feature_columns: dict[str, Sequence[str]]) -> DataFrame:
    """City tables as one, with ``city`` and ``node_id``; all cities must list the same features in order."""
    lists = {tuple(v) for v in feature_columns.values()}
    if len(lists) > 1:
        raise ValueError("Feature columns differ between cities.")
    out: DataFrame | None = None
    for city, table in tables.items():
        part = table.withColumn("city", F.lit(city)).withColumn("node_id", node_id(F.lit(city), F.col("block_id")))
        out = part if out is None else out.unionByName(part)
    return out


def swap_target(dataset: DataFrame, values: DataFrame, target_column: str, value_column: str) -> DataFrame:
    """Replace the label by another view of it, matched on ``node_id``; every row must have exactly one."""
    checks.require_unique(values, "node_id", what="target view")
    if not dataset.join(values, "node_id", "left_anti").isEmpty():
        raise ValueError("The target view lacks rows of the dataset.")
    return dataset.drop(target_column).join(
        values.select("node_id", F.col(value_column).alias(target_column)), "node_id"
    )


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """Join in which every left row may have at most one partner; with ``one_to_one`` right rows too."""
    if one_to_one:
        checks.require_unique(left, *on, what="left side")
    checks.require_unique(right, *on, what="right side")
    return left.join(right, list(on), how)
