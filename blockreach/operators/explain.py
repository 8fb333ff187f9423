"""Feature attributions: sampling, Shapley estimates, summaries, clusters, dependence curves, selection.

Long attribution tables have ``node_id, city, feature, shap`` (and ``feature_value``, ``cluster_id``
where needed).
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from blockreach.functions.naming import direction, family_code, family_name, family_title, feature_label
from blockreach.functions.numeric import minmax, undo_log1p
from blockreach.operators.clusters import fit_starts, nearest_centre
from blockreach.operators.metrics import top_per_group
from blockreach.operators.boosting import BoostedTrees
from blockreach.operators.quantiles import medians, quantiles, tied_ranks
from blockreach.operators.tree_explain import tree_dependence
from blockreach.session import cut_lineage, spread

# Weights of the selection priority.
SHAP_WEIGHT, GAIN_WEIGHT, PROTECTED_BONUS = 0.75, 0.25, 0.15


# --- sampling ---------------------------------------------------------------------------------

def _shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("draw_", F.xxhash64(F.col(key), F.lit(seed)))


def _capped(df: DataFrame, max_rows: int) -> DataFrame:
    return df.orderBy("draw_").limit(max_rows).drop("draw_")


def sample_by_share(df: DataFrame, max_rows: int, seed: int = 42, key: str = "node_id") -> DataFrame:
    """At most ``max_rows`` rows, each city in proportion to its size and with at least one row."""
    sizes = df.groupBy("city").agg(F.count(F.lit(1)).alias("size_"))
    total = sizes.agg(F.sum("size_")).first()[0] or 0
    if max_rows <= 0 or total <= max_rows:
        return df
    quota = sizes.select("city", F.greatest(F.bround(F.col("size_") * (max_rows / total)).cast("bigint"), F.lit(1)).alias("quota_"))
    return _capped(_shuffled(sample_by_quota(df, quota, seed, key), key, seed), max_rows).select(*df.columns)


def sample_by_quota(df: DataFrame, quota: DataFrame, seed: int = 42, key: str = "node_id") -> DataFrame:
    """``quota_`` rows of each city, drawn in hash order.

    Ranks come from range-partitioned positions, so a city with most rows is not sorted in one task.
    """
    ranked = tied_ranks(_shuffled(df, key, seed), "draw_", ["city"], "place_").join(quota, "city")
    return ranked.where("place_ <= quota_").select(*df.columns)


def sample_per_city(df: DataFrame, per_city: int, max_rows: int = 0, seed: int = 42, key: str = "node_id") -> DataFrame:
    """Up to ``per_city`` rows of each city, then at most ``max_rows`` overall (0: no cap)."""
    picked = top_per_group(_shuffled(df, key, seed), ["city"], [F.col("draw_"), F.col(key)], per_city, "place_").drop("place_")
    return (_capped(picked, max_rows) if max_rows > 0 else picked.drop("draw_")).select(*df.columns)


# --- estimates --------------------------------------------------------------------------------

def draw_background(df: DataFrame, draws: int, seed: int = 42, key: str = "node_id") -> DataFrame:
    """``draws`` rows in the order of a hash of their key, so from all cities and the same at every size."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), key).limit(draws)


def shapley_values(model, rows: DataFrame, features: Sequence[str], background: DataFrame, draws: int = 8, seed: int = 42) -> DataFrame:
    """Sampled Shapley values: ``(node_id, feature, feature_value, shap, base_value)``.

    Each draw pairs a background row with a random feature order; features switch from the background
    value to the row's own one by one and every change in prediction goes to the feature switched.
    The values of a row add up to its prediction minus the base value. A draw begins at its background row and ends
    at the row itself, so these are scored once each and only the steps between once per draw. One group per row
    holds plain sums, which hash; arrays kept beside them would have all steps sorted first.
    """
    rng = random.Random(seed)
    names = list(features)
    count = len(names)
    picked = draw_background(background, draws, seed).select(*names).collect()  # at most ``draws`` rows
    starts, places = [], []
    for i in range(draws):
        order = names[:]
        rng.shuffle(order)
        z = picked[i % len(picked)]
        starts.append([float(z[n]) for n in names])
        places.append([order.index(n) for n in names])
    drawn = rows.sparkSession.createDataFrame(list(enumerate(starts)), "draw int, z array<double>")
    base = {r["draw"]: r["y_pred"] for r in model.transform(drawn.select("draw", array_to_vector("z").alias("features"))).select("draw", "y_pred").collect()}
    base_value = sum(base.values()) / draws
    first = [sum(base[d] for d in range(draws) if places[d][i] == 0) for i in range(count)]
    last = [float(sum(places[d][i] == count - 1 for d in range(draws))) for i in range(count)]

    plans = F.array(*[
        F.struct(F.array([F.lit(v) for v in z]).alias("z"), F.array([F.lit(v) for v in at]).alias("pos")) for z, at in zip(starts, places)
    ])
    between = max(count - 1, 1)
    s = F.col("step")  # 0: the row itself
    steps = (
        rows.select("node_id", *[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(draws * (count - 1)))))
        .withColumn("k", F.when(s == 0, count).otherwise((s - 1) % between + 1))
        .withColumn("plan", F.get(plans, F.when(s == 0, 0).otherwise(F.floor((s - 1) / between)).cast("int")))
    )
    k, pos = F.col("k"), [F.get("plan.pos", F.lit(i)) for i in range(count)]
    mixed = F.array([F.when(pos[i] < k, F.col(f"x{i}")).otherwise(F.get("plan.z", F.lit(i))) for i in range(count)])
    scored = model.transform(steps.withColumn("features", array_to_vector(mixed)))
    p = F.col("y_pred")

    def gain(i: int) -> Column:
        own = F.lit(last[i]) * p if last[i] else F.lit(None).cast("double")
        return F.sum(F.when(s == 0, own).when(pos[i] == k - 1, p).when(pos[i] == k, -p))

    total = scored.groupBy("node_id").agg(*[gain(i).alias(f"g{i}") for i in range(count)], *[F.first(f"x{i}").alias(f"x{i}") for i in range(count)])
    values = F.explode(F.array([
        F.struct(F.lit(n).alias("feature"), F.col(f"x{i}").alias("feature_value"), ((F.col(f"g{i}") - first[i]) / draws).alias("shap")) for i, n in enumerate(names)
    ])).alias("v")
    return total.select("node_id", values).select("node_id", "v.*", F.lit(base_value).alias("base_value"))


def occlusion_importance(model, table: DataFrame, features: Sequence[str], steps: int = 2) -> DataFrame:
    """Change in prediction when one feature is blanked in a node's whole neighbourhood.

    ``table`` carries the features and their smoothed copies (``{feature}__hop{i}``); blanking a
    feature everywhere around a node blanks all of its copies.
    """
    groups = {f: [f, *[f"{f}__hop{i}" for i in range(1, steps + 1)]] for f in features}
    columns = [c for f in features for c in groups[f]]
    order = [*features, *[f"{f}__hop{i}" for i in range(1, steps + 1) for f in features]]
    masks = F.explode(F.array([F.lit(f) for f in ["", *features]])).alias("feature")
    owner = {c: f for f, cs in groups.items() for c in cs}
    spread = table.select("node_id", "city", *columns, masks)
    blanked = F.array([F.when(F.col("feature") == owner[c], 0.0).otherwise(F.col(c)) for c in order])
    scored = model.transform(spread.withColumn("features", array_to_vector(blanked))).select("node_id", "city", "feature", "y_pred")
    original = F.max(F.when(F.col("feature") == "", F.col("y_pred"))).over(Window.partitionBy("node_id"))
    out = scored.withColumn("original", original).where(F.col("feature") != "")
    return out.select(
        "node_id", "city", "feature", F.abs(F.col("y_pred") - F.col("original")).alias("importance"),
        F.col("y_pred").alias("masked_y_pred"), F.col("original").alias("y_pred"),
    )


def partial_dependence(
    model, reference: DataFrame, features: Sequence[str], curve_features: Sequence[str], grid_size: int = 25,
    logged: Sequence[str] = (),
) -> DataFrame:
    """Mean, 10 % and 90 % predictions over all rows along a grid of each feature, other columns as they are.

    Boosted trees give a row's whole curve in one walk; other models score one copy of the row per point.
    """
    names = list(features)
    # Rows fan out below, and a merged partition of the model table holds up to millions of their copies.
    rows = cut_lineage(spread(reference.select(*names)))
    long = rows.unpivot([], list(curve_features), "feature", "value")
    # Four numbers per curve.
    ends = {r["feature"]: r["q"] for r in quantiles(long, "value", ["feature"], [0.05, 0.95, 0.0, 1.0]).collect()}
    grids = {}
    for f in curve_features:
        low, high, least, most = (float(v) for v in ends[f])
        if low == high:
            low, high = least, most
        grids[f] = [low] if low == high else [low + (high - low) * i / (grid_size - 1) for i in range(grid_size)]
    if isinstance(model, BoostedTrees):
        return tree_dependence(model, rows, curve_features, grids, logged)
    curves = [F.struct(F.lit(f).alias("feature"), F.lit(v).alias("value")) for f, points in grids.items() for v in points]
    copies = rows.withColumn("c", F.explode(F.array(*curves)))
    values = F.array([F.when(F.col("c.feature") == n, F.col("c.value")).otherwise(F.col(n)) for n in names])
    scored = model.transform(copies.withColumn("features", array_to_vector(values)))
    scored = cut_lineage(scored.select("c.feature", "c.value", "y_pred"))
    means = scored.groupBy("feature", "value").agg(F.avg("y_pred").alias("mean_prediction"))
    out = means.join(quantiles(scored, "y_pred", ["feature", "value"], [0.1, 0.9]), ["feature", "value"])
    raw = F.when(F.col("feature").isin(list(logged)), undo_log1p(F.col("value"))).otherwise(F.col("value"))
    return out.select(
        "feature", F.col("value").alias("feature_value_model_scale"), raw.alias("feature_value_raw_scale"),
        "mean_prediction", F.col("q")[0].alias("prediction_p10"), F.col("q")[1].alias("prediction_p90"),
    )


def dependence_summary(curves: DataFrame) -> DataFrame:
    """Range and end-to-end change of each dependence curve."""
    v = F.col("feature_value_raw_scale")
    return curves.groupBy("feature").agg(
        F.min(v).alias("min_raw_value"), F.max(v).alias("max_raw_value"),
        (F.max_by("mean_prediction", "feature_value_model_scale") - F.min_by("mean_prediction", "feature_value_model_scale")).alias("prediction_change"),
        F.min("mean_prediction").alias("min_mean_prediction"), F.max("mean_prediction").alias("max_mean_prediction"),
    )


# --- summaries --------------------------------------------------------------------------------

def attribution_summary(shap: DataFrame) -> DataFrame:
    """Mean absolute and signed attribution, mean value and value/attribution correlation per feature."""
    flat = (F.stddev_pop("feature_value") > 0) & (F.stddev_pop("shap") > 0)
    return shap.groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap"), F.avg("shap").alias("mean_shap"),
        F.avg("feature_value").alias("mean_feature_value"),
        F.when(flat, F.coalesce(F.corr("feature_value", "shap"), F.lit(0.0))).otherwise(0.0).alias("feature_shap_corr"),
    )


def attribution_by_city(shap: DataFrame) -> DataFrame:
    """Mean absolute attribution per city and feature."""
    return shap.groupBy("city", "feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"), F.count(F.lit(1)).alias("n_explained_rows"))


def feature_report(summary: DataFrame) -> DataFrame:
    """Importance share, direction, family and label of each feature."""
    total = summary.agg(F.sum("mean_abs_shap")).first()[0] or 0.0
    share = 100 * F.col("mean_abs_shap") / total if total > 0 else F.lit(0.0)
    return summary.withColumns({
        "relative_importance_pct": share, "direction": direction(F.col("feature_shap_corr")),
        "feature_family": family_title(F.col("feature")), "feature_label": feature_label(F.col("feature")),
    })


def family_totals(summary: DataFrame, value: str = "mean_abs_shap", family: Column | None = None) -> DataFrame:
    """Sum of a per-feature value by family and its share in percent."""
    name = family_title(F.col("feature")) if family is None else family
    sums = summary.groupBy(name.alias("feature_family")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n_features"))
    # One row per family, so the unpartitioned window is tiny.
    whole = F.sum("total").over(Window.partitionBy(F.lit(1)))
    return sums.withColumn("relative_importance_pct", F.when(whole > 0, 100 * F.col("total") / whole).otherwise(0.0))


def top_city_features(by_city: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most important features of each city."""
    return top_per_group(by_city, ["city"], [F.desc("mean_abs_shap"), F.col("feature")], k, "city_rank")


def cluster_profile(shap: DataFrame, by: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Mean, mean absolute, median and population deviation of each feature per cluster, ranked by mean absolute."""
    keys = [*by, "feature"]
    stats = shap.groupBy(*keys).agg(
        F.avg("shap").alias("mean_shap"), F.avg(F.abs("shap")).alias("mean_abs_shap"), F.stddev_pop("shap").alias("std_shap"),
    ).join(medians(shap, "shap", keys, "median_shap"), keys)
    order = Window.partitionBy(*by).orderBy(F.desc("mean_abs_shap"), "feature")
    return stats.withColumn("family", family_code(F.col("feature"))).withColumn("abs_rank_within_cluster", F.row_number().over(order))


def cluster_family_shares(profile: DataFrame, value: str = "mean_abs_shap", by: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Family totals within each cluster and their share of the cluster (zero when nothing is left to share)."""
    out = profile.groupBy(*by, "family").agg(F.sum(value).alias("total_importance"), F.count(F.lit(1)).alias("n_features"))
    whole = F.sum("total_importance").over(Window.partitionBy(*by))
    return out.withColumn("family_share", F.when(whole > 0, F.col("total_importance") / whole).otherwise(0.0))


def cluster_cities(assignments: DataFrame) -> DataFrame:
    """Share of each city within each cluster."""
    counts = assignments.groupBy("cluster_id", "city").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cluster_id")))


def cluster_summary(assignments: DataFrame, profile: DataFrame, top_n: int = 5) -> DataFrame:
    """Size, mean target and prediction, leading cities (JSON) and leading features of each cluster."""
    stats = assignments.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("y_true").alias("mean_y_true"), F.avg("y_pred").alias("mean_y_pred"),
        F.avg(F.col("y_pred") - F.col("y_true")).alias("mean_prediction_error"),
    )
    stats = stats.withColumn("row_share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(1))))  # a row per cluster
    cities = top_per_group(cluster_cities(assignments), ["cluster_id"], [F.desc("n"), F.col("city")], 5)
    cities = cities.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "city", F.round("share", 4).alias("share")))).alias("c"))
    cities = cities.select("cluster_id", F.to_json(F.map_from_entries(F.transform("c", lambda s: F.struct(s.city, s.share)))).alias("top_cities"))

    def leading(name: str, *order: Column) -> DataFrame:
        best = top_per_group(profile, ["cluster_id"], [*order, F.col("feature")], top_n)
        items = F.array_sort(F.collect_list(F.struct("rank", "feature")))
        return best.groupBy("cluster_id").agg(F.array_join(F.transform(items, lambda s: s.feature), "; ").alias(name))

    out = stats.join(cities, "cluster_id")
    for part in (
        leading("top_abs_features", F.desc("mean_abs_shap")), leading("top_positive_features", F.desc("mean_shap")),
        leading("top_negative_features", F.asc("mean_shap")),
    ):
        out = out.join(part, "cluster_id")
    return out.withColumn("cluster_label", F.concat(F.lit("C"), F.col("cluster_id").cast("string")))


def masks_wide(masks: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long importances to one row per node, averaging repeats and filling gaps with zero."""
    return masks.groupBy(*keys).pivot("feature", list(features)).agg(F.avg("importance")).na.fill(0.0, list(features))


def mask_importance(masks: DataFrame) -> DataFrame:
    """Mean and median importance and number of explained nodes per feature."""
    stats = masks.groupBy("feature").agg(F.avg("importance").alias("mean_importance"), F.count_distinct("node_id").alias("n_explained_nodes"))
    return stats.join(medians(masks, "importance", ["feature"], "median_importance"), "feature")


def family_balance(family_shares: DataFrame, assignments: DataFrame) -> DataFrame:
    """Family shares side by side for each cluster, with its mean prediction."""
    families = ["PT", "BE", "ACS"]
    wide = family_shares.groupBy("cluster_id").pivot("family", families).agg(F.avg("family_share")).na.fill(0.0, families)
    mean = assignments.groupBy("cluster_id").agg(F.avg("y_pred").alias("mean_y_pred"))
    return wide.join(mean, "cluster_id", "left")


def context_profile(members: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cluster mean and median of each context column, and the mean's distance from the overall mean in
    population deviations (zero for a constant column)."""
    long = members.select("cluster_id", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["cluster_id"], list(columns), "variable", "value")
    overall = long.groupBy("variable").agg(F.avg("value").alias("overall_mean"), F.stddev_pop("value").alias("sd"))
    out = long.groupBy("cluster_id", "variable").agg(F.avg("value").alias("cluster_mean")).join(overall, "variable")
    out = out.join(medians(long, "value", ["cluster_id", "variable"], "cluster_median"), ["cluster_id", "variable"])
    distance = F.when(F.col("sd") > 0, (F.col("cluster_mean") - F.col("overall_mean")) / F.col("sd")).otherwise(0.0)
    return out.select("cluster_id", "variable", "cluster_mean", "cluster_median", "overall_mean", distance.alias("standardized_difference"))


def context_heatmap(profile: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """Variables by cluster, the most distinctive variable first (``position``)."""
    order = profile.groupBy("variable").agg(F.max(F.abs("standardized_difference")).alias("strength"))
    wide = profile.groupBy("variable").pivot("cluster_id", list(clusters)).agg(F.avg("standardized_difference")).na.fill(0.0)
    wide = wide.withColumnsRenamed({str(c): f"C{c}" for c in clusters}).join(order, "variable")
    # One row per context variable, so the unpartitioned window is tiny.
    return wide.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("strength"), "variable")))


# --- clusters ---------------------------------------------------------------------------------

def attribution_vectors(shap: DataFrame) -> DataFrame:
    """One vector per node, features in name order."""
    items = F.array_sort(F.collect_list(F.struct("feature", "shap")))
    return shap.groupBy("node_id").agg(array_to_vector(F.transform(items, lambda s: s.shap)).alias("raw"))


def standard_vectors(vectors: DataFrame) -> DataFrame:
    """Centred and scaled vectors."""
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vectors).transform(vectors)


def relabel_by_prediction(clusters: DataFrame, predictions: DataFrame) -> DataFrame:
    """Number clusters by ascending mean prediction: 0 has the lowest."""
    joined = clusters.join(predictions, "node_id")
    means = joined.groupBy("raw_cluster_id").agg(F.avg("y_pred").alias("m"))
    # One row per cluster, so the unpartitioned window is tiny.
    order = means.select("raw_cluster_id", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("m", "raw_cluster_id")) - 1).alias("cluster_id"))
    return joined.join(order, "raw_cluster_id").drop("raw_cluster_id").withColumn("cluster_label", F.concat(F.lit("C"), F.col("cluster_id").cast("string")))


def cluster_attributions(shap: DataFrame, predictions: DataFrame, k: int = 5, starts: int = 50, seed: int = 42) -> tuple[DataFrame, float]:
    """k-means on standardised attribution vectors, best of several starts; assignments and silhouette."""
    vectors = cut_lineage(standard_vectors(attribution_vectors(shap)).select("node_id", "features", vector_to_array("features").alias("x")))
    centres, costs = fit_starts(vectors.select(F.xxhash64("node_id").alias("key"), "x"), k, starts, seed)
    labelled = vectors.withColumn("raw_cluster_id", nearest_centre(F.col("x"), centres[costs.argmin()]))
    quality = ClusteringEvaluator(featuresCol="features", predictionCol="raw_cluster_id").evaluate(labelled)
    return relabel_by_prediction(labelled.select("node_id", "raw_cluster_id"), predictions), quality


def project_two(shap: DataFrame) -> tuple[DataFrame, list[float]]:
    """First two principal components of the standardised vectors and their variance shares."""
    vectors = standard_vectors(attribution_vectors(shap))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vectors)
    out = model.transform(vectors).withColumn("p", vector_to_array("pc"))
    return out.select("node_id", F.col("p")[0].alias("pc1"), F.col("p")[1].alias("pc2")), [float(v) for v in model.explainedVariance]


# --- feature selection ------------------------------------------------------------------------

def feature_priority(features: DataFrame, shap: DataFrame, gain: DataFrame, protected: Sequence[str]) -> DataFrame:
    """Selection priority of each feature from scaled attribution, scaled gain and a protection bonus."""
    mean_gain = gain.groupBy("feature").agg(F.avg("importance_gain").alias("mean_gain"))
    out = features.select("feature").join(shap.select("feature", "mean_abs_shap"), "feature", "left").join(mean_gain, "feature", "left")
    out = out.na.fill(0.0, ["mean_abs_shap", "mean_gain"]).withColumn("protected", F.col("feature").isin(list(protected)))
    ends = out.agg(*[f(c).alias(f"{p}_{c}") for c in ("mean_abs_shap", "mean_gain") for f, p in ((F.min, "lo"), (F.max, "hi"))]).first()
    scaled = {
        name: minmax(F.col(c), F.lit(ends[f"lo_{c}"]), F.lit(ends[f"hi_{c}"]))
        for name, c in (("shap_score", "mean_abs_shap"), ("gain_score", "mean_gain"))
    }
    out = out.withColumns(scaled)
    return out.withColumn(
        "priority",
        SHAP_WEIGHT * F.col("shap_score") + GAIN_WEIGHT * F.col("gain_score") + PROTECTED_BONUS * F.col("protected").cast("double"),
    )


def reduced_features(
    vectors: DataFrame, features: Sequence[str], priority: DataFrame, protected: Sequence[str],
    limits: dict[str, tuple[int, int]], threshold: float = 0.95, max_features: int = 60,
) -> list[str]:
    """Correlation-pruned feature list: correlations over all rows in Spark, a greedy pick on that matrix.

    Per family, features come in order of protection and priority; one is taken unless it correlates
    too strongly with one already taken (a protected one may still fill the family minimum). Families
    are topped up to their minimum, then the weakest unprotected features go until the total fits.
    """
    matrix = Correlation.corr(vectors, "features").first()[0].toArray()
    at = {f: i for i, f in enumerate(features)}
    score = {r["feature"]: float(r["priority"]) for r in priority.collect()}  # one row per feature
    rank = {f: i for i, f in enumerate(protected)}
    chosen: dict[str, list[str]] = {}
    for family, (least, most) in limits.items():
        queue = sorted(
            (f for f in features if family_name(f) == family),
            key=lambda f: (f not in rank, -score[f], rank.get(f, len(rank))),
        )
        kept: list[str] = []
        for f in queue:
            clash = any(abs(matrix[at[f]][at[g]]) >= threshold for g in kept)
            if len(kept) < most and (not clash or (f in rank and len(kept) < least)):
                kept.append(f)
        kept += [f for f in queue if f not in kept][: max(least - len(kept), 0)]
        chosen[family] = kept[:most]
    total = sum(len(v) for v in chosen.values())
    while total > max_features:
        loose = [(score[f], f, k) for k, v in chosen.items() if len(v) > limits[k][0] for f in v if f not in rank]
        if not loose:
            break
        _, f, family = min(loose)
        chosen[family].remove(f)
        total -= 1
    return [f for v in chosen.values() for f in v]
