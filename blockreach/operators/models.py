"""Regression over model tables: boosting, pooled and city-held-out runs, tuning, graph-smoothed regression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window, functions as F

from blockreach.operators.boosting import BoostedTrees, Boosting, feature_array, fit_models, predictions
from blockreach.operators.graph import neighbour_mean, symmetric_smooth
from blockreach.operators.metrics import full_metrics, pooled_and_city_metrics, regression_metrics
from blockreach.session import cut_lineage

# The tuning candidates.
CANDIDATES = {
    "current_default": Boosting(600, 0.03, 4, 0.85, 0.85, 1, 0.0, 1.0),
    "shallower_regularized": Boosting(500, 0.04, 3, 0.90, 0.90, 5, 0.0, 3.0),
    "fast_shallow": Boosting(400, 0.05, 3, 0.85, 0.85, 3, 0.0, 2.0),
    "medium_faster": Boosting(400, 0.05, 4, 0.85, 0.85, 3, 0.0, 2.0),
    "deeper_regularized": Boosting(600, 0.03, 5, 0.80, 0.80, 5, 0.05, 5.0),
    "slow_medium": Boosting(800, 0.02, 4, 0.85, 0.85, 2, 0.0, 2.0),
    "slow_shallow": Boosting(800, 0.03, 3, 0.90, 0.85, 3, 0.0, 2.0),
    "regularized_default_depth": Boosting(600, 0.03, 4, 0.85, 0.85, 5, 0.05, 3.0),
}


def with_vector(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def fit_boosting(train: DataFrame, features: Sequence[str], target: str, settings: Boosting) -> BoostedTrees:
    """Fit squared-error boosting on all rows of ``train``."""
    return fit_models(train, features, target, [settings])[0]


def importances(models: dict[str, BoostedTrees], df: DataFrame) -> DataFrame:
    """``(model, feature, importance_gain)``, summing to one per model."""
    rows = [(name, f, v) for name, model in models.items() for f, v in model.importances().items()]
    return df.sparkSession.createDataFrame(rows, "model string, feature string, importance_gain double")


def scored(df: DataFrame, models: dict[str, BoostedTrees], target: str, *keep: str) -> DataFrame:
    """``(keep..., y_true, model, y_pred)``: the predictions of all models, from one pass over the rows."""
    features = next(iter(models.values())).features
    named = F.arrays_zip(F.array(*[F.lit(n) for n in models]).alias("model"), predictions(list(models.values()), feature_array(features)).alias("y_pred"))
    return df.select(*keep, F.col(target).alias("y_true"), F.inline(named))


def _train_mean(df: DataFrame, target: str):
    return F.lit(df.where("split = 'train'").agg(F.avg(target)).first()[0])


def pooled_run(df: DataFrame, features: Sequence[str], target: str, settings: Boosting, ranks: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train on the train split of all cities; metrics, predictions and importances.

    Without ``ranks`` (see :func:`full_metrics`) the metrics need one pass, so predictions are not written first.
    """
    table = cut_lineage(df.select("node_id", "city", "split", target, *features))
    models = {"pooled": fit_boosting(table.where("split = 'train'"), features, target, settings)}
    found = scored(table, models, target, "node_id", "city", "split").drop("model")
    found = cut_lineage(found) if ranks else found
    return pooled_and_city_metrics(found, _train_mean(table, target), ranks), found, importances(models, df).drop("model")


def leave_one_city_out_run(
    df: DataFrame, features: Sequence[str], target: str, cities: Sequence[str], settings: Boosting, ranks: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One model per held-out city, trained on all other cities; all models grow together.

    Every row is scored by every model. Without ``ranks`` (see :func:`full_metrics`) the metrics need one
    pass over these copies, so they are neither written nor shuffled.
    """
    table = cut_lineage(df.select("node_id", "city", target, *features))
    own = [replace(settings, seed=settings.seed + i) for i in range(len(cities))]
    models = dict(zip(cities, fit_models(table, features, target, own, F.col("city"), cities)))
    found = scored(table, models, target, "node_id", "city").withColumnRenamed("model", "heldout_city")
    held = F.col("heldout_city")
    repeat = F.array_position(F.array(*[F.lit(c) for c in cities]), held).cast("int") - 1
    found = found.withColumns({"split": F.when(F.col("city") == held, "test").otherwise("train"), "repeat": repeat})
    found = cut_lineage(found) if ranks else found
    base = F.get(F.array(*[F.lit(m.base) for m in models.values()]), F.col("repeat"))
    metrics = full_metrics(found, ["split", "heldout_city", "repeat"], base, ranks)
    metrics = metrics.withColumn("city", F.when(F.col("split") == "test", held).otherwise("__train_cities__"))
    return metrics, found, importances(models, df).withColumnRenamed("model", "heldout_city").withColumn("repeat", repeat)


def rank_candidates(results: DataFrame) -> DataFrame:
    """Add ``validation_rank``: best validation R² first, then smallest validation RMSE."""
    # One row per candidate, so the window is tiny.
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("r2"), "rmse", "candidate")
    ranks = results.where("split = 'val'").select("candidate", F.row_number().over(order).alias("validation_rank"))
    return results.join(ranks, "candidate")


def tune(df: DataFrame, features: Sequence[str], target: str, candidates: dict[str, Boosting]) -> DataFrame:
    """Metrics of every candidate on every split, ranked on the validation split; all candidates grow together."""
    table = cut_lineage(df.select("node_id", "city", "split", target, *features))
    models = fit_models(table.where("split = 'train'"), features, target, list(candidates.values()))
    found = scored(table, dict(zip(candidates, models)), target, "split").withColumnRenamed("model", "candidate")
    return rank_candidates(cut_lineage(regression_metrics(found, ["split", "candidate"])))


def graph_features(df: DataFrame, edges: DataFrame, features: Sequence[str], kind: str = "mean", steps: int = 2) -> tuple[DataFrame, list[str]]:
    """Add the features smoothed over one and more graph steps (``{feature}__hop{i}``).

    Rows and edges are read by every step, so both are written once before the first.
    """
    smooth = {"mean": neighbour_mean, "symmetric": symmetric_smooth}[kind]
    df, edges = cut_lineage(df), cut_lineage(edges.select("src", "dst"))
    out, names = df, list(features)
    current = df.select("node_id", *features)
    for step in range(1, steps + 1):
        current = smooth(edges, current, features)
        current = cut_lineage(current) if step < steps else current
        renamed = current.select("node_id", *[F.col(f).alias(f"{f}__hop{step}") for f in features])
        out = out.join(renamed, "node_id")
        names += [f"{f}__hop{step}" for f in features]
    return out, names


def fit_graph(table: DataFrame, names: Sequence[str], target: str, penalty: float = 1e-6):
    """Linear regression over a table of :func:`graph_features`: the model and the table with its vectors."""
    # The vectors repeat columns, so they are not written.
    table = with_vector(table, names)
    model = LinearRegression(
        featuresCol="features", labelCol=target, predictionCol="y_pred", regParam=penalty, solver="normal"
    ).fit(table.where("split = 'train'"))
    return model, table


def graph_run(df: DataFrame, edges: DataFrame, features: Sequence[str], target: str, kind: str = "mean", penalty: float = 1e-6):
    """Linear regression on two-step graph-smoothed features: the model, its predictions and feature list."""
    table, names = graph_features(df, edges, features, kind)
    return *fit_graph(cut_lineage(table), names, target, penalty), names
