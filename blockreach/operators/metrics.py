"""Regression metrics from predictions (``y_true, y_pred``), pooled and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockreach.functions.numeric import safe_divide
from blockreach.operators.quantiles import ranks_together


def present(name: str) -> Column:
    """A column whose nulls stop the job: metrics over fewer rows than given would pass unseen."""
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"Null value in {name}."))).otherwise(F.col(name))


def regression_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R² per group; R² is zero without variance, and nulls are an error."""
    df = df.withColumns({c: present(c) for c in ("y_true", "y_pred")})
    e = F.col("y_true") - F.col("y_pred")
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y_true").alias("v"),
    )
    return sums.select(*by, F.sqrt("mse").alias("rmse"), "mae", _r2(F.col("mse"), F.col("v")).alias("r2"), "n_rows")


def _r2(mse: Column, variance: Column) -> Column:
    return F.when(variance > 0, 1 - mse / variance).otherwise(0.0)


def full_metrics(df: DataFrame, by: Sequence[str], train_mean: Column, ranks: bool = True) -> DataFrame:
    """All evaluation metrics per group.

    Without ``ranks`` the rank correlation is left out; the others are one aggregate that combines on the map
    side, while ranks shuffle every row several times.

    ``train_mean`` is the baseline prediction (a literal, or a column constant within a group).
    """
    keys = list(by)
    df = df.withColumns({c: present(c).cast("double") for c in ("y_true", "y_pred")})
    y, p = F.col("y_true"), F.col("y_pred")
    e, b = y - p, y - train_mean
    ranked = ranks_together(df, {"y_true": "ry", "y_pred": "rp"}, keys) if ranks else df
    s = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(b * b).alias("base_mse"), F.avg(F.abs(b)).alias("baseline_mae"),
        F.avg("y_true").alias("target_mean"), F.avg("y_pred").alias("prediction_mean"),
        F.var_pop("y_true").alias("vy"), F.var_pop("y_pred").alias("vp"), F.stddev_samp("y_true").alias("sd"),
        F.corr("y_true", "y_pred").alias("pearson"), *([F.corr("ry", "rp").alias("spearman")] if ranks else []),
    )
    c = F.col
    bias = c("prediction_mean") - c("target_mean")
    flat = (c("vy") > 0) & (c("vp") > 0)
    pearson = F.when(flat, c("pearson")).otherwise(0.0)
    # Rescaling predictions to the target's mean and spread leaves an error of 2·var·(1 - r).
    affine = F.when(c("vp") > 0, F.when(c("vy") > 0, 1 - 2 * (1 - c("pearson"))).otherwise(0.0)).otherwise(0.0)
    rmse, base = F.sqrt("mse"), F.sqrt("base_mse")
    return s.select(
        *keys,
        rmse.alias("rmse"), "mae", _r2(c("mse"), c("vy")).alias("r2"),
        pearson.alias("pearson_r"),
        *([F.when(flat, F.coalesce(c("spearman"), F.lit(0.0))).otherwise(0.0).alias("spearman_r")] if ranks else []),
        _r2(c("mse") - bias * bias, c("vy")).alias("bias_corrected_r2"),
        affine.alias("affine_corrected_r2"),
        base.alias("baseline_rmse"), "baseline_mae", _r2(c("base_mse"), c("vy")).alias("baseline_r2"),
        safe_divide(100 * (base - rmse), base).alias("rmse_improvement_vs_baseline_pct"),
        "n_rows", "target_mean", F.coalesce("sd", F.lit(0.0)).alias("target_std"),
        "prediction_mean", bias.alias("prediction_bias"),
    )


def pooled_and_city_metrics(df: DataFrame, train_mean: Column, ranks: bool = True) -> DataFrame:
    """Metrics of every split pooled (``city = '__all__'``) and of the test split per city."""
    scopes = F.when(F.col("split") == "test", F.array(F.lit("__all__"), "city")).otherwise(F.array(F.lit("__all__")))
    return full_metrics(df.withColumn("city", F.explode(scopes)), ["split", "city"], train_mean, ranks)


def summarise(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, sample standard deviation (zero for one row), minimum and maximum: one row per group and column."""
    long = df.unpivot(list(by), list(columns), "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group in a total order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
