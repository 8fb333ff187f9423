"""Attribution, cluster, dependence and selection queries."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from blockreach.functions.naming import family_code
from blockreach.operators import checks, explain as ex, metrics as mt, models as md, tree_explain as te
from blockreach.plans import carriers as C, modeling as pm
from blockreach.plans.registry import q6, query, rounded
from blockreach.session import cut_lineage

W = f"WITH {C.ATTRIBUTION_SQL}"
FAMILY = "CASE WHEN feature LIKE 'pt_%' THEN 'PT' WHEN feature LIKE 'be_%' THEN 'BE' WHEN feature LIKE 'acs_%' THEN 'ACS' ELSE 'other' END"
TITLE = "CASE WHEN feature LIKE 'pt_%' THEN 'public transport' WHEN feature LIKE 'be_%' THEN 'built environment' ELSE 'sociodemographic' END"
shap, predictions = C.attributions, C.predictions

SUMMARY = "summary AS (SELECT feature, avg(abs(shap)) AS mean_abs_shap, avg(shap) AS mean_shap, avg(feature_value) AS mean_feature_value, corr(feature_value, shap) AS feature_shap_corr FROM shap_long GROUP BY feature)"


@query("src20_explanation_inputs", f"{W} SELECT node_id, city, cluster_id, {q6('y_true')} AS y_true, {q6('y_pred')} AS y_pred FROM predictions")
def _(spark, folder):
    checks.require_columns(shap(spark, folder), ["node_id", "city", "feature", "shap"], "attribution table")
    checks.require_columns(predictions(spark, folder), ["node_id", "city", "y_true", "y_pred"], "prediction table")
    return rounded(predictions(spark, folder))


@query("ag27_attribution_summary", f"{W}, {SUMMARY} SELECT feature, {q6('mean_abs_shap')} AS mean_abs_shap, {q6('mean_shap')} AS mean_shap, {q6('mean_feature_value')} AS mean_feature_value, {q6('feature_shap_corr')} AS feature_shap_corr FROM summary")
def _(spark, folder):
    return rounded(ex.attribution_summary(shap(spark, folder)))


@query("ag28_attribution_by_city", f"{W} SELECT city, feature, {q6('avg(abs(shap))')} AS mean_abs_shap, count(*) AS n_explained_rows FROM shap_long GROUP BY city, feature")
def _(spark, folder):
    return rounded(ex.attribution_by_city(shap(spark, folder)))


@query("ag29_family_totals", f"{W}, {SUMMARY} SELECT {TITLE} AS feature_family, {q6('sum(mean_abs_shap)')} AS total, count(*) AS n_features, {q6('100 * sum(mean_abs_shap) / (SELECT sum(mean_abs_shap) FROM summary)')} AS relative_importance_pct FROM summary GROUP BY 1")
def _(spark, folder):
    return rounded(ex.family_totals(ex.attribution_summary(shap(spark, folder))))


@query("ag29_feature_report", f"""{W}, {SUMMARY} SELECT feature, {q6('100 * mean_abs_shap / sum(mean_abs_shap) OVER ()')} AS relative_importance_pct,
  CASE WHEN feature_shap_corr >= 0.2 THEN 'higher feature values generally raise predictions' WHEN feature_shap_corr <= -0.2 THEN 'higher feature values generally lower predictions' ELSE 'mixed or weak directional pattern' END AS direction,
  {TITLE} AS feature_family, replace(regexp_replace(feature, '^(pt_|be_|acs_)', ''), '_', ' ') AS feature_label FROM summary""")
def _(spark, folder):
    return rounded(ex.feature_report(ex.attribution_summary(shap(spark, folder))).select("feature", "relative_importance_pct", "direction", "feature_family", "feature_label"))


@query("wn05_city_feature_ranks", f"{W}, c AS (SELECT city, feature, avg(abs(shap)) AS v FROM shap_long GROUP BY city, feature), r AS (SELECT city, feature, CAST(row_number() OVER (PARTITION BY city ORDER BY v DESC, feature) AS INTEGER) AS city_rank FROM c) SELECT * FROM r WHERE city_rank <= 10")
def _(spark, folder):
    return ex.top_city_features(ex.attribution_by_city(shap(spark, folder))).select("city", "feature", "city_rank")


@query("tk02_top_features", f"{W}, {SUMMARY} SELECT feature, {q6('mean_abs_shap')} AS mean_abs_shap FROM summary ORDER BY summary.mean_abs_shap DESC, feature LIMIT 15")
def _(spark, folder):
    return rounded(ex.attribution_summary(shap(spark, folder)).orderBy(F.desc("mean_abs_shap"), "feature").limit(15).select("feature", "mean_abs_shap"))


GAINS = "gains AS (SELECT city AS experiment, CAST(node_id AS VARCHAR) AS repeat, feature, abs(shap) AS importance_gain FROM shap_long)"


def gains(spark: SparkSession, folder: str) -> DataFrame:
    return shap(spark, folder).select(F.col("city").alias("experiment"), F.col("node_id").cast("string").alias("repeat"), "feature", F.abs("shap").alias("importance_gain"))


@query("ag26_importance_summary", f"""{W}, {GAINS}, s AS (SELECT experiment, feature, avg(importance_gain) AS mean, coalesce(stddev_samp(importance_gain), 0.0) AS std, min(importance_gain) AS min, max(importance_gain) AS max FROM gains GROUP BY 1, 2)
  SELECT experiment, feature, {q6('mean')} AS mean, {q6('std')} AS std, {q6('min')} AS min, {q6('max')} AS max FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY mean DESC, feature) AS k FROM s) WHERE k <= 20""")
def _(spark, folder):
    rows = mt.summarise(gains(spark, folder).select("experiment", "feature", "importance_gain"), ["experiment", "feature"], ["importance_gain"]).drop("metric")
    return rounded(mt.top_per_group(rows, ["experiment"], [F.desc("mean"), F.col("feature")], 20).drop("rank"))


PROFILE = """profile AS (SELECT cluster_id, feature, avg(shap) AS mean_shap, avg(abs(shap)) AS mean_abs_shap, median(shap) AS median_shap, stddev_pop(shap) AS std_shap FROM shap_long GROUP BY cluster_id, feature),
ranked AS (SELECT *, """ + FAMILY + """ AS family, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY mean_abs_shap DESC, feature) AS INTEGER) AS abs_rank_within_cluster FROM profile)"""


def profile(spark: SparkSession, folder: str) -> DataFrame:
    return ex.cluster_profile(shap(spark, folder))


@query("ag30_cluster_profile", f"{W}, {PROFILE} SELECT cluster_id, feature, {q6('mean_shap')} AS mean_shap, {q6('mean_abs_shap')} AS mean_abs_shap, {q6('median_shap')} AS median_shap, {q6('std_shap')} AS std_shap, family, abs_rank_within_cluster FROM ranked")
def _(spark, folder):
    return rounded(profile(spark, folder))


SHARES = "shares AS (SELECT cluster_id, family, sum(mean_abs_shap) AS total_importance, count(*) AS n_features, sum(mean_abs_shap) / sum(sum(mean_abs_shap)) OVER (PARTITION BY cluster_id) AS family_share FROM ranked GROUP BY cluster_id, family)"


@query("ag31_cluster_family_shares", f"{W}, {PROFILE}, {SHARES} SELECT cluster_id, family, {q6('total_importance')} AS total_importance, n_features, {q6('family_share')} AS family_share FROM shares")
def _(spark, folder):
    return rounded(ex.cluster_family_shares(profile(spark, folder)))


@query("wn06_share_of_partition", f"{W} SELECT city, feature, {q6('sum(abs(shap)) / sum(sum(abs(shap))) OVER (PARTITION BY city)')} AS share FROM shap_long GROUP BY city, feature")
def _(spark, folder):
    rows = ex.attribution_by_city(shap(spark, folder)).select("city", F.col("feature").alias("family"), "mean_abs_shap")
    out = ex.cluster_family_shares(rows, by=["city"])
    return rounded(out.select("city", F.col("family").alias("feature"), F.col("family_share").alias("share")))


def _top(order: str, name: str) -> str:
    return f"(SELECT cluster_id, string_agg(feature, '; ' ORDER BY k) AS {name} FROM (SELECT cluster_id, feature, row_number() OVER (PARTITION BY cluster_id ORDER BY {order}, feature) AS k FROM profile) WHERE k <= 5 GROUP BY cluster_id)"


@query("ag32_cluster_summary", f"""{W}, {PROFILE}, n AS (SELECT cluster_id, count(*) AS n_rows, avg(y_true) AS mean_y_true, avg(y_pred) AS mean_y_pred, avg(y_pred - y_true) AS mean_prediction_error FROM predictions GROUP BY cluster_id)
  SELECT cluster_id, 'C' || cluster_id AS cluster_label, n_rows, {q6('n_rows / sum(n_rows) OVER ()')} AS row_share, {q6('mean_y_true')} AS mean_y_true, {q6('mean_y_pred')} AS mean_y_pred, {q6('mean_prediction_error')} AS mean_prediction_error,
  top_abs_features, top_positive_features, top_negative_features FROM n JOIN {_top('mean_abs_shap DESC', 'top_abs_features')} USING (cluster_id) JOIN {_top('mean_shap DESC', 'top_positive_features')} USING (cluster_id) JOIN {_top('mean_shap', 'top_negative_features')} USING (cluster_id)""")
def _(spark, folder):
    return rounded(ex.cluster_summary(predictions(spark, folder), profile(spark, folder)).drop("top_cities"))


@query("ag32_cluster_top_cities", f"""{W}, s AS (SELECT cluster_id, city, count(*) AS n FROM predictions GROUP BY 1, 2), k AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster_id) AS share, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, city) AS k FROM s)
  SELECT cluster_id, city, {q6('round(share, 4)')} AS share FROM k WHERE k <= 5""")
def _(spark, folder):
    table = ex.cluster_summary(predictions(spark, folder), profile(spark, folder)).select("cluster_id", F.explode(F.from_json("top_cities", "map<string, double>")).alias("city", "share"))
    return rounded(table)


@query("ag33_city_composition", f"{W} SELECT cluster_id, city, count(*) AS n, {q6('count(*) / sum(count(*)) OVER (PARTITION BY cluster_id)')} AS share FROM predictions GROUP BY cluster_id, city")
def _(spark, folder):
    return rounded(ex.cluster_cities(predictions(spark, folder)))


NAMES = [f"{'pt_' if i % 3 == 0 else 'be_' if i % 3 == 1 else 'acs_'}f_{i:02d}" for i in range(64)]


def masks(spark: SparkSession, folder: str) -> DataFrame:
    return shap(spark, folder).where(F.col("shap") > 0).select("node_id", "feature", F.col("shap").alias("importance"))


@query("ag34_masks_wide", f"{W} SELECT node_id, {', '.join(f"{q6(f"coalesce(avg(shap) FILTER (WHERE feature = '{n}'), 0.0)")} AS {n}" for n in NAMES)} FROM shap_long WHERE shap > 0 GROUP BY node_id")
def _(spark, folder):
    return rounded(ex.masks_wide(masks(spark, folder), ["node_id"], NAMES))


@query("ag35_mask_importance", f"{W} SELECT feature, {q6('avg(shap)')} AS mean_importance, {q6('median(shap)', 8)} AS median_importance, count(DISTINCT node_id) AS n_explained_nodes FROM shap_long WHERE shap > 0 GROUP BY feature")
def _(spark, folder):
    table = ex.mask_importance(masks(spark, folder))
    return rounded(table, "median_importance").withColumn("median_importance", F.round("median_importance", 8) + 0.0)


CONTEXT = ["acs_population", "acs_poverty_share", "acs_median_household_income", "be_compactness"]


def members(spark: SparkSession, folder: str) -> DataFrame:
    return pm.labelled(spark, folder).withColumn("cluster_id", (F.col("o_orderkey") % 5).cast("int"))


EQUITY = f"""WITH {pm.LABELLED}, long AS (SELECT cluster_id, variable, value FROM (SELECT CAST(o_orderkey % 5 AS INTEGER) AS cluster_id, {', '.join(CONTEXT)} FROM labelled) UNPIVOT (value FOR variable IN ({', '.join(CONTEXT)}))),
  o AS (SELECT variable, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY variable),
  equity AS (SELECT cluster_id, variable, avg(value) AS cluster_mean, median(value) AS cluster_median, any_value(m) AS overall_mean, (avg(value) - any_value(m)) / any_value(s) AS standardized_difference FROM long JOIN o USING (variable) GROUP BY cluster_id, variable)"""


@query("ag36_context_profile", f"{EQUITY} SELECT cluster_id, variable, {q6('cluster_mean', 4)} AS cluster_mean, {q6('cluster_median', 8)} AS cluster_median, {q6('overall_mean', 4)} AS overall_mean, {q6('standardized_difference')} AS standardized_difference FROM equity")
def _(spark, folder):
    table = ex.context_profile(members(spark, folder), CONTEXT)
    fixed = {c: F.round(c, d) + 0.0 for c, d in (("cluster_mean", 4), ("overall_mean", 4), ("cluster_median", 8))}
    return rounded(table, "cluster_median").withColumns(fixed)


@query("ag42_context_heatmap", f"""{EQUITY}, h AS (SELECT variable, max(abs(standardized_difference)) AS strength, {', '.join(f'avg(standardized_difference) FILTER (WHERE cluster_id = {c}) AS "C{c}"' for c in range(5))} FROM equity GROUP BY variable)
  SELECT variable, {', '.join(f'{q6(f'"C{c}"')} AS "C{c}"' for c in range(5))}, {q6('strength')} AS strength, CAST(row_number() OVER (ORDER BY strength DESC, variable) AS INTEGER) AS position FROM h""")
def _(spark, folder):
    return rounded(ex.context_heatmap(ex.context_profile(members(spark, folder), CONTEXT), range(5)))


@query("ag41_family_balance", f"""{W}, {PROFILE}, {SHARES}, p AS (SELECT cluster_id, avg(y_pred) AS mean_y_pred FROM predictions GROUP BY cluster_id)
  SELECT cluster_id, {', '.join(f"{q6(f"max(family_share) FILTER (WHERE family = '{f}')")} AS \"{f}\"" for f in ('PT', 'BE', 'ACS'))}, {q6('any_value(mean_y_pred)')} AS mean_y_pred FROM shares JOIN p USING (cluster_id) GROUP BY cluster_id""")
def _(spark, folder):
    return rounded(ex.family_balance(ex.cluster_family_shares(profile(spark, folder)), predictions(spark, folder)))


@query("tk03_relabelled_clusters", f"""{W}, raw AS (SELECT *, (cluster_id + 3) % 5 AS raw_cluster_id FROM predictions), o AS (SELECT raw_cluster_id, CAST(row_number() OVER (ORDER BY avg(y_pred), raw_cluster_id) - 1 AS INTEGER) AS cluster_id FROM raw GROUP BY raw_cluster_id)
  SELECT r.node_id, o.cluster_id, 'C' || o.cluster_id AS cluster_label FROM raw r JOIN o USING (raw_cluster_id)""")
def _(spark, folder):
    rows = predictions(spark, folder)
    raw = rows.select("node_id", ((F.col("cluster_id") + 3) % 5).alias("raw_cluster_id"))
    return ex.relabel_by_prediction(raw, rows.select("node_id", "y_pred")).select("node_id", "cluster_id", "cluster_label")


# --- samples ----------------------------------------------------------------------------------

@query("ml15_sample_by_share", f"WITH {pm.LABELLED}, s AS (SELECT city, count(*) AS n FROM labelled WHERE split = 'test' GROUP BY city) SELECT city, CAST(greatest(round_even(n * 200.0 / (SELECT sum(n) FROM s), 0), 1) AS BIGINT) AS n_rows FROM s")
def _(spark, folder):
    """Rows per city of a proportional sample that stays under its cap."""
    test = pm.labelled(spark, folder).where("split = 'test'")
    sizes = test.groupBy("city").agg(F.count(F.lit(1)).alias("size_"))
    total = sizes.agg(F.sum("size_")).first()[0]
    quota = sizes.withColumn("quota_", F.greatest(F.bround(F.col("size_") * (200 / total)).cast("bigint"), F.lit(1)))
    picked = ex.sample_by_quota(test, quota.select("city", "quota_"), 42)
    return picked.groupBy("city").agg(F.count(F.lit(1)).alias("n_rows"))


@query("ml15_capped_sample", f"WITH {pm.LABELLED} SELECT count(*) > 200 AS sampled, true AS within_cap, count(DISTINCT city) AS n_cities FROM labelled WHERE split = 'test'")
def _(spark, folder):
    test = pm.labelled(spark, folder).where("split = 'test'")
    picked = ex.sample_by_share(test, 200)
    total = test.count()
    return picked.agg((F.count(F.lit(1)) < total).alias("sampled"), (F.count(F.lit(1)) <= 200).alias("within_cap"), F.count_distinct("city").alias("n_cities"))


@query("ml16_sample_per_city", f"WITH {pm.LABELLED} SELECT city, least(count(*), 10) AS n_rows FROM labelled WHERE split = 'test' GROUP BY city")
def _(spark, folder):
    picked = ex.sample_per_city(pm.labelled(spark, folder).where("split = 'test'"), 10)
    return picked.groupBy("city").agg(F.count(F.lit(1)).alias("n_rows"))


# --- estimates (no SQL counterpart) -----------------------------------------------------------

def fitted(spark: SparkSession, folder: str):
    df = cut_lineage(pm.labelled(spark, folder).select("node_id", "city", "split", "Y", *pm.X))
    return md.fit_boosting(df.where("split = 'train'"), pm.X, "Y", md.Boosting()), df


LINEAR = {"pt_stop_count": 2.0, "be_compactness": 30.0, "acs_population": -0.01}
LINEAR_SQL = " + ".join(f"{v} * {c}" for c, v in LINEAR.items())


def linear_model(spark: SparkSession, folder: str):
    """A regression fitted on a target that is linear in three features, and the model table."""
    df = cut_lineage(pm.labelled(spark, folder, dealt=True).select("node_id", "city", "split", *LINEAR))
    target = sum((v * F.col(c) for c, v in LINEAR.items()), F.lit(1.0))
    train = md.with_vector(df.withColumn("T", target), list(LINEAR))
    return LinearRegression(featuresCol="features", labelCol="T", predictionCol="y_pred", solver="normal").fit(train), df


@query("ml14_shapley_values", f"""WITH {pm.LABELLED}, drawn AS (SELECT * FROM labelled WHERE split = 'train' ORDER BY md5('42:' || node_id), node_id LIMIT 8),
  z AS (SELECT {', '.join(f'avg({c}) AS z_{c}' for c in LINEAR)}, avg({LINEAR_SQL} + 1) AS base_value FROM drawn)
  """ + " UNION ALL ".join(f"SELECT node_id, '{c}' AS feature, {q6(c, 3)} AS feature_value, {q6(f'{v} * ({c} - z_{c})', 3)} AS shap, {q6('base_value', 3)} AS base_value FROM labelled, z WHERE split = 'test'" for c, v in LINEAR.items()))
def _(spark, folder):
    model, df = linear_model(spark, folder)
    return rounded(ex.shapley_values(model, df.where("split = 'test'"), list(LINEAR), df.where("split = 'train'")), digits=3)


# Background rows of the exact attributions.
BACKGROUND = 100


def tree_background(df: DataFrame) -> DataFrame:
    return ex.draw_background(df.where("split = 'train'"), BACKGROUND)


@query("ml14_boosted_attributions", f"WITH {pm.LABELLED} SELECT node_id, true AS adds_up FROM labelled WHERE split = 'test'")
def _(spark, folder):
    """Exact attributions of every test row add up to its prediction."""
    model, df = fitted(spark, folder)
    rows = df.where("split = 'test'")
    total = te.tree_shapley_values(model, rows, tree_background(df)).groupBy("node_id").agg((F.sum("shap") + F.max("base_value")).alias("total"))
    return model.transform(md.with_vector(rows, pm.X)).join(total, "node_id").select("node_id", (F.abs(F.col("total") - F.col("y_pred")) <= 1e-6).alias("adds_up"))


# Two flags that a tree of depth two crosses: its attributions average over the background in closed form.
@query("ml14_tree_attributions", f"""WITH {pm.FLAGGED}, p AS (SELECT third, fifth, avg(y_true) AS v FROM flagged WHERE split = 'train' GROUP BY third, fifth),
  z AS (SELECT third, fifth, count(*) AS n FROM (SELECT * FROM flagged WHERE split = 'train' ORDER BY md5('42:' || node_id), node_id LIMIT {BACKGROUND}) GROUP BY third, fifth),
  parts AS (SELECT x.third, x.fifth, z.n, xx.v AS xx, zz.v AS zz, xz.v AS xz, zx.v AS zx FROM p x, z JOIN p zz ON zz.third = z.third AND zz.fifth = z.fifth
    JOIN p xx ON xx.third = x.third AND xx.fifth = x.fifth JOIN p xz ON xz.third = x.third AND xz.fifth = z.fifth JOIN p zx ON zx.third = z.third AND zx.fifth = x.fifth),
  s AS (SELECT third, fifth, sum(n * (xx - zx + xz - zz)) / 2 / sum(n) AS third_shap, sum(n * (xx - xz + zx - zz)) / 2 / sum(n) AS fifth_shap, sum(n * zz) / sum(n) AS base_value FROM parts GROUP BY 1, 2),
  t AS (SELECT node_id, third, fifth, third_shap, fifth_shap, base_value FROM flagged JOIN s USING (third, fifth) WHERE split = 'test')
  SELECT node_id, 'third' AS feature, third AS feature_value, {q6('third_shap')} AS shap, {q6('base_value')} AS base_value FROM t
  UNION ALL SELECT node_id, 'fifth', fifth, {q6('fifth_shap')}, {q6('base_value')} FROM t""")
def _(spark, folder):
    df = cut_lineage(pm.flagged(spark, folder))
    model = md.fit_boosting(df.where("split = 'train'"), pm.FLAGS, "Y", pm.CROSS)
    return rounded(te.tree_shapley_values(model, df.where("split = 'test'"), tree_background(df)))


@query("ml17_attribution_clusters")
def _(spark, folder):
    table, quality = ex.cluster_attributions(shap(spark, folder), predictions(spark, folder).drop("cluster_id"))
    return table.groupBy("cluster_id", "cluster_label").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("y_pred").alias("mean_y_pred"), F.lit(quality).alias("silhouette"))


GROUPS = 5


@query("ml17_planted_clusters", f"WITH {pm.LABELLED} SELECT node_id, CAST(o_orderkey % {GROUPS} AS INTEGER) AS cluster_id, 'C' || (o_orderkey % {GROUPS}) AS cluster_label FROM labelled")
def _(spark, folder):
    """Well-parted groups come back, numbered by mean prediction."""
    key = F.col("o_orderkey")
    rows = pm.labelled(spark, folder).select("node_id", "city", "o_orderkey")
    planted = F.array(*[F.struct(F.lit(f"f_{i}").alias("feature"), (F.when(key % GROUPS == i, 10.0).otherwise(0.0) + (key % 7) * 0.01).alias("shap")) for i in range(GROUPS)])
    long = rows.withColumn("s", F.explode(planted)).select("node_id", "city", "s.*")
    predicted = rows.select("node_id", (key % GROUPS * 10.0 + key % 3).alias("y_pred"))
    return ex.cluster_attributions(long, predicted, starts=4)[0].select("node_id", "cluster_id", "cluster_label")


@query("ml18_two_column_projection", f"""WITH {pm.LABELLED}, z AS (SELECT node_id, (pt_stop_count - avg(pt_stop_count) OVER ()) / stddev_samp(pt_stop_count) OVER () AS a,
    (acs_population - avg(acs_population) OVER ()) / stddev_samp(acs_population) OVER () AS b, corr(pt_stop_count, acs_population) OVER () AS r FROM labelled)
  SELECT node_id, {q6('abs(a + sign(r) * b) / sqrt(2)')} AS pc1, {q6('abs(a - sign(r) * b) / sqrt(2)')} AS pc2, {q6('(1 + abs(r)) / 2')} AS pc1_share FROM z""")
def _(spark, folder):
    """Two standardised columns have the diagonals as their components; signs are free."""
    pair = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("shap")) for c in ("pt_stop_count", "acs_population")])
    long = pm.labelled(spark, folder).select("node_id", F.explode(pair).alias("s")).select("node_id", "s.*")
    points, shares = ex.project_two(long)
    return rounded(points.select("node_id", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2"), F.lit(shares[0]).alias("pc1_share")))


@query("ml18_projection")
def _(spark, folder):
    points, shares = ex.project_two(shap(spark, folder))
    return points.withColumns({"pc1_share": F.lit(shares[0]), "pc2_share": F.lit(shares[1])})


def curve_sql(f: str) -> str:
    rest = " + ".join([f"{v} * {c}" for c, v in LINEAR.items() if c != f] + ["1"])
    value = f"lo + (hi - lo) * i / 24.0"
    pred = f"{LINEAR[f]} * ({value}) + rest"
    return f"""SELECT '{f}' AS feature, {q6(value, 3)} AS feature_value, {q6(f'avg({pred})', 3)} AS mean_prediction, {q6(f'quantile_cont({pred}, 0.1)', 3)} AS prediction_p10, {q6(f'quantile_cont({pred}, 0.9)', 3)} AS prediction_p90
  FROM (SELECT {rest} AS rest FROM labelled), (SELECT quantile_cont({f}, 0.05) AS lo, quantile_cont({f}, 0.95) AS hi FROM labelled), range(25) AS t(i) GROUP BY i, lo, hi"""


@query("ml19_partial_dependence", f"WITH {pm.LABELLED} " + " UNION ALL ".join(curve_sql(f) for f in LINEAR))
def _(spark, folder):
    model, df = linear_model(spark, folder)
    out = ex.partial_dependence(model, df, list(LINEAR), list(LINEAR))
    return rounded(out.select("feature", F.col("feature_value_raw_scale").alias("feature_value"), "mean_prediction", "prediction_p10", "prediction_p90"), digits=3)


@query("ml19_boosted_dependence")
def _(spark, folder):
    model, df = fitted(spark, folder)
    return ex.partial_dependence(model, df, pm.X, pm.X, logged=["acs_population"])


CURVES = f"""WITH {pm.LABELLED}, curve AS (SELECT city AS feature, pt_stop_count AS v, avg(Y) AS mean_prediction FROM labelled GROUP BY 1, 2)"""


@query("ag39_dependence_summary", f"""{CURVES} SELECT feature, min(v) AS min_raw_value, max(v) AS max_raw_value, {q6('arg_max(mean_prediction, v) - arg_min(mean_prediction, v)', 9)} AS prediction_change,
  {q6('min(mean_prediction)', 9)} AS min_mean_prediction, {q6('max(mean_prediction)', 9)} AS max_mean_prediction FROM curve GROUP BY feature""")
def _(spark, folder):
    v = F.col("pt_stop_count")
    curve = pm.labelled(spark, folder).groupBy(F.col("city").alias("feature"), v.alias("feature_value_model_scale"), v.alias("feature_value_raw_scale")).agg(F.avg("Y").alias("mean_prediction"))
    return rounded(ex.dependence_summary(curve), digits=9)


PROTECTED = ["pt_f_00", "be_f_01", "acs_f_02", "pt_f_03"]


@query("ml20_feature_priority", f"""{W}, {SUMMARY}, {GAINS}, g AS (SELECT feature, avg(importance_gain) AS mean_gain FROM gains WHERE experiment <> 'city_0' GROUP BY feature)
  SELECT feature, {q6("0.75 * (mean_abs_shap - min(mean_abs_shap) OVER ()) / (max(mean_abs_shap) OVER () - min(mean_abs_shap) OVER ()) + 0.25 * (mean_gain - min(mean_gain) OVER ()) / (max(mean_gain) OVER () - min(mean_gain) OVER ()) + CASE WHEN feature IN ('pt_f_00', 'be_f_01', 'acs_f_02', 'pt_f_03') THEN 0.15 ELSE 0 END")} AS priority FROM summary JOIN g USING (feature)""")
def _(spark, folder):
    summary = ex.attribution_summary(shap(spark, folder))
    table = ex.feature_priority(summary, summary, gains(spark, folder).where("experiment <> 'city_0'"), PROTECTED)
    return rounded(table.select("feature", "priority"))


@query("ml21_reduced_features")
def _(spark, folder):
    summary = ex.attribution_summary(shap(spark, folder))
    priority = ex.feature_priority(summary, summary, gains(spark, folder), PROTECTED)
    vectors = ex.attribution_vectors(shap(spark, folder)).withColumnRenamed("raw", "features")
    chosen = ex.reduced_features(vectors, sorted(NAMES), priority, PROTECTED, {"pt": (4, 12), "be": (3, 10), "acs": (3, 10)}, 0.3, 25)
    return priority.where(F.col("feature").isin(chosen)).select("feature", family_code(F.col("feature")).alias("family"), "priority")


@query("ml24_occlusion_importance", f"""WITH {pm.RING_SQL} SELECT node_id, 'pt_stop_count' AS feature, {q6('abs(pt_part)', 3)} AS importance FROM parts WHERE split = 'test'
  UNION ALL SELECT node_id, 'acs_population', {q6('abs(acs_part)', 3)} FROM parts WHERE split = 'test'""")
def _(spark, folder):
    model, table = pm.linear_graph_model(spark, folder)
    out = ex.occlusion_importance(model, table.where("split = 'test'").drop("features"), pm.SMOOTHED)
    return rounded(out.select("node_id", "feature", "importance"), digits=3)
