"""Attribution and model invariants on the smallest driver tables."""

import pytest
from pyspark.sql import functions as F

from blockreach.operators import explain as ex, models as md
from blockreach.plans import load_all, modeling as pm
from blockreach.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def fitted(spark):
    df = pm.labelled(spark, FOLDER).select("node_id", "city", "split", "Y", *pm.X).cache()
    return md.fit_boosting(df.where("split = 'train'"), pm.X, "Y", pm.QUICK), df


def test_attributions_add_up_to_the_prediction(fitted):
    model, df = fitted
    rows = ex.sample_per_city(df.where("split = 'test'"), 2)
    values = ex.shapley_values(model, rows, pm.X, df.where("split = 'train'").orderBy("node_id"))
    total = values.groupBy("node_id").agg((F.sum("shap") + F.first("base_value")).alias("total"))
    joined = model.transform(md.with_vector(rows, pm.X)).join(total, "node_id").select("y_pred", "total").collect()
    assert len(joined) == 20 and all(r.total == pytest.approx(r.y_pred, abs=1e-6) for r in joined)


def test_samples_keep_every_city(fitted):
    _, df = fitted
    picked = ex.sample_by_share(df, 100)
    assert picked.count() <= 100 and picked.select("city").distinct().count() == 10
    assert ex.sample_by_share(df, 10_000_000).count() == df.count()


def test_reduced_features_respect_limits(spark):
    names = ["pt_a", "pt_b", "pt_c", "be_a"]
    rows = [(float(i), float(i) * 2, float((i * 7) % 11), float((i * 5) % 13)) for i in range(50)]
    vectors = md.with_vector(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names)
    priority = spark.createDataFrame([("pt_a", 0.9), ("pt_b", 0.8), ("pt_c", 0.1), ("be_a", 0.5)], "feature string, priority double")
    chosen = ex.reduced_features(vectors, names, priority, [], {"pt": (1, 3), "be": (1, 2)}, 0.95, 10)
    assert chosen == ["pt_a", "pt_c", "be_a"]


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert not any(n.startswith("op") or "pipeline" in n for n in QUERIES)
