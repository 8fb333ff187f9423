"""Boosted trees: blocks against one block, penalties, missing values; exact explanations against brute force."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockreach.operators import boosting as bt, explain as ex, models as md, tree_explain as te

NAMES = ["a", "b", "c", "d"]
SMALL = bt.Boosting(trees=6, rate=0.3, depth=3, rows=1.0, columns=0.8, min_leaf=2, l1=0.5, l2=2.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        x = [float(rng.integers(0, 40)), float(rng.normal()), float(rng.integers(0, 3)), float(rng.normal() * 5)]
        y = x[0] * 0.3 + 4 * (x[1] > 0.2) * x[2] + float(rng.integers(0, 5))
        x[3] = None if i % 7 == 0 else x[3]
        rows.append((f"n{i:04d}", f"city_{i % 3}", *x, y + (9.0 if x[3] is None else 0.0), "clash"))
    return spark.createDataFrame(rows, "node_id string, city string, a double, b double, c double, d double, y double, block string").cache()


@pytest.fixture(scope="module")
def model(table):
    return md.fit_boosting(table, NAMES, "y", SMALL)


def values(df):
    return np.array([[np.nan if r[n] is None else r[n] for n in NAMES] for r in df.orderBy("node_id").collect()])


def same(one, other):
    assert (one.feature == other.feature).all() and (one.code == other.code).all() and (one.missing_left == other.missing_left).all()
    np.testing.assert_allclose(one.value, other.value, atol=1e-9)


def test_blocks_add_up_to_the_same_trees(table):
    settings = [SMALL, bt.Boosting(trees=3, rate=0.5, depth=2, rows=1.0, columns=1.0)]
    one = bt.fit_models(table, NAMES, "y", settings, F.col("city"), ["city_1", None])
    many = bt.fit_models(table, NAMES, "y", settings, F.col("city"), ["city_1", None], block_rows=128)
    for a, b in zip(one, many):
        assert a.base == pytest.approx(b.base)
        same(a, b)


def test_a_table_of_a_million_rows_is_one_block(spark, monkeypatch):
    """A level over several blocks is a Spark job, so 600 trees over 0.6 million rows were 2,400 jobs."""
    monkeypatch.setattr(bt, "grow_over_blocks", lambda *more: pytest.fail("several blocks"))
    df = spark.range(300_000).selectExpr("id node_id", "cast(id % 2 as double) a", "cast(id % 2 * 10 as double) y")
    fitted = bt.fit_models(df, ["a"], "y", [bt.Boosting(trees=1, rate=1.0, depth=1, rows=1.0, l2=0.0)])[0]
    assert fitted.predict(np.array([[0.0], [1.0]])).tolist() == pytest.approx([0.0, 10.0])


def test_wide_tables_have_shorter_blocks(table, monkeypatch):
    one = bt.fit_models(table, NAMES, "y", [SMALL])[0]
    monkeypatch.setattr(bt, "BLOCK_CELLS", 1000)
    monkeypatch.setattr(bt, "grow_in_block", lambda *more: pytest.fail("one block"))
    same(one, bt.fit_models(table, NAMES, "y", [SMALL])[0])


def test_a_held_out_group_has_no_part_in_the_fit(table):
    own = bt.fit_models(table.where("city <> 'city_1'"), NAMES, "y", [SMALL])[0]
    held = bt.fit_models(table, NAMES, "y", [SMALL], F.col("city"), ["city_1"])[0]
    # Cuts come from all rows, so compare on the rows' predictions of a model that uses few-valued columns.
    assert held.base == pytest.approx(own.base)
    assert held.base != pytest.approx(bt.fit_models(table, NAMES, "y", [SMALL])[0].base)


def test_missing_values_go_to_the_side_that_gains(table, model):
    x = values(table)
    y = np.array([r.y for r in table.orderBy("node_id").select("y").collect()])
    error = y - model.predict(x)
    assert (error ** 2).mean() < 0.25 * y.var()
    assert abs(error[np.isnan(x[:, 3])].mean()) < 2.0
    assert (model.feature[model.gain > 0] == 3).any()


def test_penalties_shrink_leaves():
    g, n = np.array([10.0, -10.0, 0.3, 5.0]), np.array([4.0, 4.0, 4.0, 0.0])
    assert bt.leaf_value(g, n, bt.Boosting(l1=0.5, l2=1.0)).tolist() == [-1.9, 1.9, 0.0, 0.0]


def test_rows_and_columns_are_drawn_per_tree():
    s = bt.Boosting(columns=0.5, rows=0.7)
    assert len({tuple(bt.drawn_columns(s, 10, t)) for t in range(20)}) > 10 and len(bt.drawn_columns(s, 10, 0)) == 5
    assert bt.drawn_rows(s, 10_000, 3, 1).tolist() == bt.drawn_rows(s, 10_000, 3, 1).tolist() != bt.drawn_rows(s, 10_000, 4, 1).tolist()
    assert 6_800 < len(bt.drawn_rows(s, 10_000, 3, 1)) < 7_200


def test_odd_tables(spark, table):
    with pytest.raises(ValueError, match="no training rows"):
        md.fit_boosting(table.limit(0), NAMES, "y", SMALL)
    with pytest.raises(ValueError, match="Null value"):
        md.fit_boosting(table.withColumn("y", F.when(F.col("node_id") > "n0005", F.col("y"))), NAMES, "y", SMALL)
    flat = md.fit_boosting(table.withColumns({n: F.lit(None).cast("double") for n in NAMES}), NAMES, "y", SMALL)
    assert flat.gain.max() == 0 and set(flat.importances().values()) == {0.0}
    empty = bt.predictions([flat], bt.feature_array(NAMES))
    assert table.limit(0).select(empty).count() == 0


def test_importances_are_mean_gains(model):
    shares = model.importances()
    assert sum(shares.values()) == pytest.approx(1.0)
    split = model.gain > 0
    mean = {i: model.gain[split & (model.feature == i)].mean() for i in range(4) if (split & (model.feature == i)).any()}
    assert shares["a"] == pytest.approx(mean[0] / sum(mean.values()))


def test_shapley_values_equal_all_coalitions(spark, table, model):
    rows, background = table.orderBy("node_id").limit(15), table.orderBy(F.desc("node_id")).limit(6)
    x, z = values(rows), values(background)
    found = {(r.node_id, r.feature): r for r in te.tree_shapley_values(model, rows, background).collect()}
    assert len(found) == 15 * 4
    for k, own in enumerate(x):
        for i, name in enumerate(NAMES):
            others = [j for j in range(4) if j != i]
            want = 0.0
            for size in range(4):
                for chosen in combinations(others, size):
                    without, with_ = z.copy(), z.copy()
                    without[:, list(chosen)] = own[list(chosen)]
                    with_[:, [*chosen, i]] = own[[*chosen, i]]
                    want += factorial(size) * factorial(3 - size) / factorial(4) * (model.predict(with_) - model.predict(without)).mean()
            assert found[f"n{k:04d}", name].shap == pytest.approx(want, abs=1e-9)
    assert found["n0000", "a"].base_value == pytest.approx(model.predict(z).mean())
    with pytest.raises(ValueError, match="background"):
        te.tree_shapley_values(model, rows, background.limit(0))


def test_curves_equal_scored_copies(table, model):
    rows = ex.partial_dependence(model, table.where("d is not null"), NAMES, NAMES, grid_size=5).collect()
    x = values(table.where("d is not null"))
    assert len(rows) == 20
    for r in rows:
        copy = x.copy()
        copy[:, NAMES.index(r.feature)] = r.feature_value_model_scale
        p = model.predict(copy)
        assert (r.mean_prediction, r.prediction_p10, r.prediction_p90) == pytest.approx((p.mean(), np.quantile(p, 0.1), np.quantile(p, 0.9)), abs=1e-9)
