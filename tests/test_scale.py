"""Work done per query: what is parsed, joined and written once, and what is not computed at all."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from blockreach.functions import schedule as S
from blockreach.operators import clusters as cl, explain as ex, metrics as mt, models as md, transit as tr
from blockreach.plans import carriers as C, modeling as pm

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_clock_text_is_computed_once(spark):
    text = F.concat_ws(":", F.col("id").cast("string"), F.lit("30"), F.lit("15"))
    out = spark.range(3).select(S.clock_minutes(text).alias("t"))
    assert plan_of(out).count("concat_ws(") == 1
    assert [r.t for r in out.orderBy("t").collect()] == [30.25, 90.25, 150.25]


def test_clock_texts_out_of_form(spark):
    texts = ["1:2:3:4", "1:2:3", " 1:2:3", "1:+2:3.5", "1:2", "", None, "1:2:3d", "::", "99:59:59"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.clock_minutes(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [62.05, 62.05, 62.05, 62 + 3.5 / 60, None, None, None, None, None, 99 * 60 + 59 + 59 / 60]


def test_coarser_schedules_equal_the_finest(spark):
    tables = C.schedule_tables(spark, FOLDER)
    whole, routes, stops = (tr.reduce_schedule(**tables, finest=f) for f in ("times", "routes", "stops"))
    for part in (routes, stops):
        assert rows_of(part.stops) == rows_of(whole.stops) and rows_of(part.places) == rows_of(whole.places)
    columns = whole.by_route.columns
    assert rows_of(routes.by_route.select(columns)) == rows_of(whole.by_route) and routes.by_time is None
    assert stops.by_route is None and stops.by_time is None
    assert whole.by_time.count() > 0


def test_metrics_without_ranks_are_one_aggregate(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).cast("double").alias("y_true"), (F.col("id") % 5).cast("double").alias("y_pred"))
    whole, less = (mt.full_metrics(df, ["g"], F.lit(4.0), ranks) for ranks in (True, False))
    assert "Join" not in plan_of(less) and "spearman_r" not in less.columns
    assert rows_of(less) == rows_of(whole.select(less.columns))


def test_held_out_runs_without_ranks(spark):
    df = pm.flagged(spark, FOLDER)
    whole, less = (md.leave_one_city_out_run(df, ["third"], "Y", pm.CITIES, pm.STUMP, ranks=r) for r in (True, False))
    keep = ["heldout_city", "split", "n_rows", *[F.round(c, 9).alias(c) for c in ("rmse", "r2", "pearson_r")]]
    assert rows_of(less[0].select(keep)) == rows_of(whole[0].select(keep)) and len(rows_of(less[0])) == 20
    assert rows_of(less[1].select(whole[1].columns)) == rows_of(whole[1])


def test_graph_features_read_rows_and_edges_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.range(5).select(F.col("id").cast("string").alias("node_id"), F.col("id").cast("double").alias("v"))
    rows = rows.mapInArrow(seen, rows.schema)
    pairs = [(str(i), str(j)) for i in range(5) for j in (i - 1, i + 1) if 0 <= j < 5]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    table, names = md.graph_features(rows, edges, ["v"])
    got = {r.node_id: (r.v__hop1, r.v__hop2) for r in table.collect()}
    assert names == ["v", "v__hop1", "v__hop2"] and reads.value == 5
    assert got == {"0": (1.0, 1.0), "1": (1.0, 1.5), "2": (2.0, 2.0), "3": (3.0, 2.5), "4": (3.0, 3.0)}


def test_distances_of_a_batch_take_little_memory():
    rng = np.random.default_rng(0)
    rows, centres = rng.standard_normal((10_000, 64)), rng.standard_normal((50, 5, 64))
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(len(rows)), pa.int64()), "x": pa.array(list(rows), pa.list_(pa.float64()))})
    found = []
    tracemalloc.start()
    for _, x in cl._pieces(iter([batch]), 250):
        found.append(cl._distances(x, centres).argmin(2).astype(np.int8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35e6
    assert (np.vstack(found) == cl._distances(rows, centres).argmin(2)).all()


class Products:
    """A model with interactions that counts the rows it scores."""

    def __init__(self, spark):
        self.scored = spark.sparkContext.accumulator(0)

    def transform(self, df):
        scored = self.scored

        def seen(batches):
            for batch in batches:
                scored.add(batch.num_rows)
                yield batch

        keep = [c for c in df.columns if c != "features"]
        x = vector_to_array("features")
        out = df.select(*keep, F.aggregate(x, F.lit(1.0), lambda p, v: p * (v + 1)).alias("y_pred"))
        return out.mapInArrow(seen, out.schema)


@pytest.mark.parametrize("count", [1, 2, 4])
def test_sampled_shapley_values_score_few_rows_and_sort_none(spark, count):
    names, draws = [f"f{i}" for i in range(count)], 8
    rng = random.Random(3)
    data = [(f"n{i}", *[round(rng.uniform(-2, 2), 3) for _ in names]) for i in range(45)]
    df = spark.createDataFrame(data, ["node_id", *names])
    rows, background = df.where("node_id < 'n3'"), df.where("node_id >= 'n3'")
    model = Products(spark)
    table = ex.shapley_values(model, rows, names, background, draws)
    assert "Sort" not in table._jdf.queryExecution().executedPlan().toString()
    model.scored.value = 0
    got = {(r.node_id, r.feature): r for r in table.collect()}
    values = {r[0]: r[1:] for r in data}
    kept = [n for n in values if n < "n3"]
    assert model.scored.value == len(kept) * (1 + draws * (count - 1)) and len(got) == len(kept) * count
    assert table.columns == ["node_id", "feature", "feature_value", "shap", "base_value"]

    predict = lambda v: np.prod([x + 1 for x in v])
    picked = sorted((n for n in values if n >= "n3"), key=lambda n: (hashlib.md5(f"42:{n}".encode()).hexdigest(), n))[:draws]
    orders = random.Random(42)
    want = {(n, f): 0.0 for n in kept for f in names}
    for i in range(draws):
        order = names[:]
        orders.shuffle(order)
        for n in kept:
            mix = list(values[picked[i]])
            for f in order:
                before = predict(mix)
                mix[names.index(f)] = values[n][names.index(f)]
                want[n, f] += (predict(mix) - before) / draws
    assert {k: r.shap for k, r in got.items()} == pytest.approx(want, abs=1e-9)
    assert all(r.feature_value == values[n][names.index(f)] for (n, f), r in got.items())
    assert {round(r.base_value, 9) for r in got.values()} == {round(float(np.mean([predict(values[n]) for n in picked])), 9)}


def test_items_are_dealt_out_before_they_are_grouped(spark):
    dealt, plain = (pm.labelled(spark, FOLDER, dealt=d).select("node_id", "split", "pt_stop_count", "pt_route_count") for d in (True, False))
    assert "RepartitionByExpression [l_orderkey" in plan_of(dealt) and "Repartition" not in plan_of(plain)
    assert rows_of(dealt) == rows_of(plain)
