"""Targets, context, datasets, splits, views, metrics and sources on small tables."""

import pytest
from pyspark.sql import functions as F

from blockreach.functions import numeric as N, schedule as S
from blockreach.operators import checks, context as cx, dataset as ds, metrics as mt, quantiles as qt, splits as sp, target as tg, transit as tr, views as vw
from blockreach.session import cut_lineage
from blockreach.sources import text


def test_two_block_target(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("b", 10.0, 20.0, 2.0, 4.0, 6.0, 8.0)],
        "block_id string, jobs_1km double, jobs_2km double, amen_food_1km double, amen_food_2km double, amen_health_1km double, amen_health_2km double",
    )
    out = tg.city_target(df, (1, 2), ("food", "health"), {1: 0.75, 2: 0.25}).orderBy("block_id").collect()
    assert [(r.E, r.A, r.Y) for r in out] == [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]


def test_global_target_uses_one_scale(spark):
    df = spark.createDataFrame(
        [("a:1", "a", "1", 0.0, 0.0), ("a:2", "a", "2", 10.0, 1.0), ("b:1", "b", "1", 100.0, 2.0), ("b:2", "b", "2", 1000.0, 10.0)],
        "node_id string, city string, block_id string, jobs_1km double, amen_food_1km double",
    )
    for view in tg.GLOBAL_VIEWS:
        got = {r.node_id: r[f"Y_{view}"] for r in tg.global_target(df, view, (1,), ("food",), {1: 1.0}).collect()}
        assert min(got.values()) == 0.0 and got["b:2"] == 1.0


def test_jobs_are_summed_and_sources_checked(spark):
    rows = spark.createDataFrame([("080310001001000", 2), ("080310001001000", 3), ("080310001001001", 5)], "w_geocode string, C000 long")
    assert {r.block_id[-1]: r.jobs for r in text.jobs_by_block(rows).collect()} == {"0": 5.0, "1": 5.0}
    other = spark.createDataFrame([("360310001001000", 1)], "w_geocode string, C000 long")
    assert text.choose_job_source({"state": rows, "city": rows}, "co")[0] == "state"
    assert text.choose_job_source({"state": rows, "city": rows}, "co", prefer_state=False)[0] == "city"
    assert text.choose_job_source({"state": other, "legacy_city": rows}, "co")[0] == "legacy_city"
    with pytest.raises(FileNotFoundError):
        text.choose_job_source({"state": other}, "co")


def test_context_ratios_and_unknown_tract(spark):
    columns = {
        "tract_geoid": "08031000100", "B03002EST1": "1000", "Shape__Area": "2000000", "B03002EST3_PCT": "50",
        "B08201_001E": "100", "B08201_002E": "20", "B08301_001E": "100", "B08301_002E": "60", "B08301_010E": "20",
        "B18101_001E": "1000", "B18101_004E": "20", "B18101_007E": "30",
    }
    names = {*cx.NUMBERS.values(), *cx.SHARES.values(), *[c for ab in cx.RATIOS.values() for c in ab], *columns}
    row = {n: columns.get(n) for n in names} | {c: str(v) for c, v in zip(cx.ADULT_COLUMNS, (200, 200, 200, 200))} | {"BD_25TO34": "290"}
    tables = spark.createDataFrame([row], ", ".join(f"`{n}` string" for n in row))
    tracts = cx.impute_medians(cx.tract_features(tables, ["B18101_004E", "B18101_007E"]))
    got = tracts.first()
    assert got.acs_population_density_per_km2 == 500.0 and got.acs_white_non_hispanic_share == 0.5
    assert got.acs_zero_vehicle_household_share == 0.2 and got.acs_car_commute_share == 0.6 and got.acs_disability_share == 0.05
    assert got.acs_bachelor_or_higher_share == 290 / 800 and got.acs_median_age == 0.0
    ids = spark.createDataFrame([("080310001001000",), ("990010001001000",)], "block_id string")
    assert [r.acs_population for r in cx.attach_to_blocks(ids, tracts).collect()] == [1000.0, 1000.0]


def test_numbers_times_and_modes(spark):
    df = spark.createDataFrame([("12.5", "25:30:30", "0"), ("1d", "7:00:00", "700"), (" 7 ", "bad", "9999"), (None, "8:15", "11")], "n string, t string, m string")
    out = df.select(N.to_number(F.col("n")).alias("n"), S.clock_minutes(F.col("t")).alias("t"), S.route_mode(F.col("m")).alias("m")).collect()
    assert [r.n for r in out] == [12.5, None, 7.0, None]
    assert [r.t for r in out] == [1530.5, 420.0, None, None]
    assert [r.m for r in out] == ["tram", "bus", "other", "bus"]


def test_transit_defaults_cover_the_contract(spark):
    names = tr.transit_feature_names()
    assert len(names) == len(set(names)) == 163
    row = tr.empty_transit_features(spark.createDataFrame([("a",)], "block_id string")).first()
    assert row.pt_nearest_stop_dist_m == row.pt_nearest_bus_stop_dist_m == 10_000.0
    assert row.pt_avg_headway_min == 1440.0 and row.pt_stop_count == 0.0


def test_leakage_guard():
    for bad in ("Y", "jobs_1km", "lon", "amen_food_1km", "E_global"):
        with pytest.raises(ValueError):
            checks.require_no_leakage(["pt_stop_count", bad])
    checks.require_no_leakage(["pt_stop_count", "be_compactness", "acs_population"])


def model_parts(spark):
    features = spark.createDataFrame([("1", 1.0, 2.0, 3.0), ("2", 2.0, 3.0, 4.0), ("3", 3.0, 4.0, 5.0)], "block_id string, pt_a double, be_b double, acs_c double")
    target = spark.createDataFrame([("1", 0.1), ("2", 0.2), ("3", 0.3)], "block_id string, Y double")
    splits = spark.createDataFrame([("1", "train", 0), ("2", "val", 1), ("3", "test", 2)], "block_id string, split string, spatial_cell int")
    return features, target, splits


def test_dataset_keeps_rows_and_order_and_rejects_gaps(spark):
    features, target, splits = model_parts(spark)
    columns = ["pt_a", "be_b", "acs_c"]
    out = ds.assemble(features, target, splits, columns)
    assert out.columns == ["block_id", *columns, "Y", "split", "spatial_cell"] and out.count() == 3
    with pytest.raises(ValueError):
        ds.assemble(features, target.where("block_id <> '2'"), splits, columns)
    with pytest.raises(ValueError):
        ds.assemble(features, target.unionByName(target), splits, columns)
    with pytest.raises(ValueError):
        ds.assemble(features.withColumn("pt_a", F.lit(None).cast("double")), target, splits, columns)


def test_spatial_split_labels_each_block_once_in_connected_regions(spark):
    rows = [("c", f"{i:03d}", float(i % 10), float(i // 10)) for i in range(100)]
    coords = spark.createDataFrame(rows, "city string, block_id string, x_m double, y_m double")
    labels = sp.spatial_splits(coords, seed=7, val_frac=0.2, test_frac=0.2, bins_x=5, bins_y=5)
    got = labels.collect()
    assert sorted(r.block_id for r in got) == [r[1] for r in rows]
    assert {r.split for r in got} == {"train", "val", "test"}
    for part in ("test", "val"):
        assert 20 <= sum(r.split == part for r in got) <= 24
    cells = {(r.spatial_cell // 5, r.spatial_cell % 5) for r in got if r.split == "test"}
    seen, front = set(), [next(iter(cells))]
    while front:
        x, y = front.pop()
        if (x, y) in cells and (x, y) not in seen:
            seen.add((x, y))
            front += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    assert seen == cells


def test_split_shift_leaves_out_train(spark):
    df = spark.createDataFrame([("train", 1.0, 1.0), ("train", 3.0, 2.0), ("val", 5.0, 1.0), ("test", 2.0, 9.0)], "split string, pt_stop_count double, be_compactness double")
    out = sp.feature_shift(df, ["pt_stop_count", "be_compactness"])
    assert {r.split for r in out.collect()} == {"val", "test"} and out.count() == 4


def test_perfect_prediction(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.2, 0.2), (0.3, 0.3)], "y_true double, y_pred double")
    row = mt.regression_metrics(df).first()
    assert (row.rmse, row.mae, row.r2) == (0.0, 0.0, 1.0)


def test_city_rank_zscore_and_context(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.9), ("b", 10.0), ("b", 20.0)], "city string, Y double")
    assert sorted(r.Y for r in vw.target_view(df, "city_rank").collect()) == [0.5, 0.5, 1.0, 1.0]
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "city string, pt_stop_density_per_km2 double")
    z = vw.city_zscore(df, ["pt_stop_density_per_km2"]).groupBy("city").agg(F.avg("pt_stop_density_per_km2").alias("m")).collect()
    assert all(r.m == pytest.approx(0.0) for r in z)
    out, names = vw.city_context(df, ["pt_stop_density_per_km2"])
    got = {r.city: (r.city_mean__pt_stop_density_per_km2, r.city_std__pt_stop_density_per_km2) for r in out.collect()}
    assert got["a"][0] == 2.0 and got["b"] == (10.0, 0.0) and "Y" not in names
    assert vw.expand(["all"], "all", vw.FEATURE_VIEWS) == list(vw.FEATURE_VIEWS)


def test_quantiles_match_linear_interpolation(spark):
    import numpy as np

    values = [5.0, 1.0, 1.0, 1.0, 9.0, 2.5, 7.0, None]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 4.0)], "k string, v double")
    got = {r.k: r.q for r in qt.quantiles(df, "v", ["k"], [0.0, 0.1, 0.5, 0.75, 1.0]).collect()}
    assert got["g"] == pytest.approx(list(np.quantile([v for v in values if v is not None], [0, 0.1, 0.5, 0.75, 1])))
    assert got["h"] == [4.0] * 5


def test_no_rows_are_lost(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", None), ("c", None, 2.0), ("d", None, 5.0)], "node_id string, city string, Y double")
    ranked = {r["node_id"]: r["r"] for r in qt.percentile_rank(df, "Y", ["city"], "r").collect()}
    assert ranked == {"a": 1.0, "b": None, "c": 0.5, "d": 1.0}
    assert vw.city_zscore(df, ["Y"]).count() == 4
    with pytest.raises(ValueError, match="lacks rows"):
        ds.swap_target(df, df.where("node_id <> 'a'").withColumn("v", F.lit(1.0)), "Y", "v")
    with pytest.raises(ValueError, match="duplicate"):
        ds.swap_target(df, df.unionByName(df).withColumn("v", F.lit(1.0)), "Y", "v")
    with pytest.raises(ValueError, match="left side"):
        ds.join_checked(df.unionByName(df), df, ["node_id"], one_to_one=True)
    scored = spark.createDataFrame([(1.0, None), (2.0, 1.0)], "y_true double, y_pred double")
    with pytest.raises(Exception, match="Null value in y_pred"):
        mt.regression_metrics(scored).collect()


def test_first_vintage_and_share_over_all_rows(spark, tmp_path):
    for year, jobs in ((2019, 5), (2020, 7)):
        folder = tmp_path / "city" / "denver"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"wac_JT00_{year}.csv").write_text(f"w_geocode,C000\n080310001001000,{jobs}\n")
    scope, rows = text.find_job_source(spark, str(tmp_path), "denver", "co")
    assert scope == "city" and [r["jobs"] for r in text.jobs_by_block(rows).collect()] == [5.0]
    mixed = spark.createDataFrame([("08" + str(i),) for i in range(2000)] + [("36" + str(i),) for i in range(400)], "w_geocode string")
    assert not text.in_state(mixed, "co") and text.in_state(mixed.limit(0), "nowhere")


def test_calendar_of_a_feed_without_a_weekday_column(spark):
    trips = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (1, "d")], "feed_idx int, service_id string")
    days = tr.WEEKDAYS
    whole = spark.createDataFrame([(0, "a", *["1"] * 5), (0, "b", *["0"] * 5)], "feed_idx int, service_id string, " + ", ".join(f"{d} string" for d in days))
    part = spark.createDataFrame([(1, "c", *["0"] * 4)], "feed_idx int, service_id string, " + ", ".join(f"{d} string" for d in days[:4]))
    both = whole.unionByName(part, allowMissingColumns=True)
    assert sorted(r["service_id"] for r in tr.active_services(both, trips).collect()) == ["a", "c", "d"]


@pytest.mark.parametrize("few", [10_000, 3])
def test_quantiles_leave_the_values_where_they_are(spark, monkeypatch, few):
    """Values behind an exploded array look small to the size check, which sent them to the driver."""
    monkeypatch.setattr(qt, "FEW_GROUPS", few)
    copies = spark.range(400).select("id", F.explode(F.array(*[F.lit(float(i)) for i in range(75)])).alias("g")).withColumn("v", F.col("id") * (F.col("g") + 1))
    found = qt.quantiles(cut_lineage(copies), "v", ["g"], [0.1, 0.9])
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.g: r.q for r in found.collect()} == {float(i): pytest.approx([39.9 * (i + 1), 359.1 * (i + 1)]) for i in range(75)}
