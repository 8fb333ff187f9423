"""Sources, sinks, tract context and backbone queries. Text sources are written to scratch and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockreach.functions import tags as T
from blockreach.operators import backbone as bb, checks, context as cx, dataset as ds, engine, graph as gr, overlay as ov, target as tg, transit as tr
from blockreach.plans import carriers as C, reach, space
from blockreach.plans.registry import q6, query, r6, rounded
from blockreach.plans.scalars import pick, sql_pick
from blockreach.sources import layers, sinks, text


def via_csv(df: DataFrame) -> str:
    """Write a frame as headed CSV to scratch; the folder."""
    path = sinks.scratch_folder(df.sparkSession)
    df.write.option("header", True).csv(path)
    return path


# --- schedules and jobs -----------------------------------------------------------------------

@query("src01_schedule_table", f"WITH {C.STOPS_SQL} SELECT stop_id, nullif(location_type, '') AS location_type FROM raw_stops WHERE feed_idx = 0")
def _(spark, folder):
    path = via_csv(C.schedule_tables(spark, folder)["stops"].where("feed_idx = 0").drop("feed_idx"))
    return text.read_schedule_table(spark, path, ["stop_id", "location_type", "wheelchair_boarding"])


@query("src02_union_feeds", f"""WITH {C.STOPS_SQL} SELECT feed_idx, 'feed' || feed_idx || ':' || trip_id AS trip_key, CASE WHEN feed_idx = 0 THEN service_id END AS service_id FROM raw_trips""")
def _(spark, folder):
    trips = C.schedule_tables(spark, folder)["trips"]
    first = trips.where("feed_idx = 0").select("trip_id", "service_id")
    second = trips.where("feed_idx = 1").select("trip_id")
    both = text.union_feeds([first, second])
    return both.select("feed_idx", tr.S.feed_key(F.col("feed_idx"), F.col("trip_id")).alias("trip_key"), "service_id")


@query("set01_union_all", f"WITH {C.STOPS_SQL} SELECT feed_idx, count(*) AS n FROM raw_times GROUP BY feed_idx")
def _(spark, folder):
    times = C.schedule_tables(spark, folder)["stop_times"]
    both = text.union_feeds([times.where(F.col("feed_idx") == i).drop("feed_idx") for i in (0, 1)])
    return both.groupBy("feed_idx").agg(F.count(F.lit(1)).alias("n"))


def job_rows(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("l_suppkey")
    return C.table(spark, folder, "lineitem", "l_suppkey", "l_quantity", "l_linenumber").select(
        F.concat(pick(key, "08", "08", "36"), C.pad(key, 13)).alias("w_geocode"),
        F.when(F.col("l_linenumber") < 7, F.col("l_quantity").cast("int")).alias("C000"))


@query("src03_jobs_by_block", f"""SELECT CASE l_suppkey % 3 WHEN 2 THEN '36' ELSE '08' END || lpad(CAST(l_suppkey AS VARCHAR), 13, '0') AS block_id,
  coalesce(sum(CASE WHEN l_linenumber < 7 THEN l_quantity END), 0.0) AS jobs FROM lineitem GROUP BY 1""")
def _(spark, folder):
    return text.read_jobs(spark, via_csv(job_rows(spark, folder)))


@query("src04_job_source_choice", "SELECT 'city' AS scope, count(*) AS n_rows FROM lineitem WHERE l_suppkey % 3 <> 2")
def _(spark, folder):
    rows = job_rows(spark, folder)
    other = rows.where(F.col("w_geocode").startswith("36"))
    scope, chosen = text.choose_job_source({"state": other, "city": rows.where(F.col("w_geocode").startswith("08")), "legacy_city": rows}, "co")
    return chosen.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(scope).alias("scope"), "n_rows")


@query("jn03_jobs_at_points", f"""WITH {C.BLOCKS_SQL} SELECT b.block_id, x, y, {q6('sum(o_totalprice)', 2)} AS jobs FROM orders JOIN blocks b ON c_custkey = o_custkey GROUP BY ALL""")
def _(spark, folder):
    rows = C.table(spark, folder, "orders", "o_custkey", "o_totalprice").select(
        F.concat(C.pad(C.div(F.col("o_custkey"), 10), 11), C.pad(F.col("o_custkey") % 10, 4)).alias("w_geocode"), F.col("o_totalprice").alias("C000"))
    return rounded(C.blocks(spark, folder).select("block_id", "x", "y").join(text.jobs_by_block(rows), "block_id"), digits=2)


@query("set03_jobs_outside_city", f"WITH {C.BLOCKS_SQL} SELECT block_id FROM blocks WHERE c_custkey IN (SELECT o_custkey FROM orders) AND city <> 'city_3'")
def _(spark, folder):
    b = C.blocks(spark, folder)
    sources = b.join(C.table(spark, folder, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("block_id")
    return sources.join(b.where("city = 'city_3'").select("block_id"), "block_id", "left_anti")


# --- tracts -----------------------------------------------------------------------------------

TRACT_SQL = """
tract AS (SELECT c_custkey // 10 AS k, lpad(CAST(c_custkey // 10 AS VARCHAR), 11, '0') AS tract_geoid, count(*) AS n,
  round(sum(c_acctbal), 2) AS bal, round(max(c_acctbal), 2) AS top, min(c_nationkey) AS nat FROM customer GROUP BY c_custkey // 10)"""


def tracts(spark: SparkSession, folder: str) -> DataFrame:
    return C.table(spark, folder, "customer", "c_custkey", "c_acctbal", "c_nationkey").groupBy(C.div(F.col("c_custkey"), 10).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"), F.round(F.max("c_acctbal"), 2).alias("top"), F.min("c_nationkey").alias("nat"))


def tract_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Raw census tables, one row per ten customers, with missing codes sprinkled in."""
    t, k = tracts(spark, folder), F.col("k")
    s = lambda c: c.cast("string")
    holed = lambda c, m: s(F.when(k % m == 0, F.lit(-666666666.0)).otherwise(c))
    demographic = t.select(
        s(k).alias("GEOID"), holed(F.col("bal"), 11).alias("B03002EST1"), s(F.col("n") * 250000.0).alias("Shape__Area"),
        *[s((k * m) % 100).alias(f"B03002EST{c}_PCT") for c, m in ((3, 3), (4, 7), (6, 11), (12, 13))],
        s((k * 17) % 100).alias("B01001_UNDER17_PCT"), s((k * 19) % 100).alias("B01001_ABOVE64_PCT"),
        *[s((k + i) % 50).alias(c) for i, c in enumerate(cx.DEGREE_COLUMNS)],
        *[s((k * (i + 2)) % 90 + 50).alias(c) for i, c in enumerate(cx.ADULT_COLUMNS)])
    socio = t.select(s(k).alias("GEOID"), holed(F.col("top"), 7).alias("B19013EST1"), s((k * 23) % 100).alias("B17021EST2_PCT"),
                     s((k * 29) % 100).alias("B23001_UE_PCT"), s(F.col("nat") + 10).alias("B08013_AVG_TTW"), s((k * 31) % 100).alias("B08303_60PLUS_TTW_PCT"))
    housing = t.select(s(k).alias("GEOID"), s((k * 37) % 100).alias("B25002EST3_PCT"), s(F.col("top") / 10).alias("B25058EST1")).where(k % 5 != 0)
    geo = F.concat(F.lit("1400000US"), C.pad(k, 11)).alias("GEO_ID")
    rest = t.select(
        geo, s(F.col("nat") + 20).alias("B01002_001E"), s(k % 40).alias("B08201_001E"), s(k % 20).alias("B08201_002E"),
        s(k % 30).alias("B08301_001E"), *[s(k % m).alias(f"B08301_0{c}E") for c, m in (("02", 5), ("10", 4), ("18", 3), ("19", 6), ("21", 7))],
        s(F.lit(100) + k % 10).alias("B18101_001E"), s(k % 9).alias("B18101_004E"), s(k % 8).alias("B18101_007E"))
    return {"demographic": demographic, "socio": socio, "housing": housing, "census": rest}


@query("src05_demographic_tracts", f"WITH {TRACT_SQL} SELECT tract_geoid, CAST(k AS VARCHAR) AS \"GEOID\" FROM tract")
def _(spark, folder):
    path = via_csv(tract_tables(spark, folder)["demographic"])
    return text.tract_ids(text.read_text_table(spark, path)).select("tract_geoid", "GEOID")


@query("src06_census_tracts", f"WITH {TRACT_SQL} SELECT tract_geoid, CAST(nat + 20 AS VARCHAR) AS \"B01002_001E\" FROM tract")
def _(spark, folder):
    census = tract_tables(spark, folder)["census"].select("GEO_ID", "B01002_001E")
    labels = census.limit(1).select(F.lit("Geography").alias("GEO_ID"), F.lit("Estimate!!Median age").alias("B01002_001E"))
    return text.census_tracts(text.read_text_table(spark, via_csv(census.unionByName(labels)))).select("tract_geoid", "B01002_001E")


META_SQL = """meta AS (SELECT 'B18101_' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || CASE p_partkey % 2 WHEN 0 THEN 'E' ELSE 'M' END AS column_name,
  'Total:!!' || CASE p_partkey % 3 WHEN 0 THEN 'With a Disability' WHEN 1 THEN 'No disability' ELSE 'with a disability, other' END AS label FROM part)"""


@query("src07_labelled_columns", f"WITH {META_SQL} SELECT column_name AS \"Column Name\" FROM meta WHERE column_name LIKE '%E' AND lower(label) LIKE '%with a disability%'")
def _(spark, folder):
    key = F.col("p_partkey")
    meta = C.table(spark, folder, "part", "p_partkey").select(
        F.concat(F.lit("B18101_"), C.pad(key, 5), pick(key, "E", "M")).alias("Column Name"),
        F.concat(F.lit("Total:!!"), pick(key, "With a Disability", "No disability", "with a disability, other")).alias("Label"))
    return text.labelled_columns(text.read_text_table(spark, via_csv(meta)))


def joined_tracts(spark: SparkSession, folder: str) -> DataFrame:
    t = tract_tables(spark, folder)
    return cx.join_tract_tables(text.tract_ids(t["demographic"]), [text.tract_ids(t["socio"]), text.tract_ids(t["housing"]), text.census_tracts(t["census"])])


DISABILITY = ("B18101_004E", "B18101_007E")
_ACS = {
    "acs_population": "CASE WHEN k % 11 <> 0 THEN bal END",
    "acs_population_density_per_km2": "CASE WHEN k % 11 <> 0 THEN bal END / (n * 0.25)",
    "acs_median_household_income": "CASE WHEN k % 7 <> 0 THEN top END",
    "acs_poverty_share": "(k * 23) % 100 / 100.0", "acs_unemployment_share": "(k * 29) % 100 / 100.0",
    "acs_white_non_hispanic_share": "(k * 3) % 100 / 100.0", "acs_black_share": "(k * 7) % 100 / 100.0",
    "acs_hispanic_share": "(k * 13) % 100 / 100.0", "acs_asian_share": "(k * 11) % 100 / 100.0",
    "acs_age_under_18_share": "(k * 17) % 100 / 100.0", "acs_age_65_plus_share": "(k * 19) % 100 / 100.0",
    "acs_bachelor_or_higher_share": f"({' + '.join(f'(k + {i}) % 50' for i in range(8))}) / CAST({' + '.join(f'((k * {i + 2}) % 90 + 50)' for i in range(4))} AS DOUBLE)",
    "acs_avg_commute_time_min": "nat + 10", "acs_commute_60_plus_min_share": "(k * 31) % 100 / 100.0",
    "acs_vacant_housing_share": "CASE WHEN k % 5 <> 0 THEN (k * 37) % 100 / 100.0 END", "acs_median_contract_rent": "CASE WHEN k % 5 <> 0 THEN top / 10 END",
    "acs_median_age": "nat + 20", "acs_zero_vehicle_household_share": "(k % 20) / nullif(CAST(k % 40 AS DOUBLE), 0)",
    **{n: f"(k % {m}) / nullif(CAST(k % 30 AS DOUBLE), 0)" for n, m in (
        ("acs_public_transit_commute_share", 4), ("acs_car_commute_share", 5), ("acs_walk_commute_share", 6),
        ("acs_bike_commute_share", 3), ("acs_work_from_home_share", 7))},
    "acs_disability_share": "(k % 9 + k % 8) / (100.0 + k % 10)",
}
ACS_SQL = f"{TRACT_SQL}, acs AS (SELECT k, tract_geoid, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _ACS.items())} FROM tract)"
_ACS_OUT = ", ".join(f"{q6(n)} AS {n}" for n in cx.ACS_FEATURES)


@query("jn05_tract_tables", f"WITH {TRACT_SQL} SELECT tract_geoid, CAST((k * 23) % 100 AS VARCHAR) AS \"B17021EST2_PCT\", CASE WHEN k % 5 <> 0 THEN CAST((k * 37) % 100 AS VARCHAR) END AS \"B25002EST3_PCT\", CAST(k % 40 AS VARCHAR) AS \"B08201_001E\" FROM tract")
def _(spark, folder):
    return joined_tracts(spark, folder).select("tract_geoid", "B17021EST2_PCT", "B25002EST3_PCT", "B08201_001E")


@query("ag24_tract_ratios", f"WITH {ACS_SQL} SELECT tract_geoid, {_ACS_OUT} FROM acs")
def _(spark, folder):
    return rounded(cx.tract_features(joined_tracts(spark, folder), DISABILITY))


_IMPUTED = ", ".join(f"coalesce({n}, (SELECT coalesce(median({n}), 0.0) FROM acs)) AS {n}" for n in cx.ACS_FEATURES)


@query("ag23_median_imputation", f"WITH {ACS_SQL}, filled AS (SELECT tract_geoid, {_IMPUTED} FROM acs) SELECT tract_geoid, {_ACS_OUT} FROM filled")
def _(spark, folder):
    return rounded(cx.impute_medians(cx.tract_features(joined_tracts(spark, folder), DISABILITY)))


@query("ag23_missing_counts", f"WITH {ACS_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count_if({n} IS NULL) AS n_missing FROM acs" for n in cx.ACS_FEATURES))
def _(spark, folder):
    return cx.missing_counts(cx.tract_features(joined_tracts(spark, folder), DISABILITY))


@query("jn06_block_context", f"""WITH {ACS_SQL}, {C.BLOCKS_SQL}, filled AS (SELECT tract_geoid, {_IMPUTED} FROM acs), kept AS (SELECT * FROM filled WHERE tract_geoid NOT LIKE '%3')
  SELECT b.block_id, {', '.join(f"{q6(f'coalesce(f.{n}, (SELECT median({n}) FROM kept))')} AS {n}" for n in cx.ACS_FEATURES)}
  FROM blocks b LEFT JOIN kept f ON substring(b.block_id, 1, 11) = f.tract_geoid""")
def _(spark, folder):
    filled = cx.impute_medians(cx.tract_features(joined_tracts(spark, folder), DISABILITY))
    return rounded(cx.attach_to_blocks(C.blocks(spark, folder), filled.where(~F.col("tract_geoid").endswith("3"))))


# --- layers -----------------------------------------------------------------------------------

@query("src08_amenity_layers", f"""WITH {C.AMENITIES_SQL}, {C.GRID_SQL} SELECT CAST(p_partkey AS VARCHAR) AS osm_id, x, y, amenity, shop,
  regexp_extract(other_tags, '"leisure"=>"([^"]+)"', 1) AS leisure, 'points' AS source_layer FROM tagged
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), x0 + 50.0, y0 + 50.0, NULL, NULL, CASE p_partkey % 2 WHEN 0 THEN 'park' END, 'multipolygons' FROM grid""")
def _(spark, folder):
    osm = lambda df: df.withColumn("osm_id", F.col("p_partkey").cast("string"))
    points = osm(C.tagged_points(spark, folder))
    shapes = osm(space.polygons(spark, folder)).withColumn("other_tags", F.when(F.col("p_partkey") % 2 == 0, '"leisure"=>"park"'))
    return rounded(layers.amenity_points(points, shapes))


BOX = (500.0, 200.0, 1500.0, 900.0)
_BOXED = "CASE WHEN c < 39 THEN x0 + 150 ELSE x0 + 50 END >= 500 AND x0 + 50 <= 1500 AND y0 + 150 >= 200 AND y0 + 50 <= 900"


def boxed_streets(spark: SparkSession, folder: str) -> DataFrame:
    lines = space.raw_streets(spark, folder).withColumn("edges", ov.once(ov.G.line_edges(F.col("line"))))
    low = lambda c: F.array_min(F.concat(F.transform("edges", lambda e: e[f"{c}1"]), F.transform("edges", lambda e: e[f"{c}2"])))
    high = lambda c: F.array_max(F.concat(F.transform("edges", lambda e: e[f"{c}1"]), F.transform("edges", lambda e: e[f"{c}2"])))
    boxed = lines.withColumns({"minx": low("x"), "miny": low("y"), "maxx": high("x"), "maxy": high("y")}).drop("edges")
    path = sinks.scratch_folder(spark)
    boxed.write.parquet(path)
    return spark.read.parquet(path)


@query("src09_road_lines", f"WITH {C.GRID_SQL} SELECT p_partkey, {space.HIGHWAY_SQL} AS highway_type FROM grid WHERE p_partkey % 6 NOT IN (2) AND {_BOXED}")
def _(spark, folder):
    return layers.require_rows(layers.road_lines(boxed_streets(spark, folder), BOX), "road lines").select("p_partkey", "highway_type")


@query("src10_street_lines", f"WITH {C.GRID_SQL} SELECT p_partkey, {space.HIGHWAY_SQL} AS highway_type, {q6(space.SPEED_SQL)} AS speed_kmh FROM grid WHERE {_BOXED}")
def _(spark, folder):
    return rounded(layers.street_lines(boxed_streets(spark, folder), BOX).select("p_partkey", "highway_type", "speed_kmh"))


@query("src11_land_polygons", f"SELECT p_partkey, {space.GROUP_SQL} AS landuse_group, p_partkey % 5 = 0 AS is_building FROM part WHERE p_partkey % 7 <> 6 OR p_partkey % 5 = 0")
def _(spark, folder):
    key = F.col("p_partkey")
    layer = C.grid_blocks(spark, folder).select(
        "p_partkey", space.choose(key, space.LANDUSE).alias("landuse"), F.when(key % 5 == 0, '"building"=>"yes"').when(key % 5 == 1, '"building"=>"No"').alias("other_tags"))
    return layers.land_polygons(layer).select("p_partkey", "landuse_group", "is_building")


@query("src12_place_boundary", f"SELECT p_partkey, lpad(CAST(p_partkey % 50 AS VARCHAR), 7, '0') AS place_geoid FROM part WHERE p_partkey % 50 = 8")
def _(spark, folder):
    places = C.grid_blocks(spark, folder).select("p_partkey", C.pad(F.col("p_partkey") % 50, 7).alias("GEOID20"), "rings")
    return layers.place_boundary(places, "0000008").select("p_partkey", "place_geoid")


@query("fn18_standard_blocks", """SELECT lpad(CAST(o_custkey AS VARCHAR), 15, '0') AS block_id, '08' AS state_fips, min(lpad(CAST(o_custkey % 100 AS VARCHAR), 3, '0')) AS county_fips,
  min(lpad(CAST(o_custkey AS VARCHAR), 6, '0')) AS tract_code, min(lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS block_code FROM orders GROUP BY o_custkey""")
def _(spark, folder):
    k = F.col("o_custkey")
    raw = C.table(spark, folder, "orders", "o_orderkey", "o_custkey").select(
        C.pad(k, 15).alias("geoid20"), F.lit("08").alias("STATEFP"), C.pad(k % 100, 3).alias("COUNTYFP20"), C.pad(k, 6).alias("TRACTCE20"),
        C.pad(F.col("o_orderkey"), 8).alias("BLOCKCE20"), F.lit(1).alias("ALAND20"))
    return layers.standard_blocks(raw)


@query("src18_city_inputs", """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'boston' WHEN n_nationkey % 3 = 1 THEN 'denver' ELSE lower(n_name) END AS city,
  CASE WHEN n_nationkey % 3 = 0 THEN 'ma' WHEN n_nationkey % 3 = 1 THEN 'co' END AS state, CASE WHEN n_nationkey % 3 = 0 THEN '2507000' WHEN n_nationkey % 3 = 1 THEN '0820000' END AS place_geoid,
  n_nationkey % 3 < 2 AS known FROM nation""")
def _(spark, folder):
    k = F.col("n_nationkey")
    asked = C.table(spark, folder, "nation").select(
        "n_nationkey", F.when(k % 3 == 0, " Boston ").when(k % 3 == 1, "DENVER").otherwise(F.col("n_name")).alias("city"),
        F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("place_geoid"))
    keyed = asked.withColumn("city_key", F.lower(F.trim("city")))
    resolved = layers.resolve_cities(asked.select("city", "state", "place_geoid").distinct())
    return keyed.select("n_nationkey", "city_key").join(resolved, F.col("city_key") == F.col("city")).drop("city_key")


@query("src19_distance_weights", "SELECT CAST(r AS INTEGER) AS radius, (6 - r) / 15.0 AS weight FROM range(1, 6) t(r) WHERE EXISTS (SELECT 1 FROM customer)")
def _(spark, folder):
    stored = C.table(spark, folder, "customer", "c_nationkey").distinct().select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("radius")).withColumn("weight", (6 - F.col("radius")) / 15.0)
    return layers.distance_weights(stored, tg.RADII_KM)


@query("src19_equal_weights", "SELECT CAST(r AS INTEGER) AS radius, 0.2::DOUBLE AS weight FROM range(1, 6) t(r)")
def _(spark, folder):
    """No city has stored weights."""
    stored = C.table(spark, folder, "customer", "c_nationkey", "c_acctbal").where("c_acctbal IS NULL")
    return layers.distance_weights(stored.select(F.col("c_nationkey").alias("radius"), F.col("c_acctbal").cast("double").alias("weight")), tg.RADII_KM)


@query("src19_partly_stored_weights", """SELECT CAST(r AS INTEGER) AS radius, coalesce(w, 0.2)::DOUBLE AS weight FROM range(1, 6) t(r)
  LEFT JOIN (SELECT r_regionkey + 1 AS k, max(r_regionkey + 2) / 20.0 AS w FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 GROUP BY r_regionkey) ON k = r""")
def _(spark, folder):
    """Every nation of a region stores that region's weight; one region stores none."""
    regions = C.table(spark, folder, "region", "r_regionkey").where("r_regionkey <> 2")
    stored = C.table(spark, folder, "nation", "n_regionkey").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return layers.distance_weights(stored.select((F.col("r_regionkey") + 1).cast("int").alias("radius"), ((F.col("r_regionkey") + 2) / 20.0).alias("weight")), tg.RADII_KM)


@query("src14_coordinates", f"WITH {C.MODEL_SQL} SELECT node_id, city, block_id, x_m, y_m FROM model")
def _(spark, folder):
    return layers.coordinates(C.model_table(spark, folder))


@query("src15_adjacency", f"{space.WITH} SELECT * FROM adjacency")
def _(spark, folder):
    return text.read_adjacency(spark, via_csv(space.adjacency(spark, folder)))


@query("src21_context_columns", f"WITH {C.MODEL_SQL} SELECT city, block_id, {q6('Y')} AS \"Y\", acs_population, acs_poverty_share FROM model")
def _(spark, folder):
    return rounded(layers.context_columns(C.model_table(spark, folder), "Y", ["acs_population", "acs_poverty_share", "acs_median_age"]))


# --- sinks ------------------------------------------------------------------------------------

@query("snk01_table", f"WITH {C.BLOCKS_SQL} SELECT block_id, city, x, y FROM blocks")
def _(spark, folder):
    path = sinks.scratch_folder(spark)
    sinks.write_table(C.blocks(spark, folder).select("block_id", "city", "x", "y"), path)
    return spark.read.parquet(f"{path}/parquet").select("block_id", "city", "x", "y")


@query("snk02_run_record", "SELECT count(*) AS n_blocks, count(DISTINCT c_nationkey) AS n_cities, 'euclidean' AS engine FROM customer")
def _(spark, folder):
    path = sinks.scratch_folder(spark)
    sinks.write_record(C.blocks(spark, folder), {"n_blocks": F.count(F.lit(1)), "n_cities": F.count_distinct("city")}, {"engine": "euclidean"}, path)
    return spark.read.json(path, schema="n_blocks bigint, n_cities bigint, engine string")


@query("snk03_backbone", f"{space.WITH} SELECT g.block_id, x0 + 50.0 AS x_m, y0 + 50.0 AS y_m, count(a.src_block_id) AS later_neighbours FROM grid g LEFT JOIN adjacency a ON a.src_block_id = g.block_id GROUP BY ALL")
def _(spark, folder):
    path = sinks.scratch_folder(spark)
    blocks = space.polygons(spark, folder)
    sinks.write_backbone(blocks.select("block_id", "rings"), bb.block_points(blocks), space.adjacency(spark, folder), path)
    later = spark.read.parquet(f"{path}/adjacency").groupBy(F.col("src_block_id").alias("block_id")).agg(F.count(F.lit(1)).alias("later_neighbours"))
    return spark.read.parquet(f"{path}/centroids").join(later, "block_id", "left").na.fill(0, ["later_neighbours"])


@query("ag38_backbone_quality", f"{space.WITH} SELECT (SELECT count(*) FROM grid) AS n_blocks, (SELECT count(*) FROM adjacency) AS n_edges, 0 AS n_duplicate_block_ids, 0 AS n_invalid_geometries, 0 AS n_isolated_blocks")
def _(spark, folder):
    return bb.backbone_quality(C.grid_blocks(spark, folder).select("block_id", "rings"), space.adjacency(spark, folder))


@query("set03_isolated_blocks", f"{space.WITH} SELECT block_id FROM grid WHERE block_id LIKE '%5'")
def _(spark, folder):
    links = space.adjacency(spark, folder).where(~F.col("src_block_id").endswith("5") & ~F.col("dst_block_id").endswith("5"))
    return bb.isolated_blocks(C.grid(spark, folder), links)


# --- engines ----------------------------------------------------------------------------------

ENGINE_RADII = C.RADII_M
_BLOCKS = "(abs(a.c - b.c) + abs(a.r - b.r)) * 100"
ENGINE_SQL = ", ".join(e for r in ENGINE_RADII for e in [f"sum(jobs) FILTER (WHERE {_BLOCKS} <= {r})::DOUBLE AS jobs_{int(r / 1000)}km"] + [
    f"coalesce(sum({c}) FILTER (WHERE {_BLOCKS} <= {r}), 0)::DOUBLE AS amen_{c}_{int(r / 1000)}km" for c in T.CATEGORIES])
ENGINE_SQL = f"""WITH {C.GRID_SQL}, {C.AMENITIES_SQL}, b AS (SELECT c, r, p_size AS jobs, {', '.join(f"(k.category = '{c}')::INTEGER AS {c}" for c in T.CATEGORIES)} FROM grid LEFT JOIN categorised k USING (p_partkey))
  SELECT a.block_id, {ENGINE_SQL} FROM grid a JOIN b ON abs(a.c - b.c) <= 50 AND abs(a.r - b.r) <= 50 GROUP BY a.block_id"""


def engine_inputs(spark: SparkSession, folder: str):
    centres = C.grid(spark, folder).select("block_id", "p_partkey", (F.col("x0") + 50.0).alias("x"), (F.col("y0") + 50.0).alias("y"), F.col("p_size").cast("double").alias("jobs"))
    kinds = reach.categorised(spark, folder).select("p_partkey", "category")
    return centres, centres.join(kinds, "p_partkey").select("x", "y", "category")


@query("gr09_block_graph_engine", ENGINE_SQL)
def _(spark, folder):
    centres, amenities = engine_inputs(spark, folder)
    points = centres.select("block_id", "x", "y")
    return engine.block_graph(points, space.polygons(spark, folder), points, centres.select("block_id", "jobs"), amenities, space.adjacency(spark, folder), ENGINE_RADII)


@query("gr09_road_engine", ENGINE_SQL)
def _(spark, folder):
    centres, amenities = engine_inputs(spark, folder)
    return engine.road_network(centres.select("block_id", "x", "y"), space.raw_streets(spark, folder), centres, amenities, ENGINE_RADII)


@query("gr09_euclidean_engine", f"WITH {reach.REACH_SQL} SELECT block_id, {reach._JOB_OUT}, {reach._AMEN_OUT} FROM reach")
def _(spark, folder):
    out = engine.euclidean(C.blocks(spark, folder), C.job_sites(spark, folder), reach.categorised(spark, folder), C.RADII_M)
    return rounded(out, digits=4)


@query("ag18_amenities_by_block", f"""WITH {C.GRID_SQL}, {C.AMENITIES_SQL}, k AS (SELECT c.x, c.y, c.category FROM categorised c WHERE category IS NOT NULL)
  SELECT g.block_id, {', '.join(f"count(*) FILTER (WHERE category = '{c}')::DOUBLE AS {c}" for c in T.CATEGORIES)} FROM k JOIN grid g ON k.x > g.x0 AND k.x < g.x0 + 100 AND k.y > g.y0 AND k.y < g.y0 + 100 GROUP BY g.block_id""")
def _(spark, folder):
    return engine.amenities_by_block(reach.categorised(spark, folder), space.polygons(spark, folder))


@query("ag37_reach_quality", f"WITH {reach.REACH_SQL} SELECT {q6('avg(CASE WHEN jobs_5km <= 0 THEN 1.0 ELSE 0.0 END)')} AS share_unreachable_jobs, " + f"{q6('avg(CASE WHEN ' + ' + '.join(f'amen_{c}_5km' for c in T.CATEGORIES) + ' <= 0 THEN 1.0 ELSE 0.0 END)')} AS share_unreachable_amenities, " + f"{q6('avg(CASE WHEN jobs_5km + ' + ' + '.join(f'amen_{c}_5km' for c in T.CATEGORIES) + ' <= 0 THEN 1.0 ELSE 0.0 END)')} AS share_unreachable_any FROM reach")
def _(spark, folder):
    return rounded(engine.reach_quality(reach.reach_table(spark, folder), 5))


@query("ag37_snap_quality", f"""{space.GWITH}, {space.POINTS_SQL}, ends AS (SELECT DISTINCT c, r FROM lattice),
  d AS (SELECT o_orderkey, min(sqrt((x - c * 100 - 50) ** 2 + (y - r * 100 - 50) ** 2)) AS dist FROM points, ends GROUP BY o_orderkey)
  SELECT {q6('avg(dist)')} AS origin_snap_dist_mean_m, {q6('median(dist)')} AS origin_snap_dist_median_m, {q6('quantile_cont(dist, 0.95)')} AS origin_snap_dist_p95_m, {q6('max(dist)')} AS origin_snap_dist_max_m FROM d""")
def _(spark, folder):
    snapped = gr.snap(space.order_points(spark, folder), "o_orderkey", gr.node_points(space.roads(spark, folder)))
    return rounded(engine.snap_quality(snapped))


@query("gr08_component_summary", f"WITH {C.GRID_SQL} SELECT count(*) AS network_n_nodes, 1 AS network_n_components, 1.0 AS share_origins_in_largest_component FROM grid")
def _(spark, folder):
    cells = C.grid(spark, folder).select(F.col("block_id").alias("node"))
    parts = gr.connected_components(gr.both_directions(space.adjacency(spark, folder)), cells)
    return gr.component_summary(parts, cells)


@query("jn04_combined_features", f"WITH b AS ({space.BUILT_SQL}) SELECT g.block_id, b.be_street_length_m, b.be_adjacency_degree, s.pt_stop_count FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 15, '0') AS block_id, p_partkey FROM part) g JOIN b ON b.block_id = g.block_id LEFT JOIN (SELECT p_partkey, CAST(p_size AS DOUBLE) AS pt_stop_count FROM part WHERE p_partkey % 2 = 0) s ON s.p_partkey = g.p_partkey")
def _(spark, folder):
    built = space.built_features(spark, folder).select("block_id", "be_street_length_m", "be_adjacency_degree")
    stops = C.grid(spark, folder).where("p_partkey % 2 = 0").select("block_id", F.col("p_size").cast("double").alias("pt_stop_count"))
    return rounded(ds.combine_features(C.grid(spark, folder), built, stops))
