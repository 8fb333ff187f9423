"""Domain tables derived from the driver tables, as DataFrames and as SQL for the comparison runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockreach.session import spread

RADII_KM = (1, 2, 3, 4, 5)
RADII_M = tuple(1000.0 * r for r in RADII_KM)
CELL_M = 100  # side of the square blocks laid out from ``part``
COLUMNS = 40  # blocks per row of that layout


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def div(value: Column, by: int) -> Column:
    return F.floor(value / by).cast("bigint")


def pad(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


# --- blocks as points -------------------------------------------------------------------------

BLOCKS_SQL = """
blocks AS (
  SELECT lpad(CAST(c_custkey // 10 AS VARCHAR), 11, '0') || lpad(CAST(c_custkey % 10 AS VARCHAR), 4, '0') AS block_id,
         'city_' || CAST(c_nationkey AS VARCHAR) AS city,
         CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x,
         CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y,
         c_custkey, c_acctbal
  FROM customer)"""


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_acctbal").select(
        F.concat(pad(div(key, 10), 11), pad(key % 10, 4)).alias("block_id"),
        F.concat(F.lit("city_"), F.col("c_nationkey").cast("string")).alias("city"),
        ((key * 7919) % 10007).cast("double").alias("x"),
        ((key * 104729) % 10009).cast("double").alias("y"),
        "c_custkey",
        "c_acctbal",
    )


JOBS_SQL = """
jobs AS (
  SELECT s_suppkey, CAST((s_suppkey * 6007) % 10007 AS DOUBLE) AS x,
         CAST((s_suppkey * 15013) % 10009 AS DOUBLE) AS y, greatest(s_acctbal, 0.0) AS jobs
  FROM supplier)"""


def job_sites(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier", "s_suppkey", "s_acctbal").select(
        "s_suppkey",
        ((key * 6007) % 10007).cast("double").alias("x"),
        ((key * 15013) % 10009).cast("double").alias("y"),
        F.greatest("s_acctbal", F.lit(0.0)).alias("jobs"),
    )


# --- tagged amenities -------------------------------------------------------------------------

AMENITIES_SQL = """
tagged AS (
  SELECT p_partkey, CAST((p_partkey * 4799) % 10007 AS DOUBLE) AS x,
         CAST((p_partkey * 8111) % 10009 AS DOUBLE) AS y,
         CASE p_partkey % 9 WHEN 0 THEN 'Cafe' WHEN 1 THEN 'clinic' WHEN 2 THEN 'school' WHEN 3 THEN 'police'
              WHEN 4 THEN 'park' WHEN 5 THEN 'bench' END AS amenity,
         CASE WHEN p_partkey % 9 IN (5, 6) THEN CASE p_partkey % 4 WHEN 0 THEN 'bakery' WHEN 1 THEN 'books' ELSE NULL END END AS shop,
         '"leisure"=>"' || CASE p_partkey % 3 WHEN 0 THEN 'pitch' WHEN 1 THEN 'garden' ELSE 'playground' END
           || '","p_size"=>"' || CAST(p_size AS VARCHAR) || '"' AS other_tags
  FROM part),
categorised AS (
  SELECT *, coalesce(
    CASE lower(amenity) WHEN 'cafe' THEN 'food_retail' WHEN 'clinic' THEN 'healthcare' WHEN 'school' THEN 'education'
         WHEN 'police' THEN 'public_services' WHEN 'park' THEN 'recreation' END,
    CASE lower(shop) WHEN 'bakery' THEN 'food_retail' END,
    CASE WHEN regexp_extract(other_tags, '"leisure"=>"([^"]+)"', 1) IN ('pitch', 'playground') THEN 'recreation' END) AS category
  FROM tagged)"""


def tagged_points(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    nine, four, three = key % 9, key % 4, key % 3
    amenity = F.lit(None).cast("string")
    for code, name in enumerate(("Cafe", "clinic", "school", "police", "park", "bench")):
        amenity = F.when(nine == code, F.lit(name)).otherwise(amenity)
    shop = F.when(nine.isin(5, 6), F.when(four == 0, F.lit("bakery")).when(four == 1, F.lit("books")))
    leisure = F.when(three == 0, F.lit("pitch")).when(three == 1, F.lit("garden")).otherwise(F.lit("playground"))
    return table(spark, folder, "part", "p_partkey", "p_size").select(
        "p_partkey",
        ((key * 4799) % 10007).cast("double").alias("x"),
        ((key * 8111) % 10009).cast("double").alias("y"),
        amenity.alias("amenity"),
        shop.alias("shop"),
        F.concat(F.lit('"leisure"=>"'), leisure, F.lit('","p_size"=>"'), F.col("p_size").cast("string"), F.lit('"')).alias("other_tags"),
    )


# --- square blocks on a grid ------------------------------------------------------------------

GRID_SQL = f"""
grid AS (
  SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 15, '0') AS block_id,
         p_partkey // {COLUMNS} AS r, p_partkey % {COLUMNS} AS c, p_size,
         {CELL_M}.0 * (p_partkey % {COLUMNS}) AS x0, {CELL_M}.0 * (p_partkey // {COLUMNS}) AS y0
  FROM part)"""


def grid(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part", "p_partkey", "p_size").select(
        "p_partkey",
        pad(key, 15).alias("block_id"),
        div(key, COLUMNS).alias("r"),
        (key % COLUMNS).alias("c"),
        "p_size",
        (CELL_M * (key % COLUMNS)).cast("double").alias("x0"),
        (CELL_M * div(key, COLUMNS)).cast("double").alias("y0"),
    )


def ring(*corners: tuple[Column, Column]) -> Column:
    """Closed ring from corner columns."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in (*corners, corners[0])])


def box_rings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(ring((x0, y0), (x1, y0), (x1, y1), (x0, y1)))


def grid_blocks(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """Square block polygons: ``block_id, rings`` plus row and column; ``dealt`` out while rows are narrow."""
    x0, y0 = F.col("x0"), F.col("y0")
    cells = grid(spark, folder)
    return (spread(cells) if dealt else cells).select(
        "p_partkey", "block_id", "r", "c", "p_size",
        box_rings(x0, y0, x0 + CELL_M, y0 + CELL_M).alias("rings"),
    )


# --- schedule tables (two feeds) --------------------------------------------------------------

STOPS_SQL = """
raw_stops AS (
  SELECT f.feed_idx, CAST(s_suppkey AS VARCHAR) AS stop_id,
         CAST(((s_suppkey - CASE WHEN s_suppkey % 7 = 6 THEN 1 ELSE 0 END) * 47) + 13.7::DOUBLE AS VARCHAR) AS stop_lat,
         CAST((((s_suppkey - CASE WHEN s_suppkey % 7 = 6 THEN 1 ELSE 0 END) * 7919) % 40000) / 10.0 + 0.03::DOUBLE AS VARCHAR) AS stop_lon,
         CASE WHEN s_suppkey % 11 = 0 THEN '1' WHEN s_suppkey % 11 = 1 THEN '' ELSE '0' END AS location_type
  FROM supplier, (VALUES (0), (1)) AS f(feed_idx)),
raw_trips AS (
  SELECT CAST(o_orderkey % 2 AS INTEGER) AS feed_idx, CAST(o_orderkey AS VARCHAR) AS trip_id,
         CAST(o_custkey % 40 AS VARCHAR) AS route_id, o_orderpriority AS service_id
  FROM orders),
raw_routes AS (
  SELECT DISTINCT CAST(o_orderkey % 2 AS INTEGER) AS feed_idx, CAST(o_custkey % 40 AS VARCHAR) AS route_id,
         CASE o_custkey % 8 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '700'
              WHEN 5 THEN '11' WHEN 6 THEN '9999' ELSE '900' END AS route_type
  FROM orders),
raw_times AS (
  SELECT CAST(l_orderkey % 2 AS INTEGER) AS feed_idx, CAST(l_orderkey AS VARCHAR) AS trip_id,
         CAST(l_suppkey AS VARCHAR) AS stop_id,
         CASE WHEN l_partkey % 101 = 0 THEN 'late' ELSE
           CAST((l_orderkey * 7 + l_linenumber * 3) % 27 AS VARCHAR) || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0')
             || ':' || lpad(CAST((l_partkey + l_suppkey) % 2 * 30 AS VARCHAR), 2, '0') END AS departure_time
  FROM lineitem),
active_services AS (
  SELECT DISTINCT service_id FROM raw_trips WHERE service_id <> '5-LOW'),
active_trips AS (
  SELECT feed_idx, trip_id, 'feed' || feed_idx || ':' || route_id AS route_key
  FROM raw_trips WHERE service_id IN (SELECT service_id FROM active_services)),
times AS (
  SELECT t.feed_idx, 'feed' || t.feed_idx || ':' || t.stop_id AS stop_key, a.route_key,
         CAST(split_part(departure_time, ':', 1) AS INTEGER) * 60 + CAST(split_part(departure_time, ':', 2) AS INTEGER)
           + CAST(split_part(departure_time, ':', 3) AS INTEGER) / 60.0::DOUBLE AS departure_min
  FROM raw_times t JOIN active_trips a ON t.feed_idx = a.feed_idx AND t.trip_id = a.trip_id
  WHERE departure_time <> 'late'),
peaks AS (
  SELECT *, ((departure_min % 1440 >= 420 AND departure_min % 1440 < 540) OR (departure_min % 1440 >= 960 AND departure_min % 1440 < 1080)) AS is_peak
  FROM times),
stops AS (
  SELECT feed_idx, 'feed' || feed_idx || ':' || stop_id AS stop_key, CAST(stop_lon AS DOUBLE) AS x, CAST(stop_lat AS DOUBLE) AS y,
         round(CAST(stop_lon AS DOUBLE), 1) AS px, round(CAST(stop_lat AS DOUBLE), 1) AS py
  FROM raw_stops
  WHERE coalesce(TRY_CAST(location_type AS DOUBLE), 0) = 0
    AND 'feed' || feed_idx || ':' || stop_id IN (SELECT stop_key FROM peaks)),
routes AS (
  SELECT 'feed' || feed_idx || ':' || route_id AS route_key, route_type,
         CASE route_type WHEN '0' THEN 'tram' WHEN '1' THEN 'metro' WHEN '2' THEN 'train' WHEN '3' THEN 'bus' WHEN '700' THEN 'bus'
              WHEN '11' THEN 'bus' WHEN '900' THEN 'tram' ELSE 'other' END AS mode
  FROM raw_routes),
service_events AS (
  SELECT p.*, s.px, s.py, s.x, s.y, r.route_type, r.mode
  FROM peaks p JOIN stops s ON p.stop_key = s.stop_key LEFT JOIN routes r ON p.route_key = r.route_key),
places AS (
  SELECT px, py, min(x) AS x, min(y) AS y FROM stops GROUP BY px, py)"""


def schedule_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Stops, routes, trips, stop_times and calendar of two feeds, all columns as text."""
    key = F.col("s_suppkey")
    at = key - F.when(key % 7 == 6, 1).otherwise(0)
    text = "string"
    feeds = F.explode(F.array(F.lit(0), F.lit(1))).alias("feed_idx")
    stops = table(spark, folder, "supplier", "s_suppkey").select(
        feeds,
        key.cast(text).alias("stop_id"),
        (at * 47 + F.lit(13.7)).cast(text).alias("stop_lat"),
        ((at * 7919) % 40000 / 10.0 + F.lit(0.03)).cast(text).alias("stop_lon"),
        F.when(key % 11 == 0, "1").when(key % 11 == 1, "").otherwise("0").alias("location_type"),
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    feed = (F.col("o_orderkey") % 2).cast("int").alias("feed_idx")
    route = (F.col("o_custkey") % 40).cast(text).alias("route_id")
    trips = orders.select(
        feed, F.col("o_orderkey").cast(text).alias("trip_id"), route, F.col("o_orderpriority").alias("service_id")
    )
    route_type = F.lit("900")
    for code, name in enumerate(("0", "1", "2", "3", "700", "11", "9999")):
        route_type = F.when(F.col("o_custkey") % 8 == code, F.lit(name)).otherwise(route_type)
    routes = orders.select(feed, route, route_type.alias("route_type")).distinct()
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    clock = F.concat_ws(
        ":",
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % 27).cast(text),
        pad(part % 60, 2),
        pad((part + supp) % 2 * 30, 2),
    )
    stop_times = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").select(
        (F.col("l_orderkey") % 2).cast("int").alias("feed_idx"),
        F.col("l_orderkey").cast(text).alias("trip_id"),
        supp.cast(text).alias("stop_id"),
        F.when(part % 101 == 0, F.lit("late")).otherwise(clock).alias("departure_time"),
    )
    weekend_only = F.col("service_id") == "5-LOW"
    calendar = trips.select("feed_idx", "service_id").distinct().select(
        "feed_idx", "service_id",
        *[F.when(weekend_only, "0").otherwise("1").alias(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday")],
        F.lit("1").alias("saturday"), F.lit("1").alias("sunday"),
    )
    return {"stops": stops, "routes": routes, "trips": trips, "stop_times": stop_times, "calendar": calendar}


# --- model table ------------------------------------------------------------------------------

MODEL_FEATURES = (
    "pt_stop_count", "pt_route_count", "pt_weekday_departures", "pt_nearest_stop_dist_m",
    "be_street_length_m", "be_bikeable_street_share", "be_compactness",
    "acs_population", "acs_poverty_share", "acs_median_household_income",
)

MODEL_SQL = """
items AS (
  SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS routes, sum(l_quantity) AS qty,
         max(l_extendedprice) AS price, sum(l_extendedprice) AS total, sum(l_discount) AS discount, sum(l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey),
model AS (
  SELECT 'city_' || CAST(o_custkey % 10 AS VARCHAR) AS city, lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS block_id,
         'city_' || CAST(o_custkey % 10 AS VARCHAR) || ':' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS node_id,
         o_orderkey,
         CAST((o_orderkey * 7919) % 10007 AS DOUBLE) AS x_m, CAST((o_orderkey * 104729) % 10009 AS DOUBLE) AS y_m,
         o_totalprice / 1000.0 AS Y,
         CAST(coalesce(n, 0) AS DOUBLE) AS pt_stop_count, CAST(coalesce(routes, 0) AS DOUBLE) AS pt_route_count,
         coalesce(qty, 0.0) AS pt_weekday_departures, round(coalesce(price, 10000.0), 4) AS pt_nearest_stop_dist_m,
         round(coalesce(total, 0.0) / 100.0, 4) AS be_street_length_m, round(coalesce(discount, 0.0), 4) AS be_bikeable_street_share,
         CAST(o_orderkey % 97 AS DOUBLE) / 97.0 AS be_compactness,
         o_totalprice AS acs_population, round(coalesce(tax, 0.0), 4) AS acs_poverty_share,
         CAST(20000 + o_custkey * 3 AS DOUBLE) AS acs_median_household_income
  FROM orders LEFT JOIN items ON o_orderkey = l_orderkey)"""


def model_table(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """One row per block with ten predictors, a target and coordinates.

    ``dealt``: items are dealt out by order before they are grouped, for tables that read few of their columns; the
    groups of a task then depend on the number of shuffle partitions instead of the size of a file split.
    """
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    items = (
        (spread(lines, "l_orderkey") if dealt else lines)
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("routes"),
            F.sum("l_quantity").alias("qty"), F.max("l_extendedprice").alias("price"),
            F.sum("l_extendedprice").alias("total"), F.sum("l_discount").alias("discount"), F.sum("l_tax").alias("tax"),
        )
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    key = F.col("o_orderkey")
    city = F.concat(F.lit("city_"), (F.col("o_custkey") % 10).cast("string"))

    def part(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default))

    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        city.alias("city"),
        pad(key, 15).alias("block_id"),
        F.concat_ws(":", city, pad(key, 15)).alias("node_id"),
        "o_orderkey",
        ((key * 7919) % 10007).cast("double").alias("x_m"),
        ((key * 104729) % 10009).cast("double").alias("y_m"),
        (F.col("o_totalprice") / 1000.0).alias("Y"),
        part("n").alias("pt_stop_count"),
        part("routes").alias("pt_route_count"),
        part("qty").alias("pt_weekday_departures"),
        F.round(part("price", 10000.0), 4).alias("pt_nearest_stop_dist_m"),
        F.round(part("total") / 100.0, 4).alias("be_street_length_m"),
        F.round(part("discount"), 4).alias("be_bikeable_street_share"),
        ((key % 97).cast("double") / 97.0).alias("be_compactness"),
        F.col("o_totalprice").alias("acs_population"),
        F.round(part("tax"), 4).alias("acs_poverty_share"),
        (20000 + F.col("o_custkey") * 3).cast("double").alias("acs_median_household_income"),
    )


# Labels used where a query needs given splits rather than grown ones.
SPLIT_SQL = "CASE WHEN o_orderkey % 20 < 3 THEN 'test' WHEN o_orderkey % 20 < 6 THEN 'val' ELSE 'train' END"


def fixed_split(key: Column) -> Column:
    return F.when(key % 20 < 3, F.lit("test")).when(key % 20 < 6, F.lit("val")).otherwise(F.lit("train"))


# --- attributions -----------------------------------------------------------------------------

ATTRIBUTION_SQL = """
shap_long AS (
  SELECT vec_id AS node_id, 'city_' || CAST(label AS VARCHAR) AS city, CAST(vec_id % 5 AS INTEGER) AS cluster_id,
         CASE i % 3 WHEN 0 THEN 'pt_' WHEN 1 THEN 'be_' ELSE 'acs_' END || 'f_' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature,
         CAST(embedding[i + 1] AS DOUBLE) AS shap,
         CAST(embedding[(i + 7) % 64 + 1] AS DOUBLE) AS feature_value
  FROM embeddings, range(64) AS t(i)),
predictions AS (
  SELECT vec_id AS node_id, 'city_' || CAST(label AS VARCHAR) AS city, CAST(vec_id % 5 AS INTEGER) AS cluster_id,
         CAST(embedding[1] AS DOUBLE) + CAST(vec_id % 5 AS DOUBLE) * 0.1 AS y_pred, CAST(embedding[2] AS DOUBLE) AS y_true
  FROM embeddings)"""


def attributions(spark: SparkSession, folder: str) -> DataFrame:
    """Long attribution table ``(node_id, city, cluster_id, feature, shap, feature_value)``."""
    i = F.col("i")
    family = F.when(i % 3 == 0, F.lit("pt_")).when(i % 3 == 1, F.lit("be_")).otherwise(F.lit("acs_"))
    return (
        table(spark, folder, "embeddings", "vec_id", "embedding", "label")
        .select("vec_id", "label", "embedding", F.posexplode("embedding").alias("i", "shap"))
        .select(
            F.col("vec_id").alias("node_id"),
            F.concat(F.lit("city_"), F.col("label").cast("string")).alias("city"),
            (F.col("vec_id") % 5).cast("int").alias("cluster_id"),
            F.concat(family, F.lit("f_"), pad(i, 2)).alias("feature"),
            F.col("shap").cast("double").alias("shap"),
            F.get("embedding", (i + 7) % 64).cast("double").alias("feature_value"),
        )
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """``(node_id, city, cluster_id, y_pred, y_true)`` for the explained rows."""
    e = F.col("embedding")
    return table(spark, folder, "embeddings", "vec_id", "embedding", "label").select(
        F.col("vec_id").alias("node_id"),
        F.concat(F.lit("city_"), F.col("label").cast("string")).alias("city"),
        (F.col("vec_id") % 5).cast("int").alias("cluster_id"),
        (e[0].cast("double") + (F.col("vec_id") % 5).cast("double") * 0.1).alias("y_pred"),
        e[1].cast("double").alias("y_true"),
    )
