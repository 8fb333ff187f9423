"""Transit queries: schedule joins, block and stop service, headways, nearest stops, catchments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockreach.functions import geometry as G, schedule as S
from blockreach.operators import cities as ct, transit as tr
from blockreach.operators.overlay import with_edges
from blockreach.operators.proximity import radius_sets
from blockreach.plans import carriers as C, space
from blockreach.plans.registry import q6, query, r6, rounded


def block_polygons(spark: SparkSession, folder: str) -> DataFrame:
    df = with_edges(C.grid_blocks(spark, folder)).withColumn("area_km2", G.polygon_area(F.col("rings")) / 1e6)
    return df.select("block_id", "area_km2", "edges", "minx", "miny", "maxx", "maxy")


def block_centres(spark: SparkSession, folder: str) -> DataFrame:
    return C.grid(spark, folder).select("block_id", (F.col("x0") + 50.0).alias("x"), (F.col("y0") + 50.0).alias("y"))


def service(spark: SparkSession, folder: str, finest: str = "times") -> tr.Service:
    return tr.reduce_schedule(**C.schedule_tables(spark, folder), finest=finest)


def stop_block(spark: SparkSession, folder: str, reduced: tr.Service) -> DataFrame:
    return tr.stops_in_blocks(reduced.stops, block_polygons(spark, folder))


WITH = f"""WITH {C.STOPS_SQL}, {C.GRID_SQL},
centres AS (SELECT block_id, x0 + 50.0 AS x, y0 + 50.0 AS y FROM grid),
stop_block AS (SELECT s.feed_idx, s.stop_key, s.px, s.py, g.block_id FROM stops s JOIN grid g
  ON s.x > g.x0 AND s.x < g.x0 + 100 AND s.y > g.y0 AND s.y < g.y0 + 100),
block_events AS (SELECT e.*, b.block_id FROM service_events e JOIN stop_block b ON e.stop_key = b.stop_key),
headway AS (SELECT feed_idx, px, py, block_id, departure_min,
  departure_min - lag(departure_min) OVER (PARTITION BY feed_idx, px, py ORDER BY departure_min) AS headway_min FROM block_events),
place_stats AS (SELECT px, py, CAST(count(*) AS DOUBLE) AS departures, CAST(count_if(is_peak) AS DOUBLE) AS peak,
  CAST(count(DISTINCT route_key) AS DOUBLE) AS routes FROM service_events GROUP BY px, py),
mode_stats AS (SELECT px, py, mode, CAST(count(*) AS DOUBLE) AS departures, CAST(count_if(is_peak) AS DOUBLE) AS peak,
  CAST(count(DISTINCT route_key) AS DOUBLE) AS routes FROM service_events GROUP BY px, py, mode),
reach AS (SELECT c.block_id, p.px, p.py, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) AS d FROM centres c, places p)
"""


@query("flt02_active_services", f"{WITH} SELECT DISTINCT feed_idx, service_id FROM raw_trips WHERE service_id <> '5-LOW'")
def _(spark, folder):
    t = C.schedule_tables(spark, folder)
    return tr.active_services(t["calendar"], t["trips"])


@query("jn01_active_departures", f"{WITH} SELECT feed_idx, stop_key, route_key, {q6('departure_min')} AS departure_min, is_peak FROM peaks")
def _(spark, folder):
    t = C.schedule_tables(spark, folder)
    return rounded(tr.departures(t["stop_times"], t["trips"], tr.active_services(t["calendar"], t["trips"])))


@query("flt03_boarding_stops", f"""{WITH} SELECT feed_idx, 'feed' || feed_idx || ':' || stop_id AS stop_key, {q6('CAST(stop_lon AS DOUBLE)')} AS x,
  {q6('CAST(stop_lat AS DOUBLE)')} AS y FROM raw_stops WHERE coalesce(TRY_CAST(location_type AS DOUBLE), 0) = 0""")
def _(spark, folder):
    return rounded(tr.boarding_stops(C.schedule_tables(spark, folder)["stops"]).select("feed_idx", "stop_key", "x", "y"))


@query("flt04_stops_in_use", f"{WITH} SELECT stop_key, px, py FROM stops")
def _(spark, folder):
    return service(spark, folder, "stops").stops.select("stop_key", "px", "py")


@query("jn02_service_by_route", f"""{WITH} SELECT stop_key, route_key, any_value(route_type) AS route_type, any_value(mode) AS mode, count(*) AS departures,
  count_if(is_peak) AS peak, {q6('min(departure_min)')} AS "first", {q6('max(departure_min)')} AS "last" FROM service_events GROUP BY stop_key, route_key""")
def _(spark, folder):
    return rounded(service(spark, folder, "routes").by_route.drop("px", "py"))


@query("jn10_stops_in_blocks", f"{WITH} SELECT stop_key, px, py, block_id FROM stop_block")
def _(spark, folder):
    return stop_block(spark, folder, service(spark, folder, "stops"))


@query("ag01_stop_counts", f"""{WITH} SELECT g.block_id, coalesce(n, 0.0) AS pt_stop_count, {q6('coalesce(n, 0.0) / 0.01')} AS pt_stop_density_per_km2
  FROM grid g LEFT JOIN (SELECT block_id, CAST(count(DISTINCT (px, py)) AS DOUBLE) AS n FROM stop_block GROUP BY block_id) s ON g.block_id = s.block_id""")
def _(spark, folder):
    polygons = block_polygons(spark, folder)
    counts = tr.stop_counts(tr.stops_in_blocks(service(spark, folder, "stops").stops, polygons))
    out = polygons.select("block_id", "area_km2").join(counts, "block_id", "left").na.fill(0.0, ["pt_stop_count"])
    density = tr.safe_divide(F.col("pt_stop_count"), F.col("area_km2"), 0.0)
    return rounded(out.select("block_id", "pt_stop_count", density.alias("pt_stop_density_per_km2")))


BLOCK_SQL = f"""SELECT block_id, CAST(count(DISTINCT route_key) AS DOUBLE) AS pt_route_count, CAST(count(*) AS DOUBLE) AS pt_weekday_departures,
  CAST(count_if(is_peak) AS DOUBLE) AS pt_peak_departures, {q6('min(departure_min)')} AS pt_first_departure_min,
  {q6('max(departure_min)')} AS pt_last_departure_min, CAST(count(DISTINCT route_type) AS DOUBLE) AS pt_modal_variety
  FROM block_events GROUP BY block_id"""


@query("ag02_block_service", f"{WITH} {BLOCK_SQL}")
def _(spark, folder):
    reduced = service(spark, folder, "routes")
    return rounded(tr.block_service(reduced, stop_block(spark, folder, reduced)))


def _mode_columns(template: str) -> str:
    return ", ".join(template.format(m=m) for m in S.MODES)


MODE_SQL = f"""SELECT block_id, {_mode_columns('''
  CASE WHEN count(*) FILTER (WHERE mode = '{m}') > 0 THEN CAST(count(DISTINCT (px, py)) FILTER (WHERE mode = '{m}') AS DOUBLE) END AS {m}_stop_count,
  CASE WHEN count(*) FILTER (WHERE mode = '{m}') > 0 THEN CAST(count(DISTINCT route_key) FILTER (WHERE mode = '{m}') AS DOUBLE) END AS {m}_route_count,
  CASE WHEN count(*) FILTER (WHERE mode = '{m}') > 0 THEN CAST(count(*) FILTER (WHERE mode = '{m}') AS DOUBLE) END AS {m}_weekday_departures,
  CASE WHEN count(*) FILTER (WHERE mode = '{m}') > 0 THEN CAST(count(*) FILTER (WHERE mode = '{m}' AND is_peak) AS DOUBLE) END AS {m}_peak_departures''')}
  FROM block_events WHERE mode <> 'other' GROUP BY block_id"""


@query("ag03_block_service_by_mode", f"{WITH} {MODE_SQL}")
def _(spark, folder):
    reduced = service(spark, folder, "routes")
    return tr.block_service_by_mode(reduced, stop_block(spark, folder, reduced))


@query("wn01_headways", f"""{WITH} SELECT feed_idx, px, py, {q6('departure_min')} AS departure_min, {q6('headway_min')} AS headway_min
  FROM headway WHERE headway_min > 0 AND headway_min <= 240""")
def _(spark, folder):
    reduced = service(spark, folder)
    gaps = tr.headways(reduced, stop_block(spark, folder, reduced))
    return rounded(gaps.select("feed_idx", "px", "py", "departure_min", "headway_min"))


HEADWAY_SQL = """SELECT block_id, avg(m) AS pt_avg_headway_min FROM (
  SELECT block_id, px, py, median(headway_min) AS m FROM headway WHERE headway_min > 0 AND headway_min <= 240 GROUP BY block_id, px, py) GROUP BY block_id"""


@query("ag04_block_headways", f"{WITH} SELECT block_id, {q6('pt_avg_headway_min')} AS pt_avg_headway_min FROM ({HEADWAY_SQL})")
def _(spark, folder):
    reduced = service(spark, folder)
    return rounded(tr.block_headways(tr.headways(reduced, stop_block(spark, folder, reduced))))


@query("flt07_headway_range", f"""{WITH} SELECT block_id, count(*) AS n, {q6('min(headway_min)')} AS shortest, {q6('max(headway_min)')} AS longest
  FROM headway WHERE headway_min > 0 AND headway_min <= 240 GROUP BY block_id""")
def _(spark, folder):
    reduced = service(spark, folder)
    gaps = tr.headways(reduced, stop_block(spark, folder, reduced))
    return rounded(gaps.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("headway_min").alias("shortest"), F.max("headway_min").alias("longest")))


@query("ag05_stop_service", f"{WITH} SELECT px, py, mode, departures, peak, routes FROM mode_stats UNION ALL SELECT px, py, 'all', departures, peak, routes FROM place_stats")
def _(spark, folder):
    reduced = service(spark, folder, "routes")
    overall = tr.place_service(reduced).withColumn("mode", F.lit("all"))
    return tr.place_service(reduced, by_mode=True).unionByName(overall)


@query("ag06_stop_routes", f"{WITH} SELECT DISTINCT px, py, route_key, mode FROM service_events")
def _(spark, folder):
    return tr.place_routes(service(spark, folder, "routes"))


def _catchment_sql() -> str:
    columns = []
    for r in tr.CATCHMENT_M:
        columns.append(f"""CAST(count(*) FILTER (WHERE d <= {r} AND s.departures > 0) AS DOUBLE) AS pt_stops_within_{r}m,
          coalesce(sum(s.departures) FILTER (WHERE d <= {r}), 0.0) AS pt_departures_within_{r}m,
          coalesce(sum(s.peak) FILTER (WHERE d <= {r}), 0.0) AS pt_peak_departures_within_{r}m""")
    modes = [
        f"""CAST(count(*) FILTER (WHERE d <= {r} AND mode = '{m}') AS DOUBLE) AS pt_{m}_stops_within_{r}m,
          coalesce(sum(departures) FILTER (WHERE d <= {r} AND mode = '{m}'), 0.0) AS pt_{m}_departures_within_{r}m,
          coalesce(sum(peak) FILTER (WHERE d <= {r} AND mode = '{m}'), 0.0) AS pt_{m}_peak_departures_within_{r}m"""
        for r in tr.CATCHMENT_M for m in S.MODES
    ]
    routes = [f"CAST(count(DISTINCT route_key) FILTER (WHERE d <= {r}) AS DOUBLE) AS pt_routes_within_{r}m" for r in tr.CATCHMENT_M] + [
        f"CAST(count(DISTINCT route_key) FILTER (WHERE d <= {r} AND mode = '{m}') AS DOUBLE) AS pt_{m}_routes_within_{r}m"
        for r in tr.CATCHMENT_M for m in S.MODES
    ]
    return f"""calls AS (SELECT DISTINCT px, py, route_key, mode FROM service_events),
    near_all AS (SELECT block_id, {', '.join(columns)} FROM reach r LEFT JOIN place_stats s USING (px, py) GROUP BY block_id),
    near_mode AS (SELECT block_id, {', '.join(modes)} FROM reach r JOIN mode_stats s USING (px, py) WHERE d <= 3000 GROUP BY block_id),
    near_routes AS (SELECT block_id, {', '.join(routes)} FROM reach r JOIN calls USING (px, py) WHERE d <= 3000 GROUP BY block_id),
    catchment AS (SELECT a.*, {', '.join(f'coalesce({n}, 0.0) AS {n}' for n in CATCH_NAMES)} FROM near_all a
      LEFT JOIN near_mode m ON a.block_id = m.block_id LEFT JOIN near_routes t ON a.block_id = t.block_id)"""


CATCH_NAMES = [
    *[f"pt_{m}_{k}_within_{r}m" for m in S.MODES for k in ("stops", "departures", "peak_departures", "routes") for r in tr.CATCHMENT_M],
    *[f"pt_routes_within_{r}m" for r in tr.CATCHMENT_M],
]
CATCHMENT_SQL = _catchment_sql()
_RATIOS = ", ".join(
    f"""{q6(f'coalesce(pt_departures_within_{r}m / nullif(pt_stops_within_{r}m, 0), 0.0)')} AS pt_departures_per_stop_within_{r}m,
    {q6(f'coalesce(pt_routes_within_{r}m / nullif(pt_stops_within_{r}m, 0), 0.0)')} AS pt_routes_per_stop_within_{r}m,
    {q6(f'coalesce(pt_peak_departures_within_{r}m / nullif(pt_departures_within_{r}m, 0), 0.0)')} AS pt_peak_departure_share_within_{r}m"""
    for r in tr.CATCHMENT_M
)


@query("ag07_catchments", f"{WITH}, {CATCHMENT_SQL} SELECT *, {_RATIOS} FROM catchment")
def _(spark, folder):
    return rounded(tr.catchments(block_centres(spark, folder), service(spark, folder, "routes")))


NEAREST_SQL = """nearest AS (SELECT block_id, px, py, d FROM (
    SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY d, px, py) AS k FROM reach) WHERE k = 1),
  near_stop AS (SELECT block_id, least(d, 10000.0) AS pt_nearest_stop_dist_m,
    CASE WHEN d <= 10000 THEN coalesce(departures, 0.0) ELSE 0.0 END AS pt_nearest_stop_departures,
    CASE WHEN d <= 10000 THEN coalesce(peak, 0.0) ELSE 0.0 END AS pt_nearest_stop_peak_departures,
    CASE WHEN d <= 10000 THEN coalesce(routes, 0.0) ELSE 0.0 END AS pt_nearest_stop_route_count
    FROM nearest LEFT JOIN place_stats USING (px, py))"""


@query("ag08_nearest_stop_service", f"""{WITH}, {NEAREST_SQL} SELECT block_id, {q6('pt_nearest_stop_dist_m')} AS pt_nearest_stop_dist_m,
  pt_nearest_stop_departures, pt_nearest_stop_peak_departures, pt_nearest_stop_route_count FROM near_stop""")
def _(spark, folder):
    return rounded(tr.nearest_stop(block_centres(spark, folder), service(spark, folder, "routes")))


NEAREST_MODE_SQL = "SELECT c.block_id, " + ", ".join(
    f"least(coalesce(min(d) FILTER (WHERE mode = '{m}'), 10000.0), 10000.0) AS pt_nearest_{m}_stop_dist_m" for m in S.MODES
) + " FROM centres c LEFT JOIN (SELECT block_id, mode, d FROM reach JOIN mode_stats USING (px, py)) q ON c.block_id = q.block_id GROUP BY c.block_id"


@query("jn14_nearest_stop_by_mode", f"{WITH}, near_mode AS ({NEAREST_MODE_SQL}) SELECT block_id, " + ", ".join(
    f"{q6(f'pt_nearest_{m}_stop_dist_m')} AS pt_nearest_{m}_stop_dist_m" for m in S.MODES) + " FROM near_mode")
def _(spark, folder):
    return rounded(tr.nearest_stop_by_mode(block_centres(spark, folder), service(spark, folder, "routes")))


CONNECTED_SQL = """SELECT a.block_id, CAST(count(DISTINCT b.block_id) FILTER (WHERE b.block_id <> a.block_id) AS DOUBLE) AS pt_connected_blocks_same_route
  FROM (SELECT DISTINCT block_id, route_key FROM block_events) a JOIN (SELECT DISTINCT block_id, route_key FROM block_events) b
  ON a.route_key = b.route_key GROUP BY a.block_id"""


@query("jn17_connected_blocks", f"{WITH} {CONNECTED_SQL}")
def _(spark, folder):
    reduced = service(spark, folder, "routes")
    return tr.connected_blocks(reduced, stop_block(spark, folder, reduced))


def _features_sql() -> str:
    def filled(n: str) -> str:
        return f"coalesce({n}, {tr.default_value(n)})"

    def ratio(a: str, b: str) -> str:
        return f"coalesce({filled(a)} / nullif({b}, 0), 0.0)"

    derived = {
        "pt_stop_density_per_km2": f"{filled('pt_stop_count')} / 0.01",
        "pt_offpeak_departures": f"{filled('pt_weekday_departures')} - {filled('pt_peak_departures')}",
        "pt_peak_departure_share": ratio("pt_peak_departures", "pt_weekday_departures"),
        "pt_departures_per_stop": ratio("pt_weekday_departures", "pt_stop_count"),
        "pt_routes_per_stop": ratio("pt_route_count", "pt_stop_count"),
        "pt_peak_departures_per_route": ratio("pt_peak_departures", "pt_route_count"),
        "pt_service_span_hours": f"greatest({filled('pt_last_departure_min')} - {filled('pt_first_departure_min')}, 0.0) / 60.0",
    }
    for m in S.MODES:
        derived[f"pt_has_{m}_service"] = f"CASE WHEN coalesce({m}_stop_count, 0) > 0 THEN 1.0 ELSE 0.0 END"
        derived[f"pt_{m}_stop_density_per_km2"] = f"coalesce({m}_stop_count, 0.0) / 0.01"
        for k in ("stop_count", "route_count", "weekday_departures", "peak_departures"):
            derived[f"pt_{m}_{k}"] = f"coalesce({m}_{k}, 0.0)"
    for r in tr.CATCHMENT_M:
        derived[f"pt_departures_per_stop_within_{r}m"] = ratio(f"pt_departures_within_{r}m", f"pt_stops_within_{r}m")
        derived[f"pt_routes_per_stop_within_{r}m"] = ratio(f"pt_routes_within_{r}m", f"pt_stops_within_{r}m")
        derived[f"pt_peak_departure_share_within_{r}m"] = ratio(f"pt_peak_departures_within_{r}m", f"pt_departures_within_{r}m")
    columns = ", ".join(f"{q6(derived.get(n, filled(n)))} AS {n}" for n in tr.transit_feature_names())
    return f"""{WITH}, {CATCHMENT_SQL}, {NEAREST_SQL}, svc AS ({BLOCK_SQL}), modes AS ({MODE_SQL}), hw AS ({HEADWAY_SQL}), conn AS ({CONNECTED_SQL}),
    near_by_mode AS ({NEAREST_MODE_SQL}), stop_n AS (SELECT block_id, CAST(count(DISTINCT (px, py)) AS DOUBLE) AS pt_stop_count FROM stop_block GROUP BY block_id)
    SELECT g.block_id, {columns} FROM grid g LEFT JOIN stop_n USING (block_id) LEFT JOIN svc USING (block_id) LEFT JOIN modes USING (block_id)
    LEFT JOIN hw USING (block_id) LEFT JOIN conn USING (block_id) LEFT JOIN near_stop USING (block_id)
    LEFT JOIN near_by_mode USING (block_id) LEFT JOIN catchment USING (block_id)"""


FEATURES_SQL = _features_sql()


def transit_features(spark: SparkSession, folder: str) -> DataFrame:
    return tr.build_transit_features(block_polygons(spark, folder), block_centres(spark, folder), service(spark, folder))


@query("transit_features", FEATURES_SQL)
def _(spark, folder):
    return rounded(transit_features(spark, folder))


@query("transit_features_two_cities", f"SELECT * EXCLUDE (city) REPLACE (city || ':' || block_id AS block_id) FROM ({FEATURES_SQL}), {space.TWIN_SQL}")
def _(spark, folder):
    """Two cities with the same blocks and schedules in one job; each sees its own stops only."""
    tables = C.schedule_tables(spark, folder)
    feeds = 1 + tables["stops"].agg(F.max("feed_idx")).first()[0]
    both = {n: t.withColumn("city_number", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("feed_idx", F.col("feed_idx") + F.col("city_number") * feeds) for n, t in tables.items()}
    both["stops"] = both["stops"].withColumn("stop_lon", (F.col("stop_lon").try_cast("double") + F.col("city_number") * ct.CITY_SPACING_M).cast("string"))
    service = tr.reduce_schedule(**{n: t.drop("city_number") for n, t in both.items()})
    polygons = with_edges(space.twins(C.grid_blocks(spark, folder), polygons=["rings"])).withColumn("area_km2", G.polygon_area(F.col("rings")) / 1e6)
    return rounded(tr.build_transit_features(polygons, space.twins(block_centres(spark, folder), x=["x"]), service))


@query("ag37_transit_coverage", f"""WITH f AS ({FEATURES_SQL}) SELECT CAST(sum(pt_stop_count) AS BIGINT) AS n_active_stops_inside_blocks,
  count_if(pt_stop_count > 0) AS n_blocks_with_stops, count_if(pt_weekday_departures > 0) AS n_blocks_with_departures,
  {q6('median(pt_nearest_stop_dist_m)')} AS median_nearest_stop_dist_m, count_if(pt_stops_within_800m > 0) AS n_blocks_with_stop_within_800m,
  count_if(pt_bus_stops_within_800m > 0) AS n_blocks_with_bus_stop_within_800m,
  count_if(pt_tram_stops_within_800m + pt_metro_stops_within_800m + pt_train_stops_within_800m > 0) AS n_blocks_with_rail_mode_stop_within_800m FROM f""")
def _(spark, folder):
    return rounded(tr.transit_summary(rounded(transit_features(spark, folder))))


@query("wn07_first_of_place", f"{WITH} SELECT px, py, {q6('x')} AS x, {q6('y')} AS y FROM places")
def _(spark, folder):
    return rounded(service(spark, folder, "stops").places, "px", "py")


@query("set04_routes_in_catchment", f"""{WITH}, calls AS (SELECT DISTINCT px, py, route_key FROM service_events)
  SELECT block_id, count(DISTINCT route_key) AS n_routes FROM reach JOIN calls USING (px, py) WHERE d <= 800 GROUP BY block_id""")
def _(spark, folder):
    reduced = service(spark, folder, "routes")
    met = radius_sets(block_centres(spark, folder), "block_id", tr.route_words(reduced), ["mode", "word"], "bits", [800.0], lambda r: "within")
    return met.where("word >= 0").groupBy("block_id").agg(F.sum(F.bit_count("within").cast("bigint")).alias("n_routes"))
