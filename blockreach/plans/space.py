"""Polygon, overlay, built-environment and graph queries on the square-block layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockreach.functions import geometry as G, projection as P, tags as T
from blockreach.operators import backbone as bb, built_env as be, cities as ct, graph as gr, overlay as ov, target as tg
from blockreach.plans import carriers as C
from blockreach.plans.registry import q6, query, r6, rounded
from blockreach.sources import sinks

HIGHWAYS = ("residential", "primary", "path", "tertiary", "service", "motorway")
HIGHWAY_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HIGHWAYS)) + " END"
LANDUSE = ("residential", "commercial", "retail", "industrial", "education", "park", "vacant")
LANDUSE_SQL = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(LANDUSE)) + " END"
GROUP_SQL = "CASE p_partkey % 7 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'retail' WHEN 3 THEN 'industrial' WHEN 4 THEN 'civic' WHEN 5 THEN 'green' ELSE 'other' END"
LAST = C.COLUMNS - 1


def polygons(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    return ov.with_edges(C.grid_blocks(spark, folder, dealt))


def choose(key, names):
    out = F.lit(names[-1])
    for i, n in enumerate(names[:-1]):
        out = F.when(key % len(names) == i, F.lit(n)).otherwise(out)
    return out


def raw_streets(spark: SparkSession, folder: str) -> DataFrame:
    """A line through each block: from the right neighbour's centre to its own and up to the next one."""
    mx, my = F.col("x0") + 50.0, F.col("y0") + 50.0
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    up = F.array(at(mx, my), at(mx, my + 100.0))
    line = F.when(F.col("c") < LAST, F.concat(F.array(at(mx + 100.0, my)), up)).otherwise(up)
    key = F.col("p_partkey")
    return C.grid(spark, folder).select(
        "p_partkey",
        F.concat(F.lit(" "), F.upper(choose(key, HIGHWAYS)), F.lit(";other")).alias("highway"),
        F.when(key % 4 == 0, "30 mph").when(key % 4 == 1, "25").when(key % 4 == 2, "walk").alias("maxspeed"),
        line.alias("line"),
    )


def streets(spark: SparkSession, folder: str) -> DataFrame:
    df = raw_streets(spark, folder).withColumn("highway_type", T.primary_tag(F.col("highway")))
    return df.withColumn("speed_kmh", T.speed_kmh(F.col("maxspeed"), F.col("highway_type"))).drop("highway", "maxspeed")


SPEED_SQL = """CASE p_partkey % 4 WHEN 0 THEN 30 * 1.60934 WHEN 1 THEN 25.0 ELSE
  CASE p_partkey % 6 WHEN 0 THEN 30.0 WHEN 1 THEN 65.0 WHEN 2 THEN 10.0 WHEN 3 THEN 45.0 WHEN 4 THEN 20.0 ELSE 105.0 END END"""


def land(spark: SparkSession, folder: str) -> DataFrame:
    """A rectangle per block that may run into its right neighbour."""
    key = F.col("p_partkey")
    x0, y0 = F.col("x0") + 25.0, F.col("y0") + 10.0
    wide = (50 + (key % 3) * 50).cast("double")
    df = C.grid(spark, folder).select(
        T.landuse_group(choose(key, LANDUSE)).alias("landuse_group"),
        T.is_building(F.when(key % 5 == 0, "yes").when(key % 5 == 1, "No")).alias("is_building"),
        C.box_rings(x0, y0, x0 + wide, y0 + 50.0).alias("rings"),
    )
    return ov.with_edges(df.where((F.col("landuse_group") != "other") | F.col("is_building")))


def adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return gr.rook_adjacency(C.grid_blocks(spark, folder))


ADJ_SQL = f"""adjacency AS (SELECT a.block_id AS src_block_id, b.block_id AS dst_block_id FROM grid a JOIN grid b
  ON (b.p_partkey = a.p_partkey + 1 AND a.c < {LAST}) OR b.p_partkey = a.p_partkey + {C.COLUMNS})"""
# A block is crossed by its own line, by the left neighbour's and by the lower neighbour's.
PIECES_SQL = f"""street AS (SELECT p_partkey, r, c, block_id, {HIGHWAY_SQL} AS kind, {SPEED_SQL} AS speed FROM grid),
pieces AS (
  SELECT block_id, kind, speed, CASE WHEN c < {LAST} THEN 100.0 ELSE 50.0 END AS m FROM street
  UNION ALL SELECT b.block_id, a.kind, a.speed, 50.0 FROM street a JOIN street b ON b.p_partkey = a.p_partkey + 1 AND a.c < {LAST}
  UNION ALL SELECT b.block_id, a.kind, a.speed, 50.0 FROM street a JOIN street b ON b.p_partkey = a.p_partkey + {C.COLUMNS}),
lengths AS (SELECT block_id, sum(m) AS street_m,
  coalesce(sum(m) FILTER (WHERE kind IN ('residential', 'path', 'tertiary', 'service')), 0.0) AS bike_m,
  coalesce(sum(m) FILTER (WHERE kind IN ('primary', 'motorway')), 0.0) AS major_m,
  coalesce(sum(m) FILTER (WHERE kind IN ('residential', 'service')), 0.0) AS local_m,
  coalesce(sum(m) FILTER (WHERE speed <= 35), 0.0) AS slow_m, sum(m * speed) AS speed_m FROM pieces GROUP BY block_id),
nodes AS (SELECT block_id, 1.0 + CASE WHEN c < {LAST} THEN 1 ELSE 0 END + CASE WHEN c > 0 THEN 1 ELSE 0 END + CASE WHEN r > 0 THEN 1 ELSE 0 END AS degree FROM grid)"""
OVERLAP_SQL = f"""plots AS (SELECT p_partkey, c, block_id, {GROUP_SQL} AS landuse_group, p_partkey % 5 = 0 AS is_building, 50.0 + (p_partkey % 3) * 50 AS w FROM grid),
common AS (
  SELECT block_id, landuse_group, is_building, least(w, 75.0) * 50 AS area_m2 FROM plots WHERE landuse_group <> 'other' OR is_building
  UNION ALL SELECT b.block_id, a.landuse_group, a.is_building, (a.w - 75.0) * 50 FROM plots a JOIN plots b ON b.p_partkey = a.p_partkey + 1
  WHERE a.w > 75 AND a.c < {LAST} AND (a.landuse_group <> 'other' OR a.is_building)),
shares AS (SELECT block_id, {', '.join(f"least(coalesce(sum(area_m2) FILTER (WHERE landuse_group = '{g}'), 0.0) / 10000.0, 1.0) AS {g}" for g in T.LANDUSE_GROUPS)}
  FROM common WHERE landuse_group <> 'other' GROUP BY block_id),
entropies AS (SELECT *, -({' + '.join(f"CASE WHEN {g} > 0 THEN {g} * ln({g}) ELSE 0.0 END" for g in T.LANDUSE_GROUPS)}) / ln(6) AS entropy FROM shares),
buildings AS (SELECT block_id, least(sum(area_m2) / 10000.0, 1.0) AS footprint, count(*) / 0.01 AS density FROM common WHERE is_building GROUP BY block_id)"""
WITH = f"WITH {C.GRID_SQL}, {ADJ_SQL}, {PIECES_SQL}, {OVERLAP_SQL}"


@query("sp01_polygon_shapes", f"WITH {C.GRID_SQL} SELECT block_id, 10000.0 AS area_m2, 400.0 AS perimeter_m, {q6('pi() / 4')} AS compactness FROM grid")
def _(spark, folder):
    return rounded(be.block_shapes(polygons(spark, folder)).select(
        "block_id", F.col("be_block_area_m2").alias("area_m2"), "perimeter_m", F.col("be_compactness").alias("compactness")))


@query("sp06_interior_points", f"WITH {C.GRID_SQL} SELECT block_id, x0 + 50.0 AS x, y0 + 50.0 AS y FROM grid")
def _(spark, folder):
    df = polygons(spark, folder).withColumn("p", G.interior_point(F.col("edges")))
    return rounded(df.select("block_id", "p.x", "p.y"))


POINTS_SQL = "points AS (SELECT o_orderkey, CAST((o_orderkey * 7919) % 4000 AS DOUBLE) AS x, CAST((o_orderkey * 10473) % 9000 AS DOUBLE) AS y FROM orders)"


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return C.table(spark, folder, "orders", "o_orderkey").select(
        "o_orderkey", ((key * 7919) % 4000).cast("double").alias("x"), ((key * 10473) % 9000).cast("double").alias("y"))


@query("sp07_points_in_polygons", f"""WITH {C.GRID_SQL}, {POINTS_SQL} SELECT p.o_orderkey, g.block_id FROM points p JOIN grid g
  ON p.x > g.x0 AND p.x < g.x0 + 100 AND p.y > g.y0 AND p.y < g.y0 + 100""")
def _(spark, folder):
    return ov.points_in_polygons(order_points(spark, folder), polygons(spark, folder)).select("o_orderkey", "block_id")


@query("sp08_clip_lines", f"{WITH} SELECT block_id, kind AS highway_type, {q6('sum(m)')} AS length_m FROM pieces GROUP BY block_id, kind")
def _(spark, folder):
    cut = ov.clip_lines(streets(spark, folder).drop("p_partkey"), polygons(spark, folder).select(*be.BLOCK))
    return rounded(cut.groupBy("block_id", "highway_type").agg(F.sum("length_m").alias("length_m")))


@query("sp09_polygon_overlaps", f"{WITH} SELECT block_id, landuse_group, is_building, {q6('area_m2')} AS area_m2 FROM common")
def _(spark, folder):
    return rounded(be.land_overlaps(land(spark, folder), polygons(spark, folder)).select("block_id", "landuse_group", "is_building", "area_m2"))


@query("sp10_table_bounds", f"WITH {C.GRID_SQL} SELECT min(x0) AS minx, min(y0) AS miny, max(x0) + 100 AS maxx, max(y0) + 100 AS maxy FROM grid")
def _(spark, folder):
    return ov.table_bounds(polygons(spark, folder))


@query("flt01_blocks_in_box", f"WITH {C.GRID_SQL} SELECT block_id FROM grid WHERE x0 <= 1250 AND x0 + 100 >= 730 AND y0 <= 910 AND y0 + 100 >= 300")
def _(spark, folder):
    return polygons(spark, folder).where(ov.in_box(730.0, 300.0, 1250.0, 910.0)).select("block_id")


@query("flt01_clustered_layout", f"WITH {C.GRID_SQL} SELECT block_id FROM grid WHERE x0 <= 1250 AND x0 + 100 >= 730 AND y0 <= 910 AND y0 + 100 >= 300")
def _(spark, folder):
    """The same box over blocks written along a space-filling curve."""
    path = sinks.scratch_folder(spark)
    sinks.write_clustered(polygons(spark, folder).select("block_id", *ov.BOX), path)
    return spark.read.schema("block_id string, minx double, miny double, maxx double, maxy double").parquet(path).where(ov.in_box(730.0, 300.0, 1250.0, 910.0)).select("block_id")


def place(spark: SparkSession, folder: str) -> DataFrame:
    """A triangle over the lower left half of the layout, two block widths short of the right edge."""
    top = C.table(spark, folder, "part", "p_partkey").agg((F.floor(F.max("p_partkey") / C.COLUMNS) * 100.0).alias("h"))
    z = F.lit(0.0)
    return ov.with_edges(top.select(F.array(C.ring((z, z), (F.lit(3800.0), z), (z, F.col("h")))).alias("rings")))


PLACE_SQL = f"{C.GRID_SQL}, place AS (SELECT 3800.0 AS w, CAST(max(p_partkey) // {C.COLUMNS} * 100 AS DOUBLE) AS h FROM part)"


@query("jn15_blocks_of_place", f"WITH {PLACE_SQL} SELECT block_id FROM grid, place WHERE (x0 + 50) / w + (y0 + 50) / h < 1")
def _(spark, folder):
    return ov.select_by_place(polygons(spark, folder, dealt=True), place(spark, folder)).select("block_id")


@query("jn15_blocks_touching_place", f"WITH {PLACE_SQL} SELECT block_id FROM grid, place WHERE x0 / w + y0 / h <= 1")
def _(spark, folder):
    return ov.select_by_place(polygons(spark, folder, dealt=True), place(spark, folder), "intersects").select("block_id")


@query("sp11_place_clipped_blocks", f"""WITH {PLACE_SQL}, corner AS (SELECT block_id, 1 - x0 / w - y0 / h AS s, w, h FROM grid, place)
  SELECT block_id, {q6('area', 3)} AS clipped_area_m2 FROM (SELECT block_id, w * h / 2 * (s * s - greatest(s - 100 / w, 0) ** 2 - greatest(s - 100 / h, 0) ** 2
    + greatest(s - 100 / w - 100 / h, 0) ** 2) AS area FROM corner WHERE s > 0) WHERE area > 1e-6""")
def _(spark, folder):
    cut = ov.select_by_place(polygons(spark, folder, dealt=True), place(spark, folder), "intersection")
    return rounded(cut.select("block_id", "clipped_area_m2").where(F.col("clipped_area_m2") > 1e-6), digits=3)


@query("jn16_blocks_near_study_area", f"""WITH {C.GRID_SQL}, study AS (SELECT * FROM grid WHERE c < 3 AND r < 2)
  SELECT DISTINCT g.block_id FROM grid g JOIN study s ON greatest(abs(g.x0 - s.x0) - 100, 0) ** 2 + greatest(abs(g.y0 - s.y0) - 100, 0) ** 2 <= 5000 ** 2""")
def _(spark, folder):
    every = polygons(spark, folder)
    return ov.blocks_near(every, every.where("c < 3 AND r < 2"), 5000.0).select("block_id")


@query("gr01_rook_adjacency", f"{WITH} SELECT * FROM adjacency")
def _(spark, folder):
    return adjacency(spark, folder)


@query("jn11_touching_pairs", f"{WITH} SELECT src_block_id AS block_id, count(*) AS later_neighbours FROM adjacency GROUP BY src_block_id")
def _(spark, folder):
    return adjacency(spark, folder).groupBy(F.col("src_block_id").alias("block_id")).agg(F.count(F.lit(1)).alias("later_neighbours"))


@query("ag11_street_lengths", f"{WITH} SELECT block_id, street_m, bike_m, major_m, local_m, slow_m, {q6('speed_m')} AS speed_m FROM lengths")
def _(spark, folder):
    return rounded(be.street_lengths(streets(spark, folder), polygons(spark, folder)))


@query("ag12_mean_speed", f"{WITH} SELECT block_id, {q6('speed_m / street_m')} AS be_estimated_avg_road_speed_kmh FROM lengths")
def _(spark, folder):
    df = be.street_lengths(streets(spark, folder), polygons(spark, folder))
    return rounded(df.select("block_id", (F.col("speed_m") / F.col("street_m")).alias("be_estimated_avg_road_speed_kmh")))


@query("ag13_road_nodes", f"""{WITH} SELECT block_id, 1.0 AS be_road_node_count, CASE WHEN degree >= 3 THEN 1.0 ELSE 0.0 END AS be_intersection_count,
  CAST(degree AS DOUBLE) AS be_avg_node_degree FROM nodes""")
def _(spark, folder):
    return be.road_nodes_by_block(streets(spark, folder), polygons(spark, folder))


@query("ag14_landuse_shares", f"{WITH} SELECT block_id, " + ", ".join(f"{q6(g)} AS be_landuse_{g}_share" for g in T.LANDUSE_GROUPS) + f", {q6('entropy')} AS be_landuse_entropy FROM entropies")
def _(spark, folder):
    p = polygons(spark, folder)
    return rounded(be.landuse_shares(be.land_overlaps(land(spark, folder), p), be.block_shapes(p)))


@query("ag15_buildings", f"{WITH} SELECT block_id, {q6('footprint')} AS be_building_footprint_share, {q6('density')} AS be_building_count_density_per_km2 FROM buildings")
def _(spark, folder):
    p = polygons(spark, folder)
    return rounded(be.building_shares(be.land_overlaps(land(spark, folder), p), be.block_shapes(p)))


@query("ag17_adjacency_degree", f"""{WITH} SELECT block_id, CAST(count(*) AS DOUBLE) AS be_adjacency_degree FROM
  (SELECT src_block_id AS block_id FROM adjacency UNION ALL SELECT dst_block_id FROM adjacency) GROUP BY block_id""")
def _(spark, folder):
    return be.adjacency_degrees(adjacency(spark, folder))


_BE = {
    "be_block_area_m2": "10000.0", "be_compactness": "pi() / 4", "be_street_length_m": "street_m", "be_bikeable_street_length_m": "bike_m",
    "be_street_length_density_m_per_km2": "street_m / 0.01", "be_bikeable_street_length_density_m_per_km2": "bike_m / 0.01",
    "be_block_area_km2": "0.01", "be_inverse_block_area_per_km2": "100.0", "be_bikeable_street_share": "bike_m / street_m",
    "be_major_road_share": "major_m / street_m", "be_major_road_density_m_per_km2": "major_m / 0.01", "be_local_road_share": "local_m / street_m",
    "be_estimated_avg_road_speed_kmh": "speed_m / street_m", "be_low_speed_street_share": "slow_m / street_m", "be_road_node_count": "1.0",
    "be_intersection_count": "CASE WHEN degree >= 3 THEN 1.0 ELSE 0.0 END", "be_avg_node_degree": "degree",
    "be_intersection_density_per_km2": "CASE WHEN degree >= 3 THEN 100.0 ELSE 0.0 END",
    "be_intersections_per_street_km": "CASE WHEN degree >= 3 THEN 1000.0 / street_m ELSE 0.0 END", "be_nodes_per_street_km": "1000.0 / street_m",
    "be_street_length_perimeter_ratio": "street_m / 400.0", "be_adjacency_degree": "deg",
    **{f"be_landuse_{g}_share": f"coalesce({g}, 0.0)" for g in T.LANDUSE_GROUPS},
    "be_landuse_entropy": "coalesce(entropy, 0.0)", "be_building_footprint_share": "coalesce(footprint, 0.0)",
    "be_building_count_density_per_km2": "coalesce(density, 0.0)",
    "be_nonresidential_landuse_share": "least(coalesce(commercial + retail + industrial + civic, 0.0), 1.0)",
    "be_activity_landuse_share": "least(coalesce(commercial + retail + civic, 0.0), 1.0)",
    "be_development_intensity": "coalesce(footprint * ln(1 + density), 0.0)",
    "be_walkability_proxy": "ln(1 + CASE WHEN degree >= 3 THEN 100.0 ELSE 0.0 END) + ln(1 + street_m / 0.01) + coalesce(entropy, 0.0) + coalesce(footprint, 0.0) - major_m / street_m",
}
BUILT_SQL = f"""{WITH}, deg AS (SELECT block_id, count(*) AS deg FROM (SELECT src_block_id AS block_id FROM adjacency UNION ALL SELECT dst_block_id FROM adjacency) GROUP BY block_id)
  SELECT g.block_id, {', '.join(f'{q6(e)} AS {n}' for n, e in _BE.items())} FROM grid g JOIN lengths USING (block_id) JOIN nodes USING (block_id) JOIN deg USING (block_id)
  LEFT JOIN entropies USING (block_id) LEFT JOIN buildings USING (block_id)"""


def built_features(spark: SparkSession, folder: str) -> DataFrame:
    return be.build_built_features(polygons(spark, folder), streets(spark, folder), land(spark, folder), adjacency(spark, folder))


@query("built_features", BUILT_SQL)
def _(spark, folder):
    return rounded(built_features(spark, folder))


@query("ag16_composites", f"SELECT block_id, be_nonresidential_landuse_share, be_activity_landuse_share, be_development_intensity, be_walkability_proxy FROM ({BUILT_SQL})")
def _(spark, folder):
    return rounded(built_features(spark, folder).select(
        "block_id", "be_nonresidential_landuse_share", "be_activity_landuse_share", "be_development_intensity", "be_walkability_proxy"))


@query("sp04_block_densities", f"SELECT block_id, be_street_length_density_m_per_km2, be_inverse_block_area_per_km2, be_street_length_perimeter_ratio, be_major_road_density_m_per_km2 FROM ({BUILT_SQL})")
def _(spark, folder):
    return rounded(built_features(spark, folder).select(
        "block_id", "be_street_length_density_m_per_km2", "be_inverse_block_area_per_km2", "be_street_length_perimeter_ratio", "be_major_road_density_m_per_km2"))


@query("ag37_built_coverage", f"""SELECT (SELECT count(*) FROM part) AS n_street_lines, (SELECT count(*) FROM part WHERE p_partkey % 7 <> 6 OR p_partkey % 5 = 0) AS n_landuse_building_polygons,
  count_if(be_street_length_m > 0) AS n_blocks_with_streets, count_if(be_intersection_count > 0) AS n_blocks_with_intersections,
  count_if(be_building_footprint_share > 0) AS n_blocks_with_building_footprints FROM ({BUILT_SQL})""")
def _(spark, folder):
    lines, plots = streets(spark, folder), land(spark, folder)
    return be.built_summary(built_features(spark, folder), lines.count(), plots.count())


# --- graphs -----------------------------------------------------------------------------------

NODE_SQL = "CAST(({0} * 100 + 50) * 1000 AS BIGINT)"
LINKS_SQL = f"""links AS (SELECT c, r, c + 1 AS c2, r AS r2 FROM grid WHERE c < {LAST} UNION ALL SELECT c, r, c, r + 1 FROM grid),
lattice AS (SELECT * FROM links UNION ALL SELECT c2, r2, c, r FROM links)"""
GWITH = f"WITH {C.GRID_SQL}, {LINKS_SQL}"


def roads(spark: SparkSession, folder: str) -> DataFrame:
    return gr.road_graph(raw_streets(spark, folder))


@query("gr03_road_graph", f"{GWITH} SELECT {NODE_SQL.format('c')} AS sx, {NODE_SQL.format('r')} AS sy, {NODE_SQL.format('c2')} AS dx, {NODE_SQL.format('r2')} AS dy, 100.0 AS w FROM lattice")
def _(spark, folder):
    return rounded(roads(spark, folder).select(
        F.col("src.mx").alias("sx"), F.col("src.my").alias("sy"), F.col("dst.mx").alias("dx"), F.col("dst.my").alias("dy"), "w"))


@query("gr04_node_degrees", f"{GWITH} SELECT {NODE_SQL.format('c')} AS mx, {NODE_SQL.format('r')} AS my, count(*) AS degree FROM lattice GROUP BY c, r")
def _(spark, folder):
    return gr.node_degrees(roads(spark, folder)).select("node.mx", "node.my", "degree")


@query("gr05_snap_points", f"""{GWITH}, {POINTS_SQL}, ends AS (SELECT DISTINCT c, r FROM lattice),
  ranked AS (SELECT o_orderkey, c, r, sqrt((x - c * 100 - 50) ** 2 + (y - r * 100 - 50) ** 2) AS d,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY (x - c * 100 - 50) ** 2 + (y - r * 100 - 50) ** 2, c, r) AS k FROM points, ends)
  SELECT o_orderkey, {NODE_SQL.format('c')} AS mx, {NODE_SQL.format('r')} AS my, {q6('d')} AS dist FROM ranked WHERE k = 1""")
def _(spark, folder):
    near = gr.snap(order_points(spark, folder), "o_orderkey", gr.node_points(roads(spark, folder)))
    return rounded(near.select("o_orderkey", "node.mx", "node.my", "dist"))


def lattice_points(spark: SparkSession, folder: str, dx: float, dy: float) -> DataFrame:
    return C.grid(spark, folder).select(
        "block_id", (F.col("x0") + 50.0 + dx).alias("x"), (F.col("y0") + 50.0 + dy).alias("y"), F.col("p_size").cast("double").alias("jobs"))


@query("gr06_attach_destinations", f"{GWITH} SELECT {NODE_SQL.format('c')} AS mx, {NODE_SQL.format('r')} AS my, 5.0 AS offset_m, CAST(p_size AS DOUBLE) AS jobs FROM grid")
def _(spark, folder):
    nodes = gr.node_points(roads(spark, folder))
    hung = gr.attach(lattice_points(spark, folder, 3.0, 4.0), "block_id", nodes, ["jobs"])
    return rounded(hung.select("node.mx", "node.my", F.col("offset").alias("offset_m"), "jobs"))


GR7_RADII = (1000.0, 2000.0, 3000.0, 4000.0, 5000.0)


@query("gr07_network_reach", f"""{GWITH} SELECT a.block_id, {', '.join(f"coalesce(sum(b.p_size) FILTER (WHERE (abs(a.c - b.c) + abs(a.r - b.r)) * 100 + 5 <= greatest({r} - 10, 0)), 0.0)::DOUBLE AS jobs_{int(r)}" for r in GR7_RADII)}
  FROM grid a JOIN grid b ON abs(a.c - b.c) <= 50 AND abs(a.r - b.r) <= 50 GROUP BY a.block_id""")
def _(spark, folder):
    edges = roads(spark, folder)
    nodes = gr.node_points(edges)
    origins = gr.snap(lattice_points(spark, folder, 0.0, 10.0), "block_id", nodes).withColumnRenamed("dist", "offset")
    destinations = gr.attach(lattice_points(spark, folder, 3.0, 4.0), "block_id", nodes, ["jobs"])
    return gr.reachability_sums(edges, origins, destinations, nodes, ["jobs"], GR7_RADII, lambda m, r: f"{m}_{int(r)}")


@query("gr02_block_graph", f"{WITH} SELECT src_block_id AS src, dst_block_id AS dst, 100.0 AS w FROM adjacency UNION ALL SELECT dst_block_id, src_block_id, 100.0 FROM adjacency")
def _(spark, folder):
    points = lattice_points(spark, folder, 0.0, 0.0)
    return rounded(gr.block_graph(adjacency(spark, folder), points))


@query("gr08_components", f"""WITH {C.GRID_SQL} SELECT block_id AS node, min(block_id) OVER (PARTITION BY r // 4) AS component FROM grid""")
def _(spark, folder):
    """Blocks split into bands by dropping the links that cross every fourth row."""
    cells = C.grid(spark, folder).select("block_id", "r")
    links = adjacency(spark, folder)
    for end in ("src", "dst"):
        links = links.join(cells.select(F.col("block_id").alias(f"{end}_block_id"), F.col("r").alias(f"{end}_r")), f"{end}_block_id")
    within = links.where(F.floor(F.col("src_r") / 4) == F.floor(F.col("dst_r") / 4))
    return gr.connected_components(gr.both_directions(within), cells.select(F.col("block_id").alias("node")))


@query("gr10_adjacency_matrix", f"""{WITH} SELECT src_block_id AS src, dst_block_id AS dst FROM adjacency WHERE src_block_id NOT LIKE '%7' AND dst_block_id NOT LIKE '%7'
  UNION ALL SELECT dst_block_id, src_block_id FROM adjacency WHERE src_block_id NOT LIKE '%7' AND dst_block_id NOT LIKE '%7'""")
def _(spark, folder):
    listed = C.grid(spark, folder).where(~F.col("block_id").endswith("7"))
    return gr.undirected_adjacency(adjacency(spark, folder), listed)


@query("flt11_known_edges", f"{WITH} SELECT * FROM adjacency WHERE src_block_id NOT LIKE '%7' AND dst_block_id NOT LIKE '%7'")
def _(spark, folder):
    return gr.known_edges(adjacency(spark, folder), C.grid(spark, folder).where(~F.col("block_id").endswith("7"))).select("src_block_id", "dst_block_id")


CITY_EDGES = f"city_edges AS (SELECT 'city_' || (a.p_partkey // 200) AS city, a.block_id AS s, b.block_id AS d FROM grid a JOIN grid b ON b.p_partkey = a.p_partkey + 1 AND a.c < {LAST})"


@query("gr11_multi_city_graph", f"WITH {C.GRID_SQL}, {CITY_EDGES} SELECT city || ':' || s AS src, city || ':' || d AS dst FROM city_edges UNION ALL SELECT city || ':' || d, city || ':' || s FROM city_edges")
def _(spark, folder):
    cells = C.grid(spark, folder).select("block_id", "r", F.concat(F.lit("city_"), C.div(F.col("p_partkey"), 200).cast("string")).alias("city"))
    links = adjacency(spark, folder)
    links = links.join(cells.select(F.col("block_id").alias("src_block_id"), "city", F.col("r").alias("r1")), "src_block_id")
    links = links.join(cells.select(F.col("block_id").alias("dst_block_id"), F.col("r").alias("r2")), "dst_block_id").where("r1 = r2")
    return gr.multi_city_graph(gr.both_directions(links, "city"))


def block_features(spark: SparkSession, folder: str) -> DataFrame:
    return C.grid(spark, folder).select(
        F.col("block_id").alias("node_id"), F.col("p_size").cast("double").alias("f1"), (F.col("p_partkey") % 13).cast("double").alias("f2"))


FEAT_SQL = f"""feats AS (SELECT block_id AS node_id, CAST(p_size AS DOUBLE) AS f1, CAST(p_partkey % 13 AS DOUBLE) AS f2 FROM grid),
both_ways AS (SELECT src_block_id AS src, dst_block_id AS dst FROM adjacency UNION ALL SELECT dst_block_id, src_block_id FROM adjacency)"""


@query("gr12_neighbour_mean", f"{WITH}, {FEAT_SQL} SELECT src AS node_id, {q6('avg(f1)')} AS f1, {q6('avg(f2)')} AS f2 FROM both_ways JOIN feats ON dst = node_id GROUP BY src")
def _(spark, folder):
    return rounded(gr.neighbour_mean(gr.both_directions(adjacency(spark, folder)), block_features(spark, folder), ["f1", "f2"]))


@query("gr13_symmetric_smooth", f"""{WITH}, {FEAT_SQL}, deg AS (SELECT src AS node_id, count(*) + 1 AS k FROM both_ways GROUP BY src),
  looped AS (SELECT * FROM both_ways UNION ALL SELECT node_id, node_id FROM feats)
  SELECT src AS node_id, {q6('sum(f1 / sqrt(a.k) / sqrt(b.k))')} AS f1, {q6('sum(f2 / sqrt(a.k) / sqrt(b.k))')} AS f2
  FROM looped JOIN feats f ON dst = f.node_id JOIN deg a ON a.node_id = src JOIN deg b ON b.node_id = dst GROUP BY src""")
def _(spark, folder):
    return rounded(gr.symmetric_smooth(gr.both_directions(adjacency(spark, folder)), block_features(spark, folder), ["f1", "f2"]))


@query("gr14_khop_neighbourhoods", f"""{WITH}, {FEAT_SQL}, h AS (SELECT a.block_id AS seed, b.block_id AS node FROM grid a JOIN grid b ON abs(a.c - b.c) + abs(a.r - b.r) <= 2)
  SELECT seed, count(*) AS subgraph_nodes, any_value(e) AS subgraph_edges FROM h JOIN (
    SELECT a.seed, count(*) AS e FROM h a JOIN adjacency ON a.node = src_block_id JOIN h b ON b.seed = a.seed AND b.node = dst_block_id GROUP BY a.seed) USING (seed) GROUP BY seed""")
def _(spark, folder):
    edges = gr.both_directions(adjacency(spark, folder))
    seeds = C.grid(spark, folder).select(F.col("block_id").alias("node"))
    return gr.khop_sizes(edges, gr.khop(edges, seeds, 2))


@query("set02_undirected_pairs", f"{WITH} SELECT * FROM adjacency")
def _(spark, folder):
    return gr.undirected_pairs(gr.both_directions(adjacency(spark, folder)), "dst", "src")


# --- projection -------------------------------------------------------------------------------

def lonlat(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return C.blocks(spark, folder).select(
        "block_id", "city", (-180.0 + (key * 37 % 3599) / 10.0 + 0.05).alias("lon"), (-79.95 + (key * 53 % 1599) / 10.0).alias("lat"))


LONLAT_SQL = f"{C.BLOCKS_SQL}, lonlat AS (SELECT block_id, city, -180.0::DOUBLE + (c_custkey * 37 % 3599) / 10.0::DOUBLE + 0.05::DOUBLE AS lon, -79.95::DOUBLE + (c_custkey * 53 % 1599) / 10.0::DOUBLE AS lat FROM blocks)"


# Rectangles of unequal size, each with a small hole in its middle, so areas weigh and centroids stay.
@query("fn26_utm_zone_of_table", f"""WITH {LONLAT_SQL}, shapes AS (SELECT city, lon, lat, CAST(block_id AS BIGINT) % 7 + 1 AS s FROM lonlat),
  centre AS (SELECT city, sum(lon * (s * s * 0.0008 - 0.000001)) / sum(s * s * 0.0008 - 0.000001) AS lon, sum(lat * (s * s * 0.0008 - 0.000001)) / sum(s * s * 0.0008 - 0.000001) AS lat FROM shapes GROUP BY city)
  SELECT city, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1 AS INTEGER) AS epsg FROM centre""")
def _(spark, folder):
    """Zone of each city from the area-weighted centroid of its polygons."""
    s = F.col("block_id").cast("bigint") % 7 + 1
    lon, lat = F.col("lon"), F.col("lat")
    shell = C.ring((lon - s * 0.02, lat - s * 0.01), (lon + s * 0.02, lat - s * 0.01), (lon + s * 0.02, lat + s * 0.01), (lon - s * 0.02, lat + s * 0.01))
    hole = C.ring((lon - 0.0005, lat - 0.0005), (lon - 0.0005, lat + 0.0005), (lon + 0.0005, lat + 0.0005), (lon + 0.0005, lat - 0.0005))
    return bb.table_utm_zone(lonlat(spark, folder).withColumn("rings", F.array(shell, hole)), ["city"])


@query("sp05_utm_round_trip", f"WITH {LONLAT_SQL} SELECT block_id, {q6('lon')} AS lon, {q6('lat')} AS lat FROM lonlat")
def _(spark, folder):
    df = lonlat(spark, folder).withColumn("epsg", P.utm_epsg(F.col("lon"), F.col("lat")))
    df = df.withColumn("m", P.to_utm(F.col("lon"), F.col("lat"), F.col("epsg")))
    df = df.withColumn("g", P.from_utm(F.col("m.x"), F.col("m.y"), F.col("epsg")))
    return rounded(df.select("block_id", "g.lon", "g.lat"))


# --- irregular shapes and overlay pairs -------------------------------------------------------

def triangles(spark: SparkSession, folder: str) -> DataFrame:
    """A right triangle with legs 30 + size and 40 + size in each block, with a small square hole."""
    x0, y0, s = F.col("x0"), F.col("y0"), F.col("p_size").cast("double")
    shell = C.ring((x0, y0), (x0 + s + 30.0, y0), (x0, y0 + s + 40.0))
    hole = C.ring((x0 + 2, y0 + 2), (x0 + 2, y0 + 7), (x0 + 7, y0 + 7), (x0 + 7, y0 + 2))
    return ov.with_edges(C.grid(spark, folder).select("block_id", F.array(shell, hole).alias("rings")))


TRIANGLE_SQL = f"""WITH {C.GRID_SQL}, t AS (SELECT block_id, (p_size + 30.0) * (p_size + 40.0) / 2 - 25 AS area, p_size + 30.0 + p_size + 40.0
  + sqrt((p_size + 30.0) ** 2 + (p_size + 40.0) ** 2) + 20 AS perimeter FROM grid)"""


@query("sp02_polygon_perimeters", f"{TRIANGLE_SQL} SELECT block_id, {q6('area')} AS area_m2, {q6('perimeter')} AS perimeter_m FROM t")
def _(spark, folder):
    df = triangles(spark, folder)
    return rounded(df.select("block_id", G.polygon_area(F.col("rings")).alias("area_m2"), G.polygon_perimeter(F.col("edges")).alias("perimeter_m")))


@query("sp03_compactness", f"{TRIANGLE_SQL} SELECT block_id, {q6('4 * pi() * area / (perimeter * perimeter)')} AS compactness FROM t")
def _(spark, folder):
    return rounded(be.block_shapes(triangles(spark, folder)).select("block_id", F.col("be_compactness").alias("compactness")))


@query("jn12_overlay_pieces", f"""{WITH}, a AS (SELECT block_id, count(*) AS n_plots, sum(area_m2) AS area FROM common GROUP BY block_id), l AS (SELECT block_id, sum(m) AS m FROM pieces GROUP BY block_id)
  SELECT block_id, n_plots, {q6('area')} AS area_m2, {q6('m')} AS length_m FROM a JOIN l USING (block_id)""")
def _(spark, folder):
    p = polygons(spark, folder)
    plots = be.land_overlaps(land(spark, folder), p).groupBy("block_id").agg(F.count(F.lit(1)).alias("n_plots"), F.sum("area_m2").alias("area_m2"))
    lines = ov.clip_lines(streets(spark, folder).drop("p_partkey"), p.select(*be.BLOCK)).groupBy("block_id").agg(F.sum("length_m").alias("length_m"))
    return rounded(plots.join(lines, "block_id"))


# --- two cities on the same coordinates -------------------------------------------------------

TWIN_SQL = "(VALUES ('a'), ('b')) AS twin(city)"


def twins(df: DataFrame, **moved) -> DataFrame:
    """Every row once for each of two cities in the same place, set apart, with the city in the block id."""
    both = df.withColumn("city", F.explode(F.array(F.lit("a"), F.lit("b"))))
    out = ct.set_apart(both, ct.city_numbers(both), **moved)
    return out.withColumn("block_id", F.concat_ws(":", "city", "block_id")) if "block_id" in out.columns else out


def twin_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return gr.rook_adjacency(twins(C.grid_blocks(spark, folder), polygons=["rings"]))


@query("gr01_two_cities", f"{WITH} SELECT city || ':' || src_block_id AS src_block_id, city || ':' || dst_block_id AS dst_block_id FROM adjacency, {TWIN_SQL}")
def _(spark, folder):
    return twin_adjacency(spark, folder)


@query("built_features_two_cities", f"SELECT * EXCLUDE (city) REPLACE (city || ':' || block_id AS block_id) FROM ({BUILT_SQL}), {TWIN_SQL}")
def _(spark, folder):
    blocks = ov.with_edges(twins(C.grid_blocks(spark, folder), polygons=["rings"]))
    lines = twins(streets(spark, folder), lines=["line"])
    plots = ov.with_edges(twins(land(spark, folder).drop("edges", *ov.BOX), polygons=["rings"]))
    return rounded(be.build_built_features(blocks, lines, plots, twin_adjacency(spark, folder)))


@query("gr07_two_cities", f"""{GWITH}, one AS (SELECT a.block_id, {', '.join(f"coalesce(sum(b.p_size) FILTER (WHERE (abs(a.c - b.c) + abs(a.r - b.r)) * 100 + 5 <= greatest({r} - 10, 0)), 0.0)::DOUBLE AS jobs_{int(r)}" for r in GR7_RADII)}
  FROM grid a JOIN grid b ON abs(a.c - b.c) <= 50 AND abs(a.r - b.r) <= 50 GROUP BY a.block_id)
  SELECT one.* EXCLUDE (block_id), city || ':' || block_id AS block_id FROM one, {TWIN_SQL}""")
def _(spark, folder):
    edges = gr.road_graph(twins(raw_streets(spark, folder), lines=["line"]))
    nodes = gr.node_points(edges)
    origins = gr.snap(twins(lattice_points(spark, folder, 0.0, 10.0), x=["x"]), "block_id", nodes).withColumnRenamed("dist", "offset")
    destinations = gr.attach(twins(lattice_points(spark, folder, 3.0, 4.0), x=["x"]), "block_id", nodes, ["jobs"])
    return gr.reachability_sums(edges, origins, destinations, nodes, ["jobs"], GR7_RADII, lambda m, r: f"{m}_{int(r)}")
