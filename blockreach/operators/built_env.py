"""Built-environment predictors per block: streets, road nodes, land use, buildings, block shape."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from blockreach.functions import geometry as G, tags as T
from blockreach.functions.numeric import clip, safe_divide
from blockreach.operators import graph as gr
from blockreach.operators.overlay import clip_lines, overlap_polygons, points_in_polygons

LOW_SPEED_KMH = 35.0
BLOCK = ("block_id", "edges", "minx", "miny", "maxx", "maxy")


def block_shapes(polygons: DataFrame) -> DataFrame:
    """Area, perimeter and compactness of each block."""
    out = polygons.withColumn("be_block_area_m2", G.polygon_area(F.col("rings"))).withColumn(
        "perimeter_m", G.polygon_perimeter(F.col("edges"))
    )
    return out.select(
        "block_id", "be_block_area_m2", "perimeter_m",
        G.compactness(F.col("be_block_area_m2"), F.col("perimeter_m")).alias("be_compactness"),
    )


def street_lengths(streets: DataFrame, polygons: DataFrame) -> DataFrame:
    """Street metres per block: all, bikeable, major, local, low speed, and speed-weighted.

    The lines are cut by the blocks once and every class is a conditional sum over the same pieces.
    ``streets``: ``highway_type, speed_kmh, line``.
    """
    pieces = clip_lines(streets.select("highway_type", "speed_kmh", "line"), polygons.select(*BLOCK))

    def metres(when: Column) -> Column:
        return F.sum(F.when(when, F.col("length_m")).otherwise(0.0))

    kind = F.col("highway_type")
    return pieces.groupBy("block_id").agg(
        F.sum("length_m").alias("street_m"),
        metres(kind.isin(list(T.BIKEABLE_STREETS))).alias("bike_m"),
        metres(kind.isin(list(T.MAJOR_STREETS))).alias("major_m"),
        metres(kind.isin(list(T.LOCAL_STREETS))).alias("local_m"),
        metres(F.col("speed_kmh") <= LOW_SPEED_KMH).alias("slow_m"),
        F.sum(F.col("length_m") * F.col("speed_kmh")).alias("speed_m"),
    )


def road_nodes_by_block(streets: DataFrame, polygons: DataFrame) -> DataFrame:
    """Road nodes, intersections (three or more neighbours) and mean degree of each block."""
    edges = gr.road_graph(streets)
    nodes = gr.node_degrees(edges).select("degree", (F.col("node.mx") / 1000.0).alias("x"), (F.col("node.my") / 1000.0).alias("y"))
    inside = points_in_polygons(nodes, polygons.select(*BLOCK))
    return inside.groupBy("block_id").agg(
        F.count(F.lit(1)).cast("double").alias("be_road_node_count"),
        F.count_if(F.col("degree") >= 3).cast("double").alias("be_intersection_count"),
        F.avg("degree").alias("be_avg_node_degree"),
    )


def land_overlaps(land: DataFrame, polygons: DataFrame) -> DataFrame:
    """Areas in common between land-use or building polygons and blocks (one pass for both)."""
    return overlap_polygons(
        polygons.select(*BLOCK), land.select("landuse_group", "is_building", *BLOCK[1:])
    )


def landuse_shares(overlaps: DataFrame, shapes: DataFrame) -> DataFrame:
    """Share of each land-use group per block, clipped to 0..1, and their entropy over log 6."""
    groups = list(T.LANDUSE_GROUPS)
    wide = overlaps.where(F.col("landuse_group") != "other").groupBy("block_id").pivot("landuse_group", groups).agg(F.sum("area_m2"))
    out = wide.join(shapes.select("block_id", "be_block_area_m2"), "block_id")
    shares = {g: clip(safe_divide(F.coalesce(F.col(g), F.lit(0.0)), F.col("be_block_area_m2"), 0.0), 0.0, 1.0) for g in groups}
    out = out.select("block_id", *[s.alias(f"be_landuse_{g}_share") for g, s in shares.items()])
    entropy = F.lit(0.0)
    for g in groups:
        p = F.col(f"be_landuse_{g}_share")
        entropy = entropy - F.when(p > 0, p * F.ln(p)).otherwise(0.0)
    return out.withColumn("be_landuse_entropy", entropy / math.log(len(groups)))


def building_shares(overlaps: DataFrame, shapes: DataFrame) -> DataFrame:
    """Built-over share and buildings per square kilometre."""
    sums = overlaps.where("is_building").groupBy("block_id").agg(
        F.sum("area_m2").alias("built_m2"), F.count(F.lit(1)).alias("n")
    ).join(shapes.select("block_id", "be_block_area_m2"), "block_id")
    area = F.col("be_block_area_m2")
    return sums.select(
        "block_id",
        clip(safe_divide(F.col("built_m2"), area, 0.0), 0.0, 1.0).alias("be_building_footprint_share"),
        safe_divide(F.col("n"), area / 1e6, 0.0).alias("be_building_count_density_per_km2"),
    )


def adjacency_degrees(edges: DataFrame) -> DataFrame:
    """Number of adjacent blocks."""
    return gr.both_directions(edges).groupBy(F.col("src").alias("block_id")).agg(F.count(F.lit(1)).cast("double").alias("be_adjacency_degree"))


def derive_densities(df: DataFrame) -> DataFrame:
    """Densities and shares from lengths, node counts and block shape."""
    c = F.col
    km2 = c("be_block_area_m2") / 1e6
    street_km = c("street_m") / 1000.0
    return df.withColumns({
        "be_street_length_m": c("street_m"),
        "be_bikeable_street_length_m": c("bike_m"),
        "be_street_length_density_m_per_km2": safe_divide(c("street_m"), km2, 0.0),
        "be_bikeable_street_length_density_m_per_km2": safe_divide(c("bike_m"), km2, 0.0),
        "be_block_area_km2": F.coalesce(km2, F.lit(0.0)),
        "be_inverse_block_area_per_km2": safe_divide(F.lit(1.0), km2, 0.0),
        "be_bikeable_street_share": safe_divide(c("bike_m"), c("street_m"), 0.0),
        "be_major_road_share": safe_divide(c("major_m"), c("street_m"), 0.0),
        "be_major_road_density_m_per_km2": safe_divide(c("major_m"), km2, 0.0),
        "be_local_road_share": safe_divide(c("local_m"), c("street_m"), 0.0),
        "be_estimated_avg_road_speed_kmh": safe_divide(c("speed_m"), c("street_m"), 0.0),
        "be_low_speed_street_share": safe_divide(c("slow_m"), c("street_m"), 0.0),
        "be_intersection_density_per_km2": safe_divide(c("be_intersection_count"), km2, 0.0),
        "be_intersections_per_street_km": safe_divide(c("be_intersection_count"), street_km, 0.0),
        "be_nodes_per_street_km": safe_divide(c("be_road_node_count"), street_km, 0.0),
        "be_street_length_perimeter_ratio": safe_divide(c("street_m"), c("perimeter_m"), 0.0),
    })


def derive_composites(df: DataFrame) -> DataFrame:
    """Non-residential and activity shares, development intensity, walkability."""
    share = lambda g: F.col(f"be_landuse_{g}_share")
    active = share("commercial") + share("retail") + share("civic")
    return df.withColumns({
        "be_nonresidential_landuse_share": clip(share("commercial") + share("retail") + share("industrial") + share("civic"), 0.0, 1.0),
        "be_activity_landuse_share": clip(active, 0.0, 1.0),
        "be_development_intensity": F.col("be_building_footprint_share") * F.log1p("be_building_count_density_per_km2"),
        "be_walkability_proxy": F.log1p("be_intersection_density_per_km2")
        + F.log1p("be_street_length_density_m_per_km2")
        + F.col("be_landuse_entropy") + F.col("be_building_footprint_share") - F.col("be_major_road_share"),
    })


def built_feature_names() -> list[str]:
    """The 35 predictor columns in contract order."""
    return [
        "be_block_area_m2", "be_compactness", "be_street_length_m", "be_bikeable_street_length_m",
        "be_street_length_density_m_per_km2", "be_bikeable_street_length_density_m_per_km2",
        "be_block_area_km2", "be_inverse_block_area_per_km2", "be_bikeable_street_share",
        "be_major_road_share", "be_major_road_density_m_per_km2", "be_local_road_share",
        "be_estimated_avg_road_speed_kmh", "be_low_speed_street_share", "be_road_node_count",
        "be_intersection_count", "be_avg_node_degree", "be_intersection_density_per_km2",
        "be_intersections_per_street_km", "be_nodes_per_street_km", "be_street_length_perimeter_ratio",
        "be_adjacency_degree", *[f"be_landuse_{g}_share" for g in T.LANDUSE_GROUPS], "be_landuse_entropy",
        "be_building_footprint_share", "be_building_count_density_per_km2",
        "be_nonresidential_landuse_share", "be_activity_landuse_share", "be_development_intensity",
        "be_walkability_proxy",
    ]


def build_built_features(polygons: DataFrame, streets: DataFrame, land: DataFrame, adjacency: DataFrame) -> DataFrame:
    """All built-environment predictors, one row per block.

    ``polygons``: ``block_id, rings, edges`` and box columns; ``streets``: ``highway_type, speed_kmh,
    line``; ``land``: ``landuse_group, is_building, edges`` and box columns; ``adjacency``: block pairs.
    """
    shapes = block_shapes(polygons)
    overlaps = land_overlaps(land, polygons)
    out = shapes
    for part in (
        street_lengths(streets, polygons), road_nodes_by_block(streets, polygons), adjacency_degrees(adjacency),
        landuse_shares(overlaps, shapes), building_shares(overlaps, shapes),
    ):
        out = out.join(part, "block_id", "left")
    out = out.na.fill(0.0, [c for c in out.columns if c not in {"block_id", "perimeter_m"}])
    return derive_composites(derive_densities(out)).select("block_id", *built_feature_names())


def built_summary(features: DataFrame, n_streets: int, n_land: int) -> DataFrame:
    """Coverage figures of a built-environment table as one row."""
    return features.agg(
        F.lit(n_streets).cast("bigint").alias("n_street_lines"),
        F.lit(n_land).cast("bigint").alias("n_landuse_building_polygons"),
        F.count_if(F.col("be_street_length_m") > 0).alias("n_blocks_with_streets"),
        F.count_if(F.col("be_intersection_count") > 0).alias("n_blocks_with_intersections"),
        F.count_if(F.col("be_building_footprint_share") > 0).alias("n_blocks_with_building_footprints"),
    )
