"""Block backbone: block points and quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from blockreach.functions import geometry as G, projection as P
from blockreach.operators.graph import both_directions
from blockreach.operators.overlay import once


def block_points(polygons: DataFrame, epsg: int | None = None) -> DataFrame:
    """Interior point of each block in metres and, with a UTM zone, in degrees."""
    out = polygons.withColumn("p", once(G.interior_point(F.col("edges"))))
    out = out.select("block_id", F.col("p.x").alias("x_m"), F.col("p.y").alias("y_m"))
    if epsg is None:
        return out
    return out.withColumn("g", once(P.from_utm(F.col("x_m"), F.col("y_m"), F.lit(epsg)))).select(
        "block_id", "x_m", "y_m", F.col("g.lon").alias("lon"), F.col("g.lat").alias("lat")
    )


def table_utm_zone(polygons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., epsg``: the UTM zone of the area-weighted centroid of all polygons (rings in degrees)."""
    moments = polygons.select(*by, once(G.polygon_moments(F.col("rings"))).alias("m"))
    centre = moments.groupBy(*by).agg(F.sum("m.area").alias("a"), F.sum("m.mx").alias("x"), F.sum("m.my").alias("y"))
    return centre.select(*by, P.utm_epsg(F.col("x") / F.col("a"), F.col("y") / F.col("a")).alias("epsg"))


def isolated_blocks(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks without any neighbour."""
    linked = both_directions(edges).select(F.col("src").alias("block_id")).distinct()
    return blocks.select("block_id").join(linked, "block_id", "left_anti")


def backbone_quality(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, repeated ids, invalid rings and isolated blocks as one row."""
    per_id = blocks.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if(~G.valid_rings(F.col("rings"))).alias("invalid")
    )
    lone = isolated_blocks(per_id, edges).withColumn("lone", F.lit(1))
    n_edges = edges.count()
    return per_id.join(lone, "block_id", "left").agg(
        F.sum("copies").alias("n_blocks"),
        F.lit(n_edges).cast("bigint").alias("n_edges"),
        F.sum(F.col("copies") - 1).alias("n_duplicate_block_ids"),
        F.sum("invalid").alias("n_invalid_geometries"),
        F.count("lone").alias("n_isolated_blocks"),
    )
