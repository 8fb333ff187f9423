"""Map layers and block tables, read from Parquet with box columns next to the geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockreach.functions import geometry as G, tags as T
from blockreach.functions.naming import node_id
from blockreach.operators.overlay import in_box, once

# Block columns by census vintage, newest first.
BLOCK_COLUMNS = {
    "block_id": ("GEOID20", "GEOID10", "GEOID"),
    "state_fips": ("STATEFP20", "STATEFP"),
    "county_fips": ("COUNTYFP20", "COUNTYFP"),
    "tract_code": ("TRACTCE20", "TRACTCE"),
    "block_code": ("BLOCKCE20", "BLOCKCE"),
}

# City, state, place.
CITIES = {
    "santa_cruz": ("ca", "0669112"), "little_rock": ("ar", "0541000"), "tulsa": ("ok", "4075000"),
    "denver": ("co", "0820000"), "atlanta": ("ga", "1304000"), "boston": ("ma", "2507000"),
    "washington_dc": ("dc", "1150000"), "houston": ("tx", "4835000"), "los_angeles": ("ca", "0644000"),
    "new_york": ("ny", "3651000"),
}


def tag_column(layer: DataFrame, tag: str) -> Column:
    """A tag's own column if the layer has one, else its value inside ``other_tags``."""
    if tag in layer.columns:
        return F.col(tag)
    if "other_tags" in layer.columns:
        return T.tag_value(F.col("other_tags"), tag)
    return F.lit(None).cast("string")


def amenity_points(points: DataFrame, polygons: DataFrame | None = None) -> DataFrame:
    """Amenities of the point layer (``x, y``) and of the polygon layer (``edges``, at an interior point)."""
    tags = lambda df: [tag_column(df, t).alias(t) for t in ("amenity", "shop", "leisure")]
    keep = ["osm_id", "x", "y"]
    out = points.select(*keep, *tags(points), F.lit("points").alias("source_layer"))
    if polygons is not None:
        at = polygons.withColumn("at_", once(G.interior_point(F.col("edges")))).withColumns({"x": F.col("at_.x"), "y": F.col("at_.y")})
        out = out.unionByName(at.select(*keep, *tags(polygons), F.lit("multipolygons").alias("source_layer")))
    return out


def road_lines(layer: DataFrame, box: tuple[float, float, float, float] | None = None, classes: Sequence[str] = T.DRIVABLE_ROADS) -> DataFrame:
    """Lines of the given road classes in a box, with ``highway_type``."""
    rows = layer if box is None else layer.where(in_box(*box))
    kind = T.primary_tag(F.col("highway"))
    return rows.where(kind.isin(list(classes))).withColumn("highway_type", kind)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The table itself; raises when it is empty."""
    if df.isEmpty():
        raise ValueError(f"No {what} found.")
    return df


def street_lines(layer: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Lines of all street classes with ``highway_type`` and ``speed_kmh``."""
    tagged = layer.withColumn("maxspeed", tag_column(layer, "maxspeed"))
    rows = road_lines(tagged, box, T.STREETS)
    return rows.withColumn("speed_kmh", T.speed_kmh(F.col("maxspeed"), F.col("highway_type")))


def land_polygons(layer: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Polygons with a known land use or a building, with ``landuse_group`` and ``is_building``."""
    rows = layer if box is None else layer.where(in_box(*box))
    out = rows.withColumns({
        "landuse_group": T.landuse_group(tag_column(layer, "landuse")), "is_building": T.is_building(tag_column(layer, "building")),
    })
    return out.where((F.col("landuse_group") != "other") | F.col("is_building"))


def column_named(columns: Sequence[str], candidates: Sequence[str]) -> str:
    """First candidate present, in any case."""
    known = {c.upper(): c for c in columns}
    found = next((known[c.upper()] for c in candidates if c.upper() in known), None)
    if found is None:
        raise KeyError(f"None of the expected columns were found: {list(candidates)}")
    return found


def standard_blocks(blocks: DataFrame) -> DataFrame:
    """Block columns under stable names, one row per id.

    Copies of a block are reduced by aggregation (smallest row), so a block repeated many times never
    has its copies sorted in one task.
    """
    names = {stable: column_named(blocks.columns, options) for stable, options in BLOCK_COLUMNS.items()}
    rest = ["rings"] if "rings" in blocks.columns else []
    out = blocks.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()], *rest)
    others = [c for c in out.columns if c != "block_id"]
    return out.groupBy("block_id").agg(F.min(F.struct(*others)).alias("r")).select("block_id", *[F.col(f"r.{c}").alias(c) for c in others])


def place_boundary(places: DataFrame, place_geoid: str) -> DataFrame:
    """The polygon parts of one place."""
    geoid = column_named(places.columns, ("GEOID", "GEOID20", "GEOID10"))
    return places.where(F.col(geoid) == place_geoid).withColumnRenamed(geoid, "place_geoid")


def resolve_cities(requested: DataFrame) -> DataFrame:
    """Requests ``(city, state, place_geoid)`` with normalised names and defaults filled in.

    ``known`` is false for a city outside the supported list without its own state and place.
    """
    spark = requested.sparkSession
    defaults = spark.createDataFrame([(c, s, p) for c, (s, p) in CITIES.items()], "city string, default_state string, default_place string")
    out = requested.withColumn("city", F.lower(F.trim("city"))).join(F.broadcast(defaults), "city", "left")  # ten rows
    state, place = F.lower(F.coalesce("state", "default_state")), F.coalesce("place_geoid", "default_place")
    return out.select("city", state.alias("state"), place.alias("place_geoid"), (state.isNotNull() & place.isNotNull()).alias("known"))


def distance_weights(stored: DataFrame, radii: Sequence[int]) -> DataFrame:
    """One weight per radius from stored ``(city, radius, weight)`` rows, which must agree across cities.

    Without any stored rows all radii weigh the same.
    """
    spark = stored.sparkSession
    wanted = spark.createDataFrame([(int(r),) for r in radii], "radius int")
    agreed = stored.groupBy("radius").agg(F.count_distinct("weight").alias("n"), F.max("weight").alias("weight"))
    if not agreed.where("n > 1").isEmpty():
        raise ValueError("Target distance weights differ across cities.")
    return wanted.join(agreed.select("radius", "weight"), "radius", "left").withColumn(
        "weight", F.coalesce("weight", F.lit(1.0 / len(radii)))
    )


def coordinates(target: DataFrame) -> DataFrame:
    """City-qualified block coordinates of a target table."""
    return target.select(node_id(F.col("city"), F.col("block_id")).alias("node_id"), "city", "block_id", "x_m", "y_m")


def context_columns(model: DataFrame, target: str, wanted: Sequence[str]) -> DataFrame:
    """Key, target and whichever of the wanted columns the model table has."""
    return model.select("city", "block_id", target, *[c for c in wanted if c in model.columns])
