"""Transit supply per block: stops, service, headways, nearest stops and catchments.

The schedule is large and the stops are few, so the departures are reduced twice by map-side
aggregation (once per stop, route and hour type; once per stop and distinct departure time) and
everything else is computed from those two small tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockreach.functions import schedule as S
from blockreach.functions.numeric import safe_divide, to_number
from blockreach.operators.overlay import points_in_polygons
from blockreach.operators.proximity import nearest, radius_sets, radius_sums
from blockreach.operators.quantiles import medians
from blockreach.session import cut_lineage

# Catchment radii, the distance that stands for "no stop", and other defaults.
CATCHMENT_M = (400, 800, 1200, 2000, 3000)
NO_STOP_M = 10_000.0
NO_SERVICE_MIN = 1440.0
MAX_HEADWAY_MIN = 240.0
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")


@dataclass(frozen=True)
class Service:
    """The reduced schedule, down to its finest part asked for."""

    stops: DataFrame  # feed_idx, stop_key, x, y, px, py: boarding stops in use
    places: DataFrame  # px, py, x, y: physical stops
    by_route: DataFrame | None  # stop_key, px, py, route_key, route_type, mode + departures, peak, first, last
    by_time: DataFrame | None  # feed_idx, stop_key, px, py, departure_min: distinct departure times


def active_services(calendar: DataFrame | None, trips: DataFrame) -> DataFrame:
    """``(feed_idx, service_id)`` running on a weekday; every service of a feed without a usable calendar."""
    every = trips.select("feed_idx", "service_id").where(F.col("service_id").isNotNull()).distinct()
    if calendar is None or any(d not in calendar.columns for d in WEEKDAYS):
        return every
    runs = sum((F.coalesce(to_number(F.col(d)), F.lit(0.0)) for d in WEEKDAYS[1:]), F.coalesce(to_number(F.col(WEEKDAYS[0])), F.lit(0.0)))
    running = calendar.where(runs > 0).select("feed_idx", "service_id").where(F.col("service_id").isNotNull()).distinct()
    # In a union of feeds, a weekday column that a feed lacks is null in all its rows.
    usable = calendar.groupBy("feed_idx").agg(F.least(*[F.count(d) for d in WEEKDAYS]).alias("n")).where("n > 0")
    return running.join(usable.select("feed_idx"), "feed_idx", "left_semi").unionByName(every.join(usable.select("feed_idx"), "feed_idx", "left_anti"))


def departures(stop_times: DataFrame, trips: DataFrame, active: DataFrame) -> DataFrame:
    """Departures of active trips: ``feed_idx, stop_key, route_key, departure_min, is_peak``."""
    running = trips.join(active, ["feed_idx", "service_id"], "left_semi").select(
        "feed_idx", "trip_id", S.feed_key(F.col("feed_idx"), F.col("route_id")).alias("route_key")
    )
    timed = stop_times.select(
        "feed_idx", "trip_id", "stop_id", S.clock_minutes(F.col("departure_time")).alias("departure_min")
    ).where(F.col("departure_min").isNotNull())
    return timed.join(running, ["feed_idx", "trip_id"]).select(
        "feed_idx",
        S.feed_key(F.col("feed_idx"), F.col("stop_id")).alias("stop_key"),
        "route_key",
        "departure_min",
        S.is_peak(F.col("departure_min")).alias("is_peak"),
    )


def boarding_stops(stops: DataFrame, project=None) -> DataFrame:
    """Boarding stops with coordinates: ``feed_idx, stop_key, x, y, px, py``.

    ``project(lon, lat)`` gives a struct ``x, y`` in metres; without it the text is already metres.
    """
    lon, lat = to_number(F.col("stop_lon")), to_number(F.col("stop_lat"))
    kept = stops
    if "location_type" in stops.columns:
        kept = kept.where(F.coalesce(to_number(F.col("location_type")), F.lit(0.0)) == 0)
    kept = kept.where(lon.isNotNull() & lat.isNotNull())
    xy = project(lon, lat) if project else F.struct(lon.alias("x"), lat.alias("y"))
    key = S.feed_key(F.col("feed_idx"), F.col("stop_id")).alias("stop_key")
    placed = kept.select("feed_idx", key, xy.alias("xy"))
    placed = placed.withColumn("place", S.stop_place(F.col("xy.x"), F.col("xy.y")))
    return placed.select(
        "feed_idx", "stop_key", "xy.x", "xy.y", F.col("place.x").alias("px"), F.col("place.y").alias("py")
    )


def _route_sums(timed: DataFrame) -> DataFrame:
    return timed.groupBy("stop_key", "route_key").agg(
        F.sum("n").alias("departures"), F.sum("peak").alias("peak"),
        F.min("departure_min").alias("first"), F.max("departure_min").alias("last"),
    )


def reduce_schedule(
    stops: DataFrame, routes: DataFrame, trips: DataFrame, stop_times: DataFrame, calendar: DataFrame | None, project=None, finest: str = "times"
) -> Service:
    """From raw schedule tables (all text, with ``feed_idx``) to the reduced :class:`Service`.

    ``finest``: the finest part asked for, one of stops, routes and times. Distinct departure times are
    nearly as many as departures, so they are neither grouped nor written for the coarser parts.
    """
    if finest not in ("stops", "routes", "times"):
        raise ValueError("finest must be one of: stops, routes, times")
    events = departures(stop_times, trips, active_services(calendar, trips))
    # One pass over the schedule, combined on the map side, so a stop with a third of all departures is
    # no hot spot. It feeds every feature and is written once.
    one = events.withColumns({"n": F.lit(1), "peak": F.col("is_peak").cast("int")})
    reduced = {
        "stops": lambda: cut_lineage(events.select("stop_key").distinct()),
        "routes": lambda: cut_lineage(_route_sums(one)),
        "times": lambda: cut_lineage(one.groupBy("stop_key", "route_key", "departure_min").agg(F.sum("n").alias("n"), F.sum("peak").alias("peak"))),
    }[finest]()
    used = boarding_stops(stops, project).join(reduced.select("stop_key").distinct(), "stop_key", "left_semi")
    places = used.groupBy("px", "py").agg(F.min_by(F.struct("x", "y"), "stop_key").alias("at")).select(
        "px", "py", "at.x", "at.y"
    )
    if finest == "stops":
        return Service(used, places, None, None)
    kinds = routes.select(
        S.feed_key(F.col("feed_idx"), F.col("route_id")).alias("route_key"), "route_type",
        S.route_mode(F.col("route_type")).alias("mode"),
    )
    per_route = reduced if finest == "routes" else _route_sums(reduced)
    by_route = per_route.join(used.select("stop_key", "px", "py"), "stop_key").join(kinds, "route_key", "left")
    by_route = by_route.withColumn("mode", F.coalesce("mode", F.lit("other")))
    if finest == "routes":
        return Service(used, places, by_route, None)
    by_time = reduced.select("stop_key", "departure_min").distinct().join(
        used.select("feed_idx", "stop_key", "px", "py"), "stop_key"
    )
    return Service(used, places, by_route, by_time)


def stops_in_blocks(stops: DataFrame, polygons: DataFrame) -> DataFrame:
    """``(stop_key, px, py, block_id)`` for stops strictly inside a block."""
    return points_in_polygons(stops, polygons.select("block_id", "edges", "minx", "miny", "maxx", "maxy")).select(
        "stop_key", "px", "py", "block_id"
    )


def stop_counts(stop_block: DataFrame) -> DataFrame:
    """Distinct physical stops per block."""
    return stop_block.groupBy("block_id").agg(F.count_distinct("px", "py").cast("double").alias("pt_stop_count"))


def _service_aggregates() -> list[Column]:
    return [
        F.count_distinct("route_key").cast("double").alias("pt_route_count"),
        F.sum("departures").cast("double").alias("pt_weekday_departures"),
        F.sum("peak").cast("double").alias("pt_peak_departures"),
    ]


def block_service(service: Service, stop_block: DataFrame) -> DataFrame:
    """Routes, departures and service hours per block with at least one departure."""
    rows = service.by_route.join(stop_block.select("stop_key", "block_id"), "stop_key")
    return rows.groupBy("block_id").agg(
        *_service_aggregates(),
        F.min("first").alias("pt_first_departure_min"),
        F.max("last").alias("pt_last_departure_min"),
        F.count_distinct("route_type").cast("double").alias("pt_modal_variety"),
    )


def block_service_by_mode(service: Service, stop_block: DataFrame) -> DataFrame:
    """Stops, routes and departures per block, one column set per mode."""
    rows = service.by_route.where(F.col("mode").isin(list(S.MODES))).join(
        stop_block.select("stop_key", "block_id"), "stop_key"
    )
    return rows.groupBy("block_id").pivot("mode", list(S.MODES)).agg(
        F.count_distinct("px", "py").cast("double").alias("stop_count"),
        F.count_distinct("route_key").cast("double").alias("route_count"),
        F.sum("departures").cast("double").alias("weekday_departures"),
        F.sum("peak").cast("double").alias("peak_departures"),
    )


def headways(service: Service, stop_block: DataFrame) -> DataFrame:
    """Gaps between consecutive departures at a physical stop, in (0, 240] minutes.

    Routes are mixed and feeds kept apart. Equal departure times give gaps of zero, which are dropped,
    so only distinct times are ordered: a window holds at most one row per second of the service day.
    """
    times = (
        service.by_time.join(stop_block.select("stop_key", "block_id"), "stop_key")
        .groupBy("feed_idx", "px", "py", "departure_min")
        .agg(F.min("block_id").alias("block_id"))
    )
    order = Window.partitionBy("feed_idx", "px", "py").orderBy("departure_min")
    gap = F.col("departure_min") - F.lag("departure_min").over(order)
    return times.withColumn("headway_min", gap).where((F.col("headway_min") > 0) & (F.col("headway_min") <= MAX_HEADWAY_MIN))


def block_headways(gaps: DataFrame) -> DataFrame:
    """Mean over a block's stops of each stop's median headway."""
    per_stop = gaps.groupBy("block_id", "px", "py").agg(F.median("headway_min").alias("m"))
    return per_stop.groupBy("block_id").agg(F.avg("m").alias("pt_avg_headway_min"))


def place_service(service: Service, by_mode: bool = False) -> DataFrame:
    """Departures, peak departures and routes of each physical stop, overall or per mode."""
    keys = ["px", "py", *(["mode"] if by_mode else [])]
    return service.by_route.groupBy(*keys).agg(
        F.sum("departures").cast("double").alias("departures"),
        F.sum("peak").cast("double").alias("peak"),
        F.count_distinct("route_key").cast("double").alias("routes"),
    )


def place_routes(service: Service) -> DataFrame:
    """Distinct ``(px, py, route_key, mode)``: which routes call at which physical stop."""
    return service.by_route.select("px", "py", "route_key", "mode").distinct()


def route_words(service: Service) -> DataFrame:
    """Routes calling at each physical stop as words of bits: ``x, y, mode, word, bits``.

    Routes of a mode are numbered into words of 64, neighbours by name (so by feed) in the same word. A route of
    several modes has a bit in a negative word of each of them and one in a word of no mode, so words from zero on
    hold every route once.
    """
    calls = place_routes(service).join(service.places, ["px", "py"])
    modes = calls.groupBy("route_key").agg(F.collect_set("mode").alias("modes")).withColumn("shared", F.size("modes") > 1)
    named = modes.select("route_key", "shared", F.explode(F.when(F.col("shared"), F.concat("modes", F.array(F.lit("")))).otherwise(F.col("modes"))).alias("mode"))
    order = Window.partitionBy("mode", "shared").orderBy("route_key")
    number = named.withColumn("number", F.row_number().over(order) - 1)
    word = (F.col("number") / 64).cast("int")
    numbers = number.select(
        "route_key", F.col("mode").alias("named"), F.when(F.col("shared") & (F.col("mode") != ""), -1 - word).otherwise(word).alias("word"), F.expr("shiftleft(1L, number % 64)").alias("bits"))
    met = calls.join(numbers, "route_key").where("named = mode or named = ''")
    return cut_lineage(met.groupBy("x", "y", F.col("named").alias("mode"), "word").agg(F.bit_or("bits").alias("bits")))


def _place_id(df: DataFrame) -> DataFrame:
    return df.withColumn("place", F.struct("px", "py"))


def nearest_stop(origins: DataFrame, service: Service) -> DataFrame:
    """Distance to the nearest stop and its service; zero service beyond 10 km."""
    hit = nearest(origins, "block_id", _place_id(service.places), "place")
    found = hit.select("block_id", "dist", "place.px", "place.py").join(place_service(service), ["px", "py"], "left")

    def near(name: str) -> Column:
        return F.when(F.col("dist") <= NO_STOP_M, F.coalesce(F.col(name), F.lit(0.0))).otherwise(0.0)

    return found.select(
        "block_id",
        F.least("dist", F.lit(NO_STOP_M)).alias("pt_nearest_stop_dist_m"),
        near("departures").alias("pt_nearest_stop_departures"),
        near("peak").alias("pt_nearest_stop_peak_departures"),
        near("routes").alias("pt_nearest_stop_route_count"),
    )


def nearest_stop_by_mode(origins: DataFrame, service: Service) -> DataFrame:
    """Distance to the nearest stop of each mode, at most 10 km."""
    served = place_service(service, by_mode=True).where(F.col("mode").isin(list(S.MODES)) & (F.col("departures") > 0))
    points = _place_id(served.join(service.places, ["px", "py"]))
    asked = origins.select("block_id", "x", "y", F.explode(F.array([F.lit(m) for m in S.MODES])).alias("mode"))
    hit = nearest(asked, "block_id", points, "place", by=["mode"])
    wide = hit.groupBy("block_id").pivot("mode", list(S.MODES)).agg(F.min("dist"))
    return wide.select(
        "block_id",
        *[F.least(F.coalesce(m, F.lit(NO_STOP_M)), F.lit(NO_STOP_M)).alias(f"pt_nearest_{m}_stop_dist_m") for m in S.MODES],
    )


def catchments(origins: DataFrame, service: Service, radii: Sequence[int] = CATCHMENT_M) -> DataFrame:
    """Stops, distinct routes, departures and peak departures within each radius, overall and per mode."""
    groups = ["", *[f"{m}_" for m in S.MODES]]
    all_modes = place_service(service)
    measures = {
        "stops": F.when(F.col("departures") > 0, 1.0).otherwise(0.0),
        "departures": F.col("departures"),
        "peak_departures": F.col("peak"),
    }
    points = service.places.join(
        all_modes.select("px", "py", *[c.alias(n) for n, c in measures.items()]), ["px", "py"], "left"
    )
    per_mode = place_service(service, by_mode=True).groupBy("px", "py").pivot("mode", list(S.MODES)).agg(
        *[F.max(c).alias(n) for n, c in measures.items()]
    )
    points = points.join(per_mode, ["px", "py"], "left").na.fill(0.0)
    names = [f"{g}{n}" for g in groups for n in measures]
    sums = radius_sums(origins, "block_id", points, names, radii, lambda m, r: f"pt_{m}_within_{int(r)}m")

    met = radius_sets(origins, "block_id", route_words(service), ["mode", "word"], "bits", radii, lambda r: f"within_{int(r)}")
    routes = met.groupBy("block_id").agg(*[
        F.sum(F.when(F.col("mode") == g[:-1] if g else F.col("word") >= 0, F.bit_count(f"within_{int(r)}")).otherwise(0)).cast("double").alias(f"pt_{g}routes_within_{r}m")
        for r in sorted(radii) for g in groups
    ])
    out = sums.join(routes, "block_id", "left").na.fill(0.0)
    ratios = {}
    for r in radii:
        stops, deps = F.col(f"pt_stops_within_{r}m"), F.col(f"pt_departures_within_{r}m")
        ratios[f"pt_departures_per_stop_within_{r}m"] = safe_divide(deps, stops, 0.0)
        ratios[f"pt_routes_per_stop_within_{r}m"] = safe_divide(F.col(f"pt_routes_within_{r}m"), stops, 0.0)
        ratios[f"pt_peak_departure_share_within_{r}m"] = safe_divide(F.col(f"pt_peak_departures_within_{r}m"), deps, 0.0)
    return out.withColumns(ratios)


def connected_blocks(service: Service, stop_block: DataFrame) -> DataFrame:
    """Number of other blocks sharing at least one route with each block.

    Blocks are numbered and every route holds its blocks as bitmaps; the union of a block's routes is
    then an OR of bitmaps, done once per distinct set of routes. No pairs of blocks are formed, so a
    route serving most of the blocks costs a few bitmaps instead of a square.
    """
    calls = service.by_route.join(stop_block.select("stop_key", "block_id"), "stop_key").select("block_id", "route_key").distinct()
    sets = cut_lineage(
        calls.groupBy("block_id")
        .agg(F.array_sort(F.collect_set("route_key")).alias("routes"))
        # Numbered in order of id, so blocks of one region share their bitmaps.
        .repartitionByRange("block_id")
        .withColumn("number", F.monotonically_increasing_id() + 1)
    )
    served = (
        sets.select("number", F.explode("routes").alias("route_key"))
        .groupBy("route_key", F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("blocks"))
    )
    kinds = sets.select("routes").distinct().withColumn("route_key", F.explode("routes"))
    reached = (
        kinds.join(served, "route_key")
        .groupBy("routes", "bucket")
        .agg(F.bitmap_or_agg("blocks").alias("blocks"))
        .groupBy("routes")
        .agg((F.sum(F.bitmap_count("blocks")) - 1).cast("double").alias("pt_connected_blocks_same_route"))
    )
    return sets.join(reached, "routes").select("block_id", "pt_connected_blocks_same_route")


def transit_feature_names() -> list[str]:
    """The 163 predictor columns in contract order."""
    names = [
        "pt_stop_count", "pt_stop_density_per_km2", "pt_route_count", "pt_weekday_departures",
        "pt_peak_departures", "pt_offpeak_departures", "pt_peak_departure_share", "pt_departures_per_stop",
        "pt_routes_per_stop", "pt_peak_departures_per_route", "pt_avg_headway_min", "pt_first_departure_min",
        "pt_last_departure_min", "pt_service_span_hours", "pt_modal_variety", "pt_nearest_stop_dist_m",
        "pt_nearest_stop_departures", "pt_nearest_stop_peak_departures", "pt_nearest_stop_route_count",
        "pt_connected_blocks_same_route",
    ]
    for pattern in (
        "pt_has_{m}_service", "pt_{m}_stop_count", "pt_{m}_stop_density_per_km2", "pt_{m}_route_count",
        "pt_{m}_weekday_departures", "pt_{m}_peak_departures", "pt_nearest_{m}_stop_dist_m",
    ):
        names += [pattern.format(m=m) for m in S.MODES]
    for metric in (
        "stops", "routes", "departures", "peak_departures", "departures_per_stop", "routes_per_stop", "peak_departure_share",
    ):
        names += [f"pt_{metric}_within_{r}m" for r in CATCHMENT_M]
    for metric in ("stops", "routes", "departures", "peak_departures"):
        names += [f"pt_{m}_{metric}_within_{r}m" for m in S.MODES for r in CATCHMENT_M]
    return names


def default_value(name: str) -> float:
    """Value of a predictor in a block without any service."""
    if name in {"pt_avg_headway_min", "pt_first_departure_min"}:
        return NO_SERVICE_MIN
    return NO_STOP_M if name.startswith("pt_nearest_") and name.endswith("_dist_m") else 0.0


def derive_block_ratios(df: DataFrame) -> DataFrame:
    """Ratios and densities from the counted columns and ``area_km2``; expects defaults filled in."""
    c = F.col
    out = {
        "pt_stop_density_per_km2": safe_divide(c("pt_stop_count"), c("area_km2"), 0.0),
        "pt_offpeak_departures": c("pt_weekday_departures") - c("pt_peak_departures"),
        "pt_peak_departure_share": safe_divide(c("pt_peak_departures"), c("pt_weekday_departures"), 0.0),
        "pt_departures_per_stop": safe_divide(c("pt_weekday_departures"), c("pt_stop_count"), 0.0),
        "pt_routes_per_stop": safe_divide(c("pt_route_count"), c("pt_stop_count"), 0.0),
        "pt_peak_departures_per_route": safe_divide(c("pt_peak_departures"), c("pt_route_count"), 0.0),
        "pt_service_span_hours": F.greatest(c("pt_last_departure_min") - c("pt_first_departure_min"), F.lit(0.0)) / 60.0,
    }
    for m in S.MODES:
        out[f"pt_has_{m}_service"] = (c(f"pt_{m}_stop_count") > 0).cast("double")
        out[f"pt_{m}_stop_density_per_km2"] = safe_divide(c(f"pt_{m}_stop_count"), c("area_km2"), 0.0)
    return df.withColumns(out)


def build_transit_features(polygons: DataFrame, centroids: DataFrame, service: Service) -> DataFrame:
    """All transit predictors, one row per block.

    ``polygons``: ``block_id, area_km2, edges`` and box columns; ``centroids``: ``block_id, x, y``.
    """
    stop_block = stops_in_blocks(service.stops, polygons)
    by_mode = block_service_by_mode(service, stop_block)
    by_mode = by_mode.withColumnsRenamed({c: f"pt_{c}" for c in by_mode.columns if c != "block_id"})
    parts = [
        stop_counts(stop_block), block_service(service, stop_block), by_mode,
        block_headways(headways(service, stop_block)), connected_blocks(service, stop_block),
        nearest_stop(centroids, service), nearest_stop_by_mode(centroids, service), catchments(centroids, service),
    ]
    out = polygons.select("block_id", "area_km2")
    for part in parts:
        out = out.join(part, "block_id", "left")
    names = transit_feature_names()
    out = out.na.fill({n: default_value(n) for n in names if n in out.columns})
    return derive_block_ratios(out).select("block_id", *names)


def empty_transit_features(block_ids: DataFrame) -> DataFrame:
    """The predictors of blocks in a city without schedules."""
    return block_ids.select("block_id", *[F.lit(default_value(n)).alias(n) for n in transit_feature_names()])


def transit_summary(features: DataFrame) -> DataFrame:
    """Coverage figures of a transit feature table as one row."""
    median = medians(features.withColumn("all_", F.lit(0)), "pt_nearest_stop_dist_m", ["all_"], "m").first()["m"]  # one number
    rail = sum((F.col(f"pt_{m}_stops_within_800m") for m in ("metro", "train")), F.col("pt_tram_stops_within_800m"))
    return features.agg(
        F.sum("pt_stop_count").cast("bigint").alias("n_active_stops_inside_blocks"),
        F.count_if(F.col("pt_stop_count") > 0).alias("n_blocks_with_stops"),
        F.count_if(F.col("pt_weekday_departures") > 0).alias("n_blocks_with_departures"),
        F.lit(median).alias("median_nearest_stop_dist_m"),
        F.count_if(F.col("pt_stops_within_800m") > 0).alias("n_blocks_with_stop_within_800m"),
        F.count_if(F.col("pt_bus_stops_within_800m") > 0).alias("n_blocks_with_bus_stop_within_800m"),
        F.count_if(rail > 0).alias("n_blocks_with_rail_mode_stop_within_800m"),
    )
