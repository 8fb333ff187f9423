"""Graphs as edge tables ``(src, dst, w)`` with both directions stored."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from blockreach.functions import geometry as G
from blockreach.functions.naming import node_id
from blockreach.operators.proximity import nearest
from blockreach.session import cut_lineage, spread

# The walk below travels to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Shared borders: tolerance in metres, grid cell, and bucket sizes of direction and offset.
BORDER_TOLERANCE_M = 1e-4
BORDER_CELL_M = 256.0
DIRECTION_BUCKET = 1e-4
OFFSET_BUCKET_M = 0.05
# Directions are folded into [SEAM, SEAM + pi); the seam avoids the common axis directions.
SEAM = -0.3


def _border_pieces(polygons: DataFrame) -> DataFrame:
    """Ring edges as directed pieces of a supporting line, filed by grid cell.

    ``ahead`` tells whether the ring runs along the folded direction with the interior on its left.
    """
    rings = polygons.select("block_id", F.posexplode("rings").alias("part", "ring"))
    signed = F.aggregate(
        G.line_edges(F.col("ring")),
        F.lit(0.0),
        lambda s, e: s + ((e.x1 - F.col("ring")[0].x) * (e.y2 - F.col("ring")[0].y) - (e.x2 - F.col("ring")[0].x) * (e.y1 - F.col("ring")[0].y)),
    )
    pieces = rings.select(
        "block_id",
        ((signed > 0) == (F.col("part") == 0)).alias("left"),
        F.explode(G.line_edges(F.col("ring"))).alias("e"),
    ).select("block_id", "left", "e.*")
    pieces = pieces.withColumn("a", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    pieces = pieces.withColumn("flip", (F.col("a") < SEAM) | (F.col("a") >= SEAM + F.pi()))
    pieces = pieces.select(
        "block_id",
        (F.col("left") != F.col("flip")).alias("ahead"),
        *[F.when(F.col("flip"), F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"{c}1") for c in ("x", "y")],
        *[F.when(F.col("flip"), F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}2") for c in ("x", "y")],
        F.when(F.col("a") < SEAM, F.col("a") + F.pi()).when(F.col("a") >= SEAM + F.pi(), F.col("a") - F.pi()).otherwise(F.col("a")).alias("a"),
    ).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))

    def cells(c: str) -> Column:
        low = F.floor((F.least(f"{c}1", f"{c}2") - BORDER_TOLERANCE_M) / BORDER_CELL_M)
        high = F.floor((F.greatest(f"{c}1", f"{c}2") + BORDER_TOLERANCE_M) / BORDER_CELL_M)
        return F.explode(F.sequence(low, high))

    filed = pieces.withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    # Offsets from the cell's own corner keep rounding far below the tolerance for any coordinates.
    ux, uy = F.cos("a"), F.sin("a")
    ox, oy = F.col("cx") * BORDER_CELL_M, F.col("cy") * BORDER_CELL_M
    return filed.select(
        "block_id", "ahead", "cx", "cy", "a",
        ((F.col("x1") - ox) * uy - (F.col("y1") - oy) * ux).alias("c"),
        ((F.col("x1") - ox) * ux + (F.col("y1") - oy) * uy).alias("t1"),
        ((F.col("x2") - ox) * ux + (F.col("y2") - oy) * uy).alias("t2"),
    )


def rook_adjacency(polygons: DataFrame) -> DataFrame:
    """Pairs of blocks sharing a border of positive length, stored once as (smaller, larger) id.

    Neighbouring rings run along a shared border in opposite directions, so edges running ahead meet
    only edges running back on the same supporting line, within one grid cell. Corner contacts have
    no common length and drop out. Polygons must not overlap.
    """
    pieces = _border_pieces(spread(polygons.select("block_id", "rings")))
    angle = F.round(F.col("a") / DIRECTION_BUCKET).cast("bigint")
    offset = lambda c: F.floor(c / OFFSET_BUCKET_M)
    ahead = pieces.where("ahead").withColumn("ka", angle).withColumn("kc", offset(F.col("c")))
    # Offsets that match differ by the tolerance at most, so few pieces lie in more than one bucket of it.
    slack = 2 * BORDER_TOLERANCE_M
    back = (
        pieces.where(~F.col("ahead"))
        .withColumn("ka", F.explode(F.sequence(angle - 1, angle + 1)))
        .withColumn("kc", F.explode(F.sequence(offset(F.col("c") - slack), offset(F.col("c") + slack))))
        .select("cx", "cy", "ka", "kc", F.col("block_id").alias("other"), F.col("a").alias("ab"), F.col("c").alias("cb"), F.col("t1").alias("s1"), F.col("t2").alias("s2"))
    )
    reach = F.greatest(F.abs("t1"), F.abs("t2"), F.abs("s1"), F.abs("s2"))
    apart = F.abs(F.col("c") - F.col("cb")) + F.abs(F.col("a") - F.col("ab")) * F.least(reach, F.lit(2 * BORDER_CELL_M))
    common = F.least("t2", "s2") - F.greatest("t1", "s1")
    # Spark sizes exploded arrays as one element, so its size check would broadcast every edge: merge instead.
    met = ahead.join(back.hint("merge"), ["cx", "cy", "ka", "kc"]).where(
        (F.col("block_id") != F.col("other")) & (apart <= BORDER_TOLERANCE_M) & (common > BORDER_TOLERANCE_M)
    )
    return undirected_pairs(met, "block_id", "other")


def undirected_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs as ``src_block_id <= dst_block_id``."""
    return df.select(F.least(a, b).alias("src_block_id"), F.greatest(a, b).alias("dst_block_id")).distinct()


def known_edges(edges: DataFrame, block_ids: DataFrame) -> DataFrame:
    """Edges between two different listed blocks."""
    ids = block_ids.select("block_id").distinct()
    kept = edges.where(F.col("src_block_id") != F.col("dst_block_id"))
    for end in ("src_block_id", "dst_block_id"):
        kept = kept.join(ids.withColumnRenamed("block_id", end), end, "left_semi")
    return kept


def both_directions(edges: DataFrame, *extra: str, src: str = "src_block_id", dst: str = "dst_block_id") -> DataFrame:
    """Each undirected edge as two rows ``(src, dst, extra...)``."""
    forth = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *extra)
    return forth.unionByName(forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *extra))


def undirected_adjacency(edges: DataFrame, block_ids: DataFrame) -> DataFrame:
    """Binary symmetric adjacency over the listed blocks."""
    return both_directions(known_edges(edges, block_ids)).distinct()


def block_graph(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Adjacency weighted by the distance between block points (``block_id, x, y``)."""
    out = edges.select("src_block_id", "dst_block_id")
    for end in ("src", "dst"):
        at = points.select(F.col("block_id").alias(f"{end}_block_id"), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
        out = out.join(at, f"{end}_block_id")
    out = out.withColumn("w", F.hypot(F.col("src_x") - F.col("dst_x"), F.col("src_y") - F.col("dst_y")))
    return both_directions(out, "w")


def road_node(x: Column, y: Column) -> Column:
    """Road node of a vertex: its position in whole millimetres."""
    return F.struct(
        F.round(F.bround(x, 3) * 1000).cast("bigint").alias("mx"),
        F.round(F.bround(y, 3) * 1000).cast("bigint").alias("my"),
    )


def road_graph(lines: DataFrame) -> DataFrame:
    """Edges between consecutive line vertices, parallel edges reduced to the shortest.

    Vertices closer than a millimetre fall together; the length comes from the unrounded positions.
    """
    seg = lines.select(F.explode(G.line_edges(F.col("line"))).alias("e")).select("e.*")
    ends = seg.select(
        road_node(F.col("x1"), F.col("y1")).alias("u"),
        road_node(F.col("x2"), F.col("y2")).alias("v"),
        F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")).alias("w"),
    ).where(F.col("u") != F.col("v"))
    once = ends.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
    return both_directions(once, "w", src="u", dst="v")


def node_points(edges: DataFrame) -> DataFrame:
    """Nodes of a road graph with coordinates in metres."""
    return edges.select(F.col("src").alias("node")).distinct().select(
        "node", (F.col("node.mx") / 1000.0).alias("x"), (F.col("node.my") / 1000.0).alias("y")
    )


def node_degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node (the edge table has no parallel edges)."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def snap(points: DataFrame, point_id: str, nodes: DataFrame) -> DataFrame:
    """Nearest road node of each point: ``(point, node, dist)``."""
    return nearest(points, point_id, nodes, "node")


def attach(points: DataFrame, point_id: str, nodes: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Destinations as values hanging on their road node at the snap distance: ``(node, offset, measures...)``.

    A leaf can never shorten a path, so the graph itself does not grow. Destinations at the same node
    and distance are summed.
    """
    at = snap(points, point_id, nodes)
    return at.join(points.select(point_id, *measures), point_id).groupBy("node", F.col("dist").alias("offset")).agg(
        *[F.sum(m).cast("double").alias(m) for m in measures]
    )


# Origins of a tile that one task walks from; denser tiles are split.
TILE_ORIGINS = 2048
# Distances (start, node) that a walk holds at once.
DISTANCES_HELD = 4_000_000


@dataclass(frozen=True)
class Roads:
    """Links of each node ``i``: ``to`` and ``w`` from ``begin[i]`` up to ``begin[i + 1]``."""

    begin: np.ndarray
    to: np.ndarray
    w: np.ndarray


def spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``low..high`` one after the other, and which range each belongs to (first)."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]


def distances(roads: Roads, starts: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest distances up to ``limit`` from all ``starts`` at once: index of the start, node, distance.

    Pairs (start, node) are settled by bands of distance, all starts together: those of a band relax their
    links until none of them gets shorter, then the next band begins. Every round is a few array steps.
    """
    n = len(roads.begin) - 1
    best = np.full(len(starts) * n, np.inf)
    mark = np.zeros(len(best), np.int32)
    active = np.arange(len(starts)) * n + starts
    best[active] = 0.0
    inside = roads.w[roads.w <= limit]
    band = max(float(np.median(inside)), limit / 1024) if len(inside) else limit
    waiting, top = [np.zeros(0, np.int64)], band

    def once(pairs: np.ndarray) -> np.ndarray:
        number = np.arange(len(pairs), dtype=np.int32)
        mark[pairs] = number
        return pairs[mark[pairs] == number]

    while True:
        while len(active):
            node = active % n
            owner, link = spans(roads.begin[node], roads.begin[node + 1])
            there = (active - node)[owner] + roads.to[link]
            far = best[active][owner] + roads.w[link]
            shorter = (far <= limit) & (far < best[there])
            there, far = there[shorter], far[shorter]
            np.minimum.at(best, there, far)
            there = once(there)
            soon = best[there] < top
            waiting.append(there[~soon])
            active = there[soon]
        # Pairs that got below the band meanwhile are settled.
        left = np.concatenate(waiting)
        left = once(left[best[left] >= top])
        if not len(left):
            break
        top = best[left].min() + band
        soon = best[left] < top
        active, waiting = left[soon], [left[~soon]]
    found = np.flatnonzero(np.isfinite(best))
    return found // n, found % n, best[found]


def reachability_sums(
    edges: DataFrame,
    origins: DataFrame,
    destinations: DataFrame,
    places: DataFrame,
    measures: Sequence[str],
    radii: Sequence[float],
    name,
    origin_id: str = "block_id",
) -> DataFrame:
    """Sums of destination values within network distance ``max(r - origin offset, 0)``, for every r.

    ``origins``: ``origin_id, node, offset``; ``destinations``: ``node, offset, measures...``; ``places``:
    ``node, x, y`` of every node. No edge may be shorter than the straight line between its ends, so
    all paths within the largest radius stay in the tile of an origin and the ring of that width around
    it. Each tile gets its edges and destinations once, dense tiles once per part of their origins, and
    walks from its origins there; only the sums leave.
    """
    limit = float(max(radii))
    count = len(measures)
    # Nodes travel as 64-bit hashes; two of the nodes around one tile would have to collide to matter.
    node = F.xxhash64("node").alias("node")
    at = places.select(node, "x", "y")
    tile = lambda c: F.floor(F.col(c) / limit)
    placed = origins.select(origin_id, node, F.col("offset").cast("double").alias("w")).join(at, "node").select(
        tile("x").alias("tx"), tile("y").alias("ty"), origin_id, F.col("node").alias("a"), "w"
    )
    parts = placed.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / TILE_ORIGINS).cast("int").alias("parts"))

    def around(df: DataFrame) -> DataFrame:
        span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - limit) / limit), F.floor((F.col(c) + limit) / limit)))
        return df.join(at, "node").withColumn("tx", span("x")).withColumn("ty", span("y")).join(parts, ["tx", "ty"]).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        )

    no_values = F.array().cast("array<double>")
    roads = around(edges.where(F.col("w") <= limit).select(F.xxhash64("src").alias("node"), F.xxhash64("dst").alias("b"), F.col("w").cast("double").alias("w")))
    values = around(
        destinations.groupBy("node", "offset").agg(*[F.sum(m).cast("double").alias(m) for m in measures])
        .select(node, F.col("offset").cast("double").alias("w"), F.array(*measures).alias("v"))
    )
    asked = placed.join(parts, ["tx", "ty"]).withColumn("part", F.pmod(F.xxhash64(origin_id, "a"), F.col("parts")).cast("int"))
    key = ["tx", "ty", "part"]
    empty_id = F.lit(None).cast(dict(origins.dtypes)[origin_id]).alias(origin_id)
    rows = (
        asked.select(*key, F.lit(0).alias("kind"), origin_id, "a", F.lit(0).cast("bigint").alias("b"), "w", no_values.alias("v"))
        .unionByName(roads.select(*key, F.lit(1).alias("kind"), empty_id, F.col("node").alias("a"), "b", "w", no_values.alias("v")))
        .unionByName(values.select(*key, F.lit(2).alias("kind"), empty_id, F.col("node").alias("a"), F.lit(0).cast("bigint").alias("b"), "w", "v"))
    )

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        kind = group["kind"].to_numpy()
        starts, links, goods = (group[kind == k] for k in range(3))
        nodes, number = np.unique(np.concatenate([starts["a"], links["a"], links["b"], goods["a"]]), return_inverse=True)
        n0, n1 = len(starts), len(links)
        own, src, dst, held = np.split(number, [n0, n0 + n1, n0 + 2 * n1])
        order, by_node = np.argsort(src, kind="stable"), np.argsort(held, kind="stable")
        roads = Roads(np.searchsorted(src[order], np.arange(len(nodes) + 1)), dst[order], links["w"].to_numpy()[order])
        begin = np.searchsorted(held[by_node], np.arange(len(nodes) + 1))
        offset = goods["w"].to_numpy()[by_node]
        worth = np.array(goods["v"].tolist(), float).reshape(len(goods), count)[by_node]
        reach = np.maximum(np.array(sorted(radii), float)[None, :] - starts["w"].to_numpy()[:, None], 0.0)
        out = np.zeros((n0, count, len(radii)))
        by_start = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, own[by_start][1:] != own[by_start][:-1]])
        bounds, at_once = np.r_[first, n0], max(1, DISTANCES_HELD // len(nodes))
        for low in range(0, len(first), at_once):
            high = min(len(first), low + at_once)
            source, node, far = distances(roads, own[by_start[first[low:high]]], limit)
            # Destinations of every reached node, for every origin that starts at the source.
            entry, at = spans(begin[node], begin[node + 1])
            source, total = source[entry], far[entry] + offset[at]
            again, place = spans(bounds[low:high][source], bounds[low + 1:high + 1][source])
            origin, total, at = by_start[place], total[again], at[again]
            # Index of the smallest radius that reaches an entry; sums then run over the radii.
            ring = (total[:, None] > reach[origin]).sum(axis=1)
            cell = origin * (len(radii) + 1) + ring
            for m in range(count):
                out[:, m] += np.bincount(cell, worth[at, m], n0 * (len(radii) + 1)).reshape(n0, -1)[:, :-1]
        out = np.cumsum(out, axis=2)[:, :, np.argsort(np.argsort(radii, kind="stable"), kind="stable")]
        named = {f"s{m}_{r}": out[:, m, r] for m in range(count) for r in range(len(radii))}
        return pd.DataFrame({origin_id: starts[origin_id].to_numpy()} | named)

    columns = [(f"s{i}_{j}", name(m, r)) for i, m in enumerate(measures) for j, r in enumerate(radii)]
    schema = ", ".join([f"`{origin_id}` {dict(origins.dtypes)[origin_id]}", *[f"{c} double" for c, _ in columns]])
    found = rows.groupBy(*key).applyInPandas(walk, schema)
    return origins.select(origin_id).join(found, origin_id, "left").select(
        origin_id, *[F.coalesce(c, F.lit(0.0)).alias(out) for c, out in columns]
    )


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Component label (its smallest node) of every node: ``(node, component)``.

    Every round hooks trees onto smaller neighbouring labels and halves the trees' depth, so the
    number of rounds grows with the logarithm of the graph's diameter, not with the diameter.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    parent = cut_lineage(nodes.select("node", F.col("node").alias("parent")).distinct())
    while True:
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        seen = parent.join(above, "parent")
        lowest = (
            links.join(seen.select(F.col("node").alias("dst"), "grand"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("grand").alias("low"))
            .join(parent, "node")
        )
        proposals = (
            seen.select("node", F.col("grand").alias("to"))
            .unionByName(lowest.select("node", F.col("low").alias("to")))
            .unionByName(lowest.select(F.col("parent").alias("node"), F.col("low").alias("to")))
        )
        moved = proposals.groupBy("node").agg(F.min("to").alias("to")).join(parent, "node")
        step = cut_lineage(moved.select(
            "node", F.least("to", "parent").alias("parent"), (F.col("to") < F.col("parent")).alias("changed")
        ))
        parent = step.select("node", "parent")
        if step.where("changed").isEmpty():
            return parent.withColumnRenamed("parent", "component")


def component_summary(components: DataFrame, origin_nodes: DataFrame) -> DataFrame:
    """Node and component counts, and the share of origins in the largest component."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component"), F.sum("n").alias("network_n_nodes"), F.count(F.lit(1)).alias("network_n_components"))
    inside = origin_nodes.join(components, "node", "left").join(
        largest.select("component", F.lit(1).alias("in_largest")), "component", "left"
    )
    share = inside.agg(F.avg(F.coalesce("in_largest", F.lit(0))).alias("share_origins_in_largest_component"))
    first = largest.first()  # one row
    return share.select(
        F.lit(first["network_n_nodes"]).cast("bigint").alias("network_n_nodes"),
        F.lit(first["network_n_components"]).cast("bigint").alias("network_n_components"),
        "share_origins_in_largest_component",
    )


def multi_city_graph(edges: DataFrame) -> DataFrame:
    """City edge tables (``city, src, dst, ...``) as one graph whose ids carry the city."""
    rest = [c for c in edges.columns if c not in {"city", "src", "dst"}]
    return edges.select(node_id(F.col("city"), F.col("src")).alias("src"), node_id(F.col("city"), F.col("dst")).alias("dst"), *rest)


def neighbour_mean(edges: DataFrame, features: DataFrame, columns: Sequence[str], self_loops: bool = False, key: str = "node_id") -> DataFrame:
    """Mean of the neighbours' features (row-normalised adjacency times X); isolated nodes get zeros."""
    pairs = edges.select("src", "dst")
    if self_loops:
        own = features.select(F.col(key).alias("src"), F.col(key).alias("dst"))
        pairs = pairs.unionByName(own)
    means = (
        pairs.join(features.select(F.col(key).alias("dst"), *columns), "dst")
        .groupBy(F.col("src").alias(key))
        .agg(*[F.avg(c).alias(c) for c in columns])
    )
    return features.select(key).join(means, key, "left").na.fill(0.0, list(columns))


def symmetric_smooth(edges: DataFrame, features: DataFrame, columns: Sequence[str], key: str = "node_id") -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 times X, with D the degrees including the self loop."""
    degree = edges.groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("k"))
    scaled = features.select(key, *columns).join(degree, key, "left").withColumn(
        "s", 1.0 / F.sqrt(F.coalesce(F.col("k"), F.lit(0)) + 1.0)
    )
    sent = scaled.select(F.col(key).alias("dst"), *[(F.col(c) * F.col("s")).alias(c) for c in columns])
    around = edges.select("src", "dst").unionByName(features.select(F.col(key).alias("src"), F.col(key).alias("dst")))
    total = around.join(sent, "dst").groupBy(F.col("src").alias(key)).agg(*[F.sum(c).alias(c) for c in columns])
    return total.join(scaled.select(key, "s"), key).select(key, *[(F.col(c) * F.col("s")).alias(c) for c in columns])


def khop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` steps of each seed, the seed included: ``(seed, node)``.

    Each hop is written before the next reads it, so plans stay as short as one hop.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    reached = cut_lineage(seeds.select(F.col("node").alias("seed"), "node").distinct())
    frontier = reached
    for _ in range(hops):
        stepped = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(stepped.join(reached, ["seed", "node"], "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


def khop_sizes(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Nodes and undirected induced edges of each seed's neighbourhood."""
    nodes = reached.groupBy("seed").agg(F.count(F.lit(1)).alias("subgraph_nodes"))
    inner = (
        edges.where(F.col("src") < F.col("dst"))
        .join(reached.select("seed", F.col("node").alias("src")), "src")
        .join(reached.select("seed", F.col("node").alias("dst")), ["seed", "dst"], "left_semi")
    )
    counts = inner.groupBy("seed").agg(F.count(F.lit(1)).alias("subgraph_edges"))
    return nodes.join(counts, "seed", "left").na.fill(0, ["subgraph_edges"])
