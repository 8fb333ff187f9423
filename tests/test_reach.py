"""Shortest distances from many starts at once against a heap, one start at a time."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockreach.operators import graph as gr, proximity as px, transit as tr


def by_heap(roads, start, limit):
    best, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        d, u = heapq.heappop(queue)
        if d > best[u]:
            continue
        for e in range(roads.begin[u], roads.begin[u + 1]):
            t, v = d + roads.w[e], int(roads.to[e])
            if t <= limit and t < best.get(v, np.inf):
                best[v] = t
                heapq.heappush(queue, (t, v))
    return best


@pytest.mark.parametrize("nodes, links, limit", [(30, 80, 12.0), (200, 700, 12.0), (400, 300, 3.0), (50, 200, 1e6), (5, 0, 10.0)])
def test_bands_equal_the_heap(nodes, links, limit):
    rng = np.random.default_rng(nodes)
    a, b = rng.integers(0, nodes, links), rng.integers(0, nodes, links)
    w = rng.choice([0.0, 1, 2.5, 7, 30], links) * rng.random(links)
    src, dst, w = np.r_[a, b], np.r_[b, a], np.r_[w, w]
    order = np.argsort(src, kind="stable")
    roads = gr.Roads(np.searchsorted(src[order], np.arange(nodes + 1)), dst[order], w[order])
    starts = rng.choice(nodes, min(nodes, 12), replace=False)
    found = {(int(s), int(v)): d for s, v, d in zip(*gr.distances(roads, starts, limit))}
    assert found == {(k, v): d for k, start in enumerate(starts.tolist()) for v, d in by_heap(roads, start, limit).items()}


def test_origins_that_share_a_node_keep_their_own_offsets(spark):
    edges = spark.createDataFrame([("a", "b", 100.0), ("b", "a", 100.0), ("b", "c", 100.0), ("c", "b", 100.0)], "src string, dst string, w double")
    places = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100.0, 0.0), ("c", 200.0, 0.0)], "node string, x double, y double")
    goods = spark.createDataFrame([("c", 0.0, 5.0), ("a", 10.0, 1.0)], "node string, offset double, jobs double")
    origins = spark.createDataFrame([("near", "a", 0.0), ("far", "a", 75.0), ("alone", "c", 1000.0)], "block_id string, node string, offset double")
    rows = {r.block_id: (r.jobs_300, r.jobs_150) for r in gr.reachability_sums(edges, origins, goods, places, ["jobs"], [300.0, 150.0], lambda m, r: f"{m}_{int(r)}").collect()}
    assert rows == {"near": (6.0, 1.0), "far": (6.0, 1.0), "alone": (5.0, 5.0)}


def test_sets_of_words_equal_counted_labels(spark):
    """Distinct labels within radii, from words of bits and from plain distances, with a crowded spot and shared labels."""
    rng = np.random.default_rng(8)
    spots = [(float(x), float(y), int(n)) for x, y, n in zip(rng.integers(0, 900, 1500), rng.integers(0, 900, 1500), rng.integers(0, 150, 1500))]
    spots += [(450.0, 450.0, n) for n in range(150)] * 3
    points = spark.createDataFrame(spots, "x double, y double, label int").selectExpr("x", "y", "cast(label div 64 as int) word", "shiftleft(1L, label % 64) bits")
    origins = [(f"o{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 900, (40, 2)))] + [("void", 9e5, 9e5)]
    found = px.radius_sets(spark.createDataFrame(origins, "block_id string, x double, y double"), "block_id", points, ["word"], "bits", [200.0, 60.0], lambda r: f"r{int(r)}")
    got = {r.block_id: (r.a, r.b) for r in found.groupBy("block_id").agg(F.sum(F.bit_count("r60")).alias("a"), F.sum(F.bit_count("r200")).alias("b")).collect()}
    for name, x, y in origins:
        want = tuple(len({n for u, v, n in spots if (u - x) ** 2 + (v - y) ** 2 <= r * r}) for r in (60, 200))
        assert got.get(name, (0, 0)) == want


def test_cells_of_points_are_not_broadcast(spark):
    """Their arrays count as one element in the size check, so they reached the driver whole."""
    points = spark.range(600).selectExpr("cast(id % 20 as double) x", "cast(id div 20 as double) y", "cast(id % 3 as int) word", "1L bits")
    tree = px.build_tree(points, ["word"], ["bits"], top_size=30.0, leaf_size=4, combine=F.bit_or)
    groups = spark.createDataFrame([(i, i % 3, 2.0, 2.0, 9.0, 9.0) for i in range(6)], "gid long, word int, ominx double, ominy double, omaxx double, omaxy double")
    plans = [met._jdf.queryExecution().executedPlan().toString() for met in px._group_levels(groups, tree, [5.0, 30.0])]
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans) and "Broadcast" not in tree.nodes._jdf.queryExecution().executedPlan().toString()


def test_a_route_of_two_modes_counts_once(spark):
    calls = [("s1", 0.0, 0.0, "r1", "bus"), ("s1", 0.0, 0.0, "r1", "tram"), ("s2", 50.0, 0.0, "r2", "bus"), ("s2", 50.0, 0.0, "r1", "bus")]
    by_route = spark.createDataFrame([(*c, 3, 1, 5.0, 9.0) for c in calls], "stop_key string, px double, py double, route_key string, mode string, departures long, peak long, first double, last double")
    places = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (50.0, 0.0, 50.0, 0.0)], "px double, py double, x double, y double")
    origins = spark.createDataFrame([("a", 10.0, 0.0), ("far", 9000.0, 0.0)], "block_id string, x double, y double")
    rows = {r.block_id: r for r in tr.catchments(origins, tr.Service(places, places, by_route, None), [20, 100]).collect()}
    a = rows["a"]
    assert (a.pt_routes_within_20m, a.pt_bus_routes_within_20m, a.pt_tram_routes_within_20m) == (1.0, 1.0, 1.0)
    assert (a.pt_routes_within_100m, a.pt_bus_routes_within_100m, a.pt_tram_routes_within_100m) == (2.0, 2.0, 1.0)
    assert rows["far"].pt_routes_within_100m == 0.0
