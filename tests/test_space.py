"""Geometry, distance joins and graphs against arithmetic and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from blockreach.functions import geometry as G, projection as P
from blockreach.operators import built_env as be, graph as gr, overlay as ov, proximity as px
from blockreach.operators.proximity import build_tree, nearest, radius_sums
from blockreach.plans import carriers as C

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [dict(x=float(x), y=float(y)) for x, y in (*points, points[0])]


def square(x, y, s=1.0):
    return ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))


def blocks(spark, rows):
    return spark.createDataFrame(rows, f"block_id string, rings {RINGS}")


def test_overlap_area_of_mixed_shapes(spark):
    hole = [square(0, 0, 4), ring((1, 1), (1, 2), (2, 2), (2, 1))]
    rows = [
        ("offset", [ring((0, 0), (2, 0), (2, 1), (0, 1))], [square(1, 0, 2)], 1.0),
        ("touching", [square(0, 0)], [square(1, 0)], 0.0),
        ("equal", [square(0, 0)], [square(0, 0)], 1.0),
        ("hole", hole, [square(0, 0, 4)], 15.0),
        ("inside hole", hole, [square(1, 1)], 0.0),
        ("triangle", [ring((0, 0), (4, 0), (0, 4))], [square(0, 0, 3)], 7.0),
        ("concave", [ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3))], [square(0, 0, 2)], 3.0),
    ]
    df = spark.createDataFrame(rows, f"name string, a {RINGS}, b {RINGS}, want double")
    df = df.withColumns({"ea": G.ring_edges(F.col("a")), "eb": G.ring_edges(F.col("b"))})
    for row in df.select("name", "want", G.overlap_area(F.col("ea"), F.col("eb")).alias("ab"), G.overlap_area(F.col("eb"), F.col("ea")).alias("ba")).collect():
        assert row.ab == pytest.approx(row.want, abs=1e-9), row.name
        assert row.ba == pytest.approx(row.want, abs=1e-9), row.name


def test_interior_point_lies_inside(spark):
    df = blocks(spark, [("u", [ring((0, 0), (5, 0), (5, 5), (4, 5), (4, 1), (1, 1), (1, 5), (0, 5))]), ("sq", [square(0, 0)])])
    out = ov.with_edges(df).withColumn("p", ov.once(G.interior_point(F.col("edges"))))
    assert all(r[0] for r in out.select(G.contains_point(F.col("edges"), F.col("p.x"), F.col("p.y"))).collect())


def test_border_points_are_outside_and_border_lines_count_for_both(spark):
    two = ov.with_edges(blocks(spark, [("a", [square(0, 0)]), ("b", [square(1, 0)])]))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 0.0, 0.0)], "id int, x double, y double")
    assert [(r.id, r.block_id) for r in ov.points_in_polygons(points, two).collect()] == [(1, "a")]
    line = spark.createDataFrame([([dict(x=1.0, y=0.0), dict(x=1.0, y=1.0)],)], "line array<struct<x:double,y:double>>")
    assert {r.block_id: r.length_m for r in ov.clip_lines(line, two).collect()} == {"a": 1.0, "b": 1.0}


def test_adjacency_needs_a_common_side(spark):
    edges = gr.rook_adjacency(blocks(spark, [("a", [square(0, 0)]), ("b", [square(1, 0)]), ("c", [square(1, 1)])]))
    assert sorted(map(tuple, edges.collect())) == [("a", "b"), ("b", "c")]


def test_adjacency_of_slanted_t_junctions(spark):
    turn = lambda x, y: (3e5 + x * math.cos(0.7) - y * math.sin(0.7), 4e6 + x * math.sin(0.7) + y * math.cos(0.7))
    rect = lambda x0, y0, x1, y1: ring(*[turn(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    shapes = [("long", [rect(0, 0, 900, 50)]), ("left", [rect(0, 50, 300, 90)]), ("mid", [rect(300, 50, 333, 90)]), ("right", [rect(333, 50, 900, 90)]), ("far", [rect(900, 90, 950, 120)])]
    edges = gr.rook_adjacency(blocks(spark, shapes))
    assert sorted(map(tuple, edges.collect())) == [("left", "long"), ("left", "mid"), ("long", "mid"), ("long", "right"), ("mid", "right")]


def test_place_selection(spark):
    df = blocks(spark, [("inside", [square(0, 0)]), ("outside", [square(2, 2)])])
    circle = ring(*[(0.5 + 0.75 * math.cos(k * math.pi / 16), 0.5 + 0.75 * math.sin(k * math.pi / 16)) for k in range(32)])
    place = ov.with_edges(spark.createDataFrame([([circle],)], f"rings {RINGS}"))
    for mode in ("representative_point", "intersects", "intersection"):
        assert [r.block_id for r in ov.select_by_place(ov.with_edges(df), place, mode).collect()] == ["inside"]


def test_utm_round_trip_is_below_a_millimetre(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.uniform(-179, 179), rng.uniform(-80, 80)) for _ in range(200)], "lon double, lat double")
    df = df.withColumn("e", P.utm_epsg(F.col("lon"), F.col("lat"))).withColumn("m", P.to_utm(F.col("lon"), F.col("lat"), F.col("e")))
    df = df.withColumn("g", P.from_utm(F.col("m.x"), F.col("m.y"), F.col("e")))
    worst = df.agg(F.max(F.greatest(F.abs(F.col("g.lon") - F.col("lon")), F.abs(F.col("g.lat") - F.col("lat"))))).first()[0]
    assert worst * 111_000 < 1e-3


def skewed_points(n, seed):
    """A third of the points in one spot of 40 m, some exact copies, the rest spread out."""
    rng = random.Random(seed)
    hot = [(rng.uniform(2000, 2040), rng.uniform(1000, 1040)) for _ in range(n // 3)]
    wide = [(rng.uniform(0, 12000), rng.uniform(0, 9000)) for _ in range(n - n // 3 - 20)]
    return hot + wide + [(5000.0, 5000.0)] * 20


def test_radius_sums_and_nearest_match_brute_force_on_skewed_points(spark):
    dest, orig = skewed_points(1500, 3), skewed_points(150, 4)
    points = spark.createDataFrame([(i, x, y, float(i % 7)) for i, (x, y) in enumerate(dest)], "pid0 int, x double, y double, jobs double")
    origins = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(orig)], "oid int, x double, y double")
    radii = [300.0, 1000.0, 2500.0]
    assert build_tree(points, (), ["jobs"], 2500.0).depth >= 2
    got = {r.oid: r for r in radius_sums(origins, "oid", points, ["jobs"], radii, lambda m, r: f"s{int(r)}").collect()}
    near = {r.oid: r for r in nearest(origins, "oid", points, "pid0").collect()}
    assert len(got) == len(near) == len(orig)
    for i, (x, y) in enumerate(orig):
        d = [math.dist((x, y), p) for p in dest]
        for r in radii:
            assert got[i][f"s{int(r)}"] == pytest.approx(sum(k % 7 for k in range(len(dest)) if d[k] <= r))
        best = min(range(len(dest)), key=lambda k: (d[k], k))
        assert near[i].dist == pytest.approx(d[best]) and near[i].pid0 == best


def test_source_offset_shortens_the_radius(spark):
    edges = spark.createDataFrame([(0, 1, 100.0), (1, 0, 100.0), (1, 2, 100.0), (2, 1, 100.0)], "src int, dst int, w double")
    origins = spark.createDataFrame([("o", 0, 75.0), ("on", 2, 400.0)], "block_id string, node int, offset double")
    values = spark.createDataFrame([(2, 0.0, 5.0)], "node int, offset double, jobs double")
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0), (2, 200.0, 0.0)], "node int, x double, y double")
    got = {r.block_id: r for r in gr.reachability_sums(edges, origins, values, places, ["jobs"], [150.0, 300.0], lambda m, r: f"r{int(r)}").collect()}
    assert (got["o"].r150, got["o"].r300) == (0.0, 5.0)
    # An offset beyond every radius still reaches values at the node itself.
    assert (got["on"].r150, got["on"].r300) == (5.0, 5.0)


def test_reachability_sums_match_dijkstra(spark, monkeypatch):
    import heapq

    monkeypatch.setattr(gr, "TILE_ORIGINS", 9)
    rng = random.Random(5)
    xy = [(rng.uniform(0, 1500), rng.uniform(0, 900)) for _ in range(120)]
    links = {}
    for a in range(120):
        for b in sorted(range(120), key=lambda k: math.dist(xy[a], xy[k]))[1:5]:
            links[(min(a, b), max(a, b))] = math.dist(xy[a], xy[b]) * rng.uniform(1, 1.6)
    both = [(a, b, w) for (a, b), w in links.items()] + [(b, a, w) for (a, b), w in links.items()]
    edges = spark.createDataFrame(both, "src int, dst int, w double")
    places = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(xy)], "node int, x double, y double")
    values = [(rng.randrange(120), rng.uniform(0, 30), float(rng.randint(1, 9))) for _ in range(90)]
    asked = [(f"o{i}", rng.randrange(120), rng.uniform(0, 40)) for i in range(70)]
    radii = [150.0, 350.0]
    out = gr.reachability_sums(
        edges, spark.createDataFrame(asked, "block_id string, node int, offset double"),
        spark.createDataFrame(values, "node int, offset double, jobs double"), places, ["jobs"], radii, lambda m, r: f"r{int(r)}")
    got = {r.block_id: (r.r150, r.r350) for r in out.collect()}
    assert len(got) == len(asked)
    for name, start, own in asked:
        best, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            for a, b, w in both:
                if a == u and d + w < best.get(b, math.inf):
                    best[b] = d + w
                    heapq.heappush(heap, (d + w, b))
        want = tuple(sum(v for n, o, v in values if best.get(n, math.inf) + o <= max(r - own, 0)) for r in radii)
        assert got[name] == pytest.approx(want)



def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + k) for k in range(1, 60)]
    pairs = spark.createDataFrame(path + star, "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in [*range(201), *range(1000, 1060), 5000]], "node int")
    labels = gr.connected_components(gr.both_directions(pairs, src="src", dst="dst"), nodes)
    counts = {r.component: r["count"] for r in labels.groupBy("component").count().collect()}
    assert counts == {0: 201, 1000: 60, 5000: 1}


def test_unknown_block_edges_are_ignored(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "missing"), ("a", "a")], "src_block_id string, dst_block_id string")
    ids = spark.createDataFrame([("a",), ("b",)], "block_id string")
    assert sorted(map(tuple, gr.undirected_adjacency(edges, ids).collect())) == [("a", "b"), ("b", "a")]


def test_built_feature_contract():
    assert len(be.built_feature_names()) == len(set(be.built_feature_names())) == 35


def test_one_large_shape_is_dealt_to_many_keys(spark):

    blocks = spark.range(40_000).select(F.col("id").cast("string").alias("block_id"), (F.col("id") % 200 * 100.0).alias("x"), (F.floor(F.col("id") / 200) * 100.0).alias("y"))
    blocks = blocks.withColumns({"minx": F.col("x"), "maxx": F.col("x") + 100, "miny": F.col("y"), "maxy": F.col("y") + 100})
    place = spark.createDataFrame([(0.0, 0.0, 19_900.0, 19_900.0)], "minx_r double, miny_r double, maxx_r double, maxy_r double")
    left = ov._filed(blocks.withColumn("own", ov._size_class()), F.array(F.lit(15)))
    keys = left.withColumn("copy", F.pmod(F.xxhash64("minx", "miny", "maxx", "maxy"), ov._copies([7], {15: 1}))).groupBy("level", "cx", "cy", "copy").count()
    sizes = [r["count"] for r in keys.collect()]
    assert len(sizes) >= 64 and max(sizes) < 1000
    assert ov.box_pairs(blocks.select("block_id", *ov.BOX), place.withColumnsRenamed({f"{b}_r": b for b in ov.BOX})).select("block_id").distinct().count() == 40_000


def test_leaves_stay_bounded_on_crowded_points(spark):
    points = spark.createDataFrame([(float(i) * 1e-6, 0.0, 1.0) for i in range(300)] + [(1e6, 1e6, 1.0)], "x double, y double, jobs double")
    tree = build_tree(points, (), ["jobs"])
    assert tree.depth > 10
    assert tree.nodes.where("leaf").select(F.max(F.size("pts"))).first()[0] <= 128


def test_table_zone_weighs_by_area(spark):
    from blockreach.operators.backbone import table_utm_zone

    def triangle(x, y, side):
        return [[(x, y), (x + side, y), (x, y + side), (x, y)]]

    rows = [("a", triangle(5.0, 10.0, 0.5)), ("a", triangle(6.9, 10.0, 2.0)), ("b", triangle(5.0, -10.0, 0.5))]
    df = spark.createDataFrame(rows, "city string, rings array<array<struct<x:double,y:double>>>")
    # The large triangle's centroid (7.57) outweighs the small one's (5.17): zone 32.
    assert {r["city"]: r["epsg"] for r in table_utm_zone(df, ["city"]).collect()} == {"a": 32632, "b": 32731}


def test_cell_joins_never_broadcast_a_layer(spark):
    """Exploded cells are far more bytes than Spark's size check expects, so no side may be broadcast."""
    blocks = ov.with_edges(C.grid_blocks(spark, "/root/testdata/sf0.001"))
    points = spark.range(100).select("id", (F.col("id") * 7.0).alias("x"), (F.col("id") * 3.0).alias("y"))
    plots = blocks.select(F.col("block_id").alias("other"), "edges", *ov.BOX)
    for joined in (gr.rook_adjacency(blocks), ov.points_in_polygons(points, blocks), ov.overlap_polygons(blocks, plots)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_rows_are_dealt_out_before_they_fan_out(spark):
    """One input file split must not cut all borders or file all shapes alone."""
    blocks = ov.with_edges(C.grid_blocks(spark, "/root/testdata/sf0.001").coalesce(1))
    for joined in (gr.rook_adjacency(blocks), ov.box_pairs(blocks.select("block_id", *ov.BOX), blocks.select("edges", *ov.BOX))):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("RoundRobinPartitioning") == 2


def test_radius_sums_open_cells_by_groups_of_origins(spark, monkeypatch):
    """Groups of any size give the sums of brute force; no row per origin and cell is made."""
    rng = random.Random(11)
    spots = [(i, rng.gauss(0, 40), rng.gauss(0, 40), float(rng.randint(1, 9))) for i in range(400)]
    spots += [(400 + i, 20.0, 20.0, 1.0) for i in range(50)] + [(450, 5.0, 5.0, None)]
    asked = [(i, rng.gauss(0, 60), rng.gauss(0, 60)) for i in range(300)] + [(300, 20.0, 20.0), (301, 20.0, 20.0), (302, None, 1.0), (303, 9e5, 9e5)]
    points = spark.createDataFrame(spots, "pid long, x double, y double, v double")
    origins = spark.createDataFrame(asked, "id long, x double, y double")
    monkeypatch.setattr(px, "GROUP_POSITIONS", 64)
    rows_of_cells = []
    levels = px._group_levels
    monkeypatch.setattr(px, "_group_levels", lambda *a: (rows_of_cells.append(m.count()) or m for m in levels(*a)))
    got = {r["id"]: (r["v_10"], r["v_50"]) for r in radius_sums(origins, "id", points, ["v"], [10.0, 50.0], lambda m, r: f"{m}_{int(r)}").collect()}
    assert len(got) == len(asked)
    for i, x, y in asked:
        want = [0.0 if x is None else sum(w or 0.0 for _, a, b, w in spots if (a - x) ** 2 + (b - y) ** 2 <= r * r) for r in (10.0, 50.0)]
        assert got[i] == pytest.approx(want)
    assert sum(rows_of_cells) < 2 * len(asked)


def test_nearest_opens_cells_by_groups_of_origins(spark, monkeypatch):
    """Keys, ties, copies, missing positions and groups of several origins against brute force."""
    rng = random.Random(12)
    spots = [(f"p{i:03d}", "ab"[i % 2], float(rng.randint(0, 40)), float(rng.randint(0, 40))) for i in range(200)]
    asked = [(i, "abc"[i % 3], float(rng.randint(-5, 45)), float(rng.randint(-5, 45))) for i in range(150)] + [(150, "a", None, 1.0)]
    points = spark.createDataFrame(spots, "pid string, k string, x double, y double")
    origins = spark.createDataFrame(asked, "id long, k string, x double, y double")
    monkeypatch.setattr(px, "NEAREST_GROUP", 8)
    got = {r["id"]: (r["k"], r["pid"], r["dist"]) for r in nearest(origins, "id", points, "pid", ["k"]).collect()}
    want = {}
    for i, k, x, y in asked:
        if x is not None and k != "c":
            d2, pid = min(((a - x) ** 2 + (b - y) ** 2, p) for p, q, a, b in spots if q == k)
            want[i] = (k, pid, math.sqrt(d2))
    assert got == want
    assert nearest(origins, "id", points.limit(0), "pid", ["k"]).count() == 0
    assert nearest(origins.drop("k"), "id", points.drop("k").limit(0), "pid").count() == 0


def test_place_of_few_parts_sees_blocks_once_and_moves_none(spark):
    """Holes, several parts, blocks around a part and none at all; the ways for small and large places agree."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rng = random.Random(5)
    shapes = [(f"s{i:03d}", [square(i % 20, i // 20)]) for i in range(200)]
    for i in range(60):
        x, y, turn = rng.uniform(-1, 20), rng.uniform(-1, 10), rng.uniform(0, 1)
        shapes.append((f"t{i:02d}", [ring(*[(x + 0.8 * math.cos(turn + a), y + 0.8 * math.sin(turn + a)) for a in (0, 2, 4)])]))
    shapes.append(("around", [square(14, 1, 5)]))
    shapes.append(("holed", [square(3, 0.5, 4), ring((4, 1), (4, 4), (6, 4), (6, 1))]))
    table = blocks(spark, shapes)
    table = ov.with_edges(table.mapInArrow(seen, table.schema))
    large = [ring((0, 0), (12, 0), (0, 9)), ring((1.5, 1.5), (1.5, 4), (3.5, 4), (3.5, 1.5))]
    place = ov.with_edges(spark.createDataFrame([(large,), ([square(15, 2, 3)],), ([square(30, 30)],)], f"rings {RINGS}"))
    for mode in ("intersection", "representative_point", "intersects"):
        for parts, held in ((place, 3), (place.limit(0), 0)):
            reads.value = 0
            small = ov.select_by_place(table, parts, mode)
            plan = small._jdf.queryExecution().optimizedPlan().toString()
            assert "RepartitionBy" not in plan and "LeftSemi" not in plan and small.columns[:2] == ["block_id", "rings"]
            got = {r["block_id"]: r for r in small.collect()}
            assert reads.value == len(shapes), mode
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(ov, "PLACE_PARTS", -1)
                filed = {r["block_id"]: r for r in ov.select_by_place(table, parts, mode).select(small.columns).collect()}
            assert got.keys() == filed.keys() and (len(got) > 50 if held else not got), mode
            if mode == "intersection":
                assert {k: r.clipped_area_m2 for k, r in got.items()} == pytest.approx({k: r.clipped_area_m2 for k, r in filed.items()})
    whole = table.crossJoin(place.select(F.col("edges").alias("other")))
    want = whole.groupBy("block_id").agg(F.sum(G.overlap_area(F.col("edges"), F.col("other"))).alias("a")).where("a > 0")
    cut = {r.block_id: r.clipped_area_m2 for r in ov.select_by_place(table, place, "intersection").collect()}
    assert cut == pytest.approx({r.block_id: r.a for r in want.collect()})
    assert cut["around"] == pytest.approx(9.0)
