"""Polygon and segment expressions over nested arrays.

A polygon is ``rings: array<array<struct<x,y>>>`` with the first vertex repeated last. Most kernels
take ``edges``, the flat ``array<struct<x1,y1,x2,y2>>`` of all ring edges (:func:`ring_edges`), so a
table prepares it once per row and every later test is a short pass over one array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Distance in metres under which a point counts as lying on an edge.
ON_EDGE_M = 1e-6


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(items: Column, combine) -> Column:
    """``combine`` over consecutive items of an array."""

    def zipped(them: Column) -> Column:
        n = F.size(them)
        short = F.greatest(n - 1, F.lit(0))
        return F.zip_with(F.slice(them, 1, short), F.slice(them, F.least(F.lit(2), n + 1), short), combine)

    return _bind(items, zipped)


def line_edges(points: Column) -> Column:
    """Consecutive vertex pairs of a line or ring."""
    return _pairs(
        points,
        lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")),
    )


def ring_edges(rings: Column) -> Column:
    """All edges of all rings."""
    return F.flatten(F.transform(rings, line_edges))


def _ring_area(ring: Column) -> Column:
    """Unsigned shoelace area of one ring, taken from its first vertex for numerical stability."""
    x0, y0 = ring[0].x, ring[0].y
    twice = F.aggregate(
        line_edges(ring),
        F.lit(0.0),
        lambda s, e: s + ((e.x1 - x0) * (e.y2 - y0) - (e.x2 - x0) * (e.y1 - y0)),
    )
    return F.abs(twice) / 2.0


def polygon_area(rings: Column) -> Column:
    """Shell area minus hole areas."""
    areas = F.transform(rings, _ring_area)
    return 2.0 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)


def polygon_moments(rings: Column) -> Column:
    """Struct ``area, mx, my``: the area and its first moments, so sums over polygons give the centroid of their union."""
    def of_ring(ring: Column, part: Column) -> Column:
        x0, y0 = ring[0].x, ring[0].y
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def add(s: Column, e: Column) -> Column:
            twice = (e.x1 - x0) * (e.y2 - y0) - (e.x2 - x0) * (e.y1 - y0)
            # A triangle from the first vertex: its centroid is the mean of its corners.
            return F.struct(
                (s.a + twice / 2).alias("a"), (s.x + twice / 2 * (x0 + e.x1 + e.x2) / 3).alias("x"), (s.y + twice / 2 * (y0 + e.y1 + e.y2) / 3).alias("y")
            )

        def oriented(s: Column) -> Column:
            sign = F.when(s.a < 0, -1.0).otherwise(1.0) * F.when(part == 0, 1.0).otherwise(-1.0)
            return F.struct((s.a * sign).alias("a"), (s.x * sign).alias("x"), (s.y * sign).alias("y"))

        return F.aggregate(line_edges(ring), zero, add, oriented)

    def total(parts: Column) -> Column:
        summed = lambda name: F.aggregate(parts, F.lit(0.0), lambda s, p: s + p[name])
        return F.struct(summed("a").alias("area"), summed("x").alias("mx"), summed("y").alias("my"))

    return _bind(F.transform(rings, of_ring), total)


def polygon_perimeter(edges: Column) -> Column:
    """Length of all rings."""
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + F.hypot(e.x2 - e.x1, e.y2 - e.y1))


def compactness(area: Column, perimeter: Column) -> Column:
    """4·pi·area / perimeter², zero without a perimeter."""
    return F.coalesce(F.try_divide(4 * math.pi * area, perimeter * perimeter), F.lit(0.0))


def bounds(edges: Column) -> Column:
    """Bounding box of an edge array (rings are closed, so start vertices suffice)."""
    return F.struct(
        F.array_min(F.transform(edges, lambda e: e.x1)).alias("minx"),
        F.array_min(F.transform(edges, lambda e: e.y1)).alias("miny"),
        F.array_max(F.transform(edges, lambda e: e.x1)).alias("maxx"),
        F.array_max(F.transform(edges, lambda e: e.y1)).alias("maxy"),
    )


def _side(e: Column, x: Column, y: Column) -> Column:
    return (e.x2 - e.x1) * (y - e.y1) - (x - e.x1) * (e.y2 - e.y1)


def _touches_edge(e: Column, x: Column, y: Column) -> Column:
    length2 = (e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)
    side = _side(e, x, y)
    return (
        (x >= F.least(e.x1, e.x2) - ON_EDGE_M)
        & (x <= F.greatest(e.x1, e.x2) + ON_EDGE_M)
        & (y >= F.least(e.y1, e.y2) - ON_EDGE_M)
        & (y <= F.greatest(e.y1, e.y2) + ON_EDGE_M)
        & (side * side <= length2 * (ON_EDGE_M * ON_EDGE_M))
    )


def _odd_crossings(edges: Column, x: Column, y: Column) -> Column:
    hits = F.filter(
        edges,
        lambda e: ((e.y1 > y) != (e.y2 > y)) & ((_side(e, x, y) > 0) == (e.y2 > e.y1)),
    )
    return F.size(hits) % 2 == 1


def on_boundary(edges: Column, x: Column, y: Column) -> Column:
    """True when the point lies on an edge."""
    return F.exists(edges, lambda e: _touches_edge(e, x, y))


def contains_point(edges: Column, x: Column, y: Column) -> Column:
    """Point strictly inside; boundary points are outside."""
    return _odd_crossings(edges, x, y) & ~on_boundary(edges, x, y)


def covers_point(edges: Column, x: Column, y: Column) -> Column:
    """Point inside or on the boundary."""
    return _odd_crossings(edges, x, y) | on_boundary(edges, x, y)


def _cuts(seg: Column, edges: Column) -> Column:
    """Sorted parameters in [0, 1] where a segment meets the edges, with both ends."""
    dx, dy = seg.x2 - seg.x1, seg.y2 - seg.y1
    length2 = dx * dx + dy * dy

    def meet(e: Column) -> Column:
        ex, ey = e.x2 - e.x1, e.y2 - e.y1
        fx, fy = e.x1 - seg.x1, e.y1 - seg.y1
        den = dx * ey - dy * ex
        t = F.try_divide(fx * ey - fy * ex, den)
        u = F.try_divide(fx * dy - fy * dx, den)
        crossing = F.when((u >= -1e-12) & (u <= 1 + 1e-12), F.array(t)).otherwise(F.array().cast("array<double>"))
        gap = fx * dy - fy * dx
        start = F.try_divide(fx * dx + fy * dy, length2)
        end = F.try_divide((e.x2 - seg.x1) * dx + (e.y2 - seg.y1) * dy, length2)
        along = F.when(gap * gap <= length2 * (ON_EDGE_M * ON_EDGE_M), F.array(start, end)).otherwise(
            F.array().cast("array<double>")
        )
        return F.when(den == 0, along).otherwise(crossing)

    inner = F.filter(F.flatten(F.transform(edges, meet)), lambda t: (t > 0) & (t < 1))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))


def _spans(seg: Column, edges: Column) -> Column:
    return _pairs(_cuts(seg, edges), lambda a, b: F.struct(a.alias("t1"), b.alias("t2")))


def clipped_length(seg: Column, edges: Column) -> Column:
    """Length of a segment inside a polygon; a piece on the border counts, as in a closed overlay."""
    length = F.hypot(seg.x2 - seg.x1, seg.y2 - seg.y1)

    def inside(span: Column) -> Column:
        mid = (span.t1 + span.t2) / 2
        x, y = seg.x1 + mid * (seg.x2 - seg.x1), seg.y1 + mid * (seg.y2 - seg.y1)
        return _bind(F.struct(x.alias("x"), y.alias("y")), lambda p: covers_point(edges, p.x, p.y))

    kept = F.filter(_spans(seg, edges), inside)
    return length * F.aggregate(kept, F.lit(0.0), lambda s, p: s + (p.t2 - p.t1))


def _boundary_sum(own: Column, other: Column, x0: Column, y0: Column, shared: bool) -> Column:
    """Twice the signed area swept by the parts of ``own`` edges inside ``other``.

    With ``shared``, parts lying on a common border are included where both run the same way.
    """

    def swept(e: Column) -> Column:
        dx, dy = e.x2 - e.x1, e.y2 - e.y1

        def keep(span: Column) -> Column:
            mid = (span.t1 + span.t2) / 2
            spot = F.struct((e.x1 + mid * dx).alias("x"), (e.y1 + mid * dy).alias("y"))
            return _bind(spot, lambda p: inside_or_along(p.x, p.y))

        def inside_or_along(x: Column, y: Column) -> Column:
            inside = contains_point(other, x, y)
            if not shared:
                return inside
            return inside | F.exists(other, lambda o: _touches_edge(o, x, y) & runs_along(o))

        def runs_along(o: Column) -> Column:
            ox, oy = o.x2 - o.x1, o.y2 - o.y1
            small = 1e-9 * (F.abs(dx) + F.abs(dy)) * (F.abs(ox) + F.abs(oy))
            return (ox * dx + oy * dy > 0) & (F.abs(ox * dy - oy * dx) <= small)

        kept = F.filter(_spans(e, other), keep)
        cross = (e.x1 - x0) * dy - (e.y1 - y0) * dx
        return cross * F.aggregate(kept, F.lit(0.0), lambda s, p: s + (p.t2 - p.t1))

    return F.aggregate(F.transform(own, swept), F.lit(0.0), lambda s, v: s + v)


def overlap_area(edges_a: Column, edges_b: Column) -> Column:
    """Area of the intersection of two polygons (shells counter-clockwise, holes clockwise).

    Green's theorem over the border of the intersection: the parts of A's border inside B, the parts
    of B's border inside A, and parts common to both that run the same way, counted once.
    """
    x0, y0 = edges_a[0].x1, edges_a[0].y1
    twice = _boundary_sum(edges_a, edges_b, x0, y0, True) + _boundary_sum(edges_b, edges_a, x0, y0, False)
    return F.greatest(twice / 2.0, F.lit(0.0))


def edges_area(edges: Column) -> Column:
    """Area inside an edge array (shells counter-clockwise, holes clockwise)."""
    x0, y0 = edges[0].x1, edges[0].y1
    twice = F.aggregate(edges, F.lit(0.0), lambda s, e: s + ((e.x1 - x0) * (e.y2 - y0) - (e.x2 - x0) * (e.y1 - y0)))
    return F.greatest(twice / 2.0, F.lit(0.0))


# Boxes are grown by so much in metres before they count as clear of an edge.
CLEAR_M = 1e-3


def box_touched(edges: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """True when an edge runs through a box or within a millimetre of it."""
    x, y = (minx + maxx) / 2, (miny + maxy) / 2
    half_x, half_y = (maxx - minx) / 2 + CLEAR_M, (maxy - miny) / 2 + CLEAR_M
    return F.exists(
        edges,
        lambda e: (F.abs(e.x1 + e.x2 - 2 * x) <= F.abs(e.x2 - e.x1) + 2 * half_x)
        & (F.abs(e.y1 + e.y2 - 2 * y) <= F.abs(e.y2 - e.y1) + 2 * half_y)
        & (F.abs(_side(e, x, y)) <= F.abs(e.x2 - e.x1) * half_y + F.abs(e.y2 - e.y1) * half_x),
    )


def clipped_area(edges: Column, minx: Column, miny: Column, maxx: Column, maxy: Column, other: Column) -> Column:
    """:func:`overlap_area` of a polygon and its box with ``other``.

    Only a box that ``other``'s border touches is cut; any other lies wholly inside or wholly outside.
    """
    return (
        F.when(box_touched(other, minx, miny, maxx, maxy), overlap_area(edges, other))
        .when(_odd_crossings(other, minx, miny), edges_area(edges))
        .otherwise(F.lit(0.0))
    )


def _point_edge_distance2(x: Column, y: Column, e: Column) -> Column:
    dx, dy = e.x2 - e.x1, e.y2 - e.y1
    t = F.coalesce(F.try_divide((x - e.x1) * dx + (y - e.y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    px, py = e.x1 + t * dx - x, e.y1 + t * dy - y
    return px * px + py * py


def polygons_within(edges_a: Column, edges_b: Column, limit: float) -> Column:
    """True when two polygons come within ``limit`` of each other (zero when they meet)."""
    limit2 = limit * limit

    def near(points: Column, edges: Column) -> Column:
        return F.exists(points, lambda p: F.exists(edges, lambda e: _point_edge_distance2(p.x1, p.y1, e) <= limit2))

    return near(edges_a, edges_b) | near(edges_b, edges_a) | polygons_meet(edges_a, edges_b)


def _segments_meet(a: Column, b: Column) -> Column:
    d1, d2 = _side(a, b.x1, b.y1), _side(a, b.x2, b.y2)
    d3, d4 = _side(b, a.x1, a.y1), _side(b, a.x2, a.y2)
    proper = (d1 * d2 < 0) & (d3 * d4 < 0)
    return (
        proper
        | _touches_edge(a, b.x1, b.y1)
        | _touches_edge(a, b.x2, b.y2)
        | _touches_edge(b, a.x1, a.y1)
        | _touches_edge(b, a.x2, a.y2)
    )


def polygons_meet(edges_a: Column, edges_b: Column) -> Column:
    """True when two polygons share at least one point."""
    return (
        F.exists(edges_a, lambda a: F.exists(edges_b, lambda b: _segments_meet(a, b)))
        | _odd_crossings(edges_b, edges_a[0].x1, edges_a[0].y1)
        | _odd_crossings(edges_a, edges_b[0].x1, edges_b[0].y1)
    )


def interior_point(edges: Column) -> Column:
    """A point inside the polygon: middle of the widest inside span of a scan line at mid-height.

    The scan line lies half-way between the vertex heights on either side of the box middle, so it
    never runs through a vertex.
    """
    ys = F.transform(edges, lambda e: e.y1)
    middle = (F.array_min(ys) + F.array_max(ys)) / 2
    below = F.array_max(F.filter(ys, lambda y: y <= middle))
    above = F.array_min(F.filter(ys, lambda y: y > middle))
    return _bind((below + above) / 2, lambda scan: _widest_middle(edges, scan))


def _widest_middle(edges: Column, scan: Column) -> Column:
    crossed = F.filter(edges, lambda e: (e.y1 > scan) != (e.y2 > scan))
    xs = F.array_sort(F.transform(crossed, lambda e: e.x1 + (scan - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)))
    spans = F.filter(
        _pairs(F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda a, b: F.struct(
            (b.x - a.x).alias("w"), (-a.x).alias("k"), ((a.x + b.x) / 2).alias("mid"), a.i.alias("i"))),
        lambda s: s.i % 2 == 0,
    )
    return F.struct(F.array_max(spans).mid.alias("x"), scan.alias("y"))


def valid_rings(rings: Column) -> Column:
    """Closed rings of at least four vertices with an area and no self-crossing edges."""

    def ring_ok(ring: Column) -> Column:
        closed = (F.size(ring) >= 4) & (ring[0] == F.element_at(ring, -1))
        edges = F.transform(line_edges(ring), lambda e, i: F.struct(e.x1, e.y1, e.x2, e.y2, i.alias("i")))
        crossing = F.exists(
            edges,
            lambda a: F.exists(
                edges,
                lambda b: (a.i < b.i)
                & (_side(a, b.x1, b.y1) * _side(a, b.x2, b.y2) < 0)
                & (_side(b, a.x1, a.y1) * _side(b, a.x2, a.y2) < 0),
            ),
        )
        return closed & (_ring_area(ring) > 0) & ~crossing

    return F.forall(rings, ring_ok)
