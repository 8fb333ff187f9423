"""Distance joins over points: sums within radii, nearest point, and matches within a radius.

Destinations are first collapsed to distinct positions (so any number of copies is one row) and then
summarised into a shallow grid hierarchy: every cell stores its tight box and its totals, cells with
few positions ("leaves") also store those positions. Neighbouring origins form groups that take the
total of each cell lying wholly inside a radius of all of them and only open the cells a circle runs
through. A dense cell is opened step by step instead of being paired point by point.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from blockreach.session import cut_lineage, spread

# The sums below travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT = 4  # a cell is cut into FANOUT x FANOUT children
LEAF_SIZE = 128  # positions a leaf may hold for sums within radii
NEAREST_LEAF_SIZE = 16  # and for nearest points, where a leaf is always searched
DEPTH_STEP = 10  # levels looked at in one job


@dataclass(frozen=True)
class PointTree:
    """Grid hierarchy over distinct positions; ``nodes`` has one row per occupied cell."""

    nodes: DataFrame
    by: tuple[str, ...]
    measures: tuple[str, ...]
    top_size: float
    depth: int


def _cell(value: Column, level: Column, top_size: float) -> Column:
    return F.floor(value / (F.lit(float(top_size)) / F.pow(F.lit(float(FANOUT)), level))).cast("bigint")


def build_tree(
    points: DataFrame,
    by: Sequence[str] = (),
    measures: Sequence[str] = (),
    top_size: float | None = None,
    id_col: str | None = None,
    leaf_size: int = LEAF_SIZE,
    combine: Callable[[str], Column] = F.sum,
) -> PointTree:
    """Summarise points (``x``, ``y``, keys ``by``, ``measures`` that ``combine`` adds up) into a :class:`PointTree`.

    Without ``top_size`` the top cells are a quarter of the extent, so there are at most 25 per key.
    """
    keys = list(by)
    sums = [combine(m).alias(m) for m in measures]
    first_id = [F.min(id_col).alias("pid")] if id_col else []
    places = cut_lineage(
        points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy(*keys, "x", "y")
        .agg(F.count(F.lit(1)).alias("copies"), *sums, *first_id)
    )
    if top_size is None:
        wide, high = places.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
        top_size = max(wide or 0.0, high or 0.0, 1.0) / 4

    depth = _depth_needed(places, keys, top_size, leaf_size)

    def at_levels(df: DataFrame) -> DataFrame:
        df = df.withColumn("level", F.explode(F.array([F.lit(k) for k in range(depth + 1)])))
        return df.withColumn("cx", _cell(F.col("x"), F.col("level"), top_size)).withColumn(
            "cy", _cell(F.col("y"), F.col("level"), top_size)
        )

    cell = [*keys, "level", "cx", "cy"]
    item = F.struct("x", "y", *(["pid"] if id_col else []), *measures)
    totals = [
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("minx"), F.min("y").alias("miny"),
        F.max("x").alias("maxx"), F.max("y").alias("maxy"),
        *sums,
    ]
    if depth == 0:
        nodes = at_levels(places).groupBy(*cell).agg(*totals, F.collect_list(item).alias("pts"))
        nodes = nodes.withColumn("leaf", F.lit(True))
    else:
        summary = at_levels(places).groupBy(*cell).agg(*totals)
        summary = summary.withColumn("leaf", (F.col("n") <= leaf_size) | (F.col("level") == depth))
        opened = summary.where(~F.col("leaf")).select(
            *keys, (F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py")
        )
        summary = _with_parent(summary)
        reached = summary.where(F.col("level") == 0).unionByName(
            summary.where(F.col("level") > 0).join(opened, [*keys, "level", "px", "py"], "left_semi"),
        )
        # A leaf holds at most ``leaf_size`` positions, so the collected arrays are bounded.
        held = (
            at_levels(places)
            .join(reached.where("leaf").select(*cell), cell, "left_semi")
            .groupBy(*cell)
            .agg(F.collect_list(item).alias("pts"))
        )
        nodes = reached.drop("px", "py").join(held.hint("merge"), cell, "left")
    return PointTree(cut_lineage(_with_parent(nodes)), tuple(keys), tuple(measures), float(top_size), depth)


def _depth_needed(places: DataFrame, keys: Sequence[str], top_size: float, leaf_size: int) -> int:
    """Smallest depth at which every cell holds at most ``leaf_size`` positions.

    One job with few rows back per ``DEPTH_STEP`` levels; the first step is enough unless positions crowd
    within a millionth of the top cell. Distinct numbers part in the end.
    """
    depth = 0
    while True:
        last = depth + DEPTH_STEP
        depth = _crowded_below(places, keys, top_size, leaf_size, depth, last)
        if depth <= last:
            return depth


def _crowded_below(places: DataFrame, keys: Sequence[str], top_size: float, leaf_size: int, first: int, last: int) -> int:
    """Smallest depth from ``first`` on without a crowded cell; ``last + 1`` if even ``last`` has one."""
    levels = F.array([F.lit(k) for k in range(first, last + 1)])
    finest = places.groupBy(
        *keys, *[_cell(F.col(c), F.lit(last), top_size).alias(f"f{c}") for c in ("x", "y")]
    ).count()
    width = F.pow(F.lit(float(FANOUT)), F.lit(last) - F.col("level"))
    fullest = (
        finest.withColumn("level", F.explode(levels))
        .groupBy(*keys, "level", F.floor(F.col("fx") / width), F.floor(F.col("fy") / width))
        .agg(F.sum("count").alias("n"))
        .groupBy("level")
        .agg(F.max("n").alias("n"))
    )
    crowded = [r["level"] for r in fullest.collect() if r["n"] > leaf_size]  # at most DEPTH_STEP + 1 rows
    return max(crowded, default=first - 1) + 1


def _with_parent(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("px", F.floor(F.col("cx") / FANOUT).cast("bigint")).withColumn(
        "py", F.floor(F.col("cy") / FANOUT).cast("bigint")
    )


def _level(tree: PointTree, level: int, *columns: str) -> DataFrame:
    at = tree.nodes.where(F.col("level") == level)
    if level == 0:
        return at.select(*tree.by, F.col("cx").alias("jx"), F.col("cy").alias("jy"), "cx", "cy", *columns)
    return at.select(*tree.by, F.col("px").alias("jx"), F.col("py").alias("jy"), "cx", "cy", *columns)


def _rank(distance2: Column, radii: Sequence[float]) -> Column:
    """Index of the smallest radius that reaches a squared distance (``len(radii)`` if none does)."""
    out = F.lit(0)
    for r in radii:
        out = out + (distance2 > float(r) * float(r)).cast("int")
    return out


_BOX = ("leaf", "minx", "miny", "maxx", "maxy", "pts")

# Origin positions that open cells together, and pairs (position, point) that a task holds at once.
GROUP_POSITIONS = 1024
PAIRS_HELD = 2_000_000
NEAREST_GROUP = 256  # origin positions of a group that looks for nearest points


def radius_sums(
    origins: DataFrame,
    origin_id: str,
    points: DataFrame,
    measures: Sequence[str],
    radii: Sequence[float],
    name,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per origin with the sum of every measure within every radius (distance <= radius).

    ``name(measure, radius)`` gives the output column. Origins that reach nothing get zeros.
    Neighbouring origins form groups that open cells by their common box; only the points of leaves
    on a circle line of some origin of a group are measured, in arrays, against all its origins.
    """
    radii = sorted(float(r) for r in radii)
    keys = list(by)
    found = _within_groups(origins, points, measures, radii, keys, "double", F.sum)
    columns = [(f"s{i}_{j}", name(m, r)) for i, m in enumerate(measures) for j, r in enumerate(radii)]
    at = origins.select(origin_id, *keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return at.join(found.hint("merge"), [*keys, "x", "y"], "left").groupBy(origin_id).agg(
        *[F.sum(F.coalesce(c, F.lit(0.0))).alias(out) for c, out in columns]
    )


def _within_groups(
    origins: DataFrame, points: DataFrame, measures: Sequence[str], radii: Sequence[float], keys: list[str], kind: str, combine: Callable[[str], Column],
    asked: DataFrame | None = None,
) -> DataFrame:
    """``(keys..., x, y, s{measure}_{radius}...)`` per origin position: the measures within each radius, doubles added up or words OR-ed.

    Origins have the keys themselves, or ask for those that ``asked`` (``jx, jy, keys...``) names for their top cell.
    """
    tree = build_tree(points, keys, measures, top_size=radii[-1], combine=combine)
    own = keys if asked is None else []
    tiles = build_tree(origins.select(*own, "x", "y"), own, top_size=radii[-1], leaf_size=GROUP_POSITIONS)
    groups = tiles.nodes.where("leaf").select(*own, "pts", *[F.col(c).alias(f"o{c}") for c in ("minx", "miny", "maxx", "maxy")])
    if asked is not None:
        top = {f"j{c}": F.floor(F.col(f"omin{c}") / radii[-1]) for c in "xy"}  # a group lies in one top cell
        groups = groups.withColumns(top).join(asked.hint("merge"), list(top)).drop(*top)
    groups = cut_lineage(groups.withColumn("gid", F.monotonically_increasing_id()))
    number = lambda c: F.transform("pts", lambda p: p[c].cast("double"))
    values = lambda at: F.array(*[F.coalesce(at(m).cast(kind), F.lit(0).cast(kind)) for m in measures])
    nowhere, nothing = F.array().cast("array<double>"), F.array().cast(f"array<{kind}>")
    rows = groups.select("gid", F.lit(0).alias("kind"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), number("x").alias("xs"), number("y").alias("ys"), nothing.alias("v"))
    for met in _group_levels(groups, tree, radii):
        whole = met.where(F.col("mid") < F.col("hi")).groupBy("gid", "mid", "hi").agg(*[combine(F.col(m).cast(kind)).alias(m) for m in measures])
        line = met.where(F.col("leaf") & (F.col("first") < F.col("mid")))
        rows = rows.unionByName(whole.select("gid", F.lit(1).alias("kind"), F.col("mid").alias("lo"), "hi", nowhere.alias("xs"), nowhere.alias("ys"), values(F.col).alias("v")))
        rows = rows.unionByName(line.select(
            "gid", F.lit(2).alias("kind"), F.col("first").alias("lo"), F.col("mid").alias("hi"), number("x").alias("xs"), number("y").alias("ys"),
            F.flatten(F.transform("pts", lambda p: values(lambda m: p[m]))).alias("v"),
        ))
    parts = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [f"s{i}_{j}" for i in range(len(measures)) for j in range(len(radii))]
    found = rows.repartition(parts, "gid").sortWithinPartitions("gid", "kind").mapInArrow(
        _values_of_groups(radii, len(measures), kind == "bigint"), ", ".join(["gid bigint, x double, y double", *[f"{c} {kind}" for c in columns]])
    )
    if keys:
        found = found.join(groups.select("gid", *keys), "gid")
    return found.drop("gid")


def _group_distances() -> tuple[Column, Column]:
    """Squared distance between the nearest and the farthest spots of a group's box and a cell's."""
    apart = [F.greatest(F.col(f"min{c}") - F.col(f"omax{c}"), F.col(f"omin{c}") - F.col(f"max{c}"), F.lit(0.0)) for c in "xy"]
    across = [F.greatest(F.col(f"max{c}") - F.col(f"omin{c}"), F.col(f"omax{c}") - F.col(f"min{c}")) for c in "xy"]
    return apart[0] * apart[0] + apart[1] * apart[1], across[0] * across[0] + across[1] * across[1]


def _group_levels(groups: DataFrame, tree: PointTree, radii: Sequence[float]) -> Iterator[DataFrame]:
    """Cells that each group of origins meets, level by level, as ``gid, first, mid, hi`` and the cell's columns.

    All origins of a group reach a cell whole from radius index ``mid`` on, and none of them below ``first``.
    """
    keys = list(tree.by)
    box = ["ominx", "ominy", "omaxx", "omaxy"]
    seeds = spread(groups.select("gid", *keys, *box)).withColumn("hi", F.lit(len(radii)))
    for c in "xy":
        top = F.floor(F.col(f"omin{c}") / tree.top_size)  # a group lies in one top cell
        seeds = seeds.withColumn(f"j{c}", F.explode(F.sequence(top - 1, top + 1)))
    for level in range(tree.depth + 1):
        near, far = _group_distances()
        met = (
            # The size check would broadcast the cells, as it takes their arrays of points for one element.
            seeds.join(_level(tree, level, *_BOX, *tree.measures).hint("merge"), [*keys, "jx", "jy"])
            .withColumn("first", _rank(near, radii))
            .where(F.col("first") < F.col("hi"))
            .withColumn("mid", F.least(_rank(far, radii), F.col("hi")))
        )
        yield met
        if level < tree.depth:
            seeds = cut_lineage(met.where(~F.col("leaf") & (F.col("first") < F.col("mid"))).select(
                "gid", *keys, *box, F.col("cx").alias("jx"), F.col("cy").alias("jy"), F.col("mid").alias("hi")
            ))


def _values_of_groups(radii: Sequence[float], count: int, words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums (or OR-ed ``words``) per origin position from rows sorted by group: its origins first, then whole cells, then leaves on circle lines."""

    def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)

    def add(total: np.ndarray, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, worth: np.ndarray, r: float) -> None:
        step = max(1, PAIRS_HELD // len(x))
        for a in range(0, len(px), step):
            dx, dy = px[None, a:a + step] - x[:, None], py[None, a:a + step] - y[:, None]
            inside, w = dx * dx + dy * dy <= r * r, worth[a:a + step]
            if words:
                for m in range(count):
                    total[:, m] |= np.bitwise_or.reduce(np.where(inside, w[None, :, m], 0), axis=1)
            elif np.isfinite(w).all():
                total += inside.astype(float) @ w
            else:
                for m in range(count):
                    total[:, m] += np.where(inside, w[None, :, m], 0.0).sum(axis=1)

    def result(gid: int, x: np.ndarray, y: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
        named = {f"s{m}_{r}": out[r, :, m] for m in range(count) for r in range(len(radii))}
        return pa.RecordBatch.from_pydict({"gid": np.full(len(x), gid), "x": x, "y": y} | named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = x = y = out = None
        for batch in batches:
            ids, kind, lo, hi = (batch.column(i).to_numpy() for i in range(4))
            ends = [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip([0, *ends], ends):
                if a == b:
                    continue
                if kind[a] == 0:
                    if gid is not None:
                        yield result(gid, x, y, out)
                    gid, (x, _), (y, _) = int(ids[a]), flat(batch.column(4).slice(a, 1)), flat(batch.column(5).slice(a, 1))
                    out = np.zeros((len(radii), len(x), count), np.int64 if words else float)
                (px, sizes), (py, _), (v, held) = (flat(batch.column(i).slice(a, b - a)) for i in (4, 5, 6))
                kinds, owner = kind[a:b], np.repeat(np.arange(b - a), sizes)
                worth = v.reshape(-1, count)
                whole = worth[:int((kinds == 1).sum())]  # the rows before them hold no values
                for (low, high), w in zip(zip(lo[a:b][kinds == 1], hi[a:b][kinds == 1]), whole):
                    out[low:high] = out[low:high] | w if words else out[low:high] + w
                points = np.flatnonzero(kinds[owner] == 2)
                low, high, worth = lo[a:b][owner[points]], hi[a:b][owner[points]], worth[len(whole):]
                for i, r in enumerate(radii):
                    on = (low <= i) & (i < high)
                    add(out[i], x, y, px[points][on], py[points][on], worth[on], r)
        if gid is not None:
            yield result(gid, x, y, out)

    return run


def radius_sets(origins: DataFrame, origin_id: str, points: DataFrame, word: Sequence[str], bits: str, radii: Sequence[float], name) -> DataFrame:
    """Bits of every word met within every radius: ``(origin, word..., name(radius)...)``, without words met nowhere.

    Sets of labels are numbered into words of 64 (columns ``word`` of ``points``, a bit mask in ``bits``).
    Cells hold the OR of their words, so an origin carries a row per word instead of one per label.
    """
    radii = sorted(float(r) for r in radii)
    present = points.select(*word, *[F.floor(F.col(c) / radii[-1]).alias(f"j{c}") for c in "xy"]).distinct()
    around = F.array([F.lit(d) for d in (-1, 0, 1)])
    # A group only asks for the words present in the nine cells around it.
    for c in "xy":
        present = present.withColumn(f"j{c}", F.explode(F.transform(around, lambda d: F.col(f"j{c}") + d)))
    columns = [(f"s0_{i}", name(r)) for i, r in enumerate(radii)]
    found = _within_groups(origins, points, [bits], radii, list(word), "bigint", F.bit_or, present.distinct()).where(" or ".join(f"{c} <> 0" for c, _ in columns))
    at = origins.select(origin_id, *[F.col(c).cast("double").alias(c) for c in "xy"])
    return at.join(found.hint("merge"), ["x", "y"]).groupBy(origin_id, *word).agg(*[F.bit_or(c).alias(out) for c, out in columns])


def nearest(
    origins: DataFrame,
    origin_id: str,
    points: DataFrame,
    point_id: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Nearest point of every origin: ``(by..., origin, point, dist)``; ties go to the smallest id.

    Neighbouring origins form groups. A group keeps a cell only while its nearest spot is not farther
    than the farthest spot of the best cell, seen from the group's whole box; the points of the leaves
    left are measured in arrays against all its origins. Origins whose key has no points are absent.
    """
    tree = build_tree(points, by, (), id_col=point_id, leaf_size=NEAREST_LEAF_SIZE)
    keys = list(by)
    # Where points are denser than origins, groups are smaller, so that a group's box holds few points.
    asked = cut_lineage(origins.select(*keys, "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull()).distinct())
    held = tree.nodes.where("level = 0").agg(F.sum("n")).first()[0] or 1
    size = max(1, min(NEAREST_GROUP, NEAREST_GROUP * asked.count() // held))
    tiles = build_tree(asked, by, leaf_size=size)
    groups = cut_lineage(tiles.nodes.where("leaf").select(
        F.monotonically_increasing_id().alias("gid"), *keys, "pts", *[F.col(c).alias(f"o{c}") for c in ("minx", "miny", "maxx", "maxy")]
    ))
    number = lambda c: F.transform("pts", lambda p: p[c].cast("double"))
    rows = groups.select("gid", F.lit(0).alias("kind"), number("x").alias("xs"), number("y").alias("ys"))
    box = ["ominx", "ominy", "omaxx", "omaxy"]
    seeds = spread(groups.select("gid", *keys, *box)).withColumn("bound", F.lit(float("inf")))
    per_group = Window.partitionBy("gid")
    for level in range(tree.depth + 1):
        at = _level(tree, level, *_BOX)
        # At most 25 top cells per key.
        met = (seeds.join(at, [*keys, "jx", "jy"]) if level else seeds.join(at, keys) if keys else seeds.crossJoin(at))
        near, far = _group_distances()
        met = met.withColumn("near", near).where(F.col("near") <= F.col("bound"))
        met = met.withColumn("bound", F.least("bound", F.min(far).over(per_group))).where(F.col("near") <= F.col("bound"))
        rows = rows.unionByName(met.where("leaf").select("gid", F.lit(1).alias("kind"), number("x").alias("xs"), number("y").alias("ys")))
        if level < tree.depth:
            seeds = cut_lineage(met.where(~F.col("leaf")).select("gid", *keys, *box, "bound", F.col("cx").alias("jx"), F.col("cy").alias("jy")))
    parts = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "gid").sortWithinPartitions("gid", "kind").mapInArrow(
        _nearest_of_groups, "gid bigint, x double, y double, px double, py double, d2 double"
    )
    if keys:
        found = found.join(groups.select("gid", *keys), "gid")
    # Positions at the same distance are few; their ids decide.
    named = tree.nodes.where("leaf").select(*keys, F.explode("pts").alias("p")).select(
        *keys, F.col("p.x").cast("double").alias("px"), F.col("p.y").cast("double").alias("py"), F.col("p.pid").alias("pid")
    )
    hits = found.join(named.hint("merge"), [*keys, "px", "py"]).groupBy(*keys, "x", "y").agg(F.min(F.struct("d2", "pid")).alias("hit"))
    best = origins.select(*keys, origin_id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(
        hits.hint("merge"), [*keys, "x", "y"]
    ).groupBy(*keys, origin_id).agg(F.min("hit").alias("hit"))
    return best.select(*keys, origin_id, F.col("hit.pid").alias(point_id), F.sqrt("hit.d2").alias("dist"))


def _nearest_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nearest positions, ties included, from rows sorted by group: its origins first, then the points to measure."""

    def result(gid: int, x: np.ndarray, y: np.ndarray, best: np.ndarray, seen: list) -> pa.RecordBatch:
        at, px, py, d2 = (np.concatenate(c) for c in zip(*seen)) if seen else (np.zeros(0, int), *[np.zeros(0)] * 3)
        kept = d2 == best[at]
        at = at[kept]
        return pa.RecordBatch.from_pydict({"gid": np.full(len(at), gid), "x": x[at], "y": y[at], "px": px[kept], "py": py[kept], "d2": d2[kept]})

    gid = x = y = best = seen = None
    for batch in batches:
        ids, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ends = [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip([0, *ends], ends):
            if a == b:
                continue
            flat = lambda column, low, high: batch.column(column).slice(low, high - low).flatten().to_numpy(zero_copy_only=False)
            if kind[a] == 0:
                if gid is not None:
                    yield result(gid, x, y, best, seen)
                gid, x, y = int(ids[a]), flat(2, a, a + 1), flat(3, a, a + 1)
                best, seen, a = np.full(len(x), np.inf), [], a + 1
            px, py = flat(2, a, b), flat(3, a, b)
            step = max(1, PAIRS_HELD // len(x))
            for i in range(0, len(px), step):
                dx, dy = px[None, i:i + step] - x[:, None], py[None, i:i + step] - y[:, None]
                d2 = dx * dx + dy * dy
                least = d2.min(axis=1)
                best = np.minimum(best, least)
                at, point = np.nonzero(d2 == best[:, None])
                seen.append((at, px[i + point], py[i + point], d2[at, point]))
    if gid is not None:
        yield result(gid, x, y, best, seen)
