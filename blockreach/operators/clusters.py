"""k-means of many starts in the same passes.

The centres of all starts lie in one array (starts x clusters x columns), which stays small however many
rows there are. Each pass over the rows is one job: tasks multiply batches of rows by all centres at once
and return sums per start and cluster, which Spark adds up. First centres are drawn as in k-means||: a few
rounds in which rows are drawn by their distance from the centres so far, then k-means++ on the drawn
rows, weighted by the rows next to them. Draws are hashes of the row's key, so repeated tasks draw the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

DRAWING_ROUNDS = 2
DRAWN_PER_CLUSTER = 2  # expected rows drawn per round and cluster
ROUNDS = 100
# A start rests when no centre moves farther than this.
STILL = 1e-4
BATCH_CELLS = 1_000_000  # distances held at once, in about five arrays of eight bytes each


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres ``(starts, clusters, columns)``: rows by starts by clusters."""
    flat = centres.reshape(-1, centres.shape[2])
    found = (x * x).sum(1)[:, None] - 2 * x @ flat.T + (flat * flat).sum(1)
    return np.maximum(found, 0).reshape(len(x), *centres.shape[:2])


def _uniform(key: np.ndarray, start: int, turn: int) -> np.ndarray:
    """Numbers in [0, 1) by a mixing hash of the row keys."""
    with np.errstate(over="ignore"):
        z = key.view(np.uint64) + np.uint64((start * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and rows of a task, so many at a time that ``width`` distances a row fit."""
    step = max(1, BATCH_CELLS // width)
    for batch in batches:
        key = batch.column(0).to_numpy()
        x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(key), -1)
        for a in range(0, len(key), step):
            yield key[a:a + step], x[a:a + step]


def _sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per start and cluster: sums of the rows nearest to it, their number, and their squared distances."""
    starts, k, d = centres.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((starts * k, d + 2))
        for _, x in _pieces(batches, starts * k):
            far = _distances(x, centres)
            own = far.argmin(2)
            member = (own[:, :, None] == np.arange(k)).reshape(len(x), -1).astype(np.float64)
            total[:, :d] += member.T @ x
            total[:, d] += member.sum(0)
            total[:, d + 1] += (member * far.reshape(len(x), -1)).sum(0)
        used = np.flatnonzero(total[:, d])
        yield pa.RecordBatch.from_pydict({"place": pa.array(used, pa.int32()), "part": pa.array(total[used].tolist(), pa.list_(pa.float64()))})

    parts = rows.mapInArrow(step, "place int, part array<double>")
    out = np.zeros((starts * k, d + 2))
    # One row per start and cluster.
    for r in parts.groupBy("place").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("total")).collect():
        out[r["place"]] = r["total"]
    out = out.reshape(starts, k, d + 2)
    return out[:, :, :d], out[:, :, d], out[:, :, d + 1]


def _drawn(rows: DataFrame, centres: Sequence[np.ndarray], cost: np.ndarray, wanted: int, turn: int) -> list[tuple[int, np.ndarray]]:
    """About ``wanted`` rows per start, by their squared distance from its centres so far."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, x in _pieces(batches, max(len(c) for c in centres)):
            for i, c in enumerate(centres):
                hit = _uniform(key, i, turn) * cost[i] < wanted * _distances(x, c[None])[:, 0].min(1)
                if hit.any():
                    yield pa.RecordBatch.from_pydict({"start": pa.array(np.full(hit.sum(), i), pa.int32()), "key": pa.array(key[hit]), "x": pa.array(x[hit].tolist(), pa.list_(pa.float64()))})

    found = rows.mapInArrow(step, "start int, key bigint, x array<double>").dropDuplicates(["start", "key"])
    # The expected number is starts * wanted, whatever the number of rows.
    return [(r["start"], np.array(r["x"])) for r in found.orderBy("start", "key").collect()]


def _spread(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on weighted points, improved by a few rounds on them."""
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    for _ in range(k - 1):
        odds = weights * _distances(points, np.array(chosen)[None])[:, 0].min(1)
        chosen.append(points[rng.choice(len(points), p=odds / odds.sum())] if odds.sum() > 0 else chosen[-1])
    centres = np.array(chosen)
    for _ in range(30):
        own = _distances(points, centres[None])[:, 0].argmin(1)
        for j in range(k):
            if weights[own == j].sum() > 0:
                centres[j] = np.average(points[own == j], axis=0, weights=weights[own == j])
    return centres


def first_centres(rows: DataFrame, k: int, starts: int, seed: int) -> np.ndarray | None:
    """First centres of every start; None without rows."""
    first = rows.agg(*[F.min_by("x", F.struct(F.xxhash64("key", F.lit(seed + i)), "key")).alias(f"x{i}") for i in range(starts)]).first()
    if first["x0"] is None:
        return None
    found = [np.array([first[f"x{i}"]]) for i in range(starts)]
    for turn in range(DRAWING_ROUNDS):
        # All starts have to have as many centres; the first is repeated where fewer were drawn.
        cost = _sums(rows, _even(found))[2].sum(1)
        for i, x in _drawn(rows, found, cost, DRAWN_PER_CLUSTER * k, seed + turn):
            found[i] = np.vstack([found[i], x])
    near = _sums(rows, _even(found))[1]
    return np.array([_spread(c, np.maximum(near[i, :len(c)], 1e-9), k, np.random.default_rng(seed + i)) for i, c in enumerate(found)])


def _even(found: Sequence[np.ndarray]) -> np.ndarray:
    most = max(len(c) for c in found)
    return np.array([np.vstack([c, np.repeat(c[:1], most - len(c), axis=0)]) for c in found])


def fit_starts(rows: DataFrame, k: int, starts: int, seed: int = 42, rounds: int = ROUNDS, watch: Callable[[int], None] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres of every start and its sum of squared distances, over ``rows (key bigint, x array<double>)``.

    Rows are read once per round for all starts that still move; ``watch`` gets their number. A cluster
    that loses all rows keeps its centre. None without rows.
    """
    centres = first_centres(rows, k, starts, seed)
    if centres is None:
        return None
    moving = np.arange(starts)
    for _ in range(rounds):
        if watch is not None:
            watch(len(moving))
        sums, counts, _ = _sums(rows, centres[moving])
        new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres[moving])
        shift = ((new - centres[moving]) ** 2).sum(2).max(1)
        centres[moving] = new
        moving = moving[shift > STILL**2]
        if not len(moving):
            break
    return centres, _sums(rows, centres)[2].sum(1)


def nearest_centre(x: Column, centres: np.ndarray) -> Column:
    """Number of the nearest of a few centres; ties take the lowest number."""
    far = [F.aggregate(F.zip_with(x, F.lit([float(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    return F.array_min(F.array(*[F.struct(d.alias("far"), F.lit(i).alias("own")) for i, d in enumerate(far)]))["own"]
