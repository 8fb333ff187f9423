"""k-means of many starts in common passes."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from blockreach.operators import clusters as cl

rng = np.random.default_rng(7)
POINTS = np.vstack([rng.normal(c, s, (n, 4)) for c, s, n in ((0, 1, 300), (4, 1.5, 200), (-5, 0.5, 120), (9, 2, 60))])


def rows_of(spark, points):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "key bigint, x array<double>").repartition(5)


def brute_cost(points, centres):
    return ((points[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_costs_rounds_and_assignment(spark):
    rows, moving = rows_of(spark, POINTS).cache(), []
    centres, costs = cl.fit_starts(rows, 5, 12, watch=moving.append)
    assert centres.shape == (12, 5, 4)
    assert np.allclose(costs, [brute_cost(POINTS, c) for c in centres])
    # Every start rests where its centres are the means of their rows.
    for c in centres:
        own = ((POINTS[:, None] - c[None]) ** 2).sum(2).argmin(1)
        assert max(np.abs(POINTS[own == j].mean(0) - c[j]).max() for j in range(5)) < 1e-3
    # One pass a round serves all starts that still move.
    assert moving == sorted(moving, reverse=True) and moving[0] == 12 and len(moving) <= cl.ROUNDS
    library = min(KMeans(k=5, seed=s).fit(rows.withColumn("features", array_to_vector("x"))).summary.trainingCost for s in range(6))
    assert costs.min() <= library * 1.001
    best = centres[costs.argmin()]
    found = {r["key"]: r["own"] for r in rows.select("key", cl.nearest_centre(F.col("x"), best).alias("own")).collect()}
    assert found == dict(enumerate(((POINTS[:, None] - best[None]) ** 2).sum(2).argmin(1).tolist()))


def test_partitions_change_nothing(spark):
    rows = rows_of(spark, POINTS[:200])
    one, many = cl.fit_starts(rows.repartition(1), 3, 4), cl.fit_starts(rows.repartition(7), 3, 4)
    assert np.allclose(one[0], many[0]) and np.allclose(one[1], many[1])


def test_few_rows_copies_and_none(spark):
    centres, costs = cl.fit_starts(rows_of(spark, np.ones((6, 2))), 3, 2)
    assert np.allclose(centres, 1) and np.allclose(costs, 0)
    assert cl.fit_starts(rows_of(spark, np.ones((1, 2))).where("key < 0"), 3, 2) is None
