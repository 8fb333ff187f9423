"""Boosted regression trees, many models in one run, over a binned column store.

Every feature is cut once at its quantiles; a row keeps one byte per feature. Rows are stored in blocks
(columns of bytes, target, group) of at most ``BLOCK_ROWS`` rows and ``BLOCK_CELLS`` bytes. Trees grow level by level: the blocks
add up gradient sums and counts per (model, node, feature, byte), the best cut of every node follows from
these sums, and the next level starts. All models of a run (held-out groups, tuning candidates) share
the blocks and the levels.

* More than one block: a level is one aggregate. Tasks add up their blocks for all models, the sums meet
  by (model, feature), and only the best cut of each node and feature reaches the driver. Every
  ``STATE_TREES`` trees the predictions so far are written with ``checkpoint()``; a lost executor's blocks
  are read again from there.
* One block: there are no sums of other blocks to wait for, so the levels follow each other inside a
  task, one task per model.

Squared error with L1 and L2 terms: a node with gradient sum ``G`` over ``n`` rows has the score
``max(|G| - l1, 0)^2 / (n + l2)`` and the leaf value ``-sign(G) max(|G| - l1, 0) / (n + l2)``, times the
rate. Rows and columns are drawn anew for each tree. Missing values (null or NaN) go to the side that
gains more. A null target is an error, as is a model without training rows. Ties take the first feature
and the smallest cut. Extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from blockreach.session import cut_lineage

# The functions below travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1_048_576
BLOCK_CELLS = 64_000_000  # bytes of features a block may hold, so that wide tables have shorter blocks
STATE_TREES = 5
BYTES = 256
MISSING = 255  # the byte of a missing value; a feature has at most 254 cuts
LEAST_GAIN = 1e-9
FEW = 240  # estimated number of values up to which a feature is cut at every value


@dataclass(frozen=True)
class Boosting:
    """Settings of a boosted-tree regression. Columns are drawn per tree."""

    trees: int = 600
    rate: float = 0.03
    depth: int = 4
    rows: float = 0.85
    columns: float = 0.85
    min_leaf: float = 1
    l1: float = 0.0
    l2: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model. Trees are complete: node ``i`` has the children ``2i + 1`` and ``2i + 2``.

    A row goes right at a node if its byte is above ``code``, and at a missing value unless
    ``missing_left``. Nodes that do not split send all rows left. ``value`` is by tree and leaf.
    """

    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    base: float
    feature: np.ndarray
    code: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Predictions of raw values ``(row, feature)``."""
        return self.score(to_bytes(values, self.cuts))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Predictions of bytes ``(feature, row)``."""
        out = np.full(rows.shape[1], self.base)
        for t in range(len(self.value)):
            out += self.value[t][leaves(self.feature[t], self.code[t], self.missing_left[t], rows)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``y_pred`` from a ``features`` vector in the order of ``self.features``."""
        return df.withColumn("y_pred", F.get(predictions([self], vector_to_array("features")), F.lit(0)))

    def importances(self) -> dict[str, float]:
        """Mean gain of each feature's splits, summing to one (all zero without a split)."""
        split = self.gain > 0
        count = np.bincount(self.feature[split], minlength=len(self.features))
        total = np.bincount(self.feature[split], self.gain[split], len(self.features))
        mean = total / np.maximum(count, 1)
        return dict(zip(self.features, (mean / (mean.sum() or 1.0)).tolist()))


def to_bytes(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bytes ``(feature, row)`` of raw values ``(row, feature)``: how many cuts lie below the value."""
    out = np.empty(values.shape[::-1], np.uint8)
    for f, cut in enumerate(cuts):
        out[f] = np.where(np.isnan(values[:, f]), MISSING, np.searchsorted(cut, values[:, f]))
    return out


def leaves(feature: np.ndarray, code: np.ndarray, missing_left: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Leaf number of every row of ``rows`` (feature, row) in one tree."""
    inner = len(feature)
    below: list = [None] * inner + [np.uint8(i) for i in range(inner + 1)]
    for i in range(inner - 1, -1, -1):
        left, right = below[2 * i + 1], below[2 * i + 2]
        below[i] = left
        if code[i] < MISSING:
            own = rows[feature[i]]
            goes = own > code[i]
            if missing_left[i]:
                goes &= own != MISSING
            below[i] = np.where(goes, right, left)
    return np.broadcast_to(below[0], rows.shape[1])


# --- growing one level ------------------------------------------------------------------------

def drawn_columns(settings: Boosting, n_features: int, tree: int) -> np.ndarray:
    """Columns of one tree, ascending."""
    size = max(1, int(settings.columns * n_features))
    return np.sort(np.random.default_rng([settings.seed, tree]).choice(n_features, size, replace=False))


def drawn_rows(settings: Boosting, n: int, tree: int, block: int) -> np.ndarray:
    """Which rows of a block one tree sees."""
    if settings.rows >= 1:
        return np.arange(n)
    return np.flatnonzero(np.random.default_rng([settings.seed, tree, block]).random(n) < settings.rows)


def level_sums(rows: np.ndarray, node: np.ndarray, gradient: np.ndarray, n_nodes: int) -> np.ndarray:
    """Gradient sum and count by (column, node, byte); ``rows`` is (column, row)."""
    out = np.empty((len(rows), n_nodes * BYTES, 2))
    start = node.astype(np.int64) * BYTES
    for j, own in enumerate(rows):
        key = start + own
        out[j, :, 0] = np.bincount(key, gradient, n_nodes * BYTES)
        out[j, :, 1] = np.bincount(key, minlength=n_nodes * BYTES)
    return out.reshape(len(rows), n_nodes, BYTES, 2)


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def _score(g: np.ndarray, n: np.ndarray, settings: Boosting) -> np.ndarray:
    return _shrunk(g, settings.l1) ** 2 / np.maximum(n + settings.l2, 1e-300)


def leaf_value(g: np.ndarray, n: np.ndarray, settings: Boosting) -> np.ndarray:
    """Leaf values before the rate; zero for a leaf without rows."""
    return np.where(n > 0, -_shrunk(g, settings.l1) / np.maximum(n + settings.l2, 1e-300), 0.0)


def cut_gains(left: np.ndarray, whole: np.ndarray, settings: Boosting) -> np.ndarray:
    """Gain of cuts from the left side's and the node's ``(gradient, count)``; zero where a side is too small."""
    right, least = whole - left, max(settings.min_leaf, 1e-12)
    gain = _score(left[..., 0], left[..., 1], settings) + _score(right[..., 0], right[..., 1], settings) - _score(whole[..., 0], whole[..., 1], settings)
    return np.where((left[..., 1] < least) | (right[..., 1] < least), 0.0, gain)


def best_cuts(sums: np.ndarray, settings: Boosting) -> tuple[np.ndarray, ...]:
    """Best cut of every (column, node): gain, byte, whether missing goes left, and the left side's sums."""
    whole = sums.sum(axis=2)
    up_to = np.cumsum(sums[:, :, :MISSING], axis=2)
    gone = sums[:, :, MISSING:]
    sides = [up_to] if not gone[..., 1].any() else [up_to, up_to + gone]
    best = np.concatenate([cut_gains(left, whole[:, :, None], settings) for left in sides], axis=2)
    at = best.argmax(axis=2)
    gain = np.take_along_axis(best, at[..., None], 2)[..., 0]
    code, missing_left = at % MISSING, at >= MISSING
    left = np.take_along_axis(up_to, code[..., None, None], 2)[:, :, 0] + np.where(missing_left[..., None], gone[:, :, 0], 0.0)
    return gain, code, missing_left, left, whole


class Growing:
    """One tree being grown, from the best cuts of its nodes, level by level."""

    def __init__(self, settings: Boosting, columns: np.ndarray) -> None:
        inner = 2**settings.depth - 1
        self.settings, self.columns, self.level = settings, columns, 0
        self.feature, self.code = np.zeros(inner, np.int16), np.full(inner, MISSING, np.uint8)
        self.missing_left, self.gain = np.zeros(inner, bool), np.zeros(inner)
        self.sums = np.zeros((2 * inner + 1, 2))
        self.open = np.zeros(2 * inner + 1, bool)
        self.open[0] = True

    @property
    def done(self) -> bool:
        return self.level >= self.settings.depth or not self.open[self.nodes].any()

    @property
    def nodes(self) -> np.ndarray:
        """Numbers of the nodes of the present level."""
        return np.arange(2**self.level - 1, 2 ** (self.level + 1) - 1)

    def split(self, gain: np.ndarray, code: np.ndarray, missing_left: np.ndarray, left: np.ndarray, whole: np.ndarray) -> None:
        """Take the best cuts of (column, node) of the present level."""
        nodes = self.nodes
        if self.level == 0:
            self.sums[0] = whole[0, 0]
        best, slot = gain.argmax(axis=0), np.arange(len(nodes))
        taken = self.open[nodes] & (gain[best, slot] > LEAST_GAIN)
        at, j, s = nodes[taken], best[taken], slot[taken]
        self.feature[at], self.code[at] = self.columns[j], code[j, s]
        self.missing_left[at], self.gain[at] = missing_left[j, s], gain[j, s]
        self.sums[2 * at + 1], self.sums[2 * at + 2] = left[j, s], whole[j, s] - left[j, s]
        self.open[2 * at + 1] = self.open[2 * at + 2] = True
        self.level += 1

    def values(self) -> np.ndarray:
        """Leaf values times the rate; a node without a split hands its own value to all its leaves."""
        own = leaf_value(self.sums[:, 0], self.sums[:, 1], self.settings) * self.settings.rate
        for i in range(len(self.feature)):
            if self.gain[i] <= 0:
                own[2 * i + 1] = own[2 * i + 2] = own[i]
        return own[len(self.feature):]

    def node_of(self, rows: np.ndarray) -> np.ndarray:
        """Place within the present level of every row (feature, row)."""
        node = np.zeros(rows.shape[1], np.int64)
        number = np.arange(rows.shape[1])
        for level in range(self.level):
            node = self.step(rows, number, node, level)
        return node

    def step(self, rows: np.ndarray, number: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        """Places one level further down."""
        at = node + (2**level - 1)
        own = rows[self.feature[at], number]
        goes = own > self.code[at]
        if self.missing_left.any():
            goes &= ~(self.missing_left[at] & (own == MISSING))
        return 2 * node + goes


def stacked(settings: Boosting, trees: list[Growing]) -> dict[str, np.ndarray]:
    """The arrays of a model from its finished trees."""
    inner = 2**settings.depth - 1
    kinds = {"feature": np.int16, "code": np.uint8, "missing_left": bool, "gain": float}
    arrays = {name: np.array([getattr(t, name) for t in trees], kind).reshape(-1, inner) for name, kind in kinds.items()}
    return arrays | {"value": np.array([t.values() for t in trees], float).reshape(-1, inner + 1)}


def fit_block(rows: np.ndarray, y: np.ndarray, settings: Boosting, base: float, block: int = 0) -> list[Growing]:
    """All trees over the training rows of one block."""
    margin = np.full(len(y), base)
    trees = []
    for t in range(settings.trees):
        columns = drawn_columns(settings, len(rows), t)
        drawn = drawn_rows(settings, len(y), t, block)
        seen, gradient = rows[:, drawn], (margin - y)[drawn]
        tree, node, number = Growing(settings, columns), np.zeros(len(drawn), np.int64), np.arange(len(drawn))
        while not tree.done:
            tree.split(*best_cuts(level_sums(seen[columns], node, gradient, 2**tree.level), settings))
            if not tree.done:
                node = tree.step(seen, number, node, tree.level - 1)
        margin += tree.values()[leaves(tree.feature, tree.code, tree.missing_left, rows)]
        trees.append(tree)
    return trees


# --- the column store -------------------------------------------------------------------------

def quantile_cuts(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, ...]:
    """At most 254 cuts per feature: all values of a feature that has few, else 254 quantiles; missing values do not count."""
    shares = [i / MISSING for i in range(1, MISSING)]
    columns = [F.when(~F.isnan(c), c) for c in (F.col(f"`{f}`").cast("double") for f in features)]
    found = df.agg(*[F.struct(F.approx_count_distinct(c, 0.02).alias("n"), F.percentile_approx(c, shares, 10_000).alias("q")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    few = [i for i in range(len(columns)) if found[i]["n"] <= FEW]
    # Sets of at most about ``FEW`` values.
    sets = df.agg(*[F.collect_set(columns[i]).alias(f"c{i}") for i in few]).first().asDict() if few else {}
    cuts = []
    for i in range(len(columns)):
        own = np.array(sorted(sets.get(f"c{i}", [])), float)
        cuts.append(own if i in few and len(own) < MISSING else np.unique(np.array(found[i]["q"] or [], float)))
    return tuple(cuts)


def column_store(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], target: str, group: Column, n_rows: int, block_rows: int, order: Sequence[str]) -> DataFrame:
    """Blocks ``(block, n, bytes, y, group)`` of at most ``block_rows`` rows, the same at every run."""
    parts = max(1, -(-n_rows // block_rows))
    table = df.select(*order, F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"), F.col(target).cast("double").alias("y"), group.cast("int").alias("group"))
    table = table.repartition(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "x", "y", "group")
    n_features = len(features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def block() -> pa.RecordBatch:
            part = held[0].column("part")[0].as_py()
            x = np.concatenate([b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_features) for b in held])
            y, g = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("y", "group"))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([part << 20 | number], pa.int64()), "n": pa.array([len(y)], pa.int32()), "bytes": pa.array([to_bytes(x, cuts).tobytes()], pa.binary()),
                "y": pa.array([y.astype(float).tobytes()], pa.binary()), "group": pa.array([g.astype(np.int32).tobytes()], pa.binary()),
            })

        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, block_rows - size)
                held.append(piece)
                size += piece.num_rows
                batch = batch.slice(piece.num_rows)
                if size == block_rows:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    return table.mapInArrow(pack, "block bigint, n int, bytes binary, y binary, group binary")


def opened(row: dict, n_features: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number, bytes (feature, row), target and group of a stored block."""
    rows = np.frombuffer(row["bytes"], np.uint8).reshape(n_features, row["n"])
    return row["block"], rows, np.frombuffer(row["y"]), np.frombuffer(row["group"], np.int32)


# --- fitting ----------------------------------------------------------------------------------

def fit_models(
    df: DataFrame, features: Sequence[str], target: str, settings: Sequence[Boosting], group: Column | None = None,
    without: Sequence[object] | None = None, order: Sequence[str] = ("node_id",), block_rows: int = BLOCK_ROWS,
) -> list[BoostedTrees]:
    """Fit one model per entry of ``settings``; model ``i`` leaves out the rows whose ``group`` is ``without[i]``.

    ``order`` names columns that tell rows apart, so that blocks and drawn rows are the same at every run.
    """
    group = F.lit(0) if group is None else group
    without = [None] * len(settings) if without is None else list(without)
    totals = df.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count(target).alias("known"), F.sum(F.col(target).cast("double")).alias("total"))
    totals = sorted(totals.collect(), key=lambda r: str(r["g"]))  # one row per group
    if any(r["known"] < r["n"] for r in totals):
        raise ValueError(f"Null value in {target}.")
    number = {r["g"]: i for i, r in enumerate(totals)}
    left_out = [number.get(w, -1) if w is not None else -1 for w in without]
    bases = []
    for skip in left_out:
        kept = [r for i, r in enumerate(totals) if i != skip]
        if not sum(r["n"] for r in kept):
            raise ValueError("A model has no training rows.")
        bases.append(sum(r["total"] for r in kept) / sum(r["n"] for r in kept))
    code = F.lit(0)
    for value, i in number.items():
        code = F.when(group.eqNullSafe(F.lit(value)), i).otherwise(code)
    cuts = quantile_cuts(df, features)
    block_rows = max(1, min(block_rows, BLOCK_CELLS // len(features)))
    n_rows = sum(r["n"] for r in totals)
    blocks = cut_lineage(column_store(df, features, cuts, target, code, n_rows, block_rows, order))
    grow = grow_in_block if n_rows <= block_rows else grow_over_blocks
    trees = grow(blocks, len(features), list(settings), left_out, bases)
    return [BoostedTrees(tuple(features), cuts, base, **own) for base, own in zip(bases, trees)]


def grow_in_block(blocks: DataFrame, n_features: int, settings: list[Boosting], left_out: list[int], bases: list[float]) -> list[dict[str, np.ndarray]]:
    """Trees over a single block, one task per model."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, rows, y, group = opened(row, n_features)
                m = row["model"]
                own = group != left_out[m]
                trees = fit_block(np.ascontiguousarray(rows[:, own]), y[own], settings[m], bases[m], block)
                yield pa.RecordBatch.from_pydict({"model": pa.array([m], pa.int32()), "trees": pa.array([cloudpickle.dumps(stacked(settings[m], trees))], pa.binary())})

    n = len(settings)
    dealt = blocks.withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(n)]))).repartitionByRange(n, "model")
    found = {r["model"]: cloudpickle.loads(r["trees"]) for r in dealt.mapInArrow(fit, "model int, trees binary").collect()}
    return [found[i] for i in range(n)]


def grow_over_blocks(blocks: DataFrame, n_features: int, settings: list[Boosting], left_out: list[int], bases: list[float]) -> list[dict[str, np.ndarray]]:
    """Trees over many blocks, one aggregate per level for all models."""
    n_models = len(settings)
    state = cut_lineage(with_margins(blocks, lambda row: np.repeat(np.array(bases)[:, None], row["n"], axis=1)))
    trees: list[list[Growing]] = [[] for _ in range(n_models)]
    kept = [0] * n_models  # trees that the state's margins hold
    growing: dict[int, Growing] = {}
    while True:
        for m, s in enumerate(settings):
            while m not in growing or growing[m].done:
                if m in growing:
                    trees[m].append(growing.pop(m))
                if len(trees[m]) >= s.trees:
                    break
                growing[m] = Growing(s, drawn_columns(s, n_features, len(trees[m])))
        if not growing:
            return [stacked(s, own) for s, own in zip(settings, trees)]
        if max(len(own) - k for own, k in zip(trees, kept)) >= STATE_TREES:
            since = [own[k:] for own, k in zip(trees, kept)]
            state = cut_lineage(with_margins(state, lambda row, since=since: margins(row, n_features, since)))
            kept = [len(own) for own in trees]
        for m, level in level_cuts(state, n_features, settings, left_out, growing, [own[k:] for own, k in zip(trees, kept)], [len(own) for own in trees]):
            growing[m].split(*level)


def margins(row: dict, n_features: int, since: list[list[Growing]]) -> np.ndarray:
    """Predictions (model, row) of a stored block after the trees grown since it was written."""
    rows = opened(row, n_features)[1]
    out = np.frombuffer(row["margin"]).reshape(len(since), row["n"]).copy()
    for m, own in enumerate(since):
        for tree in own:
            out[m] += tree.values()[leaves(tree.feature, tree.code, tree.missing_left, rows)]
    return out


def with_margins(blocks: DataFrame, make: Callable[[dict], np.ndarray]) -> DataFrame:
    """Blocks with new predictions in ``margin``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row["margin"] = make(row).tobytes()
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("bytes", "y", "group", "margin")]])
    return blocks.mapInArrow(run, "block bigint, n int, bytes binary, y binary, group binary, margin binary")


def level_sums_of(
    state: DataFrame, n_features: int, settings: list[Boosting], left_out: list[int], growing: dict[int, Growing], since: list[list[Growing]], tree_numbers: list[int],
) -> DataFrame:
    """``(model, j, sums)`` of the present level, added up within each task."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block, rows, y, group = opened(row, n_features)
                margin = margins(row, n_features, since)
                for m, tree in growing.items():
                    own = np.flatnonzero(group != left_out[m])
                    own = own[drawn_rows(settings[m], len(own), tree_numbers[m], block)]
                    seen = rows[:, own]
                    part = level_sums(seen[tree.columns], tree.node_of(seen), (margin[m] - y)[own], 2**tree.level)
                    sums[m] = part if m not in sums else sums[m] + part
        for m, part in sums.items():
            n = len(part)
            yield pa.RecordBatch.from_pydict({"model": pa.array([m] * n, pa.int32()), "j": pa.array(range(n), pa.int32()), "sums": pa.array([p.tobytes() for p in part], pa.binary())})

    return state.mapInArrow(add_up, "model int, j int, sums binary")


def level_cuts(
    state: DataFrame, n_features: int, settings: list[Boosting], left_out: list[int], growing: dict[int, Growing], since: list[list[Growing]], tree_numbers: list[int],
) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Best cuts of the present level of every growing tree, from one aggregate over the blocks."""

    def choose(table: pa.Table) -> pa.Table:
        m, j = table.column("model")[0].as_py(), table.column("j")[0].as_py()
        nodes = 2 ** growing[m].level
        whole = sum(np.frombuffer(s.as_buffer()).reshape(1, nodes, BYTES, 2) for s in table.column("sums").combine_chunks())
        return pa.table({"model": pa.array([m], pa.int32()), "j": pa.array([j], pa.int32()), "cuts": pa.array([cloudpickle.dumps(best_cuts(whole, settings[m]))], pa.binary())})

    sums = level_sums_of(state, n_features, settings, left_out, growing, since, tree_numbers)
    found = sums.groupBy("model", "j").applyInArrow(choose, "model int, j int, cuts binary").collect()
    for m in growing:
        own = [cloudpickle.loads(r["cuts"]) for r in sorted((r for r in found if r["model"] == m), key=lambda r: r["j"])]
        yield m, tuple(np.concatenate(parts) for parts in zip(*own))


def root_gains(df: DataFrame, features: Sequence[str], target: str, settings: Boosting, order: Sequence[str] = ("node_id",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every cut of the first tree's root: ``(feature, value, n_left, gradient_left, gain)``, from one aggregate over the blocks.

    Rows up to ``value`` go left; missing values go right.
    """
    n, mean = df.agg(F.count(F.lit(1)), F.avg(F.col(target).cast("double"))).first()
    cuts = quantile_cuts(df, features)
    blocks = with_margins(column_store(df, features, cuts, target, F.lit(0), n, block_rows, order), lambda row: np.full((1, row["n"]), mean))
    whole, names = replace(settings, rows=1.0, columns=1.0), list(features)

    def every_cut(sums: np.ndarray, j: int) -> pa.Table:
        left = np.cumsum(sums[:MISSING], axis=0)[:len(cuts[j])]
        gain = cut_gains(left, sums.sum(axis=0), whole)
        return pa.table({
            "feature": pa.array([names[j]] * len(left)), "value": pa.array(cuts[j]), "n_left": pa.array(left[:, 1].astype(np.int64)),
            "gradient_left": pa.array(left[:, 0]), "gain": pa.array(gain),
        })

    def choose(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(s.as_buffer()).reshape(BYTES, 2) for s in table.column("sums").combine_chunks()]
        return every_cut(sum(parts), table.column("j")[0].as_py())

    sums = level_sums_of(blocks, len(names), [whole], [-1], {0: Growing(whole, np.arange(len(names)))}, [[]], [0])
    return sums.groupBy("j").applyInArrow(choose, "feature string, value double, n_left bigint, gradient_left double, gain double")


# --- scoring ----------------------------------------------------------------------------------

def predictions(models: Sequence[BoostedTrees], values: Column) -> Column:
    """Predictions of all models as an array, from an array of the features in the models' order."""
    models = list(models)

    def score(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)
        rows = to_bytes(x, models[0].cuts)
        shared = all(m.cuts is models[0].cuts for m in models)
        out = np.stack([m.score(rows if shared else to_bytes(x, m.cuts)) for m in models], axis=1)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(models), out.ravel())

    return F.arrow_udf(score, ArrayType(DoubleType()))(values)


def feature_array(features: Sequence[str]) -> Column:
    """The features as an array of doubles."""
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features])
