"""Forests and boosted trees for many training sets at once (M2 for M4-M6, M10, M11).

A backtest, a stack or a search needs hundreds of fits whose training sets overlap: one for each origin day, fold and
parameter point.  Here they are one plan, not a driver loop of jobs:

* features are binned once, to one byte each (quantile edges of the whole frame; code 0 is a missing value, ordered first);
* targets and gradients are fixed-point integers, so sums are exact and results do not depend on how rows are dealt;
* a training set of at most LOCAL_CELLS binned values goes to one task, which grows all its trees (``applyInArrow`` on
  (training set, model); the size is counted first);
* larger training sets are grown level by level, all of them together: each task adds up histograms (model, tree, node,
  feature, bin), Spark adds those, one group per node picks its best split, and the driver gets the splits.  That takes
  depth x rounds aggregations, however many training sets there are; a forest's trees grow side by side.

Both ways use the same histograms, the same choice of splits and the same integer leaf values, so they give the same
trees.  A split minimises squared error; ties go to the first feature, then the lowest cut.  Forests draw Poisson(1)
weights per row and tree, subsampling keeps rows by the same hash of (row, tree, seed).

A search (``fold_errors``) grows trees that its points share once: a model with fewer trees is a prefix of one with more, and a
forest's tree of less depth or with more rows to split is the deeper tree cut short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..constants import MODEL_DEFAULTS
from ..functions.exprs import join_null_safe
from ..session import cut_lineage

MAX_BINS = 64
#: Binned values of a training set that one task may take (a byte each, some 30 bytes while trees grow).
LOCAL_CELLS = 1 << 23
#: The same for rows packed in blocks (``packed``), which take less.
PACKED_CELLS = 1 << 24
#: Trees that a task grows to measure importances.
TREES_A_TASK = 2
#: Histogram cells that are compared at a time (they stay in a core's cache).
LEVEL_CELLS = 1 << 14
#: Histogram cells that a task holds before it hands them on.
SENT_CELLS = 1 << 22
#: Trees of a forest that grow side by side when a training set is spread over tasks.
TREES_AT_ONCE = 10
MAX_DEPTH = 30
BITS = 30
FULL = -1
TREE_KINDS = ("random_forest", "xgboost", "lightgbm")
KNOWN = {"n_estimators", "max_depth", "learning_rate", "min_samples_leaf", "min_samples_split", "reg_alpha", "reg_lambda", "subsample",
         "colsample_bytree", "random_state"}


class TreeSpec(NamedTuple):
    """What a model of trees is grown with; ``boost`` adds trees to each other's residuals, a forest averages them."""
    boost: bool
    n_trees: int
    depth: int
    step: float
    min_leaf: int
    min_split: int
    ridge: float
    lasso: float
    rows: float
    columns: float
    seed: int


def tree_spec(kind: str, params: Mapping | None = None) -> TreeSpec:
    """The spec of a published model name; parameters that trees do not have are an error."""
    if kind not in TREE_KINDS:
        raise ValueError(f"no model of trees is called {kind!r}; known: {TREE_KINDS}")
    p = {**MODEL_DEFAULTS[kind], **(params or {})}
    if set(p) - KNOWN:
        raise ValueError(f"parameters without a counterpart: {sorted(set(p) - KNOWN)}")
    depth = int(p.get("max_depth") or MAX_DEPTH)
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"max_depth is 1 to {MAX_DEPTH}")
    forest = kind == "random_forest"
    return TreeSpec(not forest, int(p["n_estimators"]), depth, 1.0 if forest else float(p["learning_rate"]),
                    int(p.get("min_samples_leaf", 20 if kind == "lightgbm" else 1)), int(p.get("min_samples_split", 2)),
                    float(p.get("reg_lambda", 1.0 if kind == "xgboost" else 0.0)), float(p.get("reg_alpha", 0.0)), float(p.get("subsample", 1.0)),
                    float(p.get("colsample_bytree", 1.0)), int(p.get("random_state", 42)))


# --- one tree ----------------------------------------------------------------------------------------------------------

class Tree:
    """Nodes in order of creation: feature (-1: a leaf), highest bin that goes left, left child (the right one follows), value, and
    the sums of targets and weights it was made from."""

    def __init__(self):
        self.feature, self.cut, self.left, self.value = (np.empty(0, t) for t in (np.int32, np.int32, np.int32, np.int64))
        self.g, self.n = np.empty(0), np.empty(0)

    def add(self, spec: TreeSpec, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        """New leaves; returns their numbers."""
        values = leaf_value(spec, g, n)
        self.g, self.n = np.append(self.g, g), np.append(self.n, n)
        first, new = len(self.value), len(values)
        self.feature = np.append(self.feature, np.full(new, -1, np.int32))
        self.cut = np.append(self.cut, np.zeros(new, np.int32))
        self.left = np.append(self.left, np.full(new, -1, np.int32))
        self.value = np.append(self.value, values)
        return np.arange(first, first + new)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf each row ends in."""
        return self.leaves_cut(bins, [MAX_DEPTH], 0)[MAX_DEPTH]

    def leaves_cut(self, bins: np.ndarray, depths: Sequence[int], min_split: int) -> dict[int, np.ndarray]:
        """The leaf each row ends in if the tree is cut at each of the depths and below nodes of fewer than ``min_split`` rows."""
        node, row, found = np.zeros(len(bins), np.int64), np.arange(len(bins)), {}
        inner = (self.feature >= 0) & (self.n >= min_split)
        for depth in range(max(depths) + 1):
            if depth in depths:
                found[depth] = node if depth == max(depths) else node.copy()
            row = row[inner[node[row]]]
            if not len(row):
                break
            if depth < max(depths):
                at = node[row]
                node[row] = self.left[at] + (bins[row, self.feature[at]] > self.cut[at])
        return {d: found.get(d, node) for d in depths}

    def importances(self, features: int) -> np.ndarray:
        """The share of each feature in what the splits take off the squared error."""
        split = np.flatnonzero(self.feature >= 0)
        left = self.left[split]
        fit = lambda i: self.g[i] ** 2 / self.n[i]
        gain = np.bincount(self.feature[split], fit(left) + fit(left + 1) - fit(split), features)
        return gain / gain.sum() if gain.sum() > 0 else gain


def leaf_value(spec: TreeSpec, g: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.rint(spec.step * shrunk(spec, g) / np.maximum(n + spec.ridge, 1e-12)).astype(np.int64)


def shrunk(spec: TreeSpec, g: np.ndarray) -> np.ndarray:
    """Gradient sums moved towards 0 by the absolute penalty (in the units of the sums)."""
    return g if not spec.lasso else np.sign(g) * np.maximum(np.abs(g) - spec.lasso, 0.0)


def best_splits(spec: TreeSpec, g: np.ndarray, n: np.ndarray, used: np.ndarray):
    """For histograms (node, feature, bin) of gradient sums and weights: feature (-1: none), cut, and sums left of the cut.

    Sums are whole numbers in double precision.  An empty side gives the score of not splitting, so it is never chosen.
    """
    total, count = g[:, 0].sum(axis=1), n[:, 0].sum(axis=1)
    gl, nl = np.cumsum(g[:, :, :-1], axis=2), np.cumsum(n[:, :, :-1], axis=2)
    gr, nr = total[:, None, None] - gl, count[:, None, None] - nl
    score = shrunk(spec, gl) ** 2 / np.maximum(nl + spec.ridge, 1e-12)
    score += shrunk(spec, gr) ** 2 / np.maximum(nr + spec.ridge, 1e-12)
    if spec.min_leaf > 1:
        score[np.minimum(nl, nr) < spec.min_leaf] = -np.inf
    if not used.all():
        score[:, ~used] = -np.inf
    flat = score.reshape(len(score), -1)
    at, row = flat.argmax(axis=1), np.arange(len(flat))
    whole = shrunk(spec, total) ** 2 / np.maximum(count + spec.ridge, 1e-12)
    feature, cut = at // score.shape[2], at % score.shape[2]
    left, left_n = gl[row, feature, cut], nl[row, feature, cut]
    good = (flat[row, at] > whole * (1 + 1e-12) + 1e-9) & (count >= spec.min_split) & (left_n > 0) & (left_n < count)
    return np.where(good, feature, -1), cut, left, left_n, total, count


def histograms(cells: np.ndarray, node: np.ndarray, g: np.ndarray, w: np.ndarray, nodes: int, features: int, n_bins: int):
    """(node, feature, bin) sums of g and w, which are whole numbers in double precision (exact: gradients have BITS bits, and
    a task's rows are far fewer than 2^(53 - BITS)); ``cells`` is feature * n_bins + bin of each row and feature."""
    at = (cells + (node * (features * n_bins))[:, None]).ravel()
    size = nodes * features * n_bins
    total, count = np.bincount(at, np.repeat(g, features), size), np.bincount(at, np.repeat(w, features), size)
    return total.reshape(nodes, features, n_bins), count.reshape(nodes, features, n_bins)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_weights(spec: TreeSpec, rid: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree sees each row."""
    if spec.boost and spec.rows >= 1:
        return np.ones(len(rid), np.int64)
    salt = mixed(np.array([spec.seed * 1_000_003 + tree + 1], np.uint64))
    draw = (mixed(rid.astype(np.int64).view(np.uint64) ^ salt) >> np.uint64(11)) / 2.0 ** 53
    if spec.boost:
        return (draw < spec.rows).astype(np.int64)
    poisson = np.cumsum([math.exp(-spec.rows) * spec.rows ** k / math.factorial(k) for k in range(16)])
    return np.searchsorted(poisson, draw, side="right")


def tree_columns(spec: TreeSpec, features: int, tree: int) -> np.ndarray:
    """The features a tree may split on."""
    keep = max(1, math.ceil(spec.columns * features))
    draw = mixed(np.arange(1, features + 1, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(spec.seed * 7919 + tree))
    used = np.zeros(features, bool)
    used[np.argsort(draw, kind="stable")[:keep]] = True
    return used


def grow_tree(spec: TreeSpec, bins: np.ndarray, y: np.ndarray, w: np.ndarray, used: np.ndarray, n_bins: int) -> Tree:
    """One tree on the rows of one task."""
    features = bins.shape[1]
    tree = Tree()
    row = np.flatnonzero(w)
    y, w = y[row].astype(np.float64), w[row].astype(np.float64)
    cells = bins[row].astype(np.int32) + (np.arange(features) * n_bins).astype(np.int32)
    front = tree.add(spec, (y * w).sum(keepdims=True), w.sum(keepdims=True))
    node = np.zeros(len(row), np.int64)
    at_once = max(1, LEVEL_CELLS // (features * n_bins))
    for _ in range(spec.depth):
        if not len(node):
            break
        order = np.argsort(node, kind="stable")
        cells, y, w, node = cells[order], y[order], w[order], node[order]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        # Nodes whose rows have one target are leaves; the others are numbered anew.
        mixed_nodes = np.minimum.reduceat(y, starts) < np.maximum.reduceat(y, starts)
        place = np.full(len(front), -1)
        place[node[starts[mixed_nodes]]] = np.arange(mixed_nodes.sum())
        front = front[node[starts[mixed_nodes]]]
        go = place[node] >= 0
        cells, y, w, node = cells[go], y[go], w[go], place[node[go]]
        n = len(front)
        if not n:
            break
        found = [np.zeros(n) for _ in range(6)]
        ends = np.searchsorted(node, np.arange(0, n + at_once, at_once))
        for k, a in enumerate(range(0, n, at_once)):
            here, b = slice(ends[k], ends[k + 1]), min(a + at_once, n)
            hist = histograms(cells[here], node[here] - a, y[here] * w[here], w[here], b - a, features, n_bins)
            for all_, part in zip(found, best_splits(spec, *hist, used)):
                all_[a:b] = part
        split = np.flatnonzero(found[0] >= 0)
        if not len(split):
            break
        feature, cut, gl, nl, gt, nt = (x[split] for x in found)
        new = tree.add(spec, np.stack([gl, gt - gl], axis=1).ravel(), np.stack([nl, nt - nl], axis=1).ravel())
        tree.feature[front[split]], tree.cut[front[split]], tree.left[front[split]] = feature, cut, new[::2]
        place = np.full(n, -1)
        place[split] = np.arange(len(split))
        node = place[node]
        go = node >= 0
        cells, y, w, node = cells[go], y[go], w[go], node[go]
        by, top = feature.astype(np.int64)[node], cut.astype(np.int64)[node]
        node, front = 2 * node + (cells[np.arange(len(node)), by] - by * n_bins > top), new
    return tree


class Model(NamedTuple):
    base: int
    trees: list[Tree]

    def predict(self, spec: TreeSpec, bins: np.ndarray) -> np.ndarray:
        """Fixed-point predictions."""
        total = np.zeros(len(bins), np.int64)
        for t in self.trees:
            if len(t.value):
                total += t.value[t.leaves(bins)]
        return self.base + (total if spec.boost else total / max(1, len(self.trees)))


def grown_trees(spec: TreeSpec, bins: np.ndarray, y: np.ndarray, rid: np.ndarray, base: int, numbers: Sequence[int],
                n_bins: int = MAX_BINS) -> Iterator[Tree]:
    """The trees of these numbers on the rows of one task, one after the other (boosting: from 0 on)."""
    n_bins, rest = min(n_bins, int(bins.max(initial=0)) + 2), y - base
    for k in numbers:
        tree = grow_tree(spec, bins, rest, row_weights(spec, rid, k), tree_columns(spec, bins.shape[1], k), n_bins)
        yield tree
        if spec.boost:
            rest = rest - tree.value[tree.leaves(bins)]


def fit_trees(spec: TreeSpec, bins: np.ndarray, y: np.ndarray, rid: np.ndarray, n_bins: int = MAX_BINS) -> Model:
    """All trees of one model on the rows of one task; ``y`` in fixed point."""
    base = int(y.sum()) // len(y)
    return Model(base, list(grown_trees(spec, bins, y, rid, base, range(spec.n_trees), n_bins)))


def shared_trees(spec: TreeSpec) -> TreeSpec:
    """What models whose trees can be grown once have in common: all but the number of trees; of forests also not depth and rows to split."""
    return spec._replace(n_trees=0) if spec.boost else spec._replace(n_trees=0, depth=0, min_split=0)


def predictions_shared(specs: Mapping[str, TreeSpec], bins: np.ndarray, y: np.ndarray, rid: np.ndarray, asked: np.ndarray) -> dict[str, np.ndarray]:
    """Fixed-point predictions of models with the same ``shared_trees`` for the rows ``asked``, as ``Model.predict`` gives them."""
    most = {f: max(getattr(s, f) for s in specs.values()) for f in ("n_trees", "depth")}
    spec = next(iter(specs.values()))._replace(**most, min_split=min(s.min_split for s in specs.values()))
    base, totals = int(y.sum()) // len(y), {name: np.zeros(len(asked), np.int64) for name in specs}
    for k, tree in enumerate(grown_trees(spec, bins, y, rid, base, range(spec.n_trees))):
        there = {name: s for name, s in specs.items() if k < s.n_trees}
        for split in {s.min_split for s in there.values()} if len(tree.value) else ():
            same = {name: s.depth for name, s in there.items() if s.min_split == split}
            leaves = tree.leaves_cut(asked, sorted(set(same.values())), split)
            for name, depth in same.items():
                totals[name] += tree.value[leaves[depth]]
    return {name: base + (totals[name] if s.boost else totals[name] / max(1, s.n_trees)) for name, s in specs.items()}


# --- training sets spread over tasks -----------------------------------------------------------------------------------

def _by_model(batch: pa.RecordBatch, features: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    model = batch.column(0).to_numpy()
    for m in np.unique(model).tolist():
        rows = batch.filter(pa.array(model == m))
        yield m, rows, _grid(rows.column(batch.schema.names.index("_bins")), features)


def _grid(column: pa.Array, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), features)


def fit_trees_spread(rows: DataFrame, spec: TreeSpec, features: int, n_bins: int = MAX_BINS) -> dict[int, Model]:
    """Models of training rows (_model int, _rid, _bins, _y), grown together level by level.

    The driver holds the models: nodes of trees, never rows.  Boosting writes its state, one number per row and model,
    after each round.
    """
    sums = rows.groupBy("_model").agg(F.sum(F.col("_y").cast("decimal(38,0)")).alias("y"), F.count("*").alias("n")).collect()
    models = {r["_model"]: Model(int(r["y"]) // r["n"], []) for r in sums}
    context = rows.sparkSession.sparkContext
    if not models:
        return models
    base = F.create_map(*[F.lit(x) for m, v in models.items() for x in (m, v.base)]).cast("map<int,bigint>")
    state = cut_lineage(rows.select("_model", "_rid", "_bins", (F.col("_y") - base[F.col("_model")]).alias("_rest")))
    at_once = 1 if spec.boost else TREES_AT_ONCE
    for first in range(0, spec.n_trees, at_once):
        numbers = range(first, min(first + at_once, spec.n_trees))
        growing = {(m, k): Tree() for m in models for k in numbers}
        fronts = {x: None for x in growing}                      # None: the root has no node yet
        for _ in range(spec.depth):
            if not fronts:
                break
            splits = _level(state, context.broadcast((growing, fronts)), spec, features, n_bins).collect()
            fronts = _grown(spec, growing, fronts, splits)
        for (m, _), tree in sorted(growing.items()):
            models[m].trees.append(tree)
        if spec.boost:
            state = _boosted(state, context.broadcast(growing), features)
    return models


def _level(state: DataFrame, shared, spec: TreeSpec, features: int, n_bins: int) -> DataFrame:
    """(model, tree, node, feature, cut, gl, nl, g, n) of the best split of every node of the fronts (feature -1: none)."""
    width = features * n_bins

    def count(batches):
        growing, fronts = shared.value
        sums: dict = {}

        def rows_of():
            for (m, k), (g, n) in sums.items():
                node, cell = np.divmod(np.flatnonzero(n), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(node), m, np.int32)), pa.array(np.full(len(node), k, np.int32)), pa.array(node.astype(np.int32)),
                     pa.array(cell.astype(np.int32)), pa.array(g[n > 0].astype(np.int64)), pa.array(n[n > 0].astype(np.int64))],
                    ["m", "k", "node", "cell", "g", "n"])
            sums.clear()

        held = 0
        for batch in batches:
            for m, rows, bins in _by_model(batch, features):
                cells = bins.astype(np.int64) + np.arange(features) * n_bins
                rid, rest = rows.column(1).to_numpy(), rows.column(3).to_numpy()
                for k in [k for (x, k) in fronts if x == m]:
                    front = fronts[m, k]
                    w = row_weights(spec, rid, k)
                    node = np.zeros(len(rid), np.int64)
                    if front is not None:
                        place = np.full(len(growing[m, k].value), -1)
                        place[front] = np.arange(len(front))
                        node = place[growing[m, k].leaves(bins)]
                    here = np.flatnonzero((node >= 0) & (w > 0))
                    if not len(here):
                        continue
                    nodes = 1 if front is None else len(front)
                    g, n = histograms(cells[here], node[here], (rest * w)[here].astype(np.float64), w[here].astype(np.float64),
                                      nodes, features, n_bins)
                    old = sums.get((m, k))
                    if old is None:
                        sums[m, k] = g.ravel(), n.ravel()
                        held += g.size
                    else:
                        old[0][:] += g.ravel()
                        old[1][:] += n.ravel()
                    if held > SENT_CELLS:
                        yield from rows_of()
                        held = 0
        yield from rows_of()

    cells = state.mapInArrow(count, "m int, k int, node int, cell int, g bigint, n bigint")
    cells = cells.groupBy("m", "k", "node", "cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))

    def best(key, table):
        g, n = np.zeros((2, width))
        at = table.column("cell").to_numpy()
        g[at], n[at] = table.column("g").to_numpy(), table.column("n").to_numpy()
        shape = (1, features, n_bins)
        used = tree_columns(spec, features, key[1].as_py())
        found = best_splits(spec, g.reshape(shape), n.reshape(shape), used)
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([int(x[0])], pa.int64()) for x in found],
                        names=["m", "k", "node", "feature", "cut", "gl", "nl", "g", "n"])
    return cells.groupBy("m", "k", "node").applyInArrow(
        best, "m int, k int, node int, feature bigint, cut bigint, gl bigint, nl bigint, g bigint, n bigint")


def _grown(spec: TreeSpec, growing: dict, fronts: dict, splits: list) -> dict:
    """Applies the splits of a level to the trees; returns the fronts that go on."""
    new: dict = {}
    for s in sorted(splits, key=lambda s: (s["m"], s["k"], s["node"])):
        x = s["m"], s["k"]
        tree = growing[x]
        if fronts[x] is None:
            tree.add(spec, np.array([s["g"]]), np.array([s["n"]]))
        if s["feature"] < 0:
            continue
        node = 0 if fronts[x] is None else fronts[x][s["node"]]
        both = tree.add(spec, np.array([s["gl"], s["g"] - s["gl"]]), np.array([s["nl"], s["n"] - s["nl"]]))
        tree.feature[node], tree.cut[node], tree.left[node] = s["feature"], s["cut"], both[0]
        new.setdefault(x, []).extend(both.tolist())
    return {x: np.array(f) for x, f in new.items()}


def _boosted(state: DataFrame, shared, features: int) -> DataFrame:
    """The state without what the round's trees explain."""
    def run(batches):
        trees = {m: t for (m, _), t in shared.value.items()}
        for batch in batches:
            for m, rows, bins in _by_model(batch, features):
                rest = rows.column(3).to_numpy()
                if len(trees[m].value):
                    rest = rest - trees[m].value[trees[m].leaves(bins)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(rest)],
                                                 ["_model", "_rid", "_bins", "_rest"])
    return cut_lineage(state.mapInArrow(run, "_model int, _rid bigint, _bins binary, _rest bigint"))


# --- frames ------------------------------------------------------------------------------------------------------------

def binned(df: DataFrame, features: Sequence[str], ids: Sequence[str], target: str, n_bins: int = MAX_BINS) -> DataFrame:
    """``df`` with its features as one byte each in ``_bins``, a row id ``_rid`` from ``ids`` and no feature columns.

    Edges are quantiles of all rows (n_bins - 2 of them at most to a feature, taken to the driver): feature values only,
    no target enters.
    """
    features = list(features)
    steps = [k / (n_bins - 1) for k in range(1, n_bins - 1)]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, F.lit(100 * n_bins)).alias(f"c{i}")
                     for i, c in enumerate(features)]).first()
    edges = [np.unique(np.array(found[i] or [], np.float64)) for i in range(len(features))]
    keep = [c for c in df.columns if c not in features or c in ids or c == target]
    rows = df.select(*keep, F.xxhash64(*ids).alias("_rid"), *[F.col(c).cast("double").alias(f"_b{i}") for i, c in enumerate(features)])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), "_rid bigint", "_bins binary"])

    def run(batches):
        for batch in batches:
            n = len(batch.schema.names) - len(features)
            codes = np.zeros((batch.num_rows, len(features)), np.uint8)
            for i, cuts in enumerate(edges):
                x = batch.column(n + i).to_numpy(zero_copy_only=False).astype(np.float64)
                codes[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts, x, side="left"))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array([r.tobytes() for r in codes], pa.binary())],
                                             [*batch.schema.names[:n], "_bins"])
    return rows.mapInArrow(run, schema)


def fixed_scale(top: float | None) -> float:
    """What targets up to ``top`` are multiplied by to become fixed-point integers."""
    return 2.0 ** (BITS - math.ceil(math.log2(top or 1.0)) - 1)


def packed(rows: DataFrame, fold: str, target: str, scale: float) -> DataFrame:
    """``binned`` rows in blocks (fold, n, bins, rid, y, actual): the rows of a batch and fold side by side in bytes."""
    rows = rows.select(F.col(fold).cast("int").alias("fold"), "_bins", "_rid", F.round(F.col(target).cast("double") * F.lit(scale)).cast("bigint").alias("y"),
                       F.col(target).cast("double").alias("actual")).where("fold is not null and y is not null")

    def run(batches):
        for batch in batches:
            folds = batch.column(0).to_numpy()
            for f in np.unique(folds).tolist():
                bins, *numbers = batch.filter(pa.array(folds == f)).columns[1:]
                values = [f, len(bins), b"".join(bins.to_pylist()), *(x.to_numpy().tobytes() for x in numbers)]
                types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["fold", "n", "bins", "rid", "y", "actual"])
    return rows.mapInArrow(run, "fold int, n int, bins binary, rid binary, y binary, actual binary")


def _unpacked(table: pa.Table, features: int):
    """Fold, bins, row ids, fixed-point targets and targets of the rows of blocks."""
    column = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    fold = np.repeat(table.column("fold").to_numpy(), table.column("n").to_numpy())
    return fold, column("bins", np.uint8).reshape(len(fold), features), column("rid", np.int64), column("y", np.int64), column("actual", np.float64)


def _dealt(blocks: DataFrame, units: int) -> DataFrame:
    """All blocks for each unit of work; a unit is seconds or minutes of work on little input, so units are spread by their number."""
    return blocks.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1))))


def fold_errors(rows: DataFrame, specs: Mapping[str, TreeSpec], n_features: int, target: str, k: int,
                cells: int = PACKED_CELLS) -> DataFrame | None:
    """(model, variant, n, error) of every model and fold 0 to k - 1: mean squared error on the rows of the fold, learnt from those before.

    ``rows`` is one training set as in ``fit_predict``.  A task takes the rows up to one fold and grows the trees of all models that
    share them.  None if the set has more than ``cells`` binned values.
    """
    size = rows.agg(F.max(F.abs(F.col(target).cast("double"))).alias("top"), F.count("*").alias("n")).first()
    if size["n"] * n_features > cells:
        return None
    scale = fixed_scale(size["top"])
    families: dict = {}
    for name, s in specs.items():
        families.setdefault(shared_trees(s), {})[name] = s._replace(lasso=s.lasso * scale)
    members = list(families.values())

    def run(key, table):
        i, v = divmod(key[0].as_py(), k)
        fold, bins, rid, y, actual = _unpacked(table, n_features)
        learn, ask, out = fold < v, fold == v, []
        if learn.any() and ask.any():
            for name, pred in predictions_shared(members[i], bins[learn], y[learn], rid[learn], bins[ask]).items():
                # Summed in order of size: how the rows are dealt does not show.
                out.append((name, v, int(ask.sum()), float(np.sort((pred / scale - actual[ask]) ** 2).sum() / ask.sum())))
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate([pa.string(), pa.int32(), pa.int64(), pa.float64()])],
                        names=["model", "variant", "n", "error"])

    units = len(members) * k
    work = _dealt(packed(rows, "fold", target, scale), units).where(F.col("unit") % k >= F.col("fold")).repartition(4 * units, "unit")
    return work.groupBy("unit").applyInArrow(run, "model string, variant int, n bigint, error double")


def forest_importances(rows: DataFrame, spec: TreeSpec, features: Sequence[str], target: str, cells: int = PACKED_CELLS) -> DataFrame | None:
    """(feature, importance) of a forest on the ``binned`` rows: the mean of its trees' shares of the error taken off.

    Each task grows TREES_A_TASK trees and returns one number per tree and feature.  None if there are more than ``cells`` binned values.
    """
    features = list(features)
    size = rows.agg(F.max(F.abs(F.col(target).cast("double"))).alias("top"), F.count(target).alias("n")).first()
    if size["n"] * len(features) > cells:
        return None

    def run(key, table):
        first = key[0].as_py() * TREES_A_TASK
        _, bins, rid, y, _ = _unpacked(table, len(features))
        base, numbers = int(y.sum()) // len(y), range(first, min(first + TREES_A_TASK, spec.n_trees))
        found = [tree.importances(len(features)) for tree in grown_trees(spec, bins, y, rid, base, numbers)]
        return pa.table([np.repeat(np.array(numbers, np.int32), len(features)), pa.array(features * len(found)), np.concatenate(found)],
                        names=["tree", "feature", "importance"])

    units = math.ceil(spec.n_trees / TREES_A_TASK)
    blocks = packed(rows.withColumn("_fold", F.lit(0)), "_fold", target, fixed_scale(size["top"]))
    trees = _dealt(blocks, units).repartition(4 * units, "unit").groupBy("unit").applyInArrow(run, "tree int, feature string, importance double")
    # Rounded sums of whole trees: the order in which they come does not show.
    return trees.groupBy("feature").agg(F.sum(F.col("importance").cast("decimal(28,18)")).cast("double").alias("importance")).withColumn(
        "importance", F.col("importance") / F.lit(float(spec.n_trees)))


def fit_predict(rows: DataFrame, specs: Mapping[str, TreeSpec], n_features: int, by: Sequence[str], ids: Sequence[str],
                target: str, variants: Mapping[str, Sequence[int]], local_cells: int = LOCAL_CELLS) -> DataFrame:
    """Predictions (by..., ids..., model, variant, role, pred) of every model and variant of every training set.

    ``rows`` has the columns of ``binned``, ``by`` (they name a training set), ``role`` (``train`` or ``test``) and ``fold``
    (the fold a training row validates, -1 before the first, null: in no fold).  Variant FULL learns from all training rows with
    a target and predicts the test rows; variant i learns from the rows before fold i and predicts that fold and the test rows.
    """
    by, ids = list(by), list(ids)
    scale = fixed_scale(rows.agg(F.max(F.abs(F.col(target).cast("double")))).first()[0])
    specs = {name: s._replace(lasso=s.lasso * scale) for name, s in specs.items()}
    y = F.col(target).cast("double")
    rows = rows.select(*by, *ids, "role", "fold", "_rid", "_bins", F.round(y * F.lit(scale)).cast("bigint").alias("_y"))
    rows = cut_lineage(rows.where((F.col("role") == "test") | F.col("_y").isNotNull()))
    sizes = rows.groupBy(*by).count()
    large = F.col("count") * n_features > local_cells
    named = [f for f in rows.schema.fields if f.name in (*by, *ids)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in named),
                        "model string, variant int, role string, pred double"])
    work = F.explode(F.array(*[F.lit(m) for m in specs])).alias("model")
    small = join_null_safe(rows, sizes.where(~large).select(*by), by, "left_semi").select("*", work)

    def one_task(table):
        kind = table.column("model")[0].as_py()
        spec, out = specs[kind], []
        bins = _grid(table.column("_bins").combine_chunks(), n_features)
        test = table.column("role").to_numpy(zero_copy_only=False) == "test"
        fold = table.column("fold").to_numpy(zero_copy_only=False).astype(np.float64)
        y = table.column("_y").fill_null(0).to_numpy()
        rid = table.column("_rid").to_numpy()
        for v in variants[kind]:
            learn = ~test if v == FULL else ~test & (fold < v)
            ask = test if v == FULL else test | (fold == v)
            if not learn.any() or not ask.any():
                continue
            model = fit_trees(spec, bins[learn], y[learn], rid[learn])
            asked = table.select([f.name for f in named]).filter(pa.array(ask))
            n = asked.num_rows
            out.append(pa.table([*asked.columns, pa.array([kind] * n), pa.array([v] * n, pa.int32()),
                                 table.column("role").filter(pa.array(ask)), pa.array(model.predict(spec, bins[ask]) / scale)],
                                names=[*asked.schema.names, "model", "variant", "role", "pred"]))
        blank = pa.table([pa.array([], table.schema.field(f.name).type) for f in named] + [
            pa.array([], t) for t in (pa.string(), pa.int32(), pa.string(), pa.float64())],
            names=[*(f.name for f in named), "model", "variant", "role", "pred"])
        return pa.concat_tables([blank, *out])

    result = small.groupBy(*by, "model").applyInArrow(one_task, schema)
    if sizes.where(large).take(1):
        result = result.unionByName(_spread(rows, sizes.where(large).select(*by), specs, n_features, by, named, variants, scale, schema))
    return result


def _spread(rows: DataFrame, sets: DataFrame, specs, n_features: int, by: list[str], named, variants, scale: float, schema: str) -> DataFrame:
    """``fit_predict`` for training sets beyond one task: there are few, as each is large."""
    spark = rows.sparkSession
    listed = sets.orderBy(*by).collect()
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(listed)],
                                     StructType([StructField("_number", IntegerType()), *sets.schema.fields]))
    rows = cut_lineage(join_null_safe(rows, numbered, by))
    out = None
    for kind, spec in specs.items():
        n = len(variants[kind])
        which = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(variants[kind])])).alias("_w")
        each = rows.select("*", which).withColumn("_model", (F.col("_number") * n + F.col("_w.i")).cast("int"))
        v = F.col("_w.v")
        test = F.col("role") == "test"
        learn = each.where(~test & ((v == FULL) | (F.col("fold") < v))).select("_model", "_rid", "_bins", "_y")
        shared = spark.sparkContext.broadcast(fit_trees_spread(learn, spec, n_features))
        ask = each.where(test | ((v != FULL) & (F.col("fold") == v))).select(
            "_model", "_bins", *[f.name for f in named], F.lit(kind).alias("model"), v.cast("int").alias("variant"), "role")

        def run(batches, shared=shared, spec=spec):
            for batch in batches:
                for m, part, bins in _by_model(batch, n_features):
                    if m in shared.value:
                        pred = shared.value[m].predict(spec, bins) / scale
                        yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(pred, pa.float64())], [*part.schema.names[2:], "pred"])
        done = ask.mapInArrow(run, schema)
        out = done if out is None else out.unionByName(done)
    return out
