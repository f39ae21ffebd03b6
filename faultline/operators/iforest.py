"""Isolation forest (guard layer 3) on Spark — MLlib has none.

Fit
---
* A row belongs to a tree if a hash of (row key, tree, seed) falls below
  ``max_samples``: every tree sees that share of all rows, whatever their number.
* Trees grow level by level, all trees of all forests together, or as many at a time as keep
  the nodes of a partition's rows within ``NODE_BYTES``. The rows are dealt
  evenly and written once; blocks of them carry the node that each row has reached in
  every tree, and a pass moves these trees one step on. It keeps count, minimum and
  maximum of each feature for each (tree, node), per task first; those of all
  tasks, whose number does not grow with the rows, are joined on the executors and come to the driver once, their size depends only on the trees. The driver then draws feature and threshold of each node
  by md5 of (seed, tree, node). So the fitted trees depend neither on partitions
  nor on the machine, and SQL can replay them.
* ``max_depth`` bounds the model, the same for every table: a node table of at
  most trees x 2^(max_depth + 1) rows.

Score
-----
The trees are broadcast once; one Arrow function over a struct of the features
returns the scores of all forests. ``score = 2^(-E[h]/c(psi))``; ``decision =
-score - offset`` where ``offset`` is the exact contamination quantile of
``-score`` over the training rows; a row is an anomaly when ``decision < 0``.
Scores are rounded to nine decimals, so that the order of a sum never decides.
Rows with a missing feature have no score and are no anomaly; infinite values
are left out of the fit.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.draws import TWO_52, hash60
from faultline.operators.quantiles import select_quantiles
from faultline.operators.sums import summed
from faultline.schema import KEY
from faultline.session import cut_lineage, ship_package

EULER = 0.5772156649015329
MAX_DEPTH = 8
#: Modulus of the hashes that deal rows to trees; the node number of rows that have left a tree.
PRIME, SETTLED = (1 << 31) - 1, (1 << 16) - 1
#: Rows of a block, and how many partitions send their ranges straight to the driver (those of more are joined first, by so many parts of the trees).
ROWS_A_BLOCK, FEW_PARTITIONS, PARTS = 50_000, 2, 8
#: Partitions at most, unless more tasks run at once: each gives its ranges of all nodes (21 MB in a fit of 350 trees) once, however many blocks it has.
MOST_PARTITIONS = 24
#: Bytes of nodes that the rows of a partition carry at most: more trees wait for the next turn. Two turns' worth is kept at a time.
NODE_BYTES = 128 << 20


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def row_hash(key: Column) -> Column:
    """31-bit hash of a row's key."""
    return hash60(key) % F.lit(PRIME)


def _md5_bits(text: str, digits: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def members(row: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows belong to a tree: a line modulo a prime, drawn for the tree, puts the row's hash below the share."""
    a, b = 1 + _md5_bits(f"{seed}|{tree}|a", 15) % (PRIME - 1), _md5_bits(f"{seed}|{tree}|b", 15) % PRIME
    return (row * a + b) % PRIME < math.floor(min(1.0, share) * PRIME)


def node_draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two numbers in [0, 1): which usable feature a node splits, and where."""
    return tuple(_md5_bits(f"{seed}|{tree}|{node}|{what}", 13) / TWO_52 for what in ("feature", "cut"))


@dataclass
class IsolationForestModel:
    """Trees as complete binary trees (heap layout: children of p are 2p+1 and 2p+2).

    ``feature`` is -1 for a leaf or an absent node; ``size`` counts the training rows of a node.
    """

    features: list
    feature: np.ndarray
    threshold: np.ndarray
    size: np.ndarray
    psi: int
    max_depth: int = MAX_DEPTH
    offset: float | None = None
    contamination: float = 0.05
    scale: dict | None = None  # feature -> (median, iqr)

    @property
    def n_trees(self) -> int:
        return len(self.feature)

    @property
    def nodes(self) -> pd.DataFrame:
        """Present nodes: tree, node, feature, threshold, size, depth."""
        tree, node = np.nonzero(self.size)
        return pd.DataFrame({"tree": tree.astype("int32"), "node": node.astype("int32"), "feature": self.feature[tree, node].astype("int32"),
                             "threshold": self.threshold[tree, node], "size": self.size[tree, node].astype("int64"),
                             "depth": np.floor(np.log2(node + 1)).astype("int32")})

    def leaf_values(self) -> np.ndarray:
        """Path length that a row gets for each slot of the deepest level; a leaf above it fills its left spine."""
        first = 2 ** self.max_depth - 1
        depth = np.floor(np.log2(np.arange(self.feature.shape[1]) + 1))
        value = depth[None, :] + c_factor(self.size)
        out = np.zeros((self.n_trees, first + 1))
        out[:] = value[:, first:]
        for p in range(first - 1, -1, -1):
            leaf = self.feature[:, p] < 0
            spine = p
            while spine < first:
                spine = 2 * spine + 1
            out[leaf, spine - first] = value[leaf, p]
        return out

    def transform(self, df: DataFrame, flag: str = "l3_isolation", score: str = "anomaly_score") -> DataFrame:
        decision = -score_many(df, [self])["s0"] - F.lit(self.offset)
        return _with_decision(df, decision, decision < 0, flag, score)


def _with_decision(df: DataFrame, decision, is_anomaly, flag: str, score: str) -> DataFrame:
    return df.withColumns({score: decision, flag: F.coalesce(is_anomaly, F.lit(False))})


def _walk(xt: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row after ``levels`` steps down one tree; a leaf above is followed down its left spine."""
    values, rows = xt.ravel(), np.arange(xt.shape[1])
    start, cut = np.maximum(feature, 0).astype(np.intp) * len(rows), np.where(feature >= 0, threshold, np.nan)
    node = np.zeros(len(rows), np.intp)
    for _ in range(levels):
        right = values.take(start.take(node) + rows) >= cut.take(node)
        node = 2 * node + 1 + right
    return node


def score_many(df: DataFrame, models: list[IsolationForestModel]):
    """Struct column with the score of each model (s0, s1, ...; higher is more anomalous), null where a feature is missing."""
    ship_package(df.sparkSession)
    features = models[0].features
    packs = [(m.feature, m.threshold, m.leaf_values(), m.max_depth, float(c_factor([m.psi])[0]),
              np.array([(m.scale or {}).get(f, (0.0, 1.0)) for f in features]).T) for m in models]
    shared = df.sparkSession.sparkContext.broadcast(packs)

    @F.pandas_udf(", ".join(f"s{i} double" for i in range(len(models))))
    def score(rows: pd.DataFrame) -> pd.DataFrame:
        raw = rows.to_numpy(dtype=float)
        out = {}
        for i, (feature, threshold, leaves, depth, c, (middle, width)) in enumerate(shared.value):
            xt = np.ascontiguousarray(((raw - middle) / width).T)
            first = 2 ** depth - 1
            total = np.zeros(len(raw))
            for t in range(len(feature)):
                total += leaves[t, _walk(xt, feature[t], threshold[t], depth) - first]
            s = np.power(2.0, -total / len(feature) / c) if c > 0 else np.ones(len(raw))
            out[f"s{i}"] = pd.Series(s.round(9)).where(~np.isnan(raw).any(axis=1))
        return pd.DataFrame(out)

    return score(F.struct(*[F.col(f).cast("double").alias(f) for f in features]))


@dataclass
class _Block:
    """Some rows: (rows, features) values, the (tree, row) nodes they have reached, counted within the level, and both ends of each feature's order."""

    x: np.ndarray
    node: np.ndarray
    ends: tuple | None = None


def _ends_of(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows with the least (ascending) and the greatest (descending) values of each feature, ``most`` at most."""
    order = np.argsort(x, axis=0).T.astype(np.int32)
    return order[:, :most].copy(), order[:, :-most - 1:-1].copy()


def _blocks(rows: DataFrame, names: list, trees: list[tuple], levels: int):
    """RDD of blocks; a row that is no member of a tree counts as settled there."""
    ends = _ends(2 ** levels)
    schema, most = pa.schema([("x", pa.binary()), ("h", pa.binary())]), ROWS_A_BLOCK

    def packed(held):
        x, h = (np.concatenate(v).tobytes() for v in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([x]), pa.array([h])], schema=schema)

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            held.append((np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in names], axis=1).astype("<f8"), batch.column("__h").to_numpy().astype("<i8")))
            n += batch.num_rows
            if n >= most:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def unpack(r):
        x, h = np.frombuffer(r.x, "<f8").reshape(-1, len(names)), np.frombuffer(r.h, "<i8")
        return _Block(x, np.stack([np.where(members(h, tree, seed, share), 0, SETTLED).astype(np.uint16) for tree, seed, share in trees]), _ends_of(x, ends))

    return rows.mapInArrow(pack, "x binary, h binary").rdd.map(unpack)


def _step(b: _Block, feature: np.ndarray, threshold: np.ndarray) -> _Block:
    """All trees one level down; rows at a leaf settle."""
    width = feature.shape[1]
    values, rows, moved = np.ascontiguousarray(b.x.T).ravel(), np.arange(len(b.x)), np.empty_like(b.node)
    for t, node in enumerate(b.node):
        f, cut = np.append(feature[t], -1), np.append(threshold[t], np.nan)
        at = np.minimum(node, width).astype(np.intp)  # the slot behind the last is that of settled rows
        right = values.take((np.maximum(f, 0) * len(rows)).take(at) + rows) >= cut.take(at)
        moved[t] = np.where((f >= 0).take(at), 2 * at + right, SETTLED)
    return _Block(b.x, moved, b.ends)


def _by_sorting(x: np.ndarray, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    """Sets minima and maxima of the features of every node that occurs."""
    order = np.argsort(node, kind="stable")
    node, x = node[order], x[order]
    at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    lo[node[at]], hi[node[at]] = np.minimum.reduceat(x, at, axis=0), np.maximum.reduceat(x, at, axis=0)


def _ends(width: int) -> int:
    """Rows at each end of a feature's order that are looked at for the ranges of so many nodes."""
    return 8 * width + 256


def _ranges(blocks, trees: int, width: int, d: int):
    """(part, (count, minima and maxima of the features by (tree, node)) of its trees) of one partition.

    Most nodes have rows among the first and the last of each feature's order, and the
    first or last of them is the minimum or maximum; the rows of other nodes are sorted by node.
    """
    n, lo, hi = np.zeros((trees, width), np.int64), np.full((trees, width, d), np.inf), np.full((trees, width, d), -np.inf)
    ends = _ends(width)
    for b in blocks:
        first, last = (side[:, :ends][:, ::-1].astype(np.intp) for side in b.ends or _ends_of(b.x, ends))  # the outermost are the last to be set
        low, high = [b.x[at, f] for f, at in enumerate(first)], [b.x[at, f] for f, at in enumerate(last)]
        for t in range(trees):
            node = np.minimum(b.node[t], width).astype(np.intp)
            count = np.bincount(node, minlength=width + 1)
            mine_lo, mine_hi = np.full((d, width + 1), np.inf), np.full((d, width + 1), -np.inf)
            for f in range(d):
                mine_lo[f, node.take(first[f])] = low[f]  # the last of equal places stays
                mine_hi[f, node.take(last[f])] = high[f]
            unseen = (np.isinf(mine_lo) | np.isinf(mine_hi)).any(axis=0) & (count > 0)
            unseen[width] = False
            mine_lo, mine_hi = mine_lo.T, mine_hi.T
            if unseen.any():
                rest = np.flatnonzero(unseen.take(node))
                _by_sorting(b.x[rest], b.node[t, rest], mine_lo, mine_hi)
            n[t] += count[:width]
            lo[t], hi[t] = np.minimum(lo[t], mine_lo[:width]), np.maximum(hi[t], mine_hi[:width])
    for part in range(PARTS):
        yield part, (n[part::PARTS], lo[part::PARTS], hi[part::PARTS])


def _both(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])


def _grow(rows: DataFrame, features: list, trees: list[tuple], max_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tree, node) sizes, features and thresholds of trees (number, seed, share) on the same rows, a pass a level for all of them."""
    d, slots = len(features), 2 ** (max_depth + 1) - 1
    sizes, splits, cuts = np.zeros((len(trees), slots), np.int64), np.full((len(trees), slots), -1, np.int32), np.zeros((len(trees), slots))
    state, older = _blocks(rows, features, trees, max_depth).persist(StorageLevel.MEMORY_AND_DISK), []
    for level in range(max_depth + 1):
        width, first = 2 ** level, 2 ** level - 1
        found = state.mapPartitions(lambda bs, width=width: _ranges(bs, len(trees), width, d))
        size, lo, hi = np.zeros((len(trees), width), np.int64), np.zeros((len(trees), width, d)), np.zeros((len(trees), width, d))
        for part, got in summed(found, _both, FEW_PARTITIONS).items():
            size[part::PARTS], lo[part::PARTS], hi[part::PARTS] = got
        feature, threshold = np.full(size.shape, -1, np.int64), np.zeros(size.shape)
        if level < max_depth:
            usable = (hi > lo) & (size > 1)[..., None]
            t, k = np.nonzero(usable.any(axis=-1))
            u = np.array([node_draws(trees[i][1], trees[i][0], first + int(j)) for i, j in zip(t, k)]).reshape(-1, 2)
            mask = usable[t, k]
            f = (mask.cumsum(axis=1) > np.floor(u[:, 0] * mask.sum(axis=1))[:, None]).argmax(axis=1)
            low, high = lo[t, k, f], hi[t, k, f]
            cut = low + u[:, 1] * (high - low)
            feature[t, k], threshold[t, k] = f, np.where(cut > low, cut, high)
        for whole, now in ((sizes, size), (splits, feature), (cuts, threshold)):
            whole[:, first:first + width] = now
        if not (feature >= 0).any():
            break
        older.append(state)
        state = state.map(lambda b, feature=feature, threshold=threshold: _step(b, feature, threshold)).persist(StorageLevel.MEMORY_AND_DISK)
        while len(older) > 1:  # the one before is still needed until the next pass
            older.pop(0).unpersist()
    for s in [*older, state]:
        s.unpersist()
    return sizes, splits, cuts


def _fit_many(df: DataFrame, features: list, specs: list[tuple], key: str, robust: bool, max_depth: int) -> list[IsolationForestModel]:
    """Fit several forests on the same rows. ``specs``: (n_trees, max_samples, contamination, seed)."""
    spark = df.sparkSession
    if not 0 < max_depth < 16:
        raise ValueError("max_depth must be between 1 and 15: nodes of a level are counted in two bytes")
    ship_package(spark)
    finite = [F.when(F.abs(F.col(f).cast("double")) < math.inf, F.col(f).cast("double")).alias(f) for f in features]
    # written once: no null test of the features is carried into the expressions of ``df``, which would be evaluated for each of them
    clean = cut_lineage(df.select(row_hash(F.col(key)).alias("__h"), *finite)).dropna(subset=features)
    n = clean.count()
    partitions = max(spark.sparkContext.defaultParallelism, min(MOST_PARTITIONS, -(-n // ROWS_A_BLOCK)))
    clean = cut_lineage(clean.repartition(partitions, "__h", *features))
    scale = None
    if robust:
        found = select_quantiles(clean, {f: F.col(f) for f in features}, [0.25, 0.5, 0.75])[None]
        scale = {f: (q[1] or 0.0, (q[2] - q[0]) if q[2] is not None and q[2] > q[0] else 1.0) for f, q in found.items()}
    rows = clean.select("__h", *[((F.col(f) - F.lit(scale[f][0])) / F.lit(scale[f][1])).alias(f) if scale else F.col(f) for f in features])
    slots = 2 ** (max_depth + 1) - 1
    models = [IsolationForestModel(features, np.full((trees, slots), -1, np.int32), np.zeros((trees, slots)), np.zeros((trees, slots), np.int64),
                                   max(2, int(share * n)), max_depth, None, contamination, scale) for trees, share, contamination, _ in specs]
    trees = [(t, seed, share) for count, share, _, seed in specs for t in range(count)]
    starts = np.cumsum([0, *[s[0] for s in specs]])
    at_once = max(1, NODE_BYTES // (2 * max(1, -(-n // partitions))))
    for i in range(0, len(trees) if n else 0, at_once):
        grown = _grow(rows, features, trees[i:i + at_once], max_depth)
        for t, (size, feature, threshold) in enumerate(zip(*grown), i):
            k = int(np.searchsorted(starts, t, side="right")) - 1
            models[k].size[t - starts[k]], models[k].feature[t - starts[k]], models[k].threshold[t - starts[k]] = size, feature, threshold
    # offsets: the contamination quantiles of -score over the training rows, scored once
    both = cut_lineage(clean.select(score_many(clean, models).alias("s")).select("s.*"))
    found = select_quantiles(both, {f"s{i}": -F.col(f"s{i}") for i in range(len(models))}, sorted({s[2] for s in specs}))[None]
    at = sorted({s[2] for s in specs})
    for i, m in enumerate(models):
        value = found[f"s{i}"][at.index(m.contamination)]
        m.offset = float(value) if value is not None else 0.0
    return models


def fit_forest(df: DataFrame, features, n_trees: int = 200, max_samples: float = 0.8, contamination: float = 0.05, seed: int = 42,
               key: str = KEY, robust: bool = True, max_depth: int = MAX_DEPTH) -> IsolationForestModel:
    """Fit an isolation forest on ``df`` (numeric ``features``, unique ``key``).

    ``robust`` centres each feature on its median and divides by its IQR
    (zero IQR -> 1) before the trees see it.
    """
    return _fit_many(df, list(features), [(n_trees, max_samples, contamination, seed)], key, robust, max_depth)[0]


@dataclass
class ForestPair:
    """Two forests OR-ed together; the score is the first forest's decision value."""

    main: IsolationForestModel
    aggressive: IsolationForestModel

    def transform(self, df: DataFrame, flag: str = "l3_isolation", score: str = "anomaly_score") -> DataFrame:
        name = "__scores"
        scored = df.withColumn(name, score_many(df, [self.main, self.aggressive]))
        da, db = -F.col(f"{name}.s0") - F.lit(self.main.offset), -F.col(f"{name}.s1") - F.lit(self.aggressive.offset)
        return _with_decision(scored, da, (da < 0) | (db < 0), flag, score).drop(name)


def fit_forest_pair(df: DataFrame, features, contamination: float = 0.05, seed: int = 42, key: str = KEY, robust: bool = True,
                    max_depth: int = MAX_DEPTH) -> ForestPair:
    """200 trees / 80 % samples / c, and 150 trees / 50 % samples / 2c with seed + 1 — fitted together."""
    main, aggressive = _fit_many(df, list(features), [(200, 0.8, contamination, seed), (150, 0.5, 2 * contamination, seed + 1)], key, robust, max_depth)
    return ForestPair(main, aggressive)


def save_forest(model: IsolationForestModel, spark, path: str) -> str:
    """Node table as parquet + a one-row metadata table (shared storage, reloadable anywhere)."""
    spark.createDataFrame(model.nodes).write.mode("overwrite").parquet(f"{path}/nodes")
    scale = None if not model.scale else [(f, float(m), float(w)) for f, (m, w) in model.scale.items()]
    spark.createDataFrame([(list(model.features), model.psi, model.n_trees, model.max_depth, model.offset, model.contamination, scale)],
                          "features ARRAY<STRING>, psi LONG, n_trees INT, max_depth INT, offset DOUBLE, contamination DOUBLE, "
                          "scale ARRAY<STRUCT<feature: STRING, middle: DOUBLE, width: DOUBLE>>").write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load_forest(spark, path: str) -> IsolationForestModel:
    m = spark.read.parquet(f"{path}/meta").first()
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()  # the model: at most trees x 2^(max_depth + 1) rows
    shape = (m.n_trees, 2 ** (m.max_depth + 1) - 1)
    feature, threshold, size = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int64)
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    feature[at], threshold[at], size[at] = nodes["feature"], nodes["threshold"], nodes["size"]
    scale = {s.feature: (s.middle, s.width) for s in m.scale} if m.scale else None
    return IsolationForestModel(list(m.features), feature, threshold, size, m.psi, m.max_depth, m.offset, m.contamination, scale)
