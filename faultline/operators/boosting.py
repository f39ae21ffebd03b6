"""Gradient-boosted trees on Spark, many models grown together.

MLlib boosts one model at a time with a job per tree level; a search over
rounds, depths, rates and folds repeats that for every point. Here all models
of a search share the passes over the data:

* features are cut at exact quantiles into at most ``BINS`` bins; a row is its
  bin numbers, label, weight, fold, and the margin, gradient and hessian of every model;
* a pass over the rows sums gradients and hessians by (model, node, feature, bin) for all
  models at one level, of one of two children only (the other is the rest of their parent) and only of nodes heavy
  enough for a split; the sums of all partitions are added up on the executors and come to the
  driver once, which picks the splits of the level: what it gets does not depend on the rows;
* margins advance one round after the trees of the round are done. The first
  rounds of an ensemble are the smaller ensemble: margins kept at 50, 100 and 200
  rounds are the scores of three grid points (:func:`search`);
* a row outside a model's fold has no gradient there, but gets margins: held-out
  scores need no scoring pass.

Gradients are rounded to multiples of 2^-20, so every sum is exact and the
model depends neither on partitions nor on the machine. Loss: logistic for two
classes, softmax with one tree a class and round for more; leaf value
``-rate * G / (H + 1)``, splits need a hessian of ``MIN_CHILD`` on both sides.
A missing feature takes the left branch.

The rows are blocks of numpy arrays in an RDD: the margins change in place from
round to round, which no DataFrame operation does without a job of its own.

As long as the rows fit the tasks that run at once (``HELD_ROWS`` each), all rounds run in
one barrier stage: every task keeps its rows, margins and gradients, and after a pass reads
the sums of all tasks from the shared checkpoint folder and picks the same splits as the others.
A pass then costs no job, and no row is read again. With more rows, or a checkpoint folder that
Python cannot open, each pass is a job over the blocks; these are checkpointed in the shared folder every ``KEEP_EVERY`` rounds, so a lost
executor costs at most that many rounds of one partition. Both ways add up the same sums.
"""

from __future__ import annotations

import itertools
import os
import random
import time
from dataclasses import dataclass
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.quantiles import select_quantiles
from faultline.operators.sampling import dense_index, md5_key
from faultline.operators.sums import summed
from faultline.schema import KEY
from faultline.session import checkpoint_dir, cut_lineage, scratch_path, ship_package

BINS, KEEP_EVERY, UNIT = 64, 20, 2.0 ** 20
#: Regularisation of leaf values and least hessian of a child (the usual defaults of boosted-tree libraries).
LAMBDA, MIN_CHILD = 1.0, 1.0
#: Rows of a partition of blocks, at most and at least; results do not depend on them.
ROWS_A_PARTITION, LEAST_ROWS = 250_000, 10_000
#: Up to so many partitions send their sums straight to the driver, those of more are added up first.
FEW_PARTITIONS = 2
#: Rows that a task keeps for all rounds (about 450 bytes each with 16 ensembles), and tasks that exchange their sums, at most; results do not depend on them.
HELD_ROWS, HELD_TASKS = 1_000_000, 16
#: Rows whose margins and gradients a task computes at once: they stay in its cache.
CACHED_ROWS = 16_384
#: Seconds that a task waits for the sums of another.
PATIENCE = 1_800
#: From so many rows on, sums are taken by two features at once; rows that tell which child is the smaller one.
PAIRED_ROWS, GUESS_ROWS = 4_000, 4_096
#: Held-out scores.
_SCORES = "spec int, rounds int, fold int, key long, label int, prob array<double>"
#: Stored models.
_NODES = "round long, output long, node long, feature long, threshold double, value double, gain double"
_META = "features array<string>, rounds int, depth int, rate double, fold int, classes int"
#: The grid that the search draws from.
GRID = {"trees": [50, 100, 200], "depth": [3, 5, 7], "rate": [0.01, 0.1, 0.2]}


@dataclass(frozen=True)
class Spec:
    """One ensemble: ``fold`` is left out of its fit (None: all rows are in)."""

    rounds: int
    depth: int
    rate: float
    fold: int | None = None
    classes: int = 2

    @property
    def outputs(self) -> int:
        return 1 if self.classes == 2 else self.classes


@dataclass
class BoostedModel:
    """Trees as heaps (children of p are 2p+1 and 2p+2), one a round and output; ``feature`` -1 marks a leaf or an absent node."""

    features: list
    spec: Spec
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def first(self, rounds: int) -> "BoostedModel":
        """The ensemble of the first rounds."""
        spec = Spec(rounds, self.spec.depth, self.spec.rate, self.spec.fold, self.spec.classes)
        return BoostedModel(self.features, spec, *(x[:rounds] for x in (self.feature, self.threshold, self.value, self.gain)))

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows, outputs) sums of leaf values for a matrix of features; NaN takes the left branch."""
        out, columns = np.zeros((len(x), self.spec.outputs)), np.ascontiguousarray(x.T)
        for r in range(len(self.feature)):
            for k in range(self.spec.outputs):
                out[:, k] += self.value[r, k].take(_leaves(columns, self.feature[r, k], self.threshold[r, k]))
        return out

    def probabilities(self, df: DataFrame):
        """Array column with the probability of every class."""
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def proba(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(list(_probabilities(shared.value.margins(rows.to_numpy(float)))))

        return proba(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features]))

    def importances(self) -> list[float]:
        """Share of the total gain by feature."""
        total = np.zeros(len(self.features))
        at = self.feature >= 0
        np.add.at(total, self.feature[at], self.gain[at])
        return (total / total.sum() if total.sum() else total).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per node (at most rounds x outputs x 2^(depth + 1)) and a row about the ensemble, as Parquet."""
        r, k, p = np.nonzero((self.feature >= 0) | (self.value != 0))
        spark.createDataFrame(pd.DataFrame({"round": r, "output": k, "node": p, "feature": self.feature[r, k, p].astype(int), "threshold": self.threshold[r, k, p],
                                            "value": self.value[r, k, p], "gain": self.gain[r, k, p]}), _NODES).write.parquet(f"{path}/nodes")
        s = self.spec
        spark.createDataFrame([(self.features, s.rounds, s.depth, s.rate, s.fold, s.classes)], _META).write.parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedModel":
        m = spark.read.schema(_META).parquet(f"{path}/meta").first()
        nodes = spark.read.schema(_NODES).parquet(f"{path}/nodes").toPandas()
        model = _empty(m.features, Spec(m.rounds, m.depth, m.rate, m.fold, m.classes))
        at = tuple(nodes[c].to_numpy(int) for c in ("round", "output", "node"))
        for name in ("feature", "threshold", "value", "gain"):
            getattr(model, name)[at] = nodes[name].to_numpy()
        return model


def _empty(features: list, spec: Spec) -> BoostedModel:
    shape = (spec.rounds, spec.outputs, 2 ** (spec.depth + 1) - 1)
    return BoostedModel(list(features), spec, np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape), np.zeros(shape))


def _probabilities(margins: np.ndarray) -> np.ndarray:
    """(rows, classes) from margins: logistic for one output, else softmax."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins))
        return np.concatenate([1 - p, p], axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- the rows -----------------------------------------------------------------------------------

@dataclass
class _Block:
    """Some rows: keys, (features, rows) bin numbers, labels, weights and folds, and the margins of every output (None: no longer needed)."""

    key: np.ndarray
    code: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    margin: list


def _gradients(b: _Block, spec: Spec, slot: slice, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounded gradients and hessians of output ``k`` of an ensemble for the rows ``at``."""
    p = _probabilities(np.stack([b.margin[o][at] for o in range(slot.start, slot.stop)], axis=1))[:, k + (spec.outputs == 1)]
    w = b.weight[at] * UNIT
    return np.rint((p - (b.y[at] == k + (spec.outputs == 1))) * w), np.rint(np.maximum(p * (1 - p), 1e-5) * w)


def _blocks(rows: DataFrame, features: list, edges: list[np.ndarray], outputs: int):
    """RDD of blocks of a frame (key, y, weight, fold, features); a partition is one block, unless it is far larger than planned."""
    kinds = {"key": "i8", "y": "i4", "weight": "f8", "fold": "i4"}
    most = 2 * ROWS_A_PARTITION

    def packed(held):
        joined = [np.concatenate(column, axis=-1).tobytes() for column in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in joined], names=["code", *kinds])

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            x = [batch.column(f).to_numpy(zero_copy_only=False) for f in features]
            code = np.stack([np.where(np.isnan(v), 0, np.searchsorted(e, v)) for v, e in zip(x, edges)]).astype(np.uint8)
            held.append([code, *(batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in kinds.items())])
            n += batch.num_rows
            if n >= most:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def unpack(r):
        of = {c: np.frombuffer(r[c], t) for c, t in kinds.items()}
        n = len(of["key"])
        return _Block(of["key"], np.frombuffer(r.code, np.uint8).reshape(-1, n), of["y"], of["weight"], of["fold"], [np.zeros(n) for _ in range(outputs)])

    return rows.mapInArrow(pack, "code binary, key binary, y binary, weight binary, fold binary").rdd.map(unpack)


# --- growing ------------------------------------------------------------------------------------

def _leaves(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Heap number of the leaf that each row reaches in a tree; ``columns`` is (features, rows)."""
    n = columns.shape[1]
    out, todo = np.zeros(n, np.uint8 if len(feature) < 256 else np.uint32), [(0, np.ones(n, bool))]
    while todo:
        p, here = todo.pop()
        if feature[p] < 0:
            out |= here * out.dtype.type(p)
        else:
            right = here & (columns[feature[p]] > cut[p])
            todo += [(2 * p + 1, here ^ right), (2 * p + 2, right)]
    return out


def _inside(code: np.ndarray, feature: np.ndarray, cut: np.ndarray, node: int, known: dict) -> np.ndarray:
    """Which rows are in a node; ``known`` holds those of the nodes seen so far, the root's at least."""
    if node not in known:
        p = (node - 1) // 2
        here = _inside(code, feature, cut, p, known)
        right = here & (code[feature[p]] > cut[p])
        known[2 * p + 1], known[2 * p + 2] = here ^ right, right
    return known[node]


def _histograms(code: np.ndarray, pairs: list[np.ndarray], at: np.ndarray, sides: tuple) -> np.ndarray:
    """(2, features x bins) sums of gradients and hessians of the rows ``at``, whose values are ``sides``.

    Many rows are summed by two features at once, a pass over the rows for each
    pair of features, and the sums of each feature taken from those.
    """
    d = len(code)
    if len(at) < PAIRED_ROWS:
        flat = (code.take(at, axis=1) + (np.arange(d) * BINS)[:, None]).ravel()
        return np.stack([np.bincount(flat, np.tile(v, d), d * BINS) for v in sides])
    return _paired(d, (pair.take(at).astype(np.intp, copy=False) for pair in pairs), sides)


def _paired(d: int, places, sides: tuple) -> np.ndarray:
    """The sums by two features at once; ``places`` are the pairs' numbers of the rows."""
    out = np.zeros((2, d, BINS))
    for i, place in enumerate(places):
        two = 2 * i + 1 < d
        for side, v in enumerate(sides):
            sums = np.bincount(place, v, BINS * BINS if two else BINS)
            if two:
                sums = sums.reshape(BINS, BINS)
                out[side, 2 * i], out[side, 2 * i + 1] = sums.sum(axis=1), sums.sum(axis=0)
            else:
                out[side, 2 * i] = sums
    return out.reshape(2, -1)


def _sums(blocks, active: list[int], specs: list[Spec], slots: list[slice], feature: np.ndarray, cut: np.ndarray, wanted: list[list[int]]):
    """(place in ``active``, (nodes, 2, features x bins) gradient and hessian sums of its wanted nodes) of one partition."""
    total, place = {}, {o: a for a, o in enumerate(active)}
    for b in blocks:
        d = len(b.code)
        pairs = [b.code[f] * np.uint16(BINS) + b.code[f + 1] if f + 1 < d else b.code[f] for f in range(0, d, 2)]
        for spec, slot in zip(specs, slots):
            for o in (o for o in range(slot.start, slot.stop) if o in place):
                a = place[o]
                known = {0: np.ones(len(b.y), bool) if spec.fold is None else b.fold != spec.fold}
                for i, node in enumerate(wanted[a]):
                    at = np.flatnonzero(_inside(b.code, feature[a], cut[a], node, known))
                    g, h = _gradients(b, spec, slot, o - slot.start, at)
                    if not h.all():
                        at, g, h = at[h > 0], g[h > 0], h[h > 0]
                    total.setdefault(a, np.zeros((len(wanted[a]), 2, d * BINS), np.int64))[i] += _histograms(b.code, pairs, at, (g, h)).astype(np.int64)
    yield from total.items()


def _best_splits(t: np.ndarray, d: int, n_edges: np.ndarray):
    """For (nodes, 2, features x bins) sums: G and H of each node, best gain, its feature and bin, and the sums left of it."""
    left = np.cumsum(t.reshape(len(t), 2, d, BINS) / UNIT, axis=-1)
    g, h, gl, hl = left[:, 0, 0, -1], left[:, 1, 0, -1], left[:, 0], left[:, 1]
    gr, hr = g[:, None, None] - gl, h[:, None, None] - hl
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = gl ** 2 / (hl + LAMBDA) + gr ** 2 / (hr + LAMBDA) - (g ** 2 / (h + LAMBDA))[:, None, None]
    allowed = (hl >= MIN_CHILD) & (hr >= MIN_CHILD) & (np.arange(BINS)[None, :] < n_edges[:, None])
    gain = np.where(allowed, gain, -np.inf).reshape(len(t), -1)
    best = gain.argmax(axis=-1)
    pick = lambda x: np.take_along_axis(x.reshape(len(t), -1), best[:, None], -1)[:, 0]
    return g, h, pick(gain), best // BINS, best % BINS, pick(gl), pick(hl)


def _grow(sums_of, specs_of: list[Spec], active: list[int], d: int, n_edges: np.ndarray, some: np.ndarray):
    """One tree for each active output: (feature, bin, value, gain) heaps.

    ``sums_of(outputs, features, bins, wanted)`` gives the sums of the wanted nodes by place in ``outputs``. Of two children only one is summed, the other is the rest of their parent. It is the one with fewer of the rows
    ``some`` (bin numbers of one block): a guess that saves time and has no part in the result.
    """
    size = 2 ** (max(specs_of[o].depth for o in active) + 1) - 1
    feature, cut = np.full((len(active), size), -1, np.int16), np.zeros((len(active), size), np.int16)
    value, gains = np.zeros((len(active), size)), np.zeros((len(active), size))
    todo = {a: [0] for a in range(len(active))}  # nodes of this level that a split may be found for
    guess = [{0: np.ones(some.shape[1], bool)} for _ in active]
    above = {}  # sums of the level above
    while todo:
        which = sorted(todo)
        wanted = []
        for a in which:
            counts = {n: _inside(some, feature[a], cut[a], n, guess[a]).sum() for p in {(n - 1) // 2 for n in todo[a]} for n in ((2 * p + 1, 2 * p + 2) if p >= 0 else (0,))}
            wanted.append(sorted({n if n == 0 else min(n, n + 1 if n % 2 else n - 1, key=lambda c: (counts[c], c)) for n in todo[a]}))
        outs, fe, cu = [active[a] for a in which], feature[which], cut[which]
        found = sums_of(outs, fe, cu, wanted)
        here, later = {}, {}
        for i, a in enumerate(which):
            if i not in found:
                continue
            for n, sums in zip(wanted[i], found[i]):
                here[a, n] = sums
                if n:
                    here[a, n + 1 if n % 2 else n - 1] = above[a, (n - 1) // 2] - sums
            rate, depth = specs_of[active[a]].rate, specs_of[active[a]].depth
            g, h, gain, f, c, gl, hl = _best_splits(np.stack([here[a, p] for p in todo[a]]), d, n_edges)
            for k, p in enumerate(todo[a]):
                value[a, p] = -rate * g[k] / (h[k] + LAMBDA)
                if not gain[k] > 1e-6:
                    continue
                feature[a, p], cut[a, p], gains[a, p] = f[k], c[k], gain[k]
                for child, cg, ch in ((2 * p + 1, gl[k], hl[k]), (2 * p + 2, g[k] - gl[k], h[k] - hl[k])):
                    value[a, child] = -rate * cg / (ch + LAMBDA)
                    if ch >= 2 * MIN_CHILD and child < 2 ** depth - 1:  # enough for two children, and above the deepest level
                        later.setdefault(a, []).append(child)
        todo, above = later, here
    return feature, cut, value, gains


def _advance(b: _Block, trees: tuple, active: list[int]) -> _Block:
    """Margins after one more round; those of ensembles that were complete before are dropped."""
    feature, cut, value = trees
    margin = [None] * len(b.margin)
    for a, o in enumerate(active):
        margin[o] = b.margin[o] + value[a].take(_leaves(b.code, feature[a], cut[a]))
    return _Block(b.key, b.code, b.y, b.weight, b.fold, margin)


def _held_out(b: _Block, specs: list[Spec], slots: list[slice], rounds: int):
    """(spec, fold, keys, labels, probabilities) of the rows that an ensemble's fit left out, a row of bytes for each ensemble."""
    for s, (spec, slot) in enumerate(zip(specs, slots)):
        if spec.fold is None or spec.rounds < rounds:
            continue
        of = np.flatnonzero(b.fold == spec.fold)
        p = _probabilities(np.stack([b.margin[o][of] for o in range(slot.start, slot.stop)], axis=1))
        yield s, spec.fold, b.key[of].tobytes(), b.y[of].tobytes(), p.tobytes()


def _scores(packed: DataFrame, rounds: int) -> DataFrame:
    """A row for each row and ensemble of the frame of bytes."""
    def unpack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                key, y = np.frombuffer(r["key"], "i8"), np.frombuffer(r["label"], "i4")
                prob, n = np.frombuffer(r["prob"]), len(key)
                at = np.arange(n + 1, dtype=np.int32) * (len(prob) // max(n, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["spec"], np.int32)), pa.array(np.full(n, rounds, np.int32)), pa.array(np.full(n, r["fold"], np.int32)),
                                                  pa.array(key), pa.array(y), pa.ListArray.from_arrays(pa.array(at), pa.array(prob))], names=["spec", "rounds", "fold", "key", "label", "prob"])

    return packed.mapInArrow(unpack, _SCORES)


# --- all rounds in one barrier stage ------------------------------------------------------------

class _Held:
    """The rows of one task in the order of their folds, kept for all rounds, with the gradients and the rows by node of the round.

    Gradients take four bytes where these hold them exactly: whole numbers up to 2^24.
    """

    def __init__(self, blocks: list[_Block], specs: list[Spec], slots: list[slice], d: int):
        join = lambda c, empty: np.concatenate([getattr(b, c) for b in blocks], axis=-1) if blocks else empty
        n = sum(len(b.key) for b in blocks)
        none = np.zeros(0)
        fold = join("fold", none.astype("i4"))
        order = np.argsort(fold, kind="stable")  # the rows of an ensemble are one or two slices then
        fold = fold[order]
        self.block = _Block(join("key", none.astype("i8"))[order], join("code", np.zeros((d, 0), np.uint8)).take(order, axis=1), join("y", none.astype("i4"))[order], join("weight", none)[order],
                            fold, [np.zeros(n) for _ in range(slots[-1].stop)])
        code = self.block.code
        self.places = [code[f] * np.intp(BINS) + code[f + 1] if f + 1 < d else code[f].astype(np.intp) for f in range(0, d, 2)]
        self.specs, self.slots, self.scale = specs, slots, self.block.weight * UNIT
        self.parts = {}
        for spec, slot in zip(specs, slots):
            out = slice(0, 0) if spec.fold is None else slice(*(int(np.searchsorted(fold, spec.fold, side)) for side in ("left", "right")))
            self.parts |= dict.fromkeys(range(slot.start, slot.stop), [part for part in (slice(0, out.start), slice(out.stop, n)) if part.start < part.stop])
        kind = np.float32 if self.scale.max(initial=0) <= 2 ** 24 else np.float64
        self.sides = {o: (np.zeros(n, kind), np.zeros(n, kind)) for o in self.parts}

    def begin(self, active: list[int]) -> None:
        """Gradients of a round."""
        self.at, going = {o: {} for o in active}, set(active)
        for spec, slot in zip(self.specs, self.slots):
            if slot.start not in going:
                continue
            for part in (slice(i, min(i + CACHED_ROWS, part.stop)) for part in self.parts[slot.start] for i in range(part.start, part.stop, CACHED_ROWS)):
                y, w = self.block.y[part], self.scale[part]
                margins = [self.block.margin[o][part] for o in range(slot.start, slot.stop)]
                chances = [1 / (1 + np.exp(-margins[0]))] if spec.outputs == 1 else _probabilities(np.stack(margins, axis=1)).T
                for k, p in enumerate(chances):
                    g, h = (side[part] for side in self.sides[slot.start + k])
                    g[:] = np.rint((p - (y == k + (spec.outputs == 1))) * w)
                    h[:] = np.rint(np.maximum(p * (1 - p), 1e-5) * w)

    def advance(self, trees: tuple, active: list[int]) -> None:
        """Margins after one more round, in place; those of ensembles that were complete before are dropped."""
        feature, cut, value = trees
        margin = [None] * len(self.block.margin)
        for a, o in enumerate(active):
            leaves, margin[o] = _leaves(self.block.code, feature[a], cut[a]), self.block.margin[o]
            for i in range(0, len(leaves), CACHED_ROWS):
                margin[o][i:i + CACHED_ROWS] += value[a].take(leaves[i:i + CACHED_ROWS])
        self.block.margin = margin

    def _rows(self, o: int, node: int, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Numbers of the rows of a node below the root."""
        known = self.at[o]
        if node not in known:
            p = (node - 1) // 2
            here, column = self._rows(o, p, feature, cut) if p else None, self.block.code[feature[p]]
            if p:
                right = column.take(here) > cut[p]
                known[2 * p + 1], known[2 * p + 2] = here.compress(~right), here.compress(right)
                del known[p]  # its children are the only ones to ask for it
            else:
                right = column > cut[p]
                known[1], known[2] = (np.concatenate([np.flatnonzero(side[part]) + part.start for part in self.parts[o]] or [np.zeros(0, np.intp)]) for side in (~right, right))
        return known[node]

    def sums(self, outs: list[int], feature: np.ndarray, cut: np.ndarray, wanted: list[list[int]]) -> np.ndarray:
        """(all wanted nodes, 2, features x bins)."""
        found, d = [], len(self.block.code)
        for a, o in enumerate(outs):
            g, h = self.sides[o]
            for node in wanted[a]:
                if node:
                    at = self._rows(o, node, feature[a], cut[a])
                    sums = _histograms(self.block.code, self.places, at, (g.take(at).astype(float), h.take(at).astype(float)))
                else:
                    sums = sum((_paired(d, (place[part] for place in self.places), (g[part].astype(float), h[part].astype(float))) for part in self.parts[o]), np.zeros((2, d * BINS)))
                found.append(sums.astype(np.int64))
        return np.stack(found)


class _Exchange:
    """Sums of all tasks of a barrier stage, through files in a folder that they share.

    ``allGather`` answers once a second, too seldom for a thousand passes; it only tells, at the start, whether
    the folder is shared. A task has two files at a time at most: whoever writes the next has read the one before.
    """

    def __init__(self, folder: str):
        self.ctx, self.folder, self.step = BarrierTaskContext.get(), folder, 0
        self.me, self.tasks = self.ctx.partitionId(), len(self.ctx.getTaskInfos())
        self.attempt = self.ctx.allGather(str(self.ctx.taskAttemptId()))[0]  # a repeated stage reads no file of the one before

    def _name(self, step: int, task: int) -> str:
        return f"{self.folder}/{self.attempt}-{step}-{task}"

    def _write(self, data: bytes) -> None:
        name = self._name(self.step, self.me)
        with open(name + ".part", "wb") as f:
            f.write(data)
        os.replace(name + ".part", name)

    def shared(self) -> bool:
        """Whether every task sees the files of all."""
        try:
            self._write(b"")
        except OSError:
            pass
        self.ctx.barrier()
        seen = all(os.path.exists(self._name(0, t)) for t in range(self.tasks))
        return "0" not in self.ctx.allGather(str(int(seen)))

    def all_of(self, data: bytes) -> list[bytes]:
        """What each task has given in this step."""
        self.step += 1
        self._write(data)
        out, until = [], time.monotonic() + PATIENCE
        for t in range(self.tasks):
            while not os.path.exists(self._name(self.step, t)):
                if time.monotonic() > until:
                    raise TimeoutError(f"no sums of task {t} in {self.folder}")
                time.sleep(0.001)
            with open(self._name(self.step, t), "rb") as f:
                out.append(f.read())
        os.remove(self._name(self.step - 1, self.me))
        return out

    def close(self) -> None:
        self.ctx.barrier()
        os.remove(self._name(self.step, self.me))


def _all_rounds(blocks, folder: str, specs: list[Spec], slots: list[slice], spec_of: list[Spec], d: int, n_edges: np.ndarray, keep_at):
    """Every round on the rows of a barrier task: (round, trees) of the first task and (round, held-out scores) of all; nothing if the folder is not shared."""
    exchange = _Exchange(folder)
    if not exchange.shared():
        return
    held = _Held(list(blocks), specs, slots, d)
    some = next(np.frombuffer(c, np.uint8).reshape(d, -1) for c in exchange.all_of(held.block.code[:, :GUESS_ROWS].tobytes()) if c)

    def sums_of(outs, fe, cu, wanted):
        own = held.sums(outs, fe, cu, wanted)
        total = sum(np.frombuffer(x, np.int64) for x in exchange.all_of(own.tobytes())).reshape(own.shape)
        ends = np.cumsum([0, *map(len, wanted)])
        return {a: total[i:j] for a, (i, j) in enumerate(zip(ends[:-1], ends[1:]))}

    for r in range(max(s.rounds for s in specs)):
        active = [o for o, s in enumerate(spec_of) if r < s.rounds]
        held.begin(active)
        trees = _grow(sums_of, spec_of, active, d, n_edges, some)
        held.advance(trees[:3], active)
        if exchange.me == 0:
            yield r, "trees", trees
        if r + 1 in keep_at:
            for found in _held_out(held.block, specs, slots, r + 1):
                yield r + 1, "scores", found
    exchange.close()


def _local_path(spark: SparkSession, name: str) -> str | None:
    """A fresh folder under the shared checkpoint folder as a plain path; None if that folder is no file system's."""
    path = scratch_path(spark, name)
    path = path[len("file:"):] if path.startswith("file:") else path
    path = "/" + path.lstrip("/") if path.startswith("/") else None
    if path:
        os.makedirs(path)
        os.chmod(path, 0o777)  # executors may run as another user
    return path


def _slots(spark: SparkSession) -> int:
    """Tasks that surely run at once, as a barrier stage needs; 0 if that is not known."""
    conf, cores = spark.sparkContext.getConf(), spark.sparkContext.defaultParallelism
    given = conf.get("spark.default.parallelism") or conf.get("spark.dynamicAllocation.enabled", "false") == "true"
    if given or cores <= 2 and not spark.sparkContext.master.startswith("local["):  # an unset parallelism is the cores, but two at least
        return 0
    return min(HELD_TASKS, cores // int(conf.get("spark.task.cpus", "1")))


# --- fits ---------------------------------------------------------------------------------------

def fit_many(df: DataFrame, features, label: str, specs: list[Spec], key: str = KEY, fold: str | None = None, weight: str | None = None,
             keep_at=()) -> tuple[list[BoostedModel], DataFrame | None]:
    """Fit all ``specs`` on the same rows (labels 0 .. classes - 1).

    With ``keep_at`` (round numbers) also the scores of held-out rows after
    those rounds: (spec, rounds, fold, key, label, prob).
    """
    spark = df.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    features, specs = list(features), list(specs)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
                     (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"), *[F.col(f).cast("double").alias(f) for f in features])
    cuts = select_quantiles(rows, {f: F.col(f) for f in features}, [i / BINS for i in range(1, BINS)])
    edges = [np.unique([q for q in (cuts[None][f] if None in cuts else []) if q is not None]) for f in features]
    n_edges = np.array([len(e) for e in edges])
    starts = np.cumsum([0, *[s.outputs for s in specs]])
    slots = [slice(a, b) for a, b in zip(starts[:-1], starts[1:])]
    spec_of = [s for s in specs for _ in range(s.outputs)]
    n, models, folder, kept = rows.count(), [_empty(features, s) for s in specs], scratch_path(spark, "boosted"), []

    def record(r: int, active: list[int], feature, cut, value, gain) -> None:
        for i, o in enumerate(active):
            s = next(k for k, at in enumerate(slots) if at.start <= o < at.stop)
            m, k, size = models[s], o - slots[s].start, 2 ** (spec_of[o].depth + 1) - 1
            m.feature[r, k], m.value[r, k], m.gain[r, k] = feature[i, :size], value[i, :size], gain[i, :size]
            at = np.flatnonzero(m.feature[r, k] >= 0)
            m.threshold[r, k, at] = [edges[f][c] for f, c in zip(feature[i, at], cut[i, at])]

    def keep(packed, r: int) -> None:
        packed = spark.createDataFrame(packed, "spec int, fold int, key binary, label binary, prob binary")
        _scores(packed, r).write.parquet(f"{folder}/{r}")
        kept.append(f"{folder}/{r}")

    active_at = lambda r: [o for o, s in enumerate(spec_of) if r < s.rounds]
    tasks = _slots(spark)
    rounds = range(max(s.rounds for s in specs) if n else 0)
    if rounds and n <= tasks * HELD_ROWS and (sums := _local_path(spark, "boosted-sums")):
        state = _blocks(rows.repartition(max(1, min(tasks, n // LEAST_ROWS)), "key"), features, edges, 0)
        d = len(features)
        done = state.barrier().mapPartitions(lambda bs: _all_rounds(bs, sums, specs, slots, spec_of, d, n_edges, keep_at)).persist(StorageLevel.MEMORY_AND_DISK)
        done.checkpoint()  # what is read below never runs the stage again
        grown = done.filter(lambda x: x[1] == "trees").collect()
        for r, _, trees in grown:
            record(r, active_at(r), *trees)
        for r in (r for r in sorted(set(keep_at)) if grown and r - 1 in rounds):
            keep(done.filter(lambda x, r=r: x[1] == "scores" and x[0] == r).map(lambda x: x[2]), r)
        done.unpersist()
        if grown:
            return models, spark.read.schema(_SCORES).parquet(*kept) if kept else None
    partitions = max(1, -(-n // ROWS_A_PARTITION), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    state = _blocks(rows.repartition(partitions, "key"), features, edges, int(starts[-1])).persist(StorageLevel.MEMORY_AND_DISK)
    some, older = state.map(lambda b: b.code[:, :GUESS_ROWS]).first() if n else None, []
    for r in rounds:
        active = active_at(r)

        def sums_of(outs, fe, cu, wanted, state=state):
            return summed(state.mapPartitions(lambda bs: _sums(bs, outs, specs, slots, fe, cu, wanted)), add, FEW_PARTITIONS)

        trees = _grow(sums_of, spec_of, active, len(features), n_edges, some)
        record(r, active, *trees)
        older.append(state)
        state = state.map(lambda b, trees=trees[:3], active=active: _advance(b, trees, active)).persist(StorageLevel.MEMORY_AND_DISK)
        if (r + 1) % KEEP_EVERY == 0:
            state.checkpoint()
            state.count()
        if r + 1 in keep_at:
            keep(state.flatMap(lambda b, at=r + 1: _held_out(b, specs, slots, at)), r + 1)
        while len(older) > 1:  # the one before is still needed until the next pass
            older.pop(0).unpersist()
    while older:
        older.pop().unpersist()
    state.unpersist()
    return models, spark.read.schema(_SCORES).parquet(*kept) if kept else None


# --- randomised search --------------------------------------------------------------------------

def grid_points(n: int, seed: int) -> list[dict]:
    """``n`` points drawn from the grid without replacement."""
    grid = [dict(zip(GRID, p)) for p in itertools.product(*GRID.values())]
    return random.Random(seed).sample(grid, min(n, len(grid)))


@dataclass
class Search:
    """The drawn points, their held-out scores (point, fold, key, label, prob) and recalls, and the winner fitted on all rows."""

    points: list[dict]
    scores: DataFrame
    recalls: DataFrame
    best: dict
    model: BoostedModel


def recalls_of(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(point, fold, n_failures, recall) of held-out scores."""
    hit = F.avg((F.col("prob") > threshold).cast("double"))
    return scores.filter("label = 1").groupBy("point", "fold").agg(F.count("*").alias("n_failures"), hit.alias("recall"))


def search(df: DataFrame, features, label: str, n_draws: int = 4, folds: int = 3, seed: int = 42, key: str = KEY) -> Search:
    """Points of the grid by mean recall over stratified folds; the first of equal ones wins.

    Every (depth, rate) is grown once per fold, and once on all rows, to the
    most trees that a point asks for.
    """
    points = grid_points(n_draws, seed)
    dealt = dense_index(df.select(F.col(key).alias("__key"), F.col(label).alias("__label"), *features), md5_key(F.col("__key"), seed), ["__label"], name="__at", tiebreak="__key")
    dealt = cut_lineage(dealt.withColumn("__fold", (F.col("__at") % folds).cast("int")).drop("__at"))
    pairs = sorted({(p["depth"], p["rate"]) for p in points})
    most = {pair: max(p["trees"] for p in points if (p["depth"], p["rate"]) == pair) for pair in pairs}
    specs = [Spec(most[pair], *pair, fold=k) for pair in pairs for k in [*range(folds), None]]
    models, scored = fit_many(dealt, features, "__label", specs, "__key", "__fold", keep_at=sorted({p["trees"] for p in points}))
    at = {pair: [i for i, s in enumerate(specs) if (s.depth, s.rate) == pair and s.fold is not None] for pair in pairs}
    table = [(i, s, p["trees"]) for i, p in enumerate(points) for s in at[p["depth"], p["rate"]]]
    wanted = df.sparkSession.createDataFrame(table, "point int, spec int, rounds int")
    scores = scored.join(F.broadcast(wanted), ["spec", "rounds"]).select("point", "fold", "key", "label", F.get("prob", F.lit(1)).alias("prob"))
    recalls = recalls_of(scores)
    mean = {r.point: r.m for r in recalls.groupBy("point").agg(F.avg("recall").alias("m")).collect()}  # a row per drawn point
    win = max(range(len(points)), key=lambda i: (mean.get(i, 0.0), -i))
    best = points[win]
    whole = next(m for m in models if (m.spec.depth, m.spec.rate, m.spec.fold) == (best["depth"], best["rate"], None))
    return Search(points, scores, recalls, best, whole.first(best["trees"]))
