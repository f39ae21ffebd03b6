"""Exact k nearest neighbours of every vector by a k-d tree that is a table.

Build
-----
The upper levels are split on the driver by a sample of about ``SAMPLE`` vectors, chosen by hash,
and every vector walks down to its place in one pass; of up to ``SAMPLE`` vectors the sample has all,
so no level is left. Then all nodes with more than ``leaf`` vectors are split at the same time, one pass a
level. Both ways split a node along its widest dimension, at the quartiles (two median splits of
one dimension); boxes and counts are those of all vectors. Splits follow ranks, not widths, so a dense cluster beside far
outliers gets as many leaves as its vectors need; distinct vectors always split, so
every leaf is bounded.

Search
------
1. Every vector meets the members of its own leaf: that bounds its k-th distance.
2. Pairs of leaves are found by walking down the tree from the root, one join a
   level: a (leaf, node) pair goes on while the distance of the two boxes is within
   the largest bound in the leaf.
3. Each vector orders the leaves found by the distance of their boxes from
   itself and visits them nearest first, two, then four, then eight … a round; only
   members within its bound are ordered. Bounds shrink after every round, and leaves
   beyond a vector's bound are dropped. When none is left, the result is exact.

No step pairs all vectors of a group: a vector meets at most the members of the
leaves that its bound reaches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from faultline.session import cut_lineage, ship_package

#: Vectors of a leaf at most; vectors that the driver splits the upper levels by, about; levels that it splits at most;
#: sampled vectors of a node that it leaves whole, if the sample is not all.
LEAF, SAMPLE, SAMPLED_LEVELS, SAMPLED_LEAF = 64, 32_768, 30, 4
QUARTILES = [0.25, 0.5, 0.75]


def _boxes(rows: DataFrame, d: int) -> DataFrame:
    """(_node, n, lo, hi): members and bounding box of every node."""
    return rows.groupBy("_node").agg(F.count("*").alias("n"), F.array(*[F.min(F.col("_x")[i]) for i in range(d)]).alias("lo"),
                                     F.array(*[F.max(F.col("_x")[i]) for i in range(d)]).alias("hi"))


@dataclass
class _Top:
    """The upper levels: ``dim`` (-1: not split), ``cuts`` (absent ones infinite) and places of the children of each node, its number, and the levels below the root."""

    dim: np.ndarray
    cuts: np.ndarray
    child: np.ndarray
    node: np.ndarray
    levels: int

    def places(self, x: np.ndarray) -> np.ndarray:
        """The number of the node that each row of ``x`` comes to."""
        at, rows = np.zeros(len(x), np.intp), np.arange(len(x))
        for _ in range(self.levels):
            side = (x[rows, self.dim[at]][:, None] > self.cuts[at]).sum(axis=1)
            at = np.where(self.dim[at] < 0, at, self.child[at, side])
        return self.node[at]


def _top(x: np.ndarray, most: int) -> _Top:
    """Nodes of more than ``most`` rows of the sample, split as in ``build``."""
    dim, cuts, child, node, levels = [-1], [[np.inf] * 3], [[0] * 4], [0], 0
    todo = [(0, x)]
    while todo and levels < SAMPLED_LEVELS:
        later = []
        for at, rows in todo:
            if len(rows) <= most:
                continue
            with np.errstate(over="ignore"):
                width = rows.max(axis=0) - rows.min(axis=0)
            f = int(width.argmax())
            if not width[f] > 0:
                continue
            column = np.sort(rows[:, f])
            found = sorted({column[int(q * (len(column) - 1))] for q in QUARTILES} - {column[-1]}) or [column[column < column[-1]][-1]]
            dim[at], cuts[at][:len(found)] = f, found
            side = np.searchsorted(found, rows[:, f])
            for c in range(len(found) + 1):
                child[at][c] = len(node)
                later.append((len(node), rows[side == c]))
                dim.append(-1), cuts.append([np.inf] * 3), child.append([0] * 4), node.append(4 * node[at] + 1 + c)
        todo, levels = later, levels + bool(later)
    return _Top(np.array(dim), np.array(cuts), np.array(child), np.array(node, np.int64), levels)


def _placed(vectors: DataFrame, d: int, leaf: int) -> tuple[DataFrame, int]:
    """The vectors with their ``_node`` by the upper levels, and the number of these levels."""
    ship_package(vectors.sparkSession)
    every = max(1, -(-vectors.count() // SAMPLE))
    sample = vectors.filter(F.pmod(F.xxhash64("_vid"), F.lit(every)) == 0).select(*[F.get("_x", F.lit(i)).alias(f"x{i}") for i in range(d)])
    x = sample.toPandas().to_numpy(float).reshape(-1, d)
    top = _top(x[np.isfinite(x).all(axis=1)], leaf if every == 1 else max(SAMPLED_LEAF, leaf // every))
    shared = vectors.sparkSession.sparkContext.broadcast(top)

    def place(batches):
        for batch in batches:
            rows = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.places(rows))], names=[*batch.schema.names, "_node"])

    placed = vectors.mapInArrow(place, T.StructType([*vectors.schema.fields, T.StructField("_node", T.LongType())]))
    return cut_lineage(placed.withColumn("_node", F.col("_node").cast("decimal(38,0)"))), top.levels


def build(vectors: DataFrame, d: int, leaf: int = LEAF) -> tuple[DataFrame, list[DataFrame]]:
    """Vectors (with an array column ``_x`` of ``d`` doubles) with the ``_node`` of their leaf, and the nodes by level.

    Nodes: (_node, parent, n, lo, hi, is_leaf); the children of node p are 4p + 1 to 4p + 4.
    """
    rows, depth = _placed(vectors, d, leaf)
    settled, leaves = [], []
    while True:
        nodes = cut_lineage(_boxes(rows, d))
        done = nodes.filter(F.col("n") <= leaf)
        leaves.append(done)
        open_nodes = nodes.filter(F.col("n") > leaf)
        if open_nodes.isEmpty():
            settled.append(rows)
            break
        settled.append(rows.join(done.select("_node"), "_node", "left_semi"))
        widths = F.zip_with("hi", "lo", lambda h, l: h - l)
        split = open_nodes.select("_node", (F.array_position(widths, F.array_max(widths)) - 1).cast("int").alias("dim"), "hi")
        inside = rows.join(split, "_node").withColumn("x", F.get("_x", F.col("dim"))).withColumn("top", F.get("hi", F.col("dim"))).drop("hi")
        cuts = inside.groupBy("_node").agg(F.array_distinct(F.percentile_approx("x", QUARTILES, 10_000)).alias("cuts"))
        inside = inside.join(cuts, "_node")
        # a cut at the largest value separates nothing; without any other cut the largest value itself is split off
        cuts = F.filter("cuts", lambda c: c < F.col("top"))
        child = F.when(F.size(cuts) == 0, (F.col("x") >= F.col("top")).cast("int")).otherwise(F.size(F.filter(cuts, lambda c: F.col("x") > c)))
        rows = cut_lineage(inside.withColumn("_node", (F.col("_node") * 4 + 1 + child).cast("decimal(38,0)")).select(*rows.columns))
        depth += 1
    out, found = settled[0], leaves[0]
    for more, nodes in zip(settled[1:], leaves[1:]):
        out, found = out.unionByName(more), found.unionByName(nodes)
    nodes = cut_lineage(_with_ancestors(found, d, depth))
    return out if len(settled) == 1 else cut_lineage(out), [nodes.filter(F.col("level") == k).drop("level") for k in range(depth + 1)]


def _with_ancestors(leaves: DataFrame, d: int, depth: int) -> DataFrame:
    """All nodes above and with the leaves, with their level."""
    up = F.aggregate(F.sequence(F.lit(0), F.lit(depth)), F.array("_node"),
                     lambda path, _: F.concat(path, F.array(F.floor((F.element_at(path, -1) - 1) / 4).cast("decimal(38,0)"))))
    paths = leaves.withColumn("path", F.filter(up, lambda p: p >= 0))
    steps = paths.select("n", "lo", "hi", F.size("path").alias("length"), F.posexplode("path").alias("step", "_node"))
    nodes = steps.groupBy("_node", (F.col("length") - 1 - F.col("step")).alias("level")).agg(
        F.sum("n").alias("n"), F.array(*[F.min(F.col("lo")[i]) for i in range(d)]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in range(d)]).alias("hi"),
        (F.min("step") == 0).alias("is_leaf"))
    return nodes.withColumn("parent", F.floor((F.col("_node") - 1) / 4).cast("decimal(38,0)"))


def _box_gap(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """Distance of two boxes."""
    gaps = F.zip_with(F.zip_with(lo, hi2, lambda a, b: a - b), F.zip_with(lo2, hi, lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """Of (_vid, nb_vid, dist, avail) the nearest until ``k`` neighbours are counted; ``prev`` counts those before."""
    order = Window.partitionBy("_vid").orderBy("dist", "nb_vid")
    first = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")
    return first.withColumn("prev", F.coalesce(F.sum("avail").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("prev") < k)


def _bounds(near: DataFrame, k: int) -> DataFrame:
    """(_vid, bound): the k-th distance so far, null below k neighbours."""
    return near.groupBy("_vid").agg(F.when(F.max(F.col("prev") + F.col("avail")) >= k, F.max("dist")).alias("bound"))


def knn(vectors: DataFrame, features, k: int, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """((_vid, slot, nb_vid, dist) for slots 0 .. k - 1 of every vector, vector pairs looked at).

    ``vectors``: distinct (features, _vid, _m); a vector with ``_m`` copies has
    ``_m - 1`` neighbours at distance 0 and counts ``_m`` times for others. Ties go to the smaller ``_vid``.
    """
    d = len(features)
    rows, levels = build(vectors.select("_vid", "_m", F.array(*[F.col(f).cast("double") for f in features]).alias("_x")), d, leaf)
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    leaves = nodes.filter("is_leaf").select(F.col("_node").alias("leaf"), F.col("lo").alias("leaf_lo"), F.col("hi").alias("leaf_hi"), F.col("n").alias("leaf_n"))
    others = rows.select(F.col("_vid").alias("nb_vid"), F.col("_m").alias("nb_m"), F.col("_x").alias("nb_x"), F.col("_node").alias("leaf"))
    dist = F.sqrt(sum(((F.col("_x")[i] - F.col("nb_x")[i]) * (F.col("_x")[i] - F.col("nb_x")[i]) for i in range(1, d)),
                      (F.col("_x")[0] - F.col("nb_x")[0]) * (F.col("_x")[0] - F.col("nb_x")[0])))
    avail = F.when(F.col("_vid") == F.col("nb_vid"), F.col("_m") - 1).otherwise(F.col("nb_m"))

    def meet(visits: DataFrame) -> DataFrame:
        known = "bound" in visits.columns
        pairs = visits.join(others, "leaf").select("_vid", "nb_vid", dist.alias("dist"), avail.alias("avail"), *(["bound"] if known else [])).filter("avail > 0")
        return pairs.filter("bound IS NULL OR dist <= bound").drop("bound") if known else pairs

    own = rows.withColumnRenamed("_node", "leaf")
    near = cut_lineage(_nearest(meet(own), k))
    looked = leaves.agg(F.sum(F.col("leaf_n") * F.col("leaf_n"))).first()[0] or 0
    bounds = own.join(_bounds(near, k), "_vid", "left").select("_vid", "leaf", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    reach = bounds.groupBy("leaf").agg(F.max("bound").alias("reach"))
    front = leaves.join(reach, "leaf").select(F.col("leaf").alias("of"), F.col("leaf_lo").alias("of_lo"), F.col("leaf_hi").alias("of_hi"), "reach", F.lit(0).cast("decimal(38,0)").alias("node"))
    met = [front.select("of", F.col("node").alias("leaf")).limit(0)]
    for level in levels[1:]:
        front = front.join(level.select(F.col("parent").alias("node"), F.col("_node").alias("child"), "lo", "hi", "is_leaf"), "node")
        front = cut_lineage(front.filter(_box_gap(F.col("of_lo"), F.col("of_hi"), F.col("lo"), F.col("hi")) <= F.col("reach")))
        met.append(front.filter("is_leaf AND child <> of").select("of", F.col("child").alias("leaf")))
        front = front.filter("NOT is_leaf").select("of", "of_lo", "of_hi", "reach", F.col("child").alias("node"))
    reached = met[0]
    for more in met[1:]:
        reached = reached.unionByName(more)
    visits = (rows.withColumnRenamed("_node", "of").join(reached, "of").join(leaves, "leaf")
              .withColumn("gap", _box_gap(F.col("_x"), F.col("_x"), F.col("leaf_lo"), F.col("leaf_hi"))))
    visits = visits.withColumn("turn", F.row_number().over(Window.partitionBy("_vid").orderBy("gap", "leaf"))).select("_vid", "_m", "_x", "leaf", "leaf_n", "gap", "turn")
    visits = cut_lineage(visits.join(_bounds(near, k), "_vid", "left").filter("bound IS NULL OR gap <= bound"))
    first, many = 1, 2
    while True:
        now = visits.filter((F.col("turn") >= first) & (F.col("turn") < first + many))
        r = visits.agg(F.max("turn").alias("last"), F.sum(F.when((F.col("turn") >= first) & (F.col("turn") < first + many), F.col("leaf_n"))).alias("pairs")).first()
        if r["last"] is None or r["last"] < first:
            break
        looked += r["pairs"] or 0
        near = cut_lineage(_nearest(near.select("_vid", "nb_vid", "dist", "avail").unionByName(meet(now)), k))
        first, many = first + many, 2 * many
        visits = cut_lineage(visits.filter(F.col("turn") >= first).drop("bound").join(_bounds(near, k), "_vid", "left").filter("bound IS NULL OR gap <= bound"))
    last = F.least(F.col("prev") + F.col("avail"), F.lit(k)) - 1
    slots = F.explode(F.sequence(F.col("prev").cast("int"), last.cast("int")))
    return near.select("_vid", slots.alias("slot"), "nb_vid", "dist"), int(looked)
