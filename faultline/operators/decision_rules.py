"""Exact shallow decision trees, one for all rows and one per left-out fold, grown together.

Every distinct value of every feature is a possible split. A level takes one
pass: class counts by (model, node, feature, value), running sums of them in value order, and
the least Gini impurity over the midpoints between neighbouring values. Ties
go to the first feature, then to the smaller value. Only the chosen splits, a row
per node, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.prefix import running_sums
from faultline.operators.sampling import dense_index, md5_key
from faultline.schema import KEY
from faultline.session import cut_lineage


@dataclass
class RuleTree:
    """Splits and class counts by heap number (children of p are 2p + 1 and 2p + 2)."""

    features: list
    splits: dict
    counts: dict

    def node_of(self) -> Column:
        """Leaf of a row, as an expression over the feature columns."""
        return _walk(self.splits, self.features, 0)

    def prediction(self) -> Column:
        """1 where the leaf holds more rows of the class than others."""
        out = F.lit(0)
        for p, (n, pos) in self.counts.items():
            if p not in self.splits and 2 * pos > n:
                out = F.when(self.node_of() == p, 1).otherwise(out)
        return out

    def rules(self, node: int = 0, path: tuple = ()) -> list[tuple]:
        """(rule, n, n_positive, prediction) of the leaves, left to right."""
        if node not in self.splits:
            n, pos = self.counts.get(node, (0, 0))
            return [(" AND ".join(path), n, pos, 1.0 if 2 * pos > n else 0.0)]
        f, cut = self.splits[node]
        return self.rules(2 * node + 1, (*path, f"{self.features[f]} <= {cut:.4f}")) + self.rules(2 * node + 2, (*path, f"{self.features[f]} > {cut:.4f}"))


def _walk(splits: dict, features: list, node: int) -> Column:
    if node not in splits:
        return F.lit(node)
    f, cut = splits[node]
    return F.when(F.col(features[f]) <= cut, _walk(splits, features, 2 * node + 1)).otherwise(_walk(splits, features, 2 * node + 2))


def _impurity(n: Column, pos: Column) -> Column:
    return 2 * pos * (n - pos) / n


def fit_rules(df: DataFrame, features, target: Column, depth: int = 2, folds: int = 0, seed: int = 42, key: str = KEY) -> tuple[RuleTree, list[float]]:
    """The tree of all rows and, with ``folds``, the F1 of each fold under the tree of the other folds.

    Folds are stratified: each class is dealt in turn by a hash of the key.
    Missing values count as 0.
    """
    features = list(features)
    value = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features]
    rows = df.select(F.col(key).alias("__key"), target.cast("int").alias("__y"), *value)
    if folds:
        rows = dense_index(rows, md5_key(F.col("__key"), seed), ["__y"], name="__fold", tiebreak="__key").withColumn("__fold", (F.col("__fold") % folds).cast("int"))
    rows = cut_lineage(rows if folds else rows.withColumn("__fold", F.lit(-1)))
    models = range(folds + 1)  # the last is the tree of all rows
    dealt = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).filter("model <> __fold")
    trees = {m: RuleTree(features, {}, {}) for m in models}
    for r in dealt.groupBy("model").agg(F.count("*").alias("n"), F.sum("__y").alias("pos")).collect():
        trees[r.model].counts[0] = (r.n, r.pos)
    for level in range(depth):
        node = F.lit(-1)
        for m, tree in trees.items():
            node = F.when(F.col("model") == m, tree.node_of()).otherwise(node)
        at = dealt.withColumn("node", node).filter(F.col("node") >= 2 ** level - 1)
        long = at.select("model", "node", "__y", F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("x")) for i, f in enumerate(features)])))
        counts = long.groupBy("model", "node", "f", "x").agg(F.count("*").alias("n"), F.sum("__y").alias("pos"))
        sums = running_sums(counts, ["model", "node", "f"], "x", ["n", "pos"]).filter("next IS NOT NULL AND pos_all > 0 AND pos_all < n_all")
        score = _impurity(F.col("n_upto"), F.col("pos_upto")) + _impurity(F.col("n_all") - F.col("n_upto"), F.col("pos_all") - F.col("pos_upto"))
        best = sums.groupBy("model", "node").agg(F.min(F.struct(score.alias("score"), "f", "x", "next", "n_upto", "pos_upto", "n_all", "pos_all")).alias("b"))
        for r in best.collect():  # a row per node of the level
            tree, b, p = trees[r.model], r.b, r.node
            tree.splits[p] = (b.f, b.x / 2 + b.next / 2)
            tree.counts[2 * p + 1], tree.counts[2 * p + 2] = (b.n_upto, b.pos_upto), (b.n_all - b.n_upto, b.pos_all - b.pos_upto)
    if not folds:
        return trees[0], []
    pred = F.lit(0)
    for m in range(folds):
        pred = F.when(F.col("__fold") == m, trees[m].prediction()).otherwise(pred)
    hit = rows.withColumn("p", pred).groupBy("__fold").agg(*[F.sum(x.cast("long")).alias(n) for n, x in (
        ("tp", F.col("__y") * F.col("p")), ("real", F.col("__y")), ("said", F.col("p")))]).orderBy("__fold").collect()
    return trees[folds], [2.0 * r.tp / (r.real + r.said) if r.real + r.said else 0.0 for r in hit]
