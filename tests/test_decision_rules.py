"""Exact shallow trees and running sums against plain loops."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators.decision_rules import fit_rules
from faultline.operators.prefix import running_sums


def best_split(x, y):
    n, pos, best = len(y), y.sum(), None
    if not 0 < pos < n:
        return None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            nl, pl = left.sum(), y[left].sum()
            score = 2 * pl * (nl - pl) / nl + 2 * (pos - pl) * ((n - nl) - (pos - pl)) / (n - nl)
            if best is None or (score, f, a) < best[0]:
                best = ((score, f, a), f, a / 2 + b / 2)
    return best and best[1:]


def plain(x, y, depth, node=0):
    split = best_split(x, y) if depth else None
    if split is None:
        return {node: (len(y), int(y.sum()))}, {}
    left = x[:, split[0]] <= split[1]
    counts, splits = {node: (len(y), int(y.sum()))}, {node: split}
    for side, child in ((left, 2 * node + 1), (~left, 2 * node + 2)):
        c, s = plain(x[side], y[side], depth - 1, child)
        counts |= c
        splits |= s
    return counts, splits


@pytest.mark.parametrize("seed,depth", [(1, 2), (2, 2), (3, 3)])
def test_trees_equal_a_plain_search(spark, seed, depth):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 6, 300).astype(float), rng.normal(size=300).round(2), rng.normal(size=300)], axis=1)
    y = ((x[:, 0] > 2) & (x[:, 1] > 0)).astype(int) ^ (rng.random(300) < 0.1)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "unit_id LONG, a DOUBLE, b DOUBLE, c DOUBLE, y INT").repartition(6)
    tree, f1 = fit_rules(df, ["a", "b", "c"], F.col("y") == 1, depth=depth, folds=3)
    counts, splits = plain(x, y, depth)
    assert tree.counts == counts and tree.splits.keys() == splits.keys()
    assert all(tree.splits[p] == pytest.approx(splits[p]) for p in splits)
    assert sum(r[1] for r in tree.rules()) == 300 and len(f1) == 3 and all(0.5 < v <= 1 for v in f1)
    got = [r.p for r in df.orderBy("unit_id").select(tree.prediction().alias("p")).collect()]
    where = np.zeros(300, int)
    for _ in range(depth):
        where = np.array([2 * p + 1 + (x[i, splits[p][0]] > splits[p][1]) if p in splits else p for i, p in enumerate(where)])
    assert got == [int(2 * counts[p][1] > counts[p][0]) for p in where]


def test_missing_values_one_class_and_no_rows(spark):
    rows = [(1, None, 1), (2, float("nan"), 1), (3, 5.0, 0), (4, 6.0, 0), (4, 6.0, 0)]
    df = spark.createDataFrame(rows, "unit_id LONG, a DOUBLE, y INT")
    tree, _ = fit_rules(df, ["a"], F.col("y") == 1)
    assert [(r[0], r[1], r[3]) for r in tree.rules()] == [("a <= 2.5000", 2, 1.0), ("a > 2.5000", 3, 0.0)]
    one, f1 = fit_rules(df, ["a"], F.lit(True), folds=2)
    assert one.rules() == [("", 5, 5, 1.0)] and f1 == [1.0, 1.0]
    none, f1 = fit_rules(df.limit(0), ["a"], F.col("y") == 1, folds=2)
    assert none.rules() == [("", 0, 0, 0.0)] and f1 == []


def test_running_sums_over_ranges_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v), int(rng.integers(1, 9))) for v in rng.permutation(3000)] + [(f"g{k % 40}", float(k), 1) for k in range(200)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE, n INT").repartition(9)
    got = {(r.g, r.v): (r.n_upto, r.n_all, r.next) for r in running_sums(df, ["g"], "v", ["n"]).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g)
        total, upto = sum(r[2] for r in mine), 0
        for k, r in enumerate(mine):
            upto += r[2]
            assert got[g, r[1]] == (upto, total, mine[k + 1][1] if k + 1 < len(mine) else None)
