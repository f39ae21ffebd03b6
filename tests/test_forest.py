"""Isolation forest: brute-force growth, independence of partitions, training flag rate, probes, missing values, streams."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.operators import guard as gd
from faultline.operators import iforest as fo
from faultline.schema import GUARD_FEATURES
from faultline.sources.telemetry import telemetry


def test_forest(spark):
    t = telemetry(spark, SF_SMALL).filter("machine_failure = 0")
    a = fo.fit_forest(t, GUARD_FEATURES, n_trees=40)
    b = fo.fit_forest(t.repartition(5), GUARD_FEATURES, n_trees=40)
    assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and (a.size == b.size).all()
    assert a.offset == pytest.approx(b.offset, abs=1e-12)
    n = t.count()
    assert abs(a.size[:, 0].mean() / n - 0.8) < 0.03  # the whole share of the rows, no cap
    s = a.transform(t)
    rate = s.agg(F.avg(F.col("l3_isolation").cast("double"))).first()[0]
    assert 0.03 <= rate <= 0.07
    med = s.agg(F.median("anomaly_score")).first()[0]
    worst = {r.name: r.anomaly_score for r in a.transform(gd.probe_frame(spark)).collect()}
    assert worst["extreme speed"] < med and worst["extreme strain"] < med


def test_every_node_splits_its_own_rows(spark):
    """Sizes and split values of each node, from the members that reach it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)).round(2)
    df = spark.createDataFrame(pd.DataFrame({"unit_id": range(400), "a": x[:, 0], "b": x[:, 1]}))
    m = fo.fit_forest(df, ["a", "b"], n_trees=6, max_samples=0.5, robust=False, max_depth=4)
    h = np.array([r.h for r in df.orderBy("unit_id").select(fo.row_hash(F.col("unit_id")).alias("h")).collect()])
    for t in range(6):
        reach = {0: np.flatnonzero(fo.members(h, t, 42, 0.5))}
        for node in range(m.feature.shape[1]):
            rows = reach.get(node, np.zeros(0, int))
            assert m.size[t, node] == len(rows)
            f, cut = m.feature[t, node], m.threshold[t, node]
            if f >= 0:
                assert x[rows, f].min() < cut <= x[rows, f].max()
                reach[2 * node + 1], reach[2 * node + 2] = rows[x[rows, f] < cut], rows[x[rows, f] >= cut]
    path = np.zeros(400)
    for t in range(6):
        for i in range(400):
            node, depth = 0, 0
            while m.feature[t, node] >= 0:
                node, depth = 2 * node + 1 + (x[i, m.feature[t, node]] >= m.threshold[t, node]), depth + 1
            path[i] += depth + fo.c_factor([m.size[t, node]])[0]
    want = 2 ** (-path / 6 / fo.c_factor([m.psi])[0])
    got = [r.s for r in df.select("unit_id", fo.score_many(df, [m])["s0"].alias("s")).orderBy("unit_id").collect()]
    assert np.allclose(got, want)


def test_missing_values_and_reload(spark, tmp_path):
    t = telemetry(spark, SF_SMALL)
    model = gd.fit_guard(t, forest=True)
    holes = t.limit(40).withColumn("rpm", F.when(F.col("unit_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(None).cast("double")))
    assert not any(r.l3_isolation for r in model.transform(holes).collect())
    path = str(tmp_path / "guard")
    gd.save_guard(model, spark, path)
    again = gd.load_guard(spark, path)
    cols = ["unit_id", "l3_isolation", "anomaly", "anomaly_score"]
    assert sorted(model.transform(t).select(cols).collect()) == sorted(again.transform(t).select(cols).collect())
    (tmp_path / "guard" / "forest_main").rename(tmp_path / "elsewhere")
    with pytest.raises(Exception):
        gd.load_guard(spark, path)


def test_layer_three_scores_a_stream(spark, tmp_path):
    t = telemetry(spark, SF_SMALL)
    model = gd.fit_guard(t, forest=True)
    path = str(tmp_path / "rows")
    t.write.parquet(path)
    q = model.transform(spark.readStream.schema(t.schema).parquet(path)).select("unit_id", "anomaly").writeStream \
        .format("memory").queryName("layer_three").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ckpt")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("layer_three").collect())) == sorted(map(tuple, model.transform(t).select("unit_id", "anomaly").collect()))


def test_ranges_from_the_ends_of_the_order_equal_plain_ones():
    """Nodes with rows only in the middle of every feature's order, copies, settled rows, one row."""
    import numpy as np

    from faultline.operators import iforest
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 3)).round(2)
    middle = (np.abs(x) < 0.2).all(axis=1)
    node = np.stack([np.where(middle, 5, rng.integers(0, 4, 6000)), np.where(rng.random(6000) < 0.3, iforest.SETTLED, rng.integers(0, 8, 6000)), np.full(6000, iforest.SETTLED)]).astype(np.uint16)
    node[1, 17] = 6
    blocks = [iforest._Block(x[:5999], node[:, :5999]), iforest._Block(x[5999:], node[:, 5999:])]
    parts = dict(iforest._ranges(blocks, 3, 8, 3))
    assert len(parts) == iforest.PARTS  # the trees are summed in parts
    for t in range(3):
        n, lo, hi = (v[t // iforest.PARTS] for v in parts[t % iforest.PARTS])
        for k in range(8):
            mine = x[node[t] == k]
            assert n[k] == len(mine)
            assert (lo[k] == (mine.min(axis=0) if len(mine) else np.inf)).all() and (hi[k] == (mine.max(axis=0) if len(mine) else -np.inf)).all()


def test_rows_are_derived_once(spark):
    """No null test of the features is carried into the expressions that make them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def derived(x):
        seen.add(1)
        return float(x % 97)

    df = spark.range(400).select(F.col("id").alias("unit_id"), derived("id").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    fo.fit_forest(df, ["a", "b"], n_trees=3, max_depth=2)
    assert seen.value == 400


def test_ranges_leave_a_bounded_number_of_partitions(spark, monkeypatch):
    """More rows make more blocks, not more partitions that each send the ranges of all nodes."""
    t = telemetry(spark, SF_SMALL)
    parts, real = [], fo.summed
    monkeypatch.setattr(fo, "summed", lambda found, *a: parts.append(found.getNumPartitions()) or real(found, *a))
    a = fo.fit_forest(t, GUARD_FEATURES, n_trees=5, max_depth=3)
    for name in ("ROWS_A_BLOCK", "ROWS_A_PARTITION"):
        monkeypatch.setattr(fo, name, 10, raising=False)
    b = fo.fit_forest(t, GUARD_FEATURES, n_trees=5, max_depth=3)
    assert max(parts) <= max(spark.sparkContext.defaultParallelism, 24)
    assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and (a.size == b.size).all() and a.offset == b.offset


def test_trees_wait_when_their_nodes_take_too_many_bytes(spark, monkeypatch):
    """The nodes that a partition's rows carry are bounded, whatever the rows; the forests are the same."""
    t = telemetry(spark, SF_SMALL)
    turns, real = [], fo._blocks
    monkeypatch.setattr(fo, "_blocks", lambda rows, names, trees, *a: turns.append(len(trees)) or real(rows, names, trees, *a))
    a = fo.fit_forest_pair(t, GUARD_FEATURES, max_depth=3)
    assert turns == [350]
    partitions = max(spark.sparkContext.defaultParallelism, 1)
    rows = -(-t.count() // partitions)
    monkeypatch.setattr(fo, "NODE_BYTES", 130 * 2 * rows, raising=False)
    b = fo.fit_forest_pair(t, GUARD_FEATURES, max_depth=3)
    assert sum(turns[1:]) == 350 and max(turns[1:]) * 2 * rows <= 130 * 2 * rows
    for x, y in ((a.main, b.main), (a.aggressive, b.aggressive)):
        assert (x.feature == y.feature).all() and (x.threshold == y.threshold).all() and (x.size == y.size).all() and x.offset == y.offset
