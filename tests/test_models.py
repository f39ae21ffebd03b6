"""Model-derived helpers: tree rules, importance ranking, permutation importance, cascade wiring."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.operators import features as fe
from faultline.operators import models as md
from faultline.sources.telemetry import telemetry


def test_physics_in_top(spark):
    imp = spark.createDataFrame([("rpm", 0.4), ("power_w", 0.3), ("tool_wear_min", 0.1), ("temp_diff_k", 0.09),
                                 ("torque_nm", 0.08), ("strain_load", 0.02)], "feature STRING, importance DOUBLE")
    got = {r.physics: (r.in_top, r.best_rank) for r in md.physics_in_top(imp, 5).collect()}
    assert got["power"] == (True, 2) and got["temp_diff"] == (True, 4) and got["strain"][0] is False
    assert [r.feature for r in md.top_k(imp, 2).collect()] == ["rpm", "power_w"]


def test_permutation_importance_detects_the_used_feature(spark):
    rows = [(i, float(i % 7), float((i * 13) % 5), 1 if i % 7 >= 4 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "unit_id LONG, a DOUBLE, b DOUBLE, y INT")

    def scorer(d):  # a perfect rule on feature a, blind to b
        return d.withColumn("_pred", (F.col("a") >= 4).cast("int"))

    imp = {r.feature: r.importance_mean for r in md.permutation_importance(df, scorer, ["a", "b"], "y", 3).collect()}
    assert imp["a"] > 0.2 and abs(imp["b"]) < 1e-12


def test_cascade_columns(spark):
    t = fe.encode_type(telemetry(spark, SF_SMALL))
    det = md.fit_detector(t, algo="rf", params={"numTrees": 5, "maxDepth": 3})
    diag = md.fit_diagnoser(md.diagnoser_frame(t), num_trees=5)
    out = md.cascade(t, det, diag)
    r = out.agg(F.count(F.when((F.col("final_pred") == 0) & F.col("final_type").isNotNull(), 1)).alias("bad"),
                F.count(F.when(F.col("overstrain_rule") & (F.col("final_type") != 3), 1)).alias("bad_osf")).first()
    assert r.bad == 0 and r.bad_osf == 0


def test_grid_sampler_and_gbt_path(spark):
    from pyspark.ml.classification import GBTClassifier
    grid = md.detector_grid(GBTClassifier())
    assert len(grid) == 27
    a, b = md.sample_grid(grid, 4, 42), md.sample_grid(grid, 4, 42)
    assert len(a) == 4 and [sorted((p.name, v) for p, v in m.items()) for m in a] == \
        [sorted((p.name, v) for p, v in m.items()) for m in b]
    t = fe.encode_type(telemetry(spark, SF_SMALL))
    det = md.fit_detector(t, algo="gbt", params={"maxIter": 3, "maxDepth": 2})
    p = det.transform(t).agg(F.min("detector_prob"), F.max("detector_prob")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0


def test_forest_detector_keeps_no_node_of_every_row_and_tree(spark, monkeypatch):
    """The trees are those of a fit that caches the nodes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2)).round(2)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] > x[:, 1]).astype(int)}))
    fit = lambda: md.fit_detector(df, ["a", "b"], "y", algo="rf", params={"numTrees": 3, "maxDepth": 4}).model.stages[-1]
    plain = fit()
    assert not plain.getCacheNodeIds()
    monkeypatch.setattr(md, "FOREST_KNOBS", md.TREE_KNOBS)
    cached = fit()
    assert cached.getCacheNodeIds()
    shape = lambda m: [line.split()[:4] for line in m.toDebugString.split("\n")[1:]]
    assert shape(plain) == shape(cached)
