"""Split, dense index, oversampling and SMOTE properties."""
import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.operators import features as fe
from faultline.operators import sampling as sm
from faultline.operators.smote import knn_table, smote
from faultline.schema import MODEL_FEATURES
from faultline.sources.telemetry import telemetry


def test_dense_index_is_a_permutation(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "unit_id").withColumn("g", F.col("unit_id") % 3)
    for restart in (True, False):
        idx = sm.dense_index(df, sm.md5_key(F.col("unit_id"), 7), ["g"], restart=restart)
        if restart:
            agg = idx.groupBy("g").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"),
                                       F.countDistinct("idx").alias("d"), F.count(F.lit(1)).alias("n")).collect()
            assert all(r.lo == 0 and r.hi == r.n - 1 and r.d == r.n for r in agg)
        else:
            r = idx.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx")).first()
            assert tuple(r) == (0, 4999, 5000)


def test_split_is_disjoint_cover(spark):
    t = telemetry(spark, SF_SMALL)
    s = sm.stratified_split(t)
    assert s.count() == t.count()
    assert s.select("unit_id").distinct().count() == t.count()
    by = {(r.machine_failure, r.is_test): r["count"] for r in s.groupBy("machine_failure", "is_test").count().collect()}
    for c in (0, 1):
        n = by[(c, True)] + by[(c, False)]
        assert by[(c, True)] == int(round(0.2 * n + 1e-9))


def test_oversample_sizes(spark):
    t = telemetry(spark, SF_SMALL)
    n = t.count()
    u = sm.oversample_uniform(t.select("unit_id", "machine_failure"), 3 * n)
    assert u.count() == 3 * n
    r = sm.resample_to(t, 2 * n)
    assert r.count() == 2 * n
    assert r.select("unit_id").distinct().count() == 2 * n
    assert r.filter("machine_failure = 0 AND twf + hdf + pwf + osf + rnf > 0").count() == 0
    n_fail = t.filter("machine_failure = 1").count()
    assert r.filter("machine_failure = 1").count() == int(2 * n * (n_fail / n) * 1.5)


def test_knn_exact_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 1, (300, 4)), rng.normal(5, 0.1, (40, 4)), np.zeros((30, 4))])
    rows = [(i, *map(float, p)) for i, p in enumerate(pts)]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "unit_id LONG, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    nn = knn_table(df, cols, 5, leaf=8).toPandas()
    # expected: 5 smallest distances to other rows (duplicates count)
    dist = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    vid_of = {}
    pdf = df.toPandas()
    for _, r in pdf.iterrows():
        key = tuple(r[cols])
        vid_of.setdefault(key, int(r.unit_id))
    for i in range(len(pts)):
        vid = vid_of[tuple(pts[i])]
        got = np.sort(nn[nn._vid == vid].dist.to_numpy())
        assert len(got) == 5
        assert np.allclose(got, np.sort(dist[i])[:5])


def test_smote_balances_and_interpolates(spark):
    t = fe.encode_type(telemetry(spark, SF_SMALL))
    out = smote(t, MODEL_FEATURES).cache()
    by = {r.machine_failure: r["count"] for r in out.groupBy("machine_failure").count().collect()}
    assert by[0] == by[1]
    mins = t.filter("machine_failure = 1").agg(*[F.min(f).alias(f) for f in MODEL_FEATURES]).first()
    maxs = t.filter("machine_failure = 1").agg(*[F.max(f).alias(f) for f in MODEL_FEATURES]).first()
    syn = out.filter("is_synthetic = 1")
    for f in MODEL_FEATURES:
        r = syn.agg(F.min(f), F.max(f)).first()
        assert r[0] >= mins[f] - 1e-9 and r[1] <= maxs[f] + 1e-9


def test_resample_falls_back_to_uniform(spark):
    """A class target below its size -> uniform draws of the whole table, still exactly N rows."""
    rows = [(i, 1 if i < 60 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "unit_id LONG, machine_failure INT").withColumns(
        {c: F.lit(0) for c in ("twf", "hdf", "pwf", "osf", "rnf")})
    out = sm.resample_to(df, 150)  # failures 60 % -> target int(150*0.6*1.5)=135 > 60, healthy 15 < 40
    assert out.count() == 150
    assert out.select("unit_id").distinct().count() == 150


def test_smote_rejects_missing_features(spark):
    import pytest
    df = spark.createDataFrame([(1, 1, None, 1.0), (2, 0, 1.0, 2.0), (3, 0, 2.0, 3.0)],
                               "unit_id LONG, machine_failure INT, a DOUBLE, b DOUBLE")
    with pytest.raises(ValueError):
        smote(df, ["a", "b"])


def test_draws_reach_every_row_of_a_huge_table(spark):
    n = 10 ** 11
    pos = [r.pos for r in sm._draws(spark, 20_000, n, 42).collect()]
    assert min(pos) >= 0 and max(pos) < n and max(pos) > 2 ** 32
    share = [sum(k * n // 10 <= p < (k + 1) * n // 10 for p in pos) / len(pos) for k in range(10)]
    assert all(0.08 < s < 0.12 for s in share)


def test_fallback_keeps_each_drawn_row(spark):
    rows = [(i, f"P{i}", 1 if i < 60 else 0, int(i % 7 == 0 and i < 60)) for i in range(100)]
    df = spark.createDataFrame(rows, "unit_id LONG, product_id STRING, machine_failure INT, twf INT").withColumns({c: F.lit(0) for c in ("hdf", "pwf", "osf", "rnf")})
    for r in sm.resample_to(df, 150).collect():
        assert (r.product_id, r.machine_failure, r.twf) == rows[r.source_unit_id][1:]


def test_top_up_adds_rows_with_keys_of_their_own(spark):
    df = spark.createDataFrame([(i, i % 4 == 0, 0, i) for i in range(40)], "draw_id LONG, f BOOLEAN, is_draw INT, value LONG") \
        .withColumn("machine_failure", F.col("f").cast("int")).drop("f")
    df = df.unionByName(df.filter("draw_id < 9").withColumn("is_draw", F.lit(1)))
    out = sm.top_up(df, 100)
    assert out.count() == 100 and out.select("is_draw", "machine_failure", "draw_id").distinct().count() == 100
    assert out.filter("is_draw < 2").exceptAll(df).count() == 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sm.top_up(df.repartition(3), 100).collect()))
    assert sm.top_up(df, 10).count() == df.count()


def test_knn_is_exact_beside_a_far_outlier_and_a_dense_cluster(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(150, 2)), 5 + rng.normal(scale=1e-4, size=(60, 2)), [[1e9, -1e9]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "unit_id LONG, a DOUBLE, b DOUBLE")
    got = np.sort(knn_table(df, ["a", "b"], 5).toPandas()["dist"].to_numpy())
    want = np.sort(np.concatenate([np.sort(np.sqrt(((x - p) ** 2).sum(axis=1)))[1:6] for p in x]))
    assert np.allclose(got, want, rtol=1e-7)


def test_knn_is_exact_beside_a_vector_between_bulk_and_tail(spark):
    x = np.array([*range(200), 1740, *range(2800, 2805)], float)
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(x)], "unit_id LONG, a DOUBLE")
    nn = knn_table(df, ["a"], 5).toPandas()
    for i, p in enumerate(x):
        assert np.allclose(np.sort(nn[nn._vid == i].dist), np.sort(np.abs(x - p))[1:6])


def test_half_of_the_vectors_in_one_tiny_cluster_meet_few_others(spark):
    """Candidate pairs stay near the vectors' number however they cluster."""
    from faultline.operators.kdtree import build, knn
    from faultline.operators.smote import _vectors
    rng = np.random.default_rng(11)
    n = 3000
    pts = np.concatenate([rng.normal(0, 1e-7, (n // 2, 3)), rng.uniform(-1e4, 1e4, (n // 2, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "unit_id LONG, a DOUBLE, b DOUBLE, c DOUBLE")
    vec = _vectors(df, ["a", "b", "c"])
    leaves = build(vec.select("_vid", F.array("a", "b", "c").alias("_x")), 3, 32)[0].groupBy("_node").count().agg(F.max("count"), F.sum("count")).first()
    assert leaves[0] <= 32 and leaves[1] == n
    found, looked = knn(vec, ["a", "b", "c"], 5, leaf=32)
    dist = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    got = found.toPandas().sort_values(["_vid", "slot"]).dist.to_numpy().reshape(n, 5)
    assert np.allclose(got, np.sort(dist, axis=1)[:, :5], rtol=1e-9, atol=0)
    assert looked < n * 32 * 30


def test_ties_copies_and_values_that_most_vectors_share(spark):
    rng = np.random.default_rng(4)
    pts = np.stack([np.where(rng.random(400) < 0.9, 7.0, rng.integers(0, 9, 400)), rng.integers(0, 12, 400).astype(float)], axis=1)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "unit_id LONG, a DOUBLE, b DOUBLE")
    nn = knn_table(df, ["a", "b"], 5, leaf=3).toPandas()
    dist = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    first = {tuple(p): i for i, p in reversed(list(enumerate(pts.tolist())))}
    assert set(nn._vid) == set(first.values()) and (nn.groupby("_vid").size() == 5).all()
    for vid, part in nn.groupby("_vid"):
        assert np.allclose(part.sort_values("slot").dist, np.sort(dist[vid])[:5])


def test_split_carries_no_filter_into_the_expressions_of_its_rows(spark):
    """A test for nulls of the label, once carried into the scan, evaluated the whole derivation of the label in one unsplit method."""
    plan = sm.stratified_split(telemetry(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(cast(" not in plan
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None), (5, 1)], "unit_id long, machine_failure int")
    got = sm.dense_index(rows, sm.md5_key(F.col("unit_id"), 42), ["machine_failure"]).collect()
    assert sorted((r.machine_failure, r.idx) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_neighbours_beyond_the_bound_are_not_ordered(spark, monkeypatch):
    """After the own leaf, only members within a vector's bound reach the window that orders them."""
    from faultline.operators import kdtree

    rng = np.random.default_rng(11)
    rows = [(i, 1, *map(float, x)) for i, x in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "_vid long, _m long, a double, b double, c double")
    ordered, kept, real = [], [], kdtree._nearest

    def counted(pairs, k):
        found = real(pairs, k)
        ordered.append(pairs.count())
        kept.append(found.count())
        return found

    monkeypatch.setattr(kdtree, "_nearest", counted)
    found, looked = kdtree.knn(df, ["a", "b", "c"], 5, leaf=16)
    x = np.array([r[2:] for r in rows])
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    assert {(r["_vid"], r["slot"]): r["nb_vid"] for r in found.collect()} == {(i, s): int(j) for i in range(300) for s, j in enumerate(np.argsort(gaps[i])[:5])}
    met = looked - ordered[0] - 300  # outside of the own leaf, where a vector also meets itself
    assert sum(ordered[1:]) - sum(kept[:-1]) < 0.7 * met


def test_upper_levels_of_the_tree_take_no_pass_of_their_own(spark, monkeypatch):
    """Vectors that the sample holds are split without a job a level; beyond it, the tree and the neighbours stay exact."""
    from faultline.operators import kdtree

    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(size=(300, 2)), np.round(rng.normal(size=(100, 2)), 1), [[np.inf, 0.0], [1e300, -1e300]]])
    pts = np.unique(pts, axis=0)
    df = spark.createDataFrame([(i, 1, [float(a), float(b)]) for i, (a, b) in enumerate(pts)], "_vid long, _m long, _x array<double>")
    written, real = [], kdtree.cut_lineage
    monkeypatch.setattr(kdtree, "cut_lineage", lambda x: (written.append(x.columns), real(x))[1])
    for sample in (kdtree.SAMPLE, 40):
        monkeypatch.setattr(kdtree, "SAMPLE", sample)
        written.clear()
        rows, levels = kdtree.build(df.filter("_vid < 400") if sample > 40 else df, 2, 4)
        if sample > 40:
            assert len(levels) > 3 and len(written) <= 3
        leaf, n = {r["_vid"]: r["_node"] for r in rows.collect()}, rows.count()
        assert n == len(leaf) == (df.count() if sample == 40 else min(400, df.count()))
        nodes = {r["_node"]: r for level in levels for r in level.collect()}
        for node, r in nodes.items():
            inside = []
            for vid, at in leaf.items():
                at = int(at)
                while at > node:
                    at = (at - 1) // 4
                if at == node:
                    inside.append(vid)
            x = pts[inside]
            assert r["n"] == len(inside) and (r["n"] <= 4) == r["is_leaf"]
            assert np.array_equal(r["lo"], x.min(axis=0)) and np.array_equal(r["hi"], x.max(axis=0))
    flat = df.filter("_vid < 390").select("_vid", "_m", F.col("_x")[0].alias("a"), F.col("_x")[1].alias("b"))
    found = kdtree.knn(flat, ["a", "b"], 3, leaf=8)[0].toPandas().sort_values(["_vid", "slot"])["dist"].to_numpy().reshape(-1, 3)
    x = pts[:390]
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    assert np.allclose(found, np.sort(gaps, axis=1)[:, :3])
