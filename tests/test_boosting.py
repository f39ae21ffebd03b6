"""Boosted trees grown together on Spark: against a plain loop, independence of partitions, search recalls, weights."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.operators import boosting as bo
from faultline.operators import features as fe
from faultline.operators import models as md
from faultline.schema import LABEL, MODEL_FEATURES
from faultline.sources.telemetry import telemetry


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 3)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0.5)).astype(int)
    flip = rng.random(600) < 0.05
    return pd.DataFrame({"unit_id": np.arange(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": np.where(flip, 1 - y, y), "fold": np.arange(600) % 3})


def plain_boosting(x, y, inside, rounds, depth, rate):
    """Margins of all rows after boosting on the rows ``inside``; every split is tried at every cut, one node at a time."""
    cuts = [np.unique(np.quantile(x[:, f], [i / bo.BINS for i in range(1, bo.BINS)])) for f in range(x.shape[1])]
    margin = np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * inside * bo.UNIT) / bo.UNIT, np.rint(np.maximum(p * (1 - p), 1e-5) * inside * bo.UNIT) / bo.UNIT
        leaves = [(np.ones(len(x), bool), 0)]
        while leaves:
            rows, level = leaves.pop()
            at = rows & (inside > 0)
            best = (1e-6, None, None)
            for f in range(x.shape[1]):
                for cut in cuts[f] if level < depth else ():
                    left = at & (x[:, f] <= cut)
                    gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[at & ~left].sum(), h[at & ~left].sum()
                    gain = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - g[at].sum() ** 2 / (h[at].sum() + 1)
                    if min(hl, hr) >= bo.MIN_CHILD and gain > best[0] + 1e-12:
                        best = (gain, f, cut)
            if best[1] is None:
                margin = margin + rows * (-rate * g[at].sum() / (h[at].sum() + 1))
            else:
                side = x[:, best[1]] <= best[2]
                leaves += [(rows & side, level + 1), (rows & ~side, level + 1)]
    return margin


def test_models_grown_together_equal_a_plain_loop(spark, rows):
    df = spark.createDataFrame(rows)
    specs = [bo.Spec(6, 3, 0.3), bo.Spec(6, 3, 0.3, fold=1), bo.Spec(3, 2, 0.1, fold=0)]
    models, scores = bo.fit_many(df, ["a", "b", "c"], "y", specs, fold="fold", keep_at=[3, 6])
    x, y = rows[["a", "b", "c"]].to_numpy(), rows["y"].to_numpy()
    for spec, model in zip(specs, models):
        inside = np.ones(600) if spec.fold is None else (rows["fold"] != spec.fold).to_numpy().astype(float)
        want = plain_boosting(x, y, inside, spec.rounds, spec.depth, spec.rate)
        assert np.allclose(model.margins(x)[:, 0], want, atol=1e-9)
    held = scores.toPandas()
    for spec, rounds in ((1, 3), (1, 6), (2, 3)):
        part = held[(held.spec == spec) & (held.rounds == rounds)].sort_values("key")
        assert (part.key.to_numpy() == rows.index[rows.fold == specs[spec].fold]).all()
        m = models[spec].first(rounds).margins(x[part.key])
        assert np.allclose([p[1] for p in part.prob], 1 / (1 + np.exp(-m[:, 0])), atol=1e-12)


def test_partitions_do_not_matter_and_models_survive_a_reload(spark, rows, tmp_path):
    df = spark.createDataFrame(rows)
    spec = bo.Spec(25, 3, 0.2)
    a = bo.fit_many(df, ["a", "b", "c"], "y", [spec])[0][0]
    old, bo.ROWS_A_PARTITION, bo.FEW_PARTITIONS = (bo.ROWS_A_PARTITION, bo.FEW_PARTITIONS), 60, 2
    try:
        b = bo.fit_many(df.repartition(3, "a"), ["a", "b", "c"], "y", [spec])[0][0]
    finally:
        bo.ROWS_A_PARTITION, bo.FEW_PARTITIONS = old
    assert all((getattr(a, n) == getattr(b, n)).all() for n in ("feature", "threshold", "value", "gain"))
    a.save(spark, str(tmp_path / "m"))
    c = bo.BoostedModel.load(spark, str(tmp_path / "m"))
    assert c.spec == spec and all((getattr(a, n) == getattr(c, n)).all() for n in ("feature", "threshold", "value", "gain"))
    p = [r[0][1] for r in df.orderBy("unit_id").select(a.probabilities(df)).collect()]
    assert np.mean((np.array(p) > 0.5) == rows["y"].to_numpy()) > 0.9
    assert sum(a.importances()) == pytest.approx(1) and a.importances()[2] < 0.2


def test_missing_features_empty_tables_and_one_class(spark, rows):
    df = spark.createDataFrame(rows)
    holes = df.withColumn("a", F.when(F.col("unit_id") % 5 == 0, F.lit(float("nan"))).when(F.col("unit_id") % 7 == 0, F.lit(None)).otherwise(F.col("a")))
    m = bo.fit_many(holes, ["a", "b", "c"], "y", [bo.Spec(5, 3, 0.3)])[0][0]
    assert holes.select(m.probabilities(holes).alias("p")).filter("p[1] between 0 and 1").count() == 600
    none = bo.fit_many(df.limit(0), ["a", "b", "c"], "y", [bo.Spec(5, 3, 0.3)])[0][0]
    assert df.select(none.probabilities(df).alias("p")).filter("p[1] = 0.5").count() == 600
    one = bo.fit_many(df.withColumn("y", F.lit(1)), ["a", "b", "c"], "y", [bo.Spec(20, 3, 0.3)])[0][0]
    assert df.select(one.probabilities(df).alias("p")).filter("p[1] > 0.8").count() == 600


def test_search_takes_the_best_recall_and_scores_say_why(spark, rows, monkeypatch):
    monkeypatch.setattr(bo, "GRID", {"trees": [2, 5], "depth": [1, 3], "rate": [0.01, 0.3]})
    df = spark.createDataFrame(rows.drop(columns="fold"))
    det = md.fit_boosted_detector(df, ["a", "b", "c"], "y", n_draws=4, folds=3, seed=5)
    s = det.search
    assert len(s.points) == 4 and len({tuple(p.values()) for p in s.points}) == 4 and s.points == bo.grid_points(4, 5)
    scores, recalls = s.scores.toPandas(), s.recalls.toPandas().set_index(["point", "fold"]).recall
    assert len(scores) == 4 * 600 and (scores.groupby("point").key.nunique() == 600).all()
    assert (scores[scores.label == 1].groupby(["point", "fold"]).size().groupby("fold").nunique() == 1).all()
    for (point, fold), part in scores[scores.label == 1].groupby(["point", "fold"]):
        assert recalls[point, fold] == pytest.approx((part.prob > 0.5).mean())
    mean = recalls.groupby("point").mean()
    assert s.best == s.points[int(mean.idxmax())] == det.best_params and det.model.spec.rounds == s.best["trees"] == len(det.model.feature)
    again = bo.fit_many(df, ["a", "b", "c"], "y", [bo.Spec(s.best["trees"], s.best["depth"], s.best["rate"])])[0][0]
    assert (again.value == det.model.value).all()


def test_grid_has_27_points():
    assert len(bo.grid_points(99, 1)) == 27 and bo.grid_points(4, 42) == bo.grid_points(4, 42)


def test_diagnoser_probabilities_sum_to_one_and_weights_count(spark):
    t = md.diagnoser_frame(fe.encode_type(telemetry(spark, SF_SMALL)))
    even, plain = md.fit_diagnoser(t, num_trees=8), md.fit_diagnoser(t, num_trees=8, weighted=False)
    a = even.transform(t, probabilities="p").select("unit_id", "failure_type", "diagnosis", "p").orderBy("unit_id").toPandas()
    b = plain.transform(t, probabilities="p").orderBy("unit_id").toPandas()
    pa, pb = np.array(a.p.tolist()), np.array(b.p.tolist())
    assert pa.shape[1] == 5 and np.allclose(pa.sum(axis=1), 1) and (pa > 0).all()
    assert (a.diagnosis == pa.argmax(axis=1)).all() and not np.allclose(pa, pb)
    rare = a.failure_type.value_counts().idxmin()
    assert pa[a.failure_type == rare, rare].mean() > pb[a.failure_type == rare, rare].mean()
    assert (a.diagnosis == a.failure_type).mean() > 0.9


def test_detector_threshold_and_default_decision(spark):
    t = fe.encode_type(telemetry(spark, SF_SMALL))
    det = md.fit_boosted_detector(t, MODEL_FEATURES, LABEL, params={"trees": 20, "depth": 3, "rate": 0.1})
    got = det.transform(t).select("detector_prob", "detector_pred", "detector_default").toPandas()
    assert (got.detector_pred == (got.detector_prob >= 0.25)).all() and (got.detector_default == (got.detector_prob > 0.5)).all()
    assert got.detector_pred.sum() >= got.detector_default.sum() > 0


def test_the_driver_gets_each_sum_once_however_many_partitions(spark):
    from operator import add

    from faultline.operators.sums import summed
    found = spark.sparkContext.parallelize(range(120), 12).mapPartitions(lambda rows: [(k, np.full(3, sum(rows_))) for rows_ in [list(rows)] for k in range(4)])
    collected = []
    few = summed(found, add, 12)
    many = summed(_Counting(found, collected), add, 2)
    assert all((few[k] == 7140).all() and (many[k] == 7140).all() for k in range(4)) and len(few) == len(many) == 4
    assert collected == [4]


class _Counting:
    """An RDD that notes how many values its sums by key send to the driver."""

    def __init__(self, rdd, seen):
        self.rdd, self.seen = rdd, seen

    def getNumPartitions(self):
        return self.rdd.getNumPartitions()

    def reduceByKey(self, *args):
        return _Counting(self.rdd.reduceByKey(*args), self.seen)

    def collect(self):
        got = self.rdd.collect()
        self.seen.append(len(got))
        return got


def test_sums_by_pairs_of_features_equal_plain_ones_and_light_nodes_cost_no_pass(spark, rows, monkeypatch):
    rng = np.random.default_rng(3)
    code = rng.integers(0, bo.BINS, (5, 9000)).astype(np.uint8)
    pairs = [code[f] * np.uint16(bo.BINS) + code[f + 1] if f + 1 < 5 else code[f] for f in range(0, 5, 2)]
    at, sides = np.flatnonzero(code[0] > 9), (rng.integers(-2 ** 20, 2 ** 20, 9000).astype(float), rng.integers(1, 2 ** 18, 9000).astype(float))
    sides = tuple(v[at] for v in sides)
    want = [np.bincount(code[f, at], v, bo.BINS) for v in sides for f in range(5)]
    assert len(at) > bo.PAIRED_ROWS and (bo._histograms(code, pairs, at, sides).reshape(10, -1) == want).all()
    passes = []
    plain = bo.summed
    monkeypatch.setattr(bo, "summed", lambda *a: passes.append(1) or plain(*a))
    model = bo.fit_many(spark.createDataFrame(rows.head(60)), ["a"], "y", [bo.Spec(3, 7, 0.9)])[0][0]
    assert len(passes) < 3 * 7 and (model.feature >= 0).any()


def test_rounds_need_no_jobs_of_their_own(spark, rows):
    df = spark.createDataFrame(rows).repartition(3).cache()
    sc = spark.sparkContext
    jobs = []
    for rounds in (2, 9):
        sc.setJobGroup(f"rounds-{rounds}", "")
        bo.fit_many(df, ["a", "b", "c"], "y", [bo.Spec(rounds, 3, 0.3)])
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    sc._jsc.clearJobGroup()
    assert 0 < jobs[1] <= jobs[0] + 2  # the first fit also fills the cache; seven rounds by job take 14 and more


def test_held_rows_and_passes_by_job_give_the_same(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows.assign(w=np.where(rows["y"] == 1, 40.5, 1.0)))
    specs = [bo.Spec(5, 3, 0.3, fold=1), bo.Spec(3, 2, 0.1), bo.Spec(4, 3, 0.2, classes=3)]
    monkeypatch.setattr(bo, "LEAST_ROWS", 100)  # several tasks that exchange sums
    found = []
    for weight in (None, "w"):
        for change in ({}, {"HELD_ROWS": 0}, {"_local_path": lambda *a: None}):
            with monkeypatch.context() as m:
                for name, value in change.items():
                    m.setattr(bo, name, value)
                models, scores = bo.fit_many(df, ["a", "b", "c"], "y", specs, fold="fold", weight=weight, keep_at=[3, 5])
                found.append((models, sorted(map(tuple, scores.collect()))))
    for (models, scores), others in ((found[0], found[1:3]), (found[3], found[4:])):
        for more, same in others:
            assert same == scores
            for x, y in zip(models, more):
                assert all(np.array_equal(getattr(x, c), getattr(y, c)) for c in ("feature", "threshold", "value", "gain"))


def test_held_rows_of_an_ensemble_are_slices(rows):
    """The root is summed without gathering rows: they stand in the order of their folds."""
    rng = np.random.default_rng(1)
    n, d = 9_000, 3
    code, fold, y = rng.integers(0, bo.BINS, (d, n)).astype(np.uint8), rng.integers(0, 3, n).astype("i4"), rng.integers(0, 2, n).astype("i4")
    half = n // 2
    blocks = [bo._Block(np.arange(n)[part], code[:, part], y[part], np.ones(n)[part], fold[part], []) for part in (slice(0, half), slice(half, n))]
    specs = [bo.Spec(1, 2, 0.1, fold=k) for k in (0, 1, 2, None)]
    held = bo._Held(blocks, specs, [slice(k, k + 1) for k in range(4)], d)
    assert [len(held.parts[o]) for o in range(4)] == [1, 2, 1, 1] and held.block.code.flags.c_contiguous
    held.begin([0, 1, 2, 3])
    feature, cut = np.array([[1, -1, -1]] * 4), np.array([[30, 0, 0]] * 4)
    got = held.sums([0, 1, 2, 3], feature, cut, [[0, 2]] * 4).reshape(4, 2, 2, d, bo.BINS)
    for o, spec in enumerate(specs):
        for i, at in enumerate((fold != spec.fold, (fold != spec.fold) & (code[1] > 30))):
            g, h = np.where(y == 1, -0.5, 0.5) * bo.UNIT, np.full(n, 0.25 * bo.UNIT)
            for side, v in enumerate((g, h)):
                assert all((got[o, i, side, f] == np.bincount(code[f][at], v[at], bo.BINS)).all() for f in range(d))


def test_a_task_holds_the_rows_of_a_gigabyte_in_half_a_gigabyte():
    """9.07 million balanced rows come from 1 GB of events: twelve tasks hold them, with the arrays of a whole round, in 500 MB each."""
    rng = np.random.default_rng(1)
    n, d = 20_000, 9
    block = bo._Block(np.arange(n), rng.integers(0, bo.BINS, (d, n)).astype(np.uint8), rng.integers(0, 2, n).astype("i4"), np.ones(n), rng.integers(0, 3, n).astype("i4"), [])
    specs = [bo.Spec(1, 5, 0.1, fold=k) for k in (0, 1, 2, None)] * 4
    held = bo._Held([block], specs, [slice(k, k + 1) for k in range(16)], d)
    held.begin(list(range(16)))
    held.sums(list(range(16)), np.array([[1, -1, -1]] * 16), np.array([[30, 0, 0]] * 16), [[1, 2]] * 16)
    b = held.block
    arrays = [b.key, b.code, b.y, b.weight, b.fold, held.scale, *b.margin, *held.places, *getattr(held, "pairs", []), *(v for side in held.sides.values() for v in side), *(v for known in held.at.values() for v in known.values())]
    assert 12 * bo.HELD_ROWS >= 9_069_192 and sum(a.nbytes for a in arrays) / n * bo.HELD_ROWS < 500e6


def test_margins_in_place_and_gradients_in_four_bytes_are_those_of_a_block(monkeypatch):
    """Heavy weights keep eight bytes; rows beyond a cached piece count."""
    monkeypatch.setattr(bo, "CACHED_ROWS", 700)
    rng = np.random.default_rng(2)
    n, d = 5_000, 3
    code, y, tree = rng.integers(0, bo.BINS, (d, n)).astype(np.uint8), rng.integers(0, 2, n).astype("i4"), (np.array([[1, 0, -1, -1, -1, -1, -1]]), np.array([[30, 12, 0, 0, 0, 0, 0]]), rng.normal(size=(1, 7)))
    for weight, kind in ((1.0, np.float32), (16.5, np.float64)):
        block = bo._Block(np.arange(n), code, y, np.full(n, weight), np.zeros(n, "i4"), [np.zeros(n)])
        held = bo._Held([block], [bo.Spec(2, 2, 0.1)], [slice(0, 1)], d)
        assert held.sides[0][0].dtype == kind
        held.begin([0])
        held.advance(tree, [0])
        held.begin([0])
        after = bo._advance(block, tree, [0])
        assert (held.block.margin[0] == after.margin[0]).all()
        for side, want in zip(held.sides[0], bo._gradients(after, bo.Spec(2, 2, 0.1), slice(0, 1), 0, np.arange(n))):
            assert (side == want).all()
