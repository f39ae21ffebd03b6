"""Distributed selection against numpy: ties, outliers, skew, missing values, groups, many rounds."""
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.operators import guard as gd
from faultline.operators import quantiles as qn
from faultline.operators import stats
from faultline.sources.telemetry import telemetry

QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def check(got, xs):
    xs = [x for x in xs if x is not None and not math.isnan(x)]
    if not xs:
        assert got == [None] * len(QS)
    else:
        assert np.allclose(got, [quantile(sorted(xs), q) for q in QS], rtol=1e-12, atol=1e-300)


def quantile(xs, q):
    """Linear between neighbours; beside an infinity, the infinity."""
    at = q * (len(xs) - 1)
    a, b = xs[math.floor(at)], xs[math.ceil(at)]
    if a == b or at == math.floor(at) or math.isinf(a):
        return a
    return b if math.isinf(b) else a + (b - a) * (at - math.floor(at))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1.0, 2.5, -3.0, float("nan")]), st.floats(-1e300, 1e300), st.sampled_from([math.inf, -math.inf, 5e-324])), max_size=40))
def test_any_values_through_forced_rounds(spark, xs):
    old, qn.FETCH = qn.FETCH, 0
    try:
        df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(2)
        check(qn.select_quantiles(df, {"x": F.col("x")}, QS)[None]["x"], xs)
    finally:
        qn.FETCH = old


@pytest.mark.parametrize("fetch", [0, 30, 50_000])
def test_groups_ties_and_one_outlier(spark, fetch, monkeypatch):
    monkeypatch.setattr(qn, "FETCH", fetch)
    rng = np.random.default_rng(1)
    rows = [(g, float(x), float(k % 3)) for g, n in (("a", 700), ("b", 5), (None, 40)) for k, x in enumerate(rng.lognormal(0, 3, n))]
    rows += [("a", 1e9, None), ("c", None, float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = qn.select_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, QS, "g")
    assert set(got) == {"a", "b", "c", None}
    for g, found in got.items():
        check(found["x"], [r[1] for r in rows if r[0] == g])
        check(found["y"], [r[2] for r in rows if r[0] == g])


def test_one_infinity_among_many_rows(spark):
    rows = spark.range(120_000).select(F.when(F.col("id") == 7, F.lit(math.inf)).otherwise(F.exp(F.col("id") / 400.0 - 150)).alias("x"))
    got = qn.select_quantiles(rows, {"x": F.col("x")}, QS)[None]["x"]
    xs = np.sort(np.where(np.arange(120_000) == 7, np.inf, np.exp(np.arange(120_000) / 400.0 - 150)))
    assert np.allclose(got, [quantile(xs, q) for q in QS], rtol=1e-9)
    hurt = telemetry(spark, SF_SMALL).withColumn("rpm", F.when(F.col("unit_id") == 3, F.lit(math.inf)).otherwise(F.col("rpm")))
    model = gd.fit_guard(hurt)
    assert model.transform(hurt).count() == hurt.count() and stats.describe(hurt, ["rpm"]).first().max == math.inf


def test_quantiles_of_many_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(x), float(k % 4)) for k, (g, x) in enumerate(zip(rng.integers(0, 300, 3000), rng.lognormal(0, 2, 3000)))]
    rows += [(1000, 5.0, 1.0)] * 2500 + [(1001, math.inf, -math.inf), (1001, 1.0, 2.0), (1002, None, float("nan")), (None, 3.0, 1.0), (1003, -0.0, 0.0), (1003, 0.0, None)]
    df = spark.createDataFrame(rows, "g long, x double, y double").repartition(7)
    names = {c: [f"{c}{i}" for i in range(len(QS))] for c in ("x", "y")}
    got = {r.g: r for r in qn.group_quantiles(df, "g", {"x": F.col("x"), "y": F.col("y")}, QS, names).collect()}
    assert set(got) == {r[0] for r in rows if r[0] is not None}
    for g, r in got.items():
        for at, c in ((1, "x"), (2, "y")):
            check([r[n] for n in names[c]], [row[at] for row in rows if row[0] == g])
    assert qn.group_quantiles(df.limit(0), "g", {"x": F.col("x")}, [0.5], {"x": ["m"]}).count() == 0


def test_nan_is_left_out_of_every_statistic(spark):
    t = telemetry(spark, SF_SMALL).withColumn("pred", F.lit(0))
    cols = ["power_w", "temp_diff_k", "strain_load"]
    hurt = t.unionByName(t.withColumns({c: F.lit(float("nan")) for c in cols}))
    same = lambda f: sorted(map(str, f(t).collect())) == sorted(map(str, f(hurt).collect()))
    assert same(lambda d: stats.type_summary(d)) and same(lambda d: stats.mean_std_profile(d, cols))
    assert same(lambda d: stats.missed_vs_caught(d).drop("n"))
    d = lambda df: {r.feature: r.cohens_d for r in stats.cohens_d(df, F.col("twf") == 1, cols).collect()}
    assert d(t) == d(hurt)
    z = stats.zscores_against(t, hurt, cols)
    assert sorted(map(str, z.collect())) == sorted(map(str, stats.zscores_against(t, t, cols).collect()))


def test_no_percentile_in_any_plan(spark, capsys):
    t = telemetry(spark, SF_SMALL)
    for df in (stats.describe(t, ["rpm", "power_w"]), stats.box_stats(t, "type", ["rpm"]), gd.detection_report(gd.fit_guard(t).transform(t))):
        df.explain("formatted")
    assert "percentile" not in capsys.readouterr().out


def test_raw_nan_is_never_flagged(spark):
    t = telemetry(spark, SF_SMALL)
    model = gd.fit_guard(t)
    nan = F.lit(float("nan"))
    hurt = t.withColumns({c: nan for c in ("rpm", "torque_nm", "tool_wear_min", "power_w", "temp_diff_k", "strain_load")})
    assert not any(r.anomaly for r in model.transform(hurt).collect())
    from faultline.operators.rules import rule_flags
    one = hurt.withColumn("torque_nm", F.lit(50.0))
    assert not any(r.heat_rule or r.overstrain_rule for r in rule_flags(one).collect())
    mixed = t.unionByName(hurt)
    again = gd.fit_guard(mixed)
    assert again.bounds.stats == model.bounds.stats
    assert stats.describe(mixed, ["rpm"]).first().q50 == stats.describe(t, ["rpm"]).first().q50


def test_many_quantiles_search_their_brackets(spark, monkeypatch):
    """63 ranks a column: a value is searched among the brackets instead of joined with each of them, pass by pass and at the end."""
    rng = np.random.default_rng(3)
    rows = [(int(k % 2), float(x), float(y) if k % 9 else None) for k, (x, y) in enumerate(zip(rng.normal(size=2000).round(2), rng.pareto(0.5, 2000)))]
    rows += [(0, math.inf, -math.inf), (1, float("nan"), 5e-324), (None, 1.0, 1e300)]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(3)
    qs, passes, real = [i / 64 for i in range(1, 64)], [], qn._searched
    monkeypatch.setattr(qn, "_searched", lambda *a: passes.append(a[2:]) or real(*a))
    for bins, fetch in ((1024, 0), (16, 0), (16, 3000)):
        monkeypatch.setattr(qn, "BINS", bins)
        monkeypatch.setattr(qn, "FETCH", fetch)
        found = qn.select_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, qs, "g")
        for g, by in found.items():
            for i, name in enumerate("ab", 1):
                xs = sorted(r[i] for r in rows if r[0] == g and r[i] is not None and not math.isnan(r[i]))
                assert by[name] == [pytest.approx(quantile(xs, q), rel=1e-12) for q in qs]
    assert () in passes and {p[0] for p in passes if p} == {16, 1024}  # values at the end, bins before
