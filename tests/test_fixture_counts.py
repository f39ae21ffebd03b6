"""FIXTURES.md expected values at sf0.01 (Spark side)."""
from pyspark.sql import functions as F

from conftest import SF_MID
from faultline.operators import features as fe
from faultline.operators import guard as gd
from faultline.operators import sampling as sm
from faultline.operators.rules import heat_rule, overstrain_rule
from faultline.sources.telemetry import telemetry


def test_counts(spark):
    t = telemetry(spark, SF_MID).cache()
    r = t.agg(F.count(F.lit(1)).alias("n"), F.sum("machine_failure").alias("failed"),
              *[F.sum(c).alias(c) for c in ("twf", "hdf", "pwf", "osf", "rnf")]).first()
    assert (r.n, r.failed) == (10000, 565)
    assert (r.twf, r.hdf, r.pwf, r.osf, r.rnf) == (79, 230, 62, 203, 11)
    assert fe.labelled_failures(t).count() == 557
    assert t.filter("rnf = 1 AND machine_failure = 0").count() == 10
    assert t.filter(heat_rule(t.columns)).count() == 142
    assert t.filter(overstrain_rule(t.columns)).count() == 695
    assert fe.overstrain_like(t).count() == 450


def test_failure_type_counts(spark):
    t = fe.with_failure_name(telemetry(spark, SF_MID))
    got = {r.failure_type: r["count"] for r in t.groupBy("failure_type").count().collect()}
    assert (got["TWF"], got["HDF"], got["PWF"], got["OSF"], got["RNF"]) == (79, 230, 60, 187, 11)


def test_split_counts(spark):
    s = sm.stratified_split(telemetry(spark, SF_MID)).filter("is_test")
    got = {r.machine_failure: r["count"] for r in s.groupBy("machine_failure").count().collect()}
    assert got == {0: 1887, 1: 113}


def test_guard_layers(spark):
    t = telemetry(spark, SF_MID)
    m = gd.fit_guard(t)
    s = m.transform(t).cache()

    def cnt(cond):
        return s.filter(cond).count()
    assert (cnt("machine_failure = 1 AND l1_stats"), cnt("machine_failure = 1 AND l2_physics"),
            cnt("machine_failure = 1 AND anomaly")) == (37, 20, 44)
    assert (cnt("machine_failure = 0 AND l1_stats"), cnt("machine_failure = 0 AND l2_physics"),
            cnt("machine_failure = 0 AND anomaly")) == (47, 147, 157)
    zero = s.filter("tool_wear_min = 0")
    assert zero.count() == 69 and zero.filter("l2_physics").count() == 69
