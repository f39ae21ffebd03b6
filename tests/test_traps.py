"""Semantics traps on tiny in-memory tables: NaN, zero division, rule variants, precedence, labels."""
import math

from pyspark.sql import functions as F

from faultline.functions.labels import failure_code, failure_name
from faultline.operators import features as fe
from faultline.operators import guard as gd
from faultline.operators.rules import apply_overrides, heat_rule, overstrain_rule

COLS = "unit_id BIGINT, rpm DOUBLE, torque_nm DOUBLE, tool_wear_min DOUBLE, power_w DOUBLE, " \
       "temp_diff_k DOUBLE, strain_load DOUBLE, machine_failure INT"


def _healthy(spark, n=200):
    rows = []
    for i in range(n):
        rpm, torque, wear = 1400.0 + (i % 17) * 7, 30.0 + (i % 13), 20.0 + (i % 23) * 5
        power = rpm * torque * 2 * math.pi / 60
        rows.append((i, rpm, torque, wear, power, 8.0 + (i % 5) * 0.3, wear * torque, 0))
    return spark.createDataFrame(rows, COLS)


def test_nan_is_never_flagged(spark):
    m = gd.fit_guard(_healthy(spark))
    probe = spark.createDataFrame([(1000, float("nan"), 40.0, 100.0, 6000.0, 9.0, 4000.0, 0)], COLS)
    probe = fe.coerce_numeric(probe, ["rpm"])  # NaN -> NULL at the source
    row = m.transform(probe).first()
    assert row.l1_stats is False


def test_zero_expected_power_no_exception(spark):
    m = gd.fit_guard(_healthy(spark))
    probe = spark.createDataFrame([(1, 0.0, 40.0, 0.0, 0.0, 9.0, 0.0, 0)], COLS)
    row = m.transform(probe).first()  # ANSI on: a plain x/0 would throw
    assert row.l2_physics in (True, False)


def test_unworn_tool_trips_physics_layer(spark):
    m = gd.fit_guard(_healthy(spark))
    probe = spark.createDataFrame([(1, 1450.0, 35.0, 0.0, 1450.0 * 35 * 2 * math.pi / 60, 9.0, 0.0, 0)], COLS)
    assert m.transform(probe).first().l2_physics is True


def test_power_tolerance(spark):
    m = gd.fit_guard(_healthy(spark))
    e = 1450.0 * 35 * 2 * math.pi / 60
    ok = spark.createDataFrame([(1, 1450.0, 35.0, 100.0, e, 9.0, 3500.0, 0)], COLS)
    bad = spark.createDataFrame([(2, 1450.0, 35.0, 100.0, e * 1.3, 9.0, 3500.0, 0)], COLS)
    assert m.transform(ok).first().l2_physics is False
    assert m.transform(bad).first().l2_physics is True


def test_probe_rows(spark):
    m = gd.fit_guard(_healthy(spark))
    got = {r.name: (r.layer1, r.layer2) for r in gd.score_probes(m, spark).collect()}
    assert got["power violation"][1] == "ANOMALY"
    assert got["extreme speed"][0] == "ANOMALY"
    assert got["negative gap"][1] == "ANOMALY"
    assert got["extreme strain"][1] == "ANOMALY"


def test_overstrain_absent_columns(spark):
    df = spark.createDataFrame([(205.0, 40.0, 11500.0), (190.0, 50.0, 11500.0), (210.0, 50.0, 100.0)],
                               "tool_wear_min DOUBLE, torque_nm DOUBLE, strain_load DOUBLE")
    full = [r[0] for r in df.select(overstrain_rule(df.columns)).collect()]
    no_torque = df.drop("torque_nm")
    nt = [r[0] for r in no_torque.select(overstrain_rule(no_torque.columns)).collect()]
    no_strain = df.drop("strain_load")
    ns = [r[0] for r in no_strain.select(overstrain_rule(no_strain.columns)).collect()]
    assert full == [True, True, True]
    assert nt == [True, True, True]
    assert ns == [False, False, True]
    only_wear = df.select("tool_wear_min")
    assert [r[0] for r in only_wear.select(overstrain_rule(only_wear.columns)).collect()] == [False] * 3


def test_precedence_overstrain_over_heat_over_model(spark):
    df = spark.createDataFrame(
        [(1, 5.0, 250.0, 50.0, 13000.0, 0, None, 0.1),   # both rules -> OSF
         (2, 5.0, 10.0, 30.0, 300.0, 0, None, 0.1),      # heat only -> HDF
         (3, 9.0, 10.0, 30.0, 300.0, 1, 2, 0.6),         # model only -> its diagnosis
         (4, 9.0, 10.0, 30.0, 300.0, 0, 2, 0.1)],        # nobody -> untyped
        "id INT, temp_diff_k DOUBLE, tool_wear_min DOUBLE, torque_nm DOUBLE, strain_load DOUBLE, "
        "detector_pred INT, diagnosis INT, detector_prob DOUBLE")
    out = {r.id: (r.final_pred, r.final_type, r.display_prob) for r in apply_overrides(df).collect()}
    assert out[1] == (1, 3, 0.75)
    assert out[2] == (1, 1, 0.26)
    assert out[3] == (1, 2, 0.6)
    assert out[4] == (0, None, 0.1)


def test_failure_code_vs_name(spark):
    df = spark.createDataFrame([(1, 0, 1, 0, 1, 0), (0, 0, 0, 0, 0, 1), (1, 0, 0, 0, 0, 0)],
                               "machine_failure INT, twf INT, hdf INT, pwf INT, osf INT, rnf INT")
    rows = df.select(failure_code().alias("c"), failure_name().alias("n")).collect()
    assert [(r.c, r.n) for r in rows] == [(1, "HDF"), (4, "RNF"), (None, "NoLabel")]
    assert fe.labelled_failures(df).count() == 1  # needs the failed label AND a flag


def test_heat_rule_null_safe(spark):
    df = spark.createDataFrame([(None,), (6.0,), (8.0,)], "temp_diff_k DOUBLE")
    assert [r[0] for r in df.select(heat_rule(df.columns)).collect()] == [False, True, False]


def test_coerce_bad_text(spark):
    df = spark.createDataFrame([("1.5",), ("bad",), (None,)], "rpm STRING")
    got = [r.rpm for r in fe.fill_missing(fe.coerce_numeric(df, ["rpm"]), ["rpm"], 0.0).collect()]
    assert got == [1.5, 0.0, 0.0]


def test_type_encoding_unknown_is_null(spark):
    df = spark.createDataFrame([("L",), ("M",), ("H",), ("X",)], "type STRING")
    assert [r.type_encoded for r in fe.encode_type(df).collect()] == [0, 1, 2, None]


def test_physics_formulas(spark):
    df = spark.createDataFrame([(300.0, 310.5, 1500.0, 40.0, 100.0)],
                               "air_temp_k DOUBLE, process_temp_k DOUBLE, rpm DOUBLE, torque_nm DOUBLE, "
                               "tool_wear_min DOUBLE")
    r = fe.add_physics(df).first()
    assert abs(r.power_w - 2 * math.pi * 1500 * 40 / 60) < 1e-9
    assert r.temp_diff_k == 10.5 and r.strain_load == 4000.0
    assert F is not None
