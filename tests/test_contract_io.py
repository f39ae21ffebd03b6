"""Input contracts, column resolution, alignment, writers and model persistence."""
import os
import tempfile

import pytest
from pyspark.ml import PipelineModel

from conftest import SF_SMALL
from faultline.operators import features as fe
from faultline.operators import models as md
from faultline.schema import ContractError, MODEL_FEATURES, missing_columns, require_columns, resolve_column
from faultline.sources.telemetry import read_sensor_csv, telemetry, write_table


def test_contract(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "rpm DOUBLE, torque_nm DOUBLE")
    with pytest.raises(ContractError) as e:
        require_columns(df, ["rpm", "tool_wear_min", "air_temp_k"])
    assert e.value.missing == ["tool_wear_min", "air_temp_k"]
    assert missing_columns(df, ["rpm", "x"]) == ["x"]
    assert resolve_column(["Power", "Temp_Diff"], "Power_W", "Power") == "Power"
    with pytest.raises(ContractError):
        fe.add_physics(df)


def test_align(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "x")], "unit_id LONG, rpm DOUBLE, extra DOUBLE, s STRING")
    out = fe.align_to(df, ["torque_nm", "rpm"])
    assert out.columns == ["unit_id", "torque_nm", "rpm"]
    assert tuple(out.first()) == (1, 0.0, 2.0)


def test_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="faultline-io-")
    src = spark.createDataFrame(
        [("1", "M14860", "M", "298.1", "308.6", "1551", "42.8", "0", "0", "0", "0", "0", "0", "0")],
        "UDI STRING, `Product ID` STRING, Type STRING, `Air temperature [K]` STRING, "
        "`Process temperature [K]` STRING, `Rotational speed [rpm]` STRING, `Torque [Nm]` STRING, "
        "`Tool wear [min]` STRING, `Machine failure` STRING, TWF STRING, HDF STRING, PWF STRING, OSF STRING, RNF STRING")
    path = write_table(src, os.path.join(d, "raw"), fmt="csv")
    df = fe.prepare_features(read_sensor_csv(spark, path))
    r = df.first()
    assert r.unit_id == 1 and r.machine_failure == 0 and r.type_encoded == 1 and abs(r.temp_diff_k - 10.5) < 1e-9
    out = write_table(df, os.path.join(d, "features"))
    assert spark.read.parquet(out).count() == 1


def test_model_persistence(spark):
    t = fe.encode_type(telemetry(spark, SF_SMALL))
    det = md.fit_detector(t, algo="rf", params={"numTrees": 5, "maxDepth": 3})
    d = tempfile.mkdtemp(prefix="faultline-model-")
    det.model.write().overwrite().save(d)
    again = md.Detector(PipelineModel.load(d), list(MODEL_FEATURES))
    a = det.transform(t).select("unit_id", "detector_prob").orderBy("unit_id").collect()
    b = again.transform(t).select("unit_id", "detector_prob").orderBy("unit_id").collect()
    assert a == b


def test_guard_persistence(spark):
    from faultline.operators import guard as gd
    t = telemetry(spark, SF_SMALL)
    m = gd.fit_guard(t, forest=True, forest_params={"max_depth": 5})
    d = tempfile.mkdtemp(prefix="faultline-guard-")
    gd.save_guard(m, spark, d)
    again = gd.load_guard(spark, d)
    cols = ["unit_id", "l1_stats", "l2_physics", "l3_isolation", "anomaly", "anomaly_score"]
    a = m.transform(t).select(*cols).orderBy("unit_id").collect()
    b = again.transform(t).select(*cols).orderBy("unit_id").collect()
    assert a == b


def test_robust_forest_same_features_out(spark):
    from faultline.operators.iforest import fit_forest
    from faultline.schema import GUARD_FEATURES
    t = telemetry(spark, SF_SMALL).filter("machine_failure = 0")
    f = fit_forest(t, GUARD_FEATURES, n_trees=20, robust=True)
    s = f.transform(t)
    assert s.select(*GUARD_FEATURES).exceptAll(t.select(*GUARD_FEATURES)).count() == 0
    assert 0.0 < s.agg({"l3_isolation": "count"}).first()[0]


def test_top_up(spark):
    from pyspark.sql import functions as F
    from faultline.operators import sampling as sm
    df = spark.range(0, 50).withColumnRenamed("id", "draw_id").withColumn("is_draw", F.lit(0)) \
        .withColumn("unit_id", F.col("draw_id"))
    out = sm.top_up(df, 80)
    assert out.count() == 80 and out.filter("is_draw = 2").count() == 30
