"""Model store, quarantine of uploads, live sink."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.operators import features as fe
from faultline.operators import guard as gd
from faultline.operators import model_store
from faultline.operators import models as md
from faultline.schema import LABEL, MODEL_FEATURES
from faultline.sources.telemetry import checked_sensor_csv, telemetry
from faultline.streaming import live_sink


@pytest.fixture(scope="module")
def fitted(spark):
    t = fe.encode_type(telemetry(spark, SF_SMALL))
    return t, md.fit_boosted_detector(t, MODEL_FEATURES, LABEL, params={"trees": 8, "depth": 3, "rate": 0.2}), md.fit_diagnoser(md.diagnoser_frame(t), num_trees=4), gd.fit_guard(t, forest=True)


def scores(t, m):
    s = m.guard.transform(m.diagnoser.transform(m.detector.transform(t)))
    return sorted(map(tuple, s.select("unit_id", "detector_prob", "detector_pred", "diagnosis", "l3_isolation", "anomaly_score", "anomaly").collect()))


def test_models_score_the_same_after_a_reload(spark, fitted, tmp_path):
    t, detector, diagnoser, guard = fitted
    root = str(tmp_path / "store")
    assert model_store.publish(spark, root, detector, diagnoser, guard) == 1
    again = model_store.load(spark, root)
    assert again.version == 1 and again.detector.threshold == detector.threshold
    assert scores(t, again) == scores(t, model_store.StoredModels(1, detector, diagnoser, guard))


def test_a_half_written_version_is_never_loaded(spark, fitted, tmp_path, monkeypatch):
    _, detector, diagnoser, _ = fitted
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        model_store.load(spark, root)
    model_store.publish(spark, root, detector)

    def broken(models, spark, folder):
        detector.model.save(spark, f"{folder}/detector")
        raise OSError("executor lost")

    monkeypatch.setattr(model_store, "write_models", broken)
    with pytest.raises(OSError):
        model_store.publish(spark, root, detector, diagnoser)
    assert model_store.load(spark, root).version == 1 and model_store.load(spark, root).diagnoser is None
    monkeypatch.undo()
    assert model_store.publish(spark, root, detector, diagnoser) == 2
    assert model_store.load(spark, root).diagnoser is not None and model_store.load(spark, root, version=1).diagnoser is None


def test_forest_fallbacks_are_stored_too(spark, fitted, tmp_path):
    t = fitted[0]
    forest = md.fit_detector(t, algo="rf", params={"numTrees": 3, "maxDepth": 3})
    root = str(tmp_path / "store")
    model_store.publish(spark, root, forest)
    again = model_store.load(spark, root).detector
    p = lambda d: [r[0] for r in d.transform(t).orderBy("unit_id").select("detector_prob").collect()]
    assert p(again) == p(forest)


def test_quarantine_keeps_every_rejected_line_with_its_reason(spark, tmp_path):
    lines = ["UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],Torque [Nm],Tool wear [min],Machine failure,TWF,HDF,PWF,OSF,RNF",
             "1,L1,L,300,310,1500,40,10,0,0,0,0,0,0", "2,L2,L,NaN,310,1500,x,10,0,0,0,0,0,0", "3,L3,Q,300,310,Infinity,40,,0,0,0,0,0,0", "4,L4,L,300",
             "5,L5,L,300,310,1500,40,10,0,0,0,0,0,0,9,9", "6,L6,H,1e2,310,1500,40,10,0,0,0,0,0,0", ""]
    (tmp_path / "up.csv").write_text("\n".join(lines) + "\n")
    accepted, rejected = checked_sensor_csv(spark, str(tmp_path / "up.csv"))
    assert {r.unit_id: r.air_temp_k for r in accepted.collect()} == {"1": 300.0, "6": 100.0}
    assert {r.unit_id: r.reason for r in rejected.collect()} == {
        "2": "no number in air_temp_k; no number in torque_nm", "3": "not finite: rpm; missing tool_wear_min; unknown type", "4": "malformed line", "5": "malformed line"}
    assert {r.line for r in rejected.filter("line is not null").collect()} == {lines[4], lines[5]}
    assert dict(accepted.dtypes)["rpm"] == "double"


def test_a_repeated_batch_leaves_the_same_rows_and_counts(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    files = [[(1, day(1), True), (2, day(2), False)], [(3, day(3), True), (4, day(1, 5), True)], [(5, day(2, 22), None)]]
    batches = [spark.createDataFrame(rows, "unit_id LONG, ts TIMESTAMP, alert BOOLEAN") for rows in files]
    root, write = str(tmp_path / "live"), live_sink.writer(str(tmp_path / "live"))
    for k, b in enumerate(batches):
        write(b, k)
    look = lambda: (sorted(map(tuple, live_sink.rows(spark, root).select("batch_id", "unit_id").collect())),
                    sorted(tuple(r) for r in live_sink.metrics(spark, root).select("batch_id", "rows", "alerts", "late_rows").collect()))
    first = look()
    assert first == ([(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)], [(0, 2, 1, 0), (1, 2, 2, 1), (2, 1, 0, 1)])
    for k in (1, 2, 0):
        write(batches[k], k)
        assert look() == first


def test_a_restarted_stream_goes_on_where_it_was(spark, tmp_path):
    schema = "unit_id LONG, ts TIMESTAMP, alert BOOLEAN"
    source, root = str(tmp_path / "in"), str(tmp_path / "live")
    assert live_sink.metrics(spark, root).count() == 0
    for k in range(3):
        spark.createDataFrame([(k, dt.datetime(2024, 1, 1 + k), k == 1)], schema).coalesce(1).write.mode("append").parquet(source)
        live_sink.drain(spark.readStream.schema(schema).parquet(source), root)
    assert sorted(r.unit_id for r in live_sink.rows(spark, root).collect()) == [0, 1, 2]
    total = live_sink.metrics(spark, root).agg(F.sum("rows"), F.sum("alerts"), F.sum("late_rows"), F.count("*")).first()
    assert tuple(total) == (3, 1, 0, 3)
