"""Plan-shape guards for the scale claims: column pruning at the scan, no Python in guard scoring."""
import re

from conftest import SF_SMALL
from faultline.operators import guard as gd
from faultline.operators import stats as st
from faultline.sources.telemetry import telemetry


def _plan(df, capsys):
    df.explain(mode="formatted")
    return capsys.readouterr().out


def test_guard_report_scans_one_column(spark, capsys):
    t = telemetry(spark, SF_SMALL)
    m = gd.fit_guard(t)
    plan = _plan(gd.detection_report(m.transform(t)), capsys)
    assert "ReadSchema: struct<event_id:bigint>" in plan
    assert "PythonUDF" not in plan and "MapInPandas" not in plan and "ArrowEvalPython" not in plan


def test_describe_is_one_aggregate(spark, capsys):
    plan = _plan(st.describe(telemetry(spark, SF_SMALL), ["rpm", "power_w"]), capsys)
    # formatted plans list each operator once in the details section: "(n) Exchange"
    assert len(re.findall(r"^\(\d+\) Exchange", plan, flags=re.M)) == 1
