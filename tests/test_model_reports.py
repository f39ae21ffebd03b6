"""Every model report recomputed from the rows of scores it rests on."""
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from faultline.operators import scenario as sc
from faultline.plans.q_models import trained
from faultline.schema import GUARD_FEATURES, LABEL, MODEL_FEATURES

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def table(spark):
    made = {}
    return lambda name: made.setdefault(name, QUERIES[name](spark, SF_SMALL).toPandas())


def check_report(report, y, p):
    got = report.set_index("class")
    for c in sorted(set(y) | set(p)):
        tp, said, real = ((y == c) & (p == c)).sum(), (p == c).sum(), (y == c).sum()
        want = (tp / said if said else 0, tp / real if real else 0, 2 * tp / (said + real))
        assert np.allclose(got.loc[str(c), ["precision", "recall", "f1"]].astype(float), want, atol=1e-4) and got.loc[str(c), "support"] == real
    assert got.loc["accuracy", "f1"] == pytest.approx((y == p).mean(), abs=1e-4)


@pytest.mark.parametrize("pred,report,confusion,summary", [
    ("detector_pred", "detector_report", "detector_confusion", "detector_scores"),
    ("detector_default", "detector_default_report", "detector_default_confusion", "detector_default_scores")])
def test_detector_reports(table, pred, report, confusion, summary):
    s = table("detector_test_scores")
    assert (s.detector_pred == (s.detector_prob >= 0.25)).all() and (s.detector_default == (s.detector_prob > 0.5)).all()
    check_report(table(report), s[LABEL].to_numpy(), s[pred].to_numpy())
    cells = {(r.label, r.pred): r.n for r in table(confusion).itertuples()}
    assert cells == {(a, b): int(((s[LABEL] == a) & (s[pred] == b)).sum()) for a in (0, 1) for b in (0, 1)}
    assert table(summary).accuracy[0] == pytest.approx((s[LABEL] == s[pred]).mean(), abs=1e-4)


def test_search_names_the_detector_s_point(spark, table):
    rows, scores = table("detector_search"), table("detector_search_scores")
    assert len(rows) == 12 and rows.groupby("point").chosen.nunique().eq(1).all() and rows[rows.chosen].point.nunique() == 1
    for r in rows.itertuples():
        part = scores[(scores.point == r.point) & (scores.fold == r.fold) & (scores[LABEL] == 1)]
        assert len(part) == r.n_failures and r.recall == pytest.approx((part.prob > 0.5).mean(), abs=1e-5)
    chosen = rows[rows.chosen].iloc[0]
    spec = trained(spark, SF_SMALL).detector.model.spec
    assert (spec.rounds, spec.depth, spec.rate) == (chosen.trees, chosen.depth, chosen.rate)
    assert rows.groupby("point").recall.mean().max() == pytest.approx(rows[rows.chosen].recall.mean())


def test_diagnoser_reports(table):
    v, p = table("diagnoser_validation"), table("diagnoser_probabilities")
    wide = p.pivot(index="unit_id", columns="failure_type", values="probability")
    assert np.allclose(wide.sum(axis=1), 1, atol=1e-5) and set(wide.index) == set(v.unit_id)
    assert (v.set_index("unit_id").diagnosis.sort_index() == wide.idxmax(axis=1).sort_index()).mean() > 0.99
    n = table("diagnoser_confusion")
    assert table("diagnoser_scores").accuracy[0] == pytest.approx(n[n.label == n.pred].n.sum() / n.n.sum(), abs=1e-4)


def test_importances_ranks_and_physics(table):
    top = table("detector_importance_top")
    assert top.importance.is_monotonic_decreasing and top.importance.sum() == pytest.approx(1, abs=1e-6) and len(top) == len(MODEL_FEATURES)
    rank = {f: k + 1 for k, f in enumerate(top.feature)}
    names = {"power": "power_w", "temp_diff": "temp_diff_k", "strain": "strain_load"}
    for r in table("physics_in_top5").itertuples():
        assert bool(r.in_top) == (rank[names[r.physics]] <= 5)
    drop = table("diagnoser_permutation_importance").set_index("feature")
    assert set(drop.index) == set(MODEL_FEATURES) and (drop.importance_std >= 0).all() and drop.importance_mean.max() > 0.02


def test_cascade_masks_and_precedence(table):
    c, s = table("cascade_scoring"), table("detector_test_scores").set_index("unit_id")
    c = c.set_index("unit_id")
    assert (c.detector_pred == s.detector_pred.loc[c.index]).all()
    assert c.diagnosis.isna().equals(c.detector_pred == 0)
    want_pred = np.where(c.overstrain_rule | c.heat_rule, 1, c.detector_pred)
    want_type = np.where(c.overstrain_rule, 3, np.where(c.heat_rule, 1, c.diagnosis))
    assert (c.final_pred == want_pred).all()
    assert np.array_equal(c.final_type.astype(float).fillna(-1), pd.Series(want_type, index=c.index).astype(float).fillna(-1))
    assert all(c[f"z_{f}"].notna().equals(c.final_pred == 1) for f in ("rpm", "power_w"))
    counts = table("cascade_type_counts")
    assert counts.n.sum() == len(c)


def test_overstrain_missed_and_stress(table):
    o, rows = table("overstrain_detection").iloc[0], table("overstrain_detection_rows")
    assert (o.n_subset, o.n_actual, o.n_detected) == (len(rows), rows.actual_failure.sum(), rows.detected.sum())
    assert (rows.detected == (rows.detector_prob >= 0.25)).all() and (rows.strain_load > 11000).all()
    s = table("detector_test_scores")
    m = table("detector_missed_vs_caught").set_index("outcome").n
    assert m.get("caught", 0) == ((s[LABEL] == 1) & (s.detector_pred == 1)).sum() and m.get("missed", 0) == ((s[LABEL] == 1) & (s.detector_pred == 0)).sum()
    g = table("stress_grid_detector")
    assert (g.status == np.where(g.detector_prob >= 0.25, "DETECTED", "MISSED")).all()


def test_drift_summary_and_steps(table):
    steps, runs = table("drift_step_scores"), table("drift_risk_summary").set_index(["machine_id", "scenario"])
    assert (steps.detector_pred == (steps.detector_prob >= 0.25)).all() and (steps.anomaly == (steps.l1_stats | steps.l2_physics | steps.l3_isolation)).all()
    assert set(steps.scenario) == set(sc.PRESETS) if isinstance(sc.PRESETS, dict) else steps.scenario.nunique() >= 3
    for key, part in list(steps.sort_values("step").groupby(["machine_id", "scenario"]))[:60]:
        r = runs.loc[key]
        hit = part[part.detector_pred == 1].step
        first = r[[c for c in runs.columns if "first" in c][0]]
        assert (pd.isna(first) and hit.empty) or first == hit.min()
        peak = r[[c for c in runs.columns if "peak" in c][0]]
        assert peak == pytest.approx(part.detector_prob.max(), abs=1e-5)


def test_guard_views_with_three_layers(spark, table):
    v, d = table("guard_forest_verdicts").set_index("unit_id"), table("guard_forest_detailed").set_index("unit_id").loc[lambda x: x.index]
    d = d.loc[v.index]
    for flag, signed in (("l1_stats", "layer1_stats"), ("l2_physics", "layer2_physics"), ("l3_isolation", "layer3_isolation"), ("anomaly", "final_prediction")):
        assert (d[signed] == np.where(v[flag], -1, 1)).all()
    assert (d.anomaly_score == v.anomaly_score).all()
    pca, var = table("guard_pca").set_index("unit_id").loc[v.index], table("guard_pca_variance")
    t = trained(spark, SF_SMALL).table.select("unit_id", LABEL, *GUARD_FEATURES).toPandas().set_index("unit_id").loc[v.index]
    z = (t[GUARD_FEATURES] - t[GUARD_FEATURES].mean()) / t[GUARD_FEATURES].std()
    fit = z[t[LABEL] == 0]
    values, vectors = np.linalg.eigh(np.cov((fit - fit.mean()).T))
    assert np.allclose(var.explained_variance_ratio, values[::-1][:2] / values.sum(), atol=1e-6)
    for k, name in ((-1, "pc1"), (-2, "pc2")):
        want = ((z - fit.mean()) @ vectors[:, k]).to_numpy()
        assert np.allclose(np.abs(np.corrcoef(want, pca[name])[0, 1]), 1, atol=1e-6)
    assert (pca.anomaly == v.anomaly).all()


def test_reloaded_models_score_the_same(table):
    r = table("reloaded_scores")
    for c in ("detector_prob", "detector_pred", "diagnosis", "anomaly_score", "anomaly"):
        assert (r[f"{c}_fitted"] == r[f"{c}_loaded"]).all()
