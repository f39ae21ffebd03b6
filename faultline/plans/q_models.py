"""Model-backed queries (E2, F1-F18, H1/H4/H5 with the detector).

Models are trained once per (application, scale dir) and reused by every
query of the process. Training data: the 80/20 stratified split, SMOTE on the
training part (detector), labelled failures with a stratified 80/20
validation split (diagnoser). Model outputs are not SQL-reproducible, so
these queries carry no oracle (rows-only check) except ``class_weights``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import features as fe
from faultline.operators import guard as gd
from faultline.operators import metrics as mt
from faultline.operators import model_store
from faultline.operators import models as md
from faultline.operators import sampling as sm
from faultline.operators import scenario as sc
from faultline.operators import stats as st
from faultline.operators.decision_rules import fit_rules
from faultline.operators.smote import smote
from faultline.plans.fixture import SPLIT_SQL, with_fixture
from faultline.plans.q_forest import forest_guard
from faultline.plans.registry import FAILURE_CODE_SQL, FAILURE_NAME_SQL, TYPE_CODE_SQL, query
from faultline.schema import LABEL, MODEL_FEATURES
from faultline.session import checkpoint_dir, cut_lineage, scratch_path
from faultline.sources.telemetry import telemetry

DETECTOR_PARAMS = {"numTrees": 100, "maxDepth": 10}
GBT_PARAMS = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1}


class Bundle:
    """Training artefacts of one (application, scale dir), each built on first use."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        self.table = fe.encode_type(telemetry(spark, sf))
        split = cut_lineage(sm.stratified_split(self.table))
        self.train = split.filter(~F.col("is_test")).drop("is_test")
        self.test = split.filter(F.col("is_test")).drop("is_test")

    @cached_property
    def balanced(self) -> DataFrame:
        checkpoint_dir(self.spark)  # tree learners checkpoint their node-id cache here
        return cut_lineage(smote(self.train, MODEL_FEATURES))

    @cached_property
    def detector(self) -> md.BoostedDetector:
        """The winner of the randomised search over boosted trees."""
        return md.fit_boosted_detector(self.balanced)

    @cached_property
    def forest_detector(self) -> md.Detector:
        """The random-forest fallback."""
        return md.fit_detector(self.balanced, algo="rf", params=DETECTOR_PARAMS)

    @cached_property
    def gbt_detector(self) -> md.Detector:
        """The boosted-tree detector at the middle of its 27-point grid."""
        return md.fit_detector(self.balanced, algo="gbt", params=GBT_PARAMS)

    @cached_property
    def failures(self) -> DataFrame:
        return cut_lineage(sm.stratified_split(md.diagnoser_frame(self.table), label="failure_type"))

    @cached_property
    def diagnoser(self) -> md.BoostedDiagnoser:
        return md.fit_diagnoser(self.failures.filter(~F.col("is_test")))

    @cached_property
    def forest_diagnoser(self) -> md.Diagnoser:
        return md.fit_forest_diagnoser(self.failures.filter(~F.col("is_test")))

    @cached_property
    def guard(self) -> gd.GuardModel:
        """All three layers, as in batch scoring; the fit is shared with the guard queries."""
        return forest_guard(self.spark, self.sf)[1]


_CACHE: dict = {}


def trained(spark, sf) -> Bundle:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CACHE:
        _CACHE[key] = Bundle(spark, sf)
    return _CACHE[key]


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def _smote_sql(body: str) -> str:
    """The balanced training split with neighbours by comparing all pairs of failures."""
    cols, nb = ", ".join(MODEL_FEATURES), ", ".join(f"b.{f} AS nb_{f}" for f in MODEL_FEATURES)
    gap = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in MODEL_FEATURES)
    mixed = ", ".join(f"{f} + u * (nb_{f} - {f}) AS {f}" for f in MODEL_FEATURES)
    return with_fixture(
        body, ("split", SPLIT_SQL),
        ("train", f"SELECT unit_id, machine_failure, {cols} FROM (SELECT *, {TYPE_CODE_SQL} AS type_encoded FROM split) s WHERE NOT is_test"),
        ("few", "SELECT *, row_number() OVER (ORDER BY md5(concat(CAST(unit_id AS VARCHAR), '|42')), unit_id) - 1 AS pos FROM train WHERE machine_failure = 1"),
        ("size", "SELECT count(*) FILTER (WHERE machine_failure = 1) AS n, count(*) FILTER (WHERE machine_failure = 0) - n AS n_new, least(5, n - 1) AS k FROM train"),
        ("near", f"SELECT a.*, {nb}, row_number() OVER (PARTITION BY a.unit_id ORDER BY sqrt({gap}), b.unit_id) - 1 AS slot FROM few a JOIN few b ON a.unit_id <> b.unit_id"),
        ("draws", "SELECT range AS d, ('0x' || substr(md5(concat(CAST(range AS VARCHAR), '|42')), 1, 15))::BIGINT % (SELECT n * k FROM size) AS pair, "
                  "('0x' || substr(md5(concat(CAST(range AS VARCHAR), '|gap|42')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM range((SELECT n_new FROM size))"),
        ("balanced", f"SELECT unit_id, machine_failure, {cols}, 0 AS is_synthetic FROM train UNION ALL "
                     f"SELECT -1 - d, 1, {mixed}, 1 FROM draws JOIN near ON pos = pair // (SELECT k FROM size) AND slot = pair % (SELECT k FROM size)"))


@query("smote_balanced", _smote_sql("SELECT machine_failure, is_synthetic, count(*) AS n FROM balanced GROUP BY 1, 2"))
def q_smote_balanced(spark, sf):
    """Training split balanced with SMOTE: rows per class and origin."""
    b = trained(spark, sf)
    return b.balanced.groupBy(LABEL, "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("smote_rows", _smote_sql("SELECT unit_id, machine_failure, is_synthetic, " + ", ".join(f"round({f}, 6) AS {f}" for f in MODEL_FEATURES) + " FROM balanced"))
def q_smote_rows(spark, sf):
    b = trained(spark, sf)
    return b.balanced.select("unit_id", LABEL, "is_synthetic", *[_r6(f) for f in MODEL_FEATURES])


@query("class_weights", with_fixture(
    "SELECT failure_type, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS class_weight FROM "
    f"(SELECT {FAILURE_CODE_SQL} AS failure_type, count(*) AS n FROM telemetry WHERE machine_failure = 1 "
    "AND twf + hdf + pwf + osf + rnf > 0 GROUP BY 1) z"))
def q_class_weights(spark, sf):
    w = md.class_weights(md.diagnoser_frame(telemetry(spark, sf)))
    return w.select("failure_type", "n", _r6("class_weight"))


def _detector_test(spark, sf):
    b = trained(spark, sf)
    return b.detector.transform(b.test)


@query("detector_test_scores")
def q_detector_test_scores(spark, sf):
    s = _detector_test(spark, sf)
    return s.select("unit_id", LABEL, _r6("detector_prob"), "detector_pred", "detector_default")


@query("detector_confusion")
def q_detector_confusion(spark, sf):
    return mt.confusion_long(_detector_test(spark, sf), LABEL, "detector_pred", classes=[0, 1])


@query("detector_report")
def q_detector_report(spark, sf):
    return mt.class_report(_detector_test(spark, sf), LABEL, "detector_pred", classes=[0, 1])


@query("detector_scores")
def q_detector_scores(spark, sf):
    return mt.summary_scores(_detector_test(spark, sf), LABEL, "detector_pred", classes=[0, 1])


@query("detector_default_report")
def q_detector_default_report(spark, sf):
    """Report on the default class decision (probability 0.5), the published measure."""
    return mt.class_report(_detector_test(spark, sf), LABEL, "detector_default", classes=[0, 1])


@query("detector_default_confusion")
def q_detector_default_confusion(spark, sf):
    return mt.confusion_long(_detector_test(spark, sf), LABEL, "detector_default", classes=[0, 1])


@query("detector_default_scores")
def q_detector_default_scores(spark, sf):
    return mt.summary_scores(_detector_test(spark, sf), LABEL, "detector_default", classes=[0, 1])


@query("detector_missed_vs_caught")
def q_detector_missed_vs_caught(spark, sf):
    """Average physics values of the failures that the detector misses and catches."""
    return st.missed_vs_caught(_detector_test(spark, sf), pred="detector_pred")


@query("detector_gbt_report")
def q_detector_gbt_report(spark, sf):
    """Boosted-tree detector (MLlib GBT) on the same SMOTE-balanced training split, test report."""
    b = trained(spark, sf)
    return mt.class_report(b.gbt_detector.transform(b.test), LABEL, "detector_pred", classes=[0, 1])


@query("detector_missed_profile")
def q_detector_missed_profile(spark, sf):
    s = _detector_test(spark, sf)
    return st.missed_profile(s, pred="detector_pred")


@query("detector_importance_top")
def q_detector_importance_top(spark, sf):
    b = trained(spark, sf)
    return md.top_k(b.detector.importances(spark), 10)


@query("physics_in_top5")
def q_physics_in_top5(spark, sf):
    b = trained(spark, sf)
    return md.physics_in_top(b.detector.importances(spark), 5)


@query("detector_search")
def q_detector_search(spark, sf):
    """Recall of every drawn grid point in every fold, and whether the point is the detector's."""
    det = trained(spark, sf).detector
    points = [(i, p["trees"], p["depth"], p["rate"], p == det.best_params) for i, p in enumerate(det.search.points)]
    points = spark.createDataFrame(points, "point INT, trees INT, depth INT, rate DOUBLE, chosen BOOLEAN")
    return det.search.recalls.join(F.broadcast(points), "point").select("point", "trees", "depth", "rate", "fold", "n_failures", _r6("recall"), "chosen")


@query("detector_search_scores")
def q_detector_search_scores(spark, sf):
    """Held-out failure probability of every training row at every drawn grid point."""
    scores = trained(spark, sf).detector.search.scores
    return scores.select("point", "fold", F.col("key").alias("unit_id"), F.col("label").alias(LABEL), _r6("prob"))


@query("detector_forest_report")
def q_detector_forest_report(spark, sf):
    """The random-forest fallback on the same balanced training split, test report."""
    b = trained(spark, sf)
    return mt.class_report(b.forest_detector.transform(b.test), LABEL, "detector_pred", classes=[0, 1])


def _diag_all(spark, sf):
    b = trained(spark, sf)
    return b.diagnoser.transform(b.failures)


@query("diagnoser_validation")
def q_diagnoser_validation(spark, sf):
    s = _diag_all(spark, sf).filter(F.col("is_test"))
    return s.select("unit_id", "failure_type", "diagnosis")


@query("diagnoser_probabilities")
def q_diagnoser_probabilities(spark, sf):
    """Probability of every failure type for the validation failures, one row a type."""
    b = trained(spark, sf)
    s = b.diagnoser.transform(b.failures.filter("is_test"), probabilities="types")
    return s.select("unit_id", F.posexplode("types").alias("failure_type", "probability")).withColumn("probability", F.round("probability", 6))


@query("diagnoser_forest_report")
def q_diagnoser_forest_report(spark, sf):
    """The random-forest fallback over all labelled failures."""
    b = trained(spark, sf)
    return mt.class_report(b.forest_diagnoser.transform(b.failures), "failure_type", "diagnosis")


@query("diagnoser_report")
def q_diagnoser_report(spark, sf):
    """Per-type report over all labelled failures (the original evaluation includes training rows)."""
    return mt.class_report(_diag_all(spark, sf), "failure_type", "diagnosis")


@query("diagnoser_confusion")
def q_diagnoser_confusion(spark, sf):
    return mt.confusion_long(_diag_all(spark, sf), "failure_type", "diagnosis")


@query("diagnoser_scores")
def q_diagnoser_scores(spark, sf):
    return mt.summary_scores(_diag_all(spark, sf), "failure_type", "diagnosis")


@query("diagnoser_importance")
def q_diagnoser_importance(spark, sf):
    b = trained(spark, sf)
    return md.top_k(b.diagnoser.importances(spark), 20)


@query("diagnoser_permutation_importance")
def q_diagnoser_permutation_importance(spark, sf):
    """Accuracy drop per permuted feature, 10 repeats, over all labelled failures."""
    b = trained(spark, sf)

    def scorer(df):
        return b.diagnoser.transform(df, out="_pred")

    return md.permutation_importance(b.failures.drop("is_test"), scorer, MODEL_FEATURES, "failure_type", 10)


@query("cascade_scoring")
def q_cascade_scoring(spark, sf):
    """Batch scoring of the test split: detector -> diagnoser -> rule overrides -> guard -> z-scores."""
    b = trained(spark, sf)
    s = md.cascade(b.test, b.detector, b.diagnoser)
    s = b.guard.transform(s)
    z = st.zscores_against(s, b.test, MODEL_FEATURES, nd=3, keep=[c for c in s.columns])
    flagged = F.col("final_pred") == 1
    return z.select("unit_id", LABEL, _r6("detector_prob"), "detector_pred", "diagnosis", "heat_rule",
                    "overstrain_rule", "final_pred", "final_type", _r6("display_prob"), "anomaly",
                    *[F.when(flagged, F.col(f"z_{f}")).alias(f"z_{f}") for f in MODEL_FEATURES])


@query("cascade_type_counts")
def q_cascade_type_counts(spark, sf):
    b = trained(spark, sf)
    s = md.cascade(b.test, b.detector, b.diagnoser)
    return fe.describe_type(s.groupBy(F.col("final_type").alias("failure_type"))
                            .agg(F.count(F.lit(1)).alias("n")))


RULE_FEATURES = ["power_w", "temp_diff_k", "strain_load", "rpm", "torque_nm", "tool_wear_min", "type_encoded"]


def _rule_ctes(folds: int) -> list[tuple[str, str]]:
    """Depth-2 trees by comparing all midpoints: dnodes holds counts and splits of each (model, node); model ``folds`` has all rows."""
    named = [f"COALESCE(CAST({f} AS DOUBLE), 0) AS {f}" for f in RULE_FEATURES]
    value = "CASE f " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(RULE_FEATURES)) + " END"
    ctes = [
        ("lab", f"SELECT unit_id, CAST(failure_type = 'PWF' AS INT) AS y, {', '.join(named)} FROM (SELECT *, {TYPE_CODE_SQL} AS type_encoded, {FAILURE_NAME_SQL} AS failure_type FROM telemetry) e WHERE failure_type <> 'NoLabel'"),
        ("dealt", f"SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(concat(CAST(unit_id AS VARCHAR), '|42')), unit_id) - 1) % {max(folds, 1)} AS fold FROM lab"),
        ("drows0", f"SELECT m.range AS model, 0 AS node, d.* FROM dealt d, range({folds + 1}) m WHERE m.range = {folds} OR m.range <> fold"),
    ]
    for level in (0, 1):
        ctes += [
            (f"dcount{level}", f"SELECT model, node, f.range AS f, {value.replace('CASE f', 'CASE f.range')} AS x, count(*) AS n, sum(y) AS pos FROM drows{level}, range({len(RULE_FEATURES)}) f GROUP BY 1, 2, 3, 4"),
            (f"dsum{level}", f"SELECT *, sum(n) OVER w AS nl, sum(pos) OVER w AS pl, lead(x) OVER w AS nx, sum(n) OVER (PARTITION BY model, node, f) AS na, sum(pos) OVER (PARTITION BY model, node, f) AS pa FROM dcount{level} WINDOW w AS (PARTITION BY model, node, f ORDER BY x)"),
            (f"dbest{level}", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, node ORDER BY 2 * pl * (nl - pl) / nl + 2 * (pa - pl) * ((na - nl) - (pa - pl)) / (na - nl), f, x) AS place FROM dsum{level} WHERE nx IS NOT NULL AND pa > 0 AND pa < na) z WHERE place = 1"),
            (f"dsplit{level}", f"SELECT model, node, f, x / 2 + nx / 2 AS cut FROM dbest{level}"),
            (f"drows{level + 1}", f"SELECT r.* REPLACE (2 * r.node + 1 + CAST({value} > cut AS INT) AS node) FROM drows{level} r JOIN dsplit{level} s ON r.model = s.model AND r.node = s.node"),
        ]
    ctes.append(("dsplits", "SELECT * FROM dsplit0 UNION ALL SELECT * FROM dsplit1"))
    ctes.append(("dnodes", "SELECT model, node, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM (" + " UNION ALL ".join(f"SELECT model, node, y FROM drows{k}" for k in range(3)) + ") z GROUP BY model, node"))
    ctes.append(("dleaves", "SELECT * FROM dnodes WHERE (model, node) NOT IN (SELECT (model, node) FROM dsplits)"))
    return ctes


def _rule_names(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(RULE_FEATURES)) + " END"


@query("pwf_decision_rules", with_fixture(f"""
SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INT) AS leaf, rule, n, pos AS n_positive, CASE WHEN 2 * pos > n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM (
  SELECT l.n, l.pos, CASE WHEN l.node > 2 THEN l.node WHEN l.node > 0 THEN 2 * l.node + 1 ELSE 0 END AS place,
    CASE WHEN l.node = 0 THEN '' ELSE concat({_rule_names('r.f')}, CASE WHEN l.node IN (1, 3, 4) THEN ' <= ' ELSE ' > ' END, printf('%.4f', r.cut)) END
    || CASE WHEN l.node > 2 THEN concat(' AND ', {_rule_names('c.f')}, CASE WHEN l.node IN (3, 5) THEN ' <= ' ELSE ' > ' END, printf('%.4f', c.cut)) ELSE '' END AS rule
  FROM dleaves l LEFT JOIN dsplits r ON r.node = 0 LEFT JOIN dsplits c ON c.node = (l.node - 1) // 2 AND l.node > 2) z""", *_rule_ctes(0)))
def q_pwf_decision_rules(spark, sf):
    """Depth-2 rules separating PWF from other labelled rows (NoLabel dropped), with exact splits."""
    df = fe.encode_type(fe.with_failure_name(telemetry(spark, sf))).filter(F.col("failure_type") != "NoLabel")
    tree, _ = fit_rules(df, RULE_FEATURES, F.col("failure_type") == "PWF")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(tree.rules())], "leaf INT, rule STRING, n LONG, n_positive LONG, prediction DOUBLE")


@query("pwf_rules_cv_f1", with_fixture("""
SELECT fold, round(f1, 9) AS f1, round(avg(f1) OVER (), 9) AS f1_mean FROM (
  SELECT CAST(fold AS INT) AS fold, CASE WHEN sum(y) + sum(p) > 0 THEN 2.0 * sum(y * p) / (sum(y) + sum(p)) ELSE 0.0 END AS f1 FROM (
    SELECT d.fold, d.y, CAST(2 * l.pos > l.n AS INT) AS p FROM dplace d JOIN dleaves l ON l.model = d.fold AND l.node = d.leaf) z GROUP BY fold) q""",
    *_rule_ctes(5), ("dwalk", "SELECT d.*, CASE WHEN s.f IS NULL THEN 0 ELSE 1 + CAST((CASE s.f " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(RULE_FEATURES)) + " END) > s.cut AS INT) END AS first FROM dealt d LEFT JOIN dsplits s ON s.model = d.fold AND s.node = 0"),
    ("dplace", "SELECT d.*, CASE WHEN first = 0 OR s.f IS NULL THEN first ELSE 2 * first + 1 + CAST((CASE s.f " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(RULE_FEATURES)) + " END) > s.cut AS INT) END AS leaf FROM dwalk d LEFT JOIN dsplits s ON s.model = d.fold AND s.node = first AND first > 0")))
def q_pwf_rules_cv_f1(spark, sf):
    """F1 of every stratified fold under the rules of the other four, and their mean."""
    df = fe.encode_type(fe.with_failure_name(telemetry(spark, sf))).filter(F.col("failure_type") != "NoLabel")
    _, f1 = fit_rules(df, RULE_FEATURES, F.col("failure_type") == "PWF", folds=5)
    rows = spark.createDataFrame([(k, float(x), float(sum(f1) / len(f1))) for k, x in enumerate(f1)], "fold INT, f1 DOUBLE, f1_mean DOUBLE")
    return rows.select("fold", F.round("f1", 9).alias("f1"), F.round("f1_mean", 9).alias("f1_mean"))


def _overstrain_scored(spark, sf):
    b = trained(spark, sf)
    return b.detector.transform(fe.overstrain_like(b.test))


@query("overstrain_detection")
def q_overstrain_detection(spark, sf):
    """Overstrain-like test rows: size, actual failures, detected, detection rate."""
    s = _overstrain_scored(spark, sf)
    return s.agg(F.count(F.lit(1)).alias("n_subset"), F.sum(LABEL).cast("bigint").alias("n_actual"),
                  F.sum("detector_pred").cast("bigint").alias("n_detected")) \
        .withColumn("detection_pct", F.round(F.lit(100.0) * F.try_divide(F.col("n_detected").cast("double"),
                                                                         F.col("n_subset")), 6))


@query("overstrain_detection_rows")
def q_overstrain_detection_rows(spark, sf):
    s = _overstrain_scored(spark, sf)
    return s.select("unit_id", "tool_wear_min", "torque_nm", "strain_load", "power_w",
                    F.col(LABEL).alias("actual_failure"), _r6("detector_prob"),
                    (F.col("detector_pred") == 1).alias("detected"))


@query("stress_grid_detector")
def q_stress_grid_detector(spark, sf):
    """Test-population mean row x stress cases, scored with the 0.25 threshold."""
    b = trained(spark, sf)
    base = b.test.agg(*[F.avg(f).alias(f) for f in MODEL_FEATURES])
    grid = sc.stress_grid(base)
    s = b.detector.transform(grid)
    return s.select("case_id", "tool_wear_min", "torque_nm", "strain_load", _r6("detector_prob"),
                    F.when(F.col("detector_pred") == 1, "DETECTED").otherwise("MISSED").alias("status"))


@query("drift_risk_summary")
def q_drift_risk_summary(spark, sf):
    """Every machine x preset: start / peak / final failure risk and first failing step."""
    b = trained(spark, sf)
    # non-drifting inputs (air/process temperature, type) ride along as keys of the projection
    start = sc.latest_state(b.table, cols=MODEL_FEATURES)
    s = b.detector.transform(sc.project(start, sc.PRESETS))
    return sc.run_summary(s.withColumn("alert", F.col("detector_pred") == 1), "alert", risk="detector_prob")


@query("drift_step_scores")
def q_drift_step_scores(spark, sf):
    """Every machine x preset x step: failure probability, guard verdict of all layers and guard score."""
    b = trained(spark, sf)
    start = sc.latest_state(b.table, cols=MODEL_FEATURES)
    s = b.guard.transform(b.detector.transform(sc.project(start, sc.PRESETS)))
    return s.select("machine_id", "scenario", "step", _r6("detector_prob"), "detector_pred", "l1_stats", "l2_physics", "l3_isolation",
                    "anomaly", _r6("anomaly_score"))


@query("reloaded_scores")
def q_reloaded_scores(spark, sf):
    """Test rows scored by the models published to a store and loaded again, next to the scores before."""
    b = trained(spark, sf)
    root = scratch_path(spark, "models")
    model_store.publish(spark, root, b.detector, b.diagnoser, b.guard)
    again = model_store.load(spark, root)

    def scores(detector, diagnoser, guard, tag):
        s = guard.transform(diagnoser.transform(detector.transform(b.test)))
        return s.select("unit_id", *[F.col(c).alias(f"{c}_{tag}") for c in ("detector_prob", "detector_pred", "diagnosis", "anomaly_score", "anomaly")])

    return scores(b.detector, b.diagnoser, b.guard, "fitted").join(scores(again.detector, again.diagnoser, again.guard, "loaded"), "unit_id")
