"""Guard with the isolation-forest layer (D8-D14 full form) and the PCA view (D18).

The oracles replay the forests in SQL: membership of rows, ranges of nodes,
drawn splits level by level, path lengths and the quantile of the scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from faultline.operators import guard as gd
from faultline.operators import sampling as sm
from faultline.operators import scenario as sc
from faultline.plans.fixture import with_fixture
from faultline.plans.q_guard import PROBE_FLAGS_SQL, PROBES_SQL, SCORED_CTES
from faultline.plans.registry import query
from faultline.schema import GUARD_FEATURES, LABEL
from faultline.sources.telemetry import telemetry

_CACHE: dict = {}


def forest_guard(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CACHE:
        t = telemetry(spark, sf)
        _CACHE[key] = (t, gd.fit_guard(t, forest=True))
    return _CACHE[key]


# --- the forests in SQL --------------------------------------------------------------------------
_N, _P = len(GUARD_FEATURES), 2147483647
_XS = [f"x{i}" for i in range(_N)]


_SCALED = ", ".join(f"({f} - q{i}[2]) / (CASE WHEN q{i}[3] > q{i}[1] THEN q{i}[3] - q{i}[1] ELSE 1.0 END) AS x{i}" for i, f in enumerate(GUARD_FEATURES))


def _draw(text: str, digits: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def _by_feature(prefix: str) -> str:
    return "CASE f " + " ".join(f"WHEN {i} THEN {prefix}{i}" for i in range(_N)) + " END"


def _forest_ctes(depth: int = 8) -> list[tuple[str, str]]:
    """fnodes: every node of both forests; fscores: the rounded scores of all rows by forest."""
    scaled = _SCALED
    cols = ", ".join(_XS)
    ctes = [
        ("fscale", "SELECT " + ", ".join(f"quantile_cont({f}, [0.25, 0.5, 0.75]) AS q{i}" for i, f in enumerate(GUARD_FEATURES)) + " FROM telemetry WHERE machine_failure = 0"),
        ("fall", f"SELECT unit_id, machine_failure, {scaled} FROM telemetry, fscale"),
        ("fin", f"SELECT unit_id, {cols}, {_draw('CAST(unit_id AS VARCHAR)', 15)} % {_P} AS h FROM fall WHERE machine_failure = 0"),
        ("ftrees", f"SELECT forest, tree, seed, 1 + {_draw('seed || chr(124) || tree || chr(124) || chr(97)', 15)} % {_P - 1} AS a, {_draw('seed || chr(124) || tree || chr(124) || chr(98)', 15)} % {_P} AS b, "
                   f"CAST(floor((CASE forest WHEN 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END) * {_P}) AS BIGINT) AS below FROM "
                   "(SELECT 0 AS forest, range AS tree, '42' AS seed FROM range(200) UNION ALL SELECT 1, range, '43' FROM range(150)) t"),
        ("frows0", f"SELECT forest, tree, seed, 0 AS node, {cols} FROM fin, ftrees WHERE (h * a + b) % {_P} < below"),
    ]
    for level in range(depth + 1):
        ranges = ", ".join(f"min({x}) AS lo{i}, max({x}) AS hi{i}" for i, x in enumerate(_XS))
        wide = [f"CAST(hi{i} > lo{i} AS INT)" for i in range(_N)]
        text = "seed || chr(124) || tree || chr(124) || node || chr(124) || "
        ctes.append((f"fstat{level}", f"SELECT forest, tree, seed, node, count(*) AS n, {ranges} FROM frows{level} GROUP BY forest, tree, seed, node"))
        ctes.append((f"fpick{level}", f"SELECT *, {', '.join(f'{w} AS w{i}' for i, w in enumerate(wide))}, {_draw(text + chr(39) + 'feature' + chr(39), 13)} / 4503599627370496.0::DOUBLE AS u, "
                                      f"{_draw(text + chr(39) + 'cut' + chr(39), 13)} / 4503599627370496.0::DOUBLE AS v FROM fstat{level}"))
        chosen = " ".join(f"WHEN w{i} = 1 AND {' + '.join(['0', *(f'w{j}' for j in range(i))])} = k THEN {i}" for i in range(_N))
        ctes.append((f"fdrawn{level}", f"SELECT *, CASE WHEN n < 2 OR {level} = {depth} THEN NULL {chosen} END AS f FROM "
                                       f"(SELECT *, floor(u * ({' + '.join(f'w{i}' for i in range(_N))})) AS k FROM fpick{level}) z"))
        ctes.append((f"fnode{level}", f"SELECT forest, tree, seed, node, n, f, {level} AS depth, CASE WHEN lo + v * (hi - lo) > lo THEN lo + v * (hi - lo) ELSE hi END AS cut "
                                      f"FROM (SELECT *, {_by_feature('lo')} AS lo, {_by_feature('hi')} AS hi FROM fdrawn{level}) z"))
        if level < depth:
            step = f"2 * r.node + 1 + CAST({_by_feature('x')} >= cut AS INT)"
            ctes.append((f"frows{level + 1}", f"SELECT r.forest, r.tree, r.seed, {step} AS node, {cols} FROM frows{level} r JOIN fnode{level} s ON r.forest = s.forest AND r.tree = s.tree AND r.node = s.node WHERE f IS NOT NULL"))
    c = lambda n: f"CASE WHEN {n} > 2 THEN 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
    ctes.append(("fnodes", " UNION ALL ".join(f"SELECT forest, tree, node, n, f, depth, cut, depth + {c('n')} AS path FROM fnode{level}" for level in range(depth + 1))))
    return ctes


def _score_ctes(source: str, depth: int = 8) -> list[tuple[str, str]]:
    """fscores: (unit_id, s0, s1) of the scaled rows in ``source``."""
    cols = ", ".join(_XS)
    ctes = [("fwalk0", f"SELECT unit_id, forest, tree, 0 AS node, {cols} FROM {source}, ftrees")]
    for level in range(depth + 1):
        ctes.append((f"fat{level}", f"SELECT w.*, f, cut, path FROM fwalk{level} w JOIN fnodes s ON s.depth = {level} AND w.forest = s.forest AND w.tree = s.tree AND w.node = s.node"))
        ctes.append((f"fwalk{level + 1}", f"SELECT unit_id, forest, tree, 2 * node + 1 + CAST({_by_feature('x')} >= cut AS INT) AS node, {cols} FROM fat{level} WHERE f IS NOT NULL"))
    paths = " UNION ALL ".join(f"SELECT unit_id, forest, path FROM fat{level} WHERE f IS NULL" for level in range(depth + 1))
    psi = "(SELECT greatest(2, CAST(floor((CASE forest WHEN 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END) * count(*)) AS BIGINT)) FROM fin)"
    ctes.append(("ftotal", f"SELECT unit_id, forest, sum(path) / count(*) AS mean_path, any_value({psi}) AS psi FROM ({paths}) p GROUP BY unit_id, forest"))
    score = "round(pow(2.0, -mean_path / (CASE WHEN psi > 2 THEN 2.0 * (ln(psi - 1.0) + 0.5772156649015329) - 2.0 * (psi - 1.0) / psi ELSE 1.0 END)), 9)"
    ctes.append(("fscores", f"SELECT unit_id, max(CASE forest WHEN 0 THEN {score} END) AS s0, max(CASE forest WHEN 1 THEN {score} END) AS s1 FROM ftotal GROUP BY unit_id"))
    return ctes


FOREST_CTES = [
    *SCORED_CTES[:2], *_forest_ctes(), *_score_ctes("fall"),
    ("foffset", "SELECT quantile_cont(-s0, 0.05) AS o0, quantile_cont(-s1, 0.1) AS o1 FROM fscores JOIN fin USING (unit_id)"),
    ("fverdicts", "SELECT s.*, -s0 - o0 AS anomaly_score, -s0 - o0 < 0 OR -s1 - o1 < 0 AS l3_isolation, "
                  "l1_stats OR l2_physics OR l3_isolation AS anomaly FROM scored s JOIN fscores USING (unit_id), foffset"),
]


@query("guard_forest_verdicts", with_fixture("SELECT unit_id, machine_failure, l1_stats, l2_physics, l3_isolation, anomaly, round(anomaly_score, 6) AS anomaly_score FROM fverdicts", *FOREST_CTES))
def q_guard_forest_verdicts(spark, sf):
    t, m = forest_guard(spark, sf)
    s = m.transform(t)
    return s.select("unit_id", LABEL, "l1_stats", "l2_physics", "l3_isolation", "anomaly",
                    F.round("anomaly_score", 6).alias("anomaly_score"))


_SIGNED = ", ".join(f"CASE WHEN {c} THEN -1 ELSE 1 END AS {n}" for c, n in (
    ("l1_stats", "layer1_stats"), ("l2_physics", "layer2_physics"), ("l3_isolation", "layer3_isolation"), ("anomaly", "final_prediction")))


@query("guard_forest_detailed", with_fixture(f"SELECT unit_id, {_SIGNED}, round(anomaly_score, 6) AS anomaly_score FROM fverdicts", *FOREST_CTES))
def q_guard_forest_detailed(spark, sf):
    t, m = forest_guard(spark, sf)
    return gd.detailed(m, t).withColumn("anomaly_score", F.round("anomaly_score", 6))


_LAYERS = ("l1_stats", "l2_physics", "l3_isolation")


@query("guard_forest_report", with_fixture(
    "SELECT *, round(100.0 * healthy_flagged / n_healthy, 6) AS false_alarm_pct, round(100.0 * failures_detected / n_failed, 6) AS detection_pct, "
    "CASE WHEN failures_detected / n_failed > 0.7 THEN 'SUCCESS' WHEN failures_detected / n_failed > 0.5 THEN 'ACCEPTABLE' ELSE 'WARNING' END AS band FROM (SELECT "
    "count(*) FILTER (WHERE machine_failure = 0) AS n_healthy, count(*) FILTER (WHERE machine_failure = 1) AS n_failed, "
    "count(*) FILTER (WHERE machine_failure = 0 AND anomaly) AS healthy_flagged, count(*) FILTER (WHERE machine_failure = 1 AND anomaly) AS failures_detected, "
    + ", ".join(f"count(*) FILTER (WHERE machine_failure = {k} AND {c}) AS {n}_{c}" for c in _LAYERS for k, n in ((1, "failures"), (0, "healthy")))
    + " FROM fverdicts) r", *FOREST_CTES))
def q_guard_forest_report(spark, sf):
    t, m = forest_guard(spark, sf)
    return gd.detection_report(m.transform(t), layers=_LAYERS)


@query("guard_forest_crosstab", with_fixture(
    "SELECT *, round(100.0 * failures_caught / (failures_caught + failures_missed), 6) AS detection_pct, round(100.0 * n_anomalies / n, 6) AS anomaly_pct FROM (SELECT "
    "count(*) AS n, count(*) FILTER (WHERE NOT anomaly) AS n_normal, count(*) FILTER (WHERE anomaly) AS n_anomalies, "
    "count(*) FILTER (WHERE machine_failure = 1 AND anomaly) AS failures_caught, count(*) FILTER (WHERE machine_failure = 1 AND NOT anomaly) AS failures_missed, "
    "count(*) FILTER (WHERE machine_failure <> 1 AND anomaly) AS false_alarms FROM fverdicts) r", *FOREST_CTES))
def q_guard_forest_crosstab(spark, sf):
    """Verdict of all three layers against the label."""
    t, m = forest_guard(spark, sf)
    return gd.crosstab(m.transform(t))


_PROBE_CTES = [
    *SCORED_CTES[:1], *_forest_ctes(), ("probes", PROBES_SQL), ("pflags", PROBE_FLAGS_SQL),
    ("pall", f"SELECT name AS unit_id, {_SCALED} FROM probes, fscale"),
    ("pboth", "SELECT CAST(unit_id AS VARCHAR) AS unit_id, " + ", ".join(_XS) + " FROM fall UNION ALL SELECT unit_id, " + ", ".join(_XS) + " FROM pall"),
    *_score_ctes("pboth"),
    ("foffset", "SELECT quantile_cont(-s0, 0.05) AS o0, quantile_cont(-s1, 0.1) AS o1 FROM fscores s JOIN fin f ON s.unit_id = CAST(f.unit_id AS VARCHAR)"),
    ("pverdicts", "SELECT name, l1, l2, -s0 - o0 < 0 OR -s1 - o1 < 0 AS l3 FROM pflags JOIN fscores ON unit_id = name, foffset"),
]


@query("guard_forest_probes", with_fixture("SELECT name, " + ", ".join(
    f"CASE WHEN {c} THEN 'ANOMALY' ELSE 'normal' END AS {n}" for c, n in (("l1", "layer1"), ("l2", "layer2"), ("l3", "layer3"), ("l1 OR l2 OR l3", "verdict")))
    + " FROM pverdicts", *_PROBE_CTES))
def q_guard_forest_probes(spark, sf):
    _, m = forest_guard(spark, sf)
    return gd.score_probes(m, spark)


@query("forest_shape", with_fixture(
    "SELECT CAST(tree AS INT) AS tree, count(*) AS n_nodes, count(*) FILTER (WHERE f IS NULL) AS n_leaves, CAST(max(depth) AS INT) AS max_depth, "
    "max(n) FILTER (WHERE node = 0) AS n_sampled FROM fnodes WHERE forest = 0 GROUP BY tree", *_forest_ctes()))
def q_forest_shape(spark, sf):
    """Per tree of the main forest: nodes, leaves, max depth, rows sampled."""
    _, m = forest_guard(spark, sf)
    nodes = spark.createDataFrame(m.forest.main.nodes, "tree INT, node INT, feature INT, threshold DOUBLE, size LONG, depth INT")
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"),
                                     F.count(F.when(F.col("feature") < 0, 1)).alias("n_leaves"),
                                     F.max("depth").alias("max_depth"),
                                     F.max(F.when(F.col("node") == 0, F.col("size"))).alias("n_sampled"))


def pca_view(df, features=GUARD_FEATURES, fit=None, k: int = 2):
    """Standardise on all rows, fit PCA on the rows where ``fit`` holds (default: all), project everyone (fit mean removed).

    One aggregate of counts, sums and cross products of all and of fitted rows
    gives means, scales and the covariance; the projection is a linear
    expression with literals. Each component's largest loading is positive.
    """
    healthy, d = F.lit(True) if fit is None else fit, len(features)
    shift = df.agg(*[F.avg(f).alias(f) for f in features]).first()  # centred first: sums of squares stay accurate
    x = [F.col(f).cast("double") - F.lit(shift[f]) for f in features]
    aggs = [F.count(F.lit(1)).alias("n"), F.count(F.when(healthy, 1)).alias("nh")]
    for i in range(d):
        aggs += [F.sum(x[i] * x[i]).alias(f"q{i}"), F.sum(F.when(healthy, x[i])).alias(f"s{i}")]
        aggs += [F.sum(F.when(healthy, x[i] * x[j])).alias(f"p{i}_{j}") for j in range(i, d)]
    r = df.agg(*aggs).first()
    scale = np.sqrt(np.array([r[f"q{i}"] for i in range(d)]) / max(1, r.n - 1))
    scale[scale == 0] = 1.0
    mean = np.array([r[f"s{i}"] or 0.0 for i in range(d)]) / max(1, r.nh)
    cross = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    cov = (cross - r.nh * np.outer(mean, mean)) / max(1, r.nh - 1) / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    cols = []
    for c in range(k):
        terms = [(x[i] - F.lit(float(mean[i]))) * F.lit(float(vectors[i, c] / scale[i])) for i in range(d)]
        cols.append(sum(terms[1:], terms[0]).alias(f"pc{c + 1}"))
    return df.select(*[c for c in df.columns if c not in features], *cols), (values / values.sum())[:k]


@query("guard_pca")
def q_guard_pca(spark, sf):
    t, m = forest_guard(spark, sf)
    # the aggregates of the view read only features and label, so the forest scores each row once
    view, _ = pca_view(m.transform(t).select("unit_id", LABEL, "anomaly", *GUARD_FEATURES), fit=F.col(LABEL) == 0)
    return view.select("unit_id", LABEL, "anomaly", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("guard_pca_variance")
def q_guard_pca_variance(spark, sf):
    t = telemetry(spark, sf)
    _, var = pca_view(t.select("unit_id", LABEL, *GUARD_FEATURES), fit=F.col(LABEL) == 0)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(var)],
                                 "component INT, explained_variance_ratio DOUBLE")


@query("guard_pca_all_rows")
def q_guard_pca_all_rows(spark, sf):
    """The view with the components fitted on all rows, and the share of variance each explains."""
    t, m = forest_guard(spark, sf)
    view, var = pca_view(m.transform(t).select("unit_id", LABEL, "anomaly", *GUARD_FEATURES))
    return view.select("unit_id", LABEL, "anomaly", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"),
                       *[F.round(F.lit(float(v)), 6).alias(f"explained{i + 1}") for i, v in enumerate(var)])


@query("drift_pca_trail")
def q_drift_pca_trail(spark, sf):
    """Test rows and every step of every machine's drift in one plane, fitted on both together."""
    t = telemetry(spark, sf)
    steps = sc.project(sc.latest_state(t, cols=GUARD_FEATURES), sc.PRESETS)
    test = sm.train_test(t)[1].select("unit_id", "machine_id", F.lit("test").alias("scenario"), F.lit(None).cast("int").alias("step"), *GUARD_FEATURES)
    trail = steps.select(F.lit(None).cast("long").alias("unit_id"), "machine_id", "scenario", F.col("step").cast("int").alias("step"), *GUARD_FEATURES)
    view, _ = pca_view(test.unionByName(trail))
    return view.select("unit_id", "machine_id", "scenario", "step", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))
