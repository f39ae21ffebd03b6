"""Three-layer anomaly guard: statistical bounds (L1), physics consistency (L2),
isolation forest (L3, see :mod:`faultline.operators.iforest`); verdict = any layer.

Fitting L1 and L2 is **one** aggregate job over the healthy rows; the fitted
parameters are a few dozen scalars held by the model object (as MLlib models
hold theirs) and applied as literals, so scoring is a single codegen'd
projection with no join, shuffle or UDF. L3 adds one Arrow-batched scoring
pass with broadcast trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.labels import verdict_text
from faultline.functions.physics import nan_to_null
from faultline.operators.quantiles import select_quantiles
from faultline.schema import GUARD_FEATURES, LABEL, require_columns

# Fixed parameters of the guard (equal to the original tool's defaults).
Z_THRESHOLD = 3.0
POWER_TOLERANCE = 0.25
STRAIN_Z_THRESHOLD = 4.0
POWER_Z_THRESHOLD = 3.0
RATIO_STD_FLOOR = 0.01
ZERO_DENOMINATOR = 1e-10
ZERO_STD = 1e-10
FENCE_K = 1.5
LOW_Q, HIGH_Q = 0.01, 0.99
TEMP_GAP_MIN, TEMP_GAP_MAX = 0.0, 25.0
POWER_GAP_ALERT_W = 1000.0
CONTAMINATION = 0.05


def _lit(v) -> Column:
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


def expected_power() -> Column:
    """rpm * torque * 2 * pi / 60 (the guard's operation order)."""
    return nan_to_null("rpm") * nan_to_null("torque_nm") * F.lit(2) * F.pi() / F.lit(60)


def expected_strain() -> Column:
    return nan_to_null("torque_nm") * nan_to_null("tool_wear_min")


def _nz(c: Column) -> Column:
    return F.when(c == 0, F.lit(ZERO_DENOMINATOR)).otherwise(c)


def power_ratio() -> Column:
    return nan_to_null("power_w") / _nz(expected_power())


def strain_ratio() -> Column:
    return nan_to_null("strain_load") / _nz(expected_strain())


# ---------------------------------------------------------------- L1 bounds
@dataclass
class BoundsModel:
    """Per-feature healthy statistics: mean, std (0 -> 1e-10), min, max, p01, p99, fences."""

    features: list
    stats: dict
    z_threshold: float = Z_THRESHOLD

    def zscore(self, f: str) -> Column:
        s = self.stats[f]
        return (nan_to_null(f) - _lit(s["mean"])) / _lit(s["std"])

    def feature_flag(self, f: str) -> Column:
        s = self.stats[f]
        x = nan_to_null(f)
        return F.coalesce((F.abs(self.zscore(f)) > F.lit(self.z_threshold))
                          | (x < _lit(s["lo"])) | (x > _lit(s["hi"])), F.lit(False))

    def flag(self) -> Column:
        out = None
        for f in self.features:
            out = self.feature_flag(f) if out is None else (out | self.feature_flag(f))
        return out

    def zscores(self, df: DataFrame, nd: int | None = None, keep=("unit_id",)) -> DataFrame:
        cols = [self.zscore(f) if nd is None else F.round(self.zscore(f), nd) for f in self.features]
        return df.select(*[k for k in keep if k in df.columns],
                         *[c.alias(f"z_{f}") for c, f in zip(cols, self.features)])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f, *(self.stats[f][k] for k in ("mean", "std", "min", "max", "p01", "p99", "lo", "hi")))
                for i, f in enumerate(self.features)]
        return spark.createDataFrame(
            rows, "ordinal INT, feature STRING, mean DOUBLE, std DOUBLE, min DOUBLE, max DOUBLE, "
                  "p01 DOUBLE, p99 DOUBLE, lo DOUBLE, hi DOUBLE")


def _bounds_aggs(features):
    aggs = []
    for f in features:
        c = nan_to_null(f)
        aggs += [F.avg(c).alias(f"{f}__mean"), F.stddev_samp(c).alias(f"{f}__std"),
                 F.min(c).alias(f"{f}__min"), F.max(c).alias(f"{f}__max")]
    return aggs


def _bounds_from_row(row, features, quantiles: dict) -> dict:
    stats = {}
    for f in features:
        std = row[f"{f}__std"]
        p01, p99 = quantiles[f]
        iqr = None if p01 is None or p99 is None else p99 - p01
        stats[f] = {
            "mean": row[f"{f}__mean"],
            "std": ZERO_STD if std == 0 else std,
            "min": row[f"{f}__min"], "max": row[f"{f}__max"], "p01": p01, "p99": p99,
            "lo": None if iqr is None else p01 - FENCE_K * iqr,
            "hi": None if iqr is None else p99 + FENCE_K * iqr,
        }
    return stats


# ---------------------------------------------------------------- L2 physics
@dataclass
class PhysicsModel:
    power_ratio_mean: float | None
    power_ratio_std: float | None
    strain_ratio_mean: float | None
    strain_ratio_std: float | None
    power_tolerance: float = POWER_TOLERANCE

    def _z(self, ratio: Column, mean, std) -> Column:
        den = None if std is None else max(std, RATIO_STD_FLOOR)
        return F.abs(ratio - _lit(mean)) / _lit(den)

    def power_z(self) -> Column:
        return self._z(power_ratio(), self.power_ratio_mean, self.power_ratio_std)

    def strain_z(self) -> Column:
        return self._z(strain_ratio(), self.strain_ratio_mean, self.strain_ratio_std)

    def power_gap(self) -> Column:
        """Relative gap |actual - expected| / expected (zero expected -> 1e-10)."""
        e = expected_power()
        return F.abs(nan_to_null("power_w") - e) / _nz(e)

    def flag(self, has_temp_gap: bool = True) -> Column:
        parts = [self.power_z() > F.lit(POWER_Z_THRESHOLD),
                 self.power_gap() > F.lit(self.power_tolerance),
                 self.strain_z() > F.lit(STRAIN_Z_THRESHOLD)]
        if has_temp_gap:
            gap = nan_to_null("temp_diff_k")
            parts += [gap < F.lit(TEMP_GAP_MIN), gap > F.lit(TEMP_GAP_MAX)]
        out = None
        for p in parts:
            p = F.coalesce(p, F.lit(False))
            out = p if out is None else (out | p)
        return out

    def scores(self, df: DataFrame, keep=("unit_id",)) -> DataFrame:
        """Expected vs actual power and the gap in percent."""
        return df.select(*[k for k in keep if k in df.columns],
                         (F.lit(100.0) * self.power_gap()).alias("power_deviation_pct"),
                         expected_power().alias("expected_power"),
                         F.col("power_w").alias("actual_power"))


def _physics_aggs():
    return [F.avg(power_ratio()).alias("pr_mean"), F.stddev_samp(power_ratio()).alias("pr_std"),
            F.avg(strain_ratio()).alias("sr_mean"), F.stddev_samp(strain_ratio()).alias("sr_std")]


# ---------------------------------------------------------------- the guard
@dataclass
class GuardModel:
    bounds: BoundsModel
    physics: PhysicsModel
    forest: object | None = None  # IsolationForestModel when fitted with forest=True
    n_fit: int = 0
    features: list = field(default_factory=lambda: list(GUARD_FEATURES))

    def layer_columns(self, df: DataFrame) -> dict:
        cols = {"l1_stats": self.bounds.flag(),
                "l2_physics": self.physics.flag("temp_diff_k" in df.columns)}
        return cols

    def transform(self, df: DataFrame, detailed: bool = True) -> DataFrame:
        """Add layer verdicts (BOOLEAN), the final verdict and, with a forest, the score."""
        require_columns(df, self.features)
        out = df.withColumns(self.layer_columns(df))
        if self.forest is not None:
            out = self.forest.transform(out)
            final = F.col("l1_stats") | F.col("l2_physics") | F.col("l3_isolation")
        else:
            final = F.col("l1_stats") | F.col("l2_physics")
        return out.withColumn("anomaly", final)


def fit_guard(df: DataFrame, features=GUARD_FEATURES, forest: bool = False,
              healthy_only: bool = True, label: str = LABEL, forest_params: dict | None = None) -> GuardModel:
    """Fit L1 + L2 over the healthy rows: one aggregate and the quantile selection (+ optional forest)."""
    require_columns(df, list(features))
    fit_df = df.filter(F.col(label) == 0) if healthy_only and label in df.columns else df
    quantiles = select_quantiles(fit_df, {f: F.col(f) for f in features}, [LOW_Q, HIGH_Q])[None]
    row = fit_df.agg(F.count(F.lit(1)).alias("n"), *_bounds_aggs(features), *_physics_aggs()).first()
    bounds = BoundsModel(list(features), _bounds_from_row(row, features, quantiles))
    physics = PhysicsModel(row["pr_mean"], row["pr_std"], row["sr_mean"], row["sr_std"])
    model = GuardModel(bounds, physics, n_fit=row["n"], features=list(features))
    if forest:
        from faultline.operators.iforest import fit_forest_pair
        model.forest = fit_forest_pair(fit_df, list(features), **(forest_params or {}))
    return model


def to_signed(flag: str) -> Column:
    """BOOLEAN verdict -> -1 (anomaly) / 1 (normal), the API-edge encoding."""
    return F.when(F.col(flag), F.lit(-1)).otherwise(F.lit(1))


def detailed(model: GuardModel, df: DataFrame, keep=("unit_id",)) -> DataFrame:
    """Layer verdicts, final verdict (-1/1) and the anomaly score, one projection."""
    scored = model.transform(df)
    cols = [*[k for k in keep if k in df.columns],
            to_signed("l1_stats").alias("layer1_stats"), to_signed("l2_physics").alias("layer2_physics")]
    if model.forest is not None:
        cols += [to_signed("l3_isolation").alias("layer3_isolation")]
    cols += [to_signed("anomaly").alias("final_prediction")]
    if model.forest is not None:
        cols += [F.col("anomaly_score")]
    return scored.select(*cols)


def verdict_labels(model: GuardModel, df: DataFrame, keep=("unit_id",)) -> DataFrame:
    scored = model.transform(df)
    return scored.select(*[k for k in keep if k in df.columns],
                         verdict_text("l1_stats").alias("layer1"), verdict_text("l2_physics").alias("layer2"),
                         verdict_text("anomaly", "ANOMALY", "OK").alias("verdict"))


def power_violations(model: GuardModel, df: DataFrame, keep=("unit_id",)) -> DataFrame:
    """Anomalous rows whose reported power is more than 1000 W off speed x torque."""
    scored = model.transform(df)
    gap = F.abs(F.col("power_w") - expected_power())
    return (scored.filter(F.col("anomaly") & (gap > F.lit(POWER_GAP_ALERT_W)))
            .select(*[k for k in keep if k in df.columns], F.col("power_w").alias("actual_power"),
                    expected_power().alias("expected_power"), gap.alias("power_gap_w")))


def detection_report(scored: DataFrame, label: str = LABEL, layers=("l1_stats", "l2_physics")) -> DataFrame:
    """Healthy flagged / failures caught, per layer and combined, with rates and a band."""
    h = F.col(label) == 0
    fl = F.col(label) == 1
    aggs = [F.count(F.when(h, 1)).alias("n_healthy"), F.count(F.when(fl, 1)).alias("n_failed"),
            F.count(F.when(h & F.col("anomaly"), 1)).alias("healthy_flagged"),
            F.count(F.when(fl & F.col("anomaly"), 1)).alias("failures_detected")]
    for lay in layers:
        aggs += [F.count(F.when(fl & F.col(lay), 1)).alias(f"failures_{lay}"),
                 F.count(F.when(h & F.col(lay), 1)).alias(f"healthy_{lay}")]
    rep = scored.agg(*aggs)
    rate = F.try_divide(F.col("failures_detected").cast("double"), F.col("n_failed"))
    return rep.select(
        "*",
        F.round(F.lit(100.0) * F.try_divide(F.col("healthy_flagged").cast("double"), F.col("n_healthy")), 6)
        .alias("false_alarm_pct"),
        F.round(F.lit(100.0) * rate, 6).alias("detection_pct"),
        F.when(rate > 0.7, "SUCCESS").when(rate > 0.5, "ACCEPTABLE").otherwise("WARNING").alias("band"))


def crosstab(scored: DataFrame, label: str = LABEL, flag: str = "anomaly") -> DataFrame:
    """Guard verdict vs label: caught, missed, false alarms, detection and anomaly rates."""
    t = F.col(label) == 1
    a = F.coalesce(F.col(flag), F.lit(False))
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~a, 1)).alias("n_normal"),
        F.count(F.when(a, 1)).alias("n_anomalies"),
        F.count(F.when(t & a, 1)).alias("failures_caught"),
        F.count(F.when(t & ~a, 1)).alias("failures_missed"),
        F.count(F.when(~t & a, 1)).alias("false_alarms"),
    ).select("*",
             F.round(F.lit(100.0) * F.try_divide(F.col("failures_caught").cast("double"),
                                                 F.col("failures_caught") + F.col("failures_missed")), 6)
             .alias("detection_pct"),
             F.round(F.lit(100.0) * F.col("n_anomalies") / F.col("n"), 6).alias("anomaly_pct"))


# Probe machines with known violations (fixed values of the original tool's test).
PROBES = [
    ("power violation", 1200.0, 25.0, 100.0, 15000.0, 8.0, 50.0),
    ("extreme speed", 5000.0, 40.0, 50.0, 20944.0, 12.0, 2000.0),
    ("negative gap", 1500.0, 40.0, 100.0, 6283.0, -5.0, 4000.0),
    ("extreme strain", 1500.0, 40.0, 100.0, 6283.0, 10.0, 50000.0),
]


def probe_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROBES, "name STRING, rpm DOUBLE, torque_nm DOUBLE, tool_wear_min DOUBLE, "
                                         "power_w DOUBLE, temp_diff_k DOUBLE, strain_load DOUBLE")


def score_probes(model: GuardModel, spark: SparkSession) -> DataFrame:
    scored = model.transform(probe_frame(spark))
    cols = ["name", verdict_text("l1_stats").alias("layer1"), verdict_text("l2_physics").alias("layer2")]
    if model.forest is not None:
        cols.append(verdict_text("l3_isolation").alias("layer3"))
    return scored.select(*cols, verdict_text("anomaly").alias("verdict"))


def save_guard(model: GuardModel, spark: SparkSession, path: str) -> str:
    """Bounds long table, physics scalars and (if fitted) both forests as parquet."""
    model.bounds.table(spark).write.mode("overwrite").parquet(f"{path}/bounds")
    p = model.physics
    spark.createDataFrame([(p.power_ratio_mean, p.power_ratio_std, p.strain_ratio_mean, p.strain_ratio_std,
                            p.power_tolerance, model.n_fit, model.bounds.z_threshold, model.forest is not None)],
                          "power_ratio_mean DOUBLE, power_ratio_std DOUBLE, strain_ratio_mean DOUBLE, "
                          "strain_ratio_std DOUBLE, power_tolerance DOUBLE, n_fit LONG, z_threshold DOUBLE, has_forest BOOLEAN") \
        .write.mode("overwrite").parquet(f"{path}/physics")
    if model.forest is not None:
        from faultline.operators.iforest import save_forest
        save_forest(model.forest.main, spark, f"{path}/forest_main")
        save_forest(model.forest.aggressive, spark, f"{path}/forest_aggressive")
    return path


def load_guard(spark: SparkSession, path: str) -> GuardModel:
    rows = spark.read.parquet(f"{path}/bounds").orderBy("ordinal").collect()
    feats = [r.feature for r in rows]
    stats = {r.feature: {k: r[k] for k in ("mean", "std", "min", "max", "p01", "p99", "lo", "hi")} for r in rows}
    ph = spark.read.parquet(f"{path}/physics").first()
    model = GuardModel(BoundsModel(feats, stats, ph.z_threshold),
                       PhysicsModel(ph.power_ratio_mean, ph.power_ratio_std, ph.strain_ratio_mean,
                                    ph.strain_ratio_std, ph.power_tolerance), n_fit=ph.n_fit, features=feats)
    if ph.has_forest:  # a forest that cannot be read is an error, not a guard of two layers
        from faultline.operators.iforest import ForestPair, load_forest
        model.forest = ForestPair(load_forest(spark, f"{path}/forest_main"), load_forest(spark, f"{path}/forest_aggressive"))
    return model
