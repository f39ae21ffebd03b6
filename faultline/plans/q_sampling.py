"""Splits, dense ids and oversampling (E, W5, W6, C14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import sampling as sm
from faultline.operators import stats as st
from faultline.plans.fixture import SPLIT_SQL, with_fixture
from faultline.plans.registry import query
from faultline.schema import DERIVED_COLS, FLAG_COLS, SENSOR_COLS
from faultline.sources.telemetry import telemetry

SEED = 42


def _h(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


@query("stratified_split", with_fixture(
    "SELECT unit_id, machine_failure, is_test FROM split", ("split", SPLIT_SQL)))
def q_stratified_split(spark, sf):
    return sm.stratified_split(telemetry(spark, sf)).select("unit_id", "machine_failure", "is_test")


@query("split_counts", with_fixture(
    "SELECT machine_failure, is_test, count(*) AS n FROM split GROUP BY 1, 2", ("split", SPLIT_SQL)))
def q_split_counts(spark, sf):
    s = sm.stratified_split(telemetry(spark, sf))
    return s.groupBy("machine_failure", "is_test").agg(F.count(F.lit(1)).alias("n"))


_UNIFORM_SQL = with_fixture(f"""
SELECT d.draw_id, r.unit_id AS source_unit_id, r.machine_failure
FROM (SELECT range AS draw_id, {_h("concat(CAST(range AS VARCHAR), '|42')")}
             % (SELECT count(*) FROM telemetry) AS pos
      FROM range((SELECT 2 * count(*) FROM telemetry))) d
JOIN (SELECT unit_id, machine_failure,
             row_number() OVER (ORDER BY md5(concat(CAST(unit_id AS VARCHAR), '|42')), unit_id) - 1 AS pos
      FROM telemetry) r ON d.pos = r.pos
""")


@query("uniform_oversample", _UNIFORM_SQL)
def q_uniform_oversample(spark, sf):
    """Uniform draws with replacement to twice the table size (draw id -> source row)."""
    t = telemetry(spark, sf).select("unit_id", "machine_failure")
    n = t.count()
    return sm.oversample_uniform(t, 2 * n, SEED).select(
        "draw_id", F.col("unit_id").alias("source_unit_id"), "machine_failure")


_BASE_COLS = ["type", *SENSOR_COLS, *DERIVED_COLS]
_RESAMPLED_COLS = ["unit_id", "product_id", "source_unit_id", "is_draw", "draw_id", *_BASE_COLS,
                   "machine_failure", *FLAG_COLS]

_RESAMPLE_CTES = [
    ("src", f"SELECT unit_id, {', '.join(_BASE_COLS)}, machine_failure FROM telemetry"),
    ("cls", "SELECT machine_failure, count(*) AS n FROM src GROUP BY 1"),
    ("tot", "SELECT CAST(sum(n) AS BIGINT) AS n_all, CAST(2 * sum(n) AS BIGINT) AS n_target, "
            "CAST(sum(CASE WHEN machine_failure = 1 THEN n ELSE 0 END) AS BIGINT) AS n_fail FROM cls"),
    ("tgt", "SELECT c.machine_failure, c.n, CASE WHEN c.machine_failure = 1 "
            "THEN CAST(trunc(t.n_target * (t.n_fail / t.n_all) * 1.5) AS BIGINT) "
            "ELSE t.n_target - CAST(trunc(t.n_target * (t.n_fail / t.n_all) * 1.5) AS BIGINT) END AS target "
            "FROM cls c, tot t"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY machine_failure ORDER BY "
               "md5(concat(CAST(unit_id AS VARCHAR), '|42')), unit_id) - 1 AS pos FROM src"),
    ("draws", "SELECT machine_failure, n, unnest(range(target - n)) AS draw_id FROM tgt WHERE target > n"),
    ("drawn", f"SELECT r.unit_id, {', '.join('r.' + c for c in _BASE_COLS)}, r.machine_failure, "
              "1 AS is_draw, d.draw_id FROM draws d JOIN ranked r ON r.machine_failure = d.machine_failure AND r.pos = "
              + _h("concat(CAST(d.draw_id AS VARCHAR), '|', CAST(d.machine_failure AS VARCHAR), '|42')")
              + " % d.n"),
    ("offs", "SELECT machine_failure, "
             "COALESCE(sum(n) OVER (ORDER BY machine_failure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
             "AS orig_off, COALESCE(sum(CASE WHEN target > n THEN target - n ELSE 0 END) OVER (ORDER BY "
             "machine_failure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS draw_off FROM tgt"),
    ("ids", "SELECT g.*, CASE WHEN g.is_draw = 0 THEN o.orig_off + g.seq "
            "ELSE (SELECT n_all FROM tot) + o.draw_off + g.seq END AS i FROM ("
            "SELECT s.*, 0 AS is_draw, s.unit_id AS draw_id, r.pos AS seq FROM src s JOIN ranked r USING (unit_id) "
            "UNION ALL SELECT d.*, d.draw_id AS seq FROM drawn d) g JOIN offs o USING (machine_failure)"),
    ("pool", "SELECT twf, hdf, pwf, osf, rnf, row_number() OVER (ORDER BY md5(concat(CAST(unit_id AS VARCHAR), "
             "'|42')), unit_id) - 1 AS fpos FROM telemetry WHERE machine_failure = 1"),
    ("nf", "SELECT count(*) AS n_fail FROM pool"),
]

_RESAMPLED_ROWS_SQL = f"""
SELECT CAST(i + 1 AS BIGINT) AS unit_id, concat('S', CAST(i + 50000 AS VARCHAR)) AS product_id, ids.unit_id AS source_unit_id,
  is_draw, draw_id, {', '.join(_BASE_COLS)}, machine_failure,
  {', '.join(f"CAST(CASE WHEN machine_failure = 1 THEN p.{f} ELSE 0 END AS INT) AS {f}" for f in FLAG_COLS)}
FROM ids LEFT JOIN pool p ON ids.machine_failure = 1 AND p.fpos =
  {_h("concat(CAST(ids.i + 1 AS VARCHAR), '|flags|42')")} % (SELECT n_fail FROM nf)
WHERE i + 1 <= (SELECT n_target FROM tot)
"""
_RS_CTES = [*_RESAMPLE_CTES, ("rs", _RESAMPLED_ROWS_SQL)]


def _resampled(spark, sf):
    t = telemetry(spark, sf)
    n = t.count()
    out = sm.resample_to(t, 2 * n, SEED)
    return out.select(*_RESAMPLED_COLS)


@query("resampled_table", with_fixture("SELECT * FROM rs", *_RS_CTES))
def q_resampled_table(spark, sf):
    """Per-class oversampling to 2x rows, new ids/product ids, flags re-drawn jointly."""
    return _resampled(spark, sf)


@query("resample_summary", with_fixture(
    "SELECT count(*) AS total, CAST(sum(machine_failure) AS BIGINT) AS failures, "
    "round(100.0 * sum(machine_failure) / count(*), 6) AS failure_pct FROM rs", *_RS_CTES))
def q_resample_summary(spark, sf):
    return st.resample_summary(_resampled(spark, sf))


@query("resampled_flag_patterns", with_fixture(
    "SELECT machine_failure, twf, hdf, pwf, osf, rnf, count(*) AS n FROM rs GROUP BY ALL", *_RS_CTES))
def q_resampled_flag_patterns(spark, sf):
    return _resampled(spark, sf).groupBy("machine_failure", *FLAG_COLS).agg(F.count(F.lit(1)).alias("n"))


@query("dense_ids", with_fixture(
    "SELECT unit_id AS source_unit_id, row_number() OVER (ORDER BY machine_failure, "
    "md5(concat(CAST(unit_id AS VARCHAR), '|42'))) AS seq_id, "
    "concat('S', CAST(row_number() OVER (ORDER BY machine_failure, md5(concat(CAST(unit_id AS VARCHAR), "
    "'|42'))) - 1 + 50000 AS VARCHAR)) AS product_id FROM telemetry"))
def q_dense_ids(spark, sf):
    t = telemetry(spark, sf).select(F.col("unit_id").alias("source_unit_id"), "machine_failure")
    ids = sm.sequence_ids(t, sm.md5_key(F.col("source_unit_id"), SEED), ["machine_failure"], id_col="seq_id")
    return ids.select("source_unit_id", "seq_id", "product_id")


@query("head_by_id", with_fixture(
    "SELECT unit_id, machine_failure FROM (SELECT unit_id, machine_failure, row_number() OVER (ORDER BY "
    "md5(concat(CAST(unit_id AS VARCHAR), '|42'))) AS seq FROM telemetry) z "
    "WHERE seq <= (SELECT count(*) // 2 FROM telemetry)"))
def q_head_by_id(spark, sf):
    """Deterministic trim to half the rows by dense id (not a bare limit)."""
    t = telemetry(spark, sf).select("unit_id", "machine_failure")
    n = t.count()
    ids = sm.sequence_ids(t, sm.md5_key(F.col("unit_id"), SEED), id_col="seq")
    return sm.head_n(ids, n // 2, "seq").select("unit_id", "machine_failure")
