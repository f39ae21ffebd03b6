"""Descriptive statistics and group profiles.

Design for scale:
  * one pass per statistic table: all features are aggregated as columns of a
    single ``agg`` (map-side partial aggregation), never by exploding the
    rows to (feature, value) first — that would shuffle n x features rows;
  * results are tiny (features x stats) and are reshaped *after* the
    aggregate with an ``inline`` of an array of structs;
  * quantiles are exact at every size (:mod:`faultline.operators.quantiles`);
    their values are a few scalars, applied as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.labels import failure_name
from faultline.functions.physics import nan_to_null
from faultline.operators.quantiles import group_quantiles, select_quantiles
from faultline.schema import LABEL, PROFILE_FEATURES

ND = 6  # decimals kept on aggregated doubles
def _r(c: Column, nd: int = ND) -> Column:
    return F.round(c, nd)


def _inline(wide: DataFrame, features, fields, keys=()) -> DataFrame:
    """Reshape one wide row per key into one row per (key, feature): ``{f}__{field}`` -> ``field``."""
    structs = [F.struct(F.lit(f).alias("feature"),
                        *[F.col(f"{f}__{k}").alias(k) for k in fields]) for f in features]
    return wide.select(*keys, F.inline(F.array(*structs)))


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per class with the overall total and share (total via a window over the tiny result)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return (counts.withColumn("total", F.sum("n").over(Window.partitionBy()))
            .withColumn("share", _r(F.col("n") / F.col("total"))))


def failure_type_distribution(df: DataFrame) -> DataFrame:
    """Failure-type counts including ``NoLabel``, with share of all rows, descending."""
    named = df.select(failure_name().alias("failure_type"))
    counts = named.groupBy("failure_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return (counts.withColumn("share", _r(F.col("n") / total))
            .orderBy(F.desc("n"), "failure_type"))


def type_summary(df: DataFrame, features=("power_w", "temp_diff_k", "strain_load"), nd: int = 3) -> DataFrame:
    """count / mean / sample std per failure type (NoLabel excluded), rounded."""
    named = df.withColumn("failure_type", failure_name()).filter(F.col("failure_type") != "NoLabel")
    aggs = []
    for f in features:
        c = nan_to_null(f)
        aggs += [F.count(c).alias(f"{f}_count"), _r(F.avg(c), nd).alias(f"{f}_mean"),
                 _r(F.stddev_samp(c), nd).alias(f"{f}_std")]
    return named.groupBy("failure_type").agg(*aggs)


def _columns(features) -> dict:
    return {f: F.col(f) for f in features}


def _optional(value) -> Column:
    return F.lit(value).cast("double")


def describe(df: DataFrame, features=PROFILE_FEATURES) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max per feature — one global aggregate and the quantile selection."""
    qs = select_quantiles(df, _columns(features), [0.25, 0.5, 0.75])[None]
    aggs = []
    for f in features:
        c = nan_to_null(F.col(f).cast("double"))
        aggs += [F.count(c).alias(f"{f}__count"), _r(F.avg(c)).alias(f"{f}__mean"),
                 _r(F.stddev_samp(c)).alias(f"{f}__std"), F.min(c).alias(f"{f}__min"),
                 *[_r(_optional(v)).alias(f"{f}__q{n}") for n, v in zip((25, 50, 75), qs[f])], F.max(c).alias(f"{f}__max")]
    return _inline(df.agg(*aggs), features, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def quantiles(df: DataFrame, features, qs=(0.1, 0.25, 0.5, 0.75, 0.9), prefix: str = "q", nd: int = 2) -> DataFrame:
    """Long table (feature, {prefix}10, {prefix}25, ...) of quantiles."""
    names = [f"{prefix}{int(round(q * 100))}" for q in qs]
    found = select_quantiles(df, _columns(features), list(qs))[None]
    rows = df.sparkSession.createDataFrame([(f, *found[f]) for f in features], ", ".join(["feature string", *(f"{n} double" for n in names)]))
    return rows.select("feature", *[_r(F.col(n), nd).alias(n) for n in names])


def quantile_compare(df: DataFrame, subset: Column, features=PROFILE_FEATURES, qs=(0.1, 0.25, 0.5, 0.75, 0.9), nd: int = 2) -> DataFrame:
    """Quantiles of a subset next to the whole table, aligned on the feature name."""
    sub = quantiles(df.filter(subset), features, qs, "subset_q", nd)
    return sub.join(quantiles(df, features, qs, "all_q", nd), on="feature", how="full")


def cohens_d(df: DataFrame, subset: Column, features=PROFILE_FEATURES) -> DataFrame:
    """Effect size subset vs rest with pooled sample std, ranked by |d| (NULL if undefined)."""
    flag = F.coalesce(subset, F.lit(False))
    aggs = []
    for f in features:
        a = F.when(flag, nan_to_null(f))
        b = F.when(~flag, nan_to_null(f))
        aggs += [F.count(a).alias(f"{f}__na"), F.count(b).alias(f"{f}__nb"),
                 F.avg(a).alias(f"{f}__ma"), F.avg(b).alias(f"{f}__mb"),
                 F.var_samp(a).alias(f"{f}__va"), F.var_samp(b).alias(f"{f}__vb")]
    wide = df.agg(*aggs)
    long = _inline(wide, features, ["na", "nb", "ma", "mb", "va", "vb"])
    dof = F.col("na") + F.col("nb") - 2
    pooled = F.sqrt(F.try_divide((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"),
                                 F.when(dof > 0, dof)))
    d = F.when(pooled > 0, (F.col("ma") - F.col("mb")) / pooled)
    return (long.select("feature", _r(d).alias("cohens_d"))
            .withColumn("abs_d", F.abs(F.col("cohens_d")))
            .orderBy(F.desc_nulls_last("abs_d"), "feature"))


def share_above_quantile(df: DataFrame, subset: Column, features, q: float = 0.75) -> DataFrame:
    """Share of the subset and of all rows above the overall q-quantile.

    The thresholds are a handful of scalars, applied as literals in the
    conditional-average pass.
    """
    found = select_quantiles(df, _columns(features), [q])[None]
    thr_row = {f: found[f][0] for f in features}
    flag = F.coalesce(subset, F.lit(False))
    aggs = []
    for f in features:
        above = F.when(nan_to_null(f) > _optional(thr_row[f]), 1.0).otherwise(0.0)
        aggs += [_optional(thr_row[f]).alias(f"{f}__q_all"),
                 _r(F.avg(F.when(flag, above))).alias(f"{f}__share_subset_above"),
                 _r(F.avg(above)).alias(f"{f}__share_all_above")]
    return _inline(df.agg(*aggs), features, ["q_all", "share_subset_above", "share_all_above"])


def subset_share(df: DataFrame, subset: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_all"),
                  F.count(F.when(F.coalesce(subset, F.lit(False)), 1)).alias("n_subset"),
                  _r(F.avg(F.when(F.coalesce(subset, F.lit(False)), 1.0).otherwise(0.0))).alias("share"))


def mean_std_profile(df: DataFrame, features) -> DataFrame:
    """Column means and sample stds, zero std replaced by 1 (for z-scoring)."""
    aggs = []
    for f in features:
        aggs += [F.avg(nan_to_null(f)).alias(f"{f}__mean"), F.stddev_samp(nan_to_null(f)).alias(f"{f}__std")]
    wide = df.agg(*aggs).select(*[x for f in features for x in (
        _r(F.col(f"{f}__mean")).alias(f"{f}__mean"),
        _r(F.when(F.col(f"{f}__std") == 0, F.lit(1.0)).otherwise(F.col(f"{f}__std"))).alias(f"{f}__std"))])
    return _inline(wide, features, ["mean", "std"])


def missed_vs_caught(df: DataFrame, pred: str = "pred", label: str = LABEL,
                     features=("power_w", "temp_diff_k", "strain_load")) -> DataFrame:
    """Average physics values of missed (pred 0) vs caught (pred 1) failures."""
    outcome = F.when(F.col(pred) == 1, F.lit("caught")).otherwise(F.lit("missed"))
    return (df.filter(F.col(label) == 1).groupBy(outcome.alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n"), *[_r(F.avg(nan_to_null(f))).alias(f"avg_{f}") for f in features]))


def missed_profile(df: DataFrame, pred: str = "pred", label: str = LABEL,
                   features=("power_w", "temp_diff_k", "strain_load")) -> DataFrame:
    """Descriptive profile of the false negatives."""
    return describe(df.filter((F.col(label) == 1) & (F.col(pred) == 0)), list(features))


def box_stats(df: DataFrame, group: str, features) -> DataFrame:
    """Box/violin data per group: quartiles, IQR, whiskers at 1.5*IQR, outlier count.

    Any number of groups: the quartiles are a table of their own, found by
    distributed ranks; one more pass finds the whiskers as min/max inside the
    fences. Rows without a group value are left out.
    """
    rows = df.select(group, *[nan_to_null(F.col(f).cast("double")).alias(f) for f in features]).filter(F.col(group).isNotNull())
    names = {f: [f"{f}__{n}" for n in ("q1", "median", "q3")] for f in features}
    q = group_quantiles(rows, group, _columns(features), [0.25, 0.5, 0.75], names)
    joined = rows.join(q, on=group, how="inner")  # no hint: the table has a row per group; AQE broadcasts it when small
    aggs = []
    for f in features:
        q1, q3 = F.col(f"{f}__q1"), F.col(f"{f}__q3")
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = (F.col(f) >= lo) & (F.col(f) <= hi)
        aggs += [F.first(q1).alias(f"{f}__q1"), F.first(F.col(f"{f}__median")).alias(f"{f}__median"),
                 F.first(q3).alias(f"{f}__q3"),
                 F.min(F.when(inside, F.col(f))).alias(f"{f}__whisker_lo"),
                 F.max(F.when(inside, F.col(f))).alias(f"{f}__whisker_hi"),
                 F.count(F.when(~inside, 1)).alias(f"{f}__n_outliers")]
    wide = joined.groupBy(group).agg(*aggs)
    long = _inline(wide, features, ["q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers"], keys=[group])
    return long.select(group, "feature", *[_r(F.col(c)).alias(c) for c in ("q1", "median", "q3")],
                       _r(F.col("q3") - F.col("q1")).alias("iqr"),
                       _r(F.col("whisker_lo")).alias("whisker_lo"), _r(F.col("whisker_hi")).alias("whisker_hi"),
                       "n_outliers")


def resample_summary(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Total rows, failures, failure share in percent."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.sum(F.col(label)).cast("bigint").alias("failures"),
                  _r(F.lit(100.0) * F.sum(F.col(label)) / F.count(F.lit(1))).alias("failure_pct"))


def zscores_against(df: DataFrame, population: DataFrame, features, nd: int | None = 3,
                    keep=("unit_id",)) -> DataFrame:
    """z-score every row of ``df`` against the mean/std (0 -> 1) of a reference population.

    The population statistics are 2 x features scalars from one aggregate;
    they are applied as literals, so scoring is a narrow projection.
    """
    row = population.agg(*[x for f in features for x in (
        F.avg(nan_to_null(f)).alias(f"{f}__m"), F.stddev_samp(nan_to_null(f)).alias(f"{f}__s"))]).first()
    cols = []
    for f in features:
        m, s = row[f"{f}__m"], row[f"{f}__s"]
        s = 1.0 if s == 0 else s
        z = (F.col(f) - F.lit(m)) / F.lit(s)
        cols.append((z if nd is None else F.round(z, nd)).alias(f"z_{f}"))
    return df.select(*[k for k in keep if k in df.columns], *cols)
