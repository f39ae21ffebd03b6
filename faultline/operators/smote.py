"""SMOTE on Spark: exact minority neighbours from a k-d tree, then hash-drawn interpolation.

Identical feature vectors are collapsed to (vector id, multiplicity) first: a
group of copies holding a third of the rows becomes one vector, and its
neighbours are its own copies at distance 0. The k nearest neighbours of every
distinct vector come from :mod:`faultline.operators.kdtree`.

Interpolation
-------------
``n_new = n_majority - n_minority`` draws; draw d picks a (row, neighbour
slot) pair uniformly via md5(d|seed) and a gap u in [0, 1) via
md5(d|gap|seed); the synthetic row is x + u * (x_nb - x). All joins are on
keys; nothing is collected except a handful of scalars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.draws import hash60, uniform
from faultline.operators.kdtree import LEAF, knn
from faultline.operators.sampling import dense_index, md5_key
from faultline.schema import KEY, LABEL
from faultline.session import cut_lineage


def _vectors(df: DataFrame, features, key: str = KEY) -> DataFrame:
    """Distinct vectors with multiplicity; vector id = smallest row key holding it (unique)."""
    return df.groupBy(*features).agg(F.count(F.lit(1)).alias("_m"), F.min(key).alias("_vid"))


def knn_table(df: DataFrame, features, k: int = 5, leaf: int = LEAF, key: str = KEY, vectors: DataFrame | None = None) -> DataFrame:
    """(_vid, slot, nb_vid, dist) for the k nearest neighbours of every distinct vector.

    Distances are Euclidean on the raw feature values (as SMOTE uses them).
    Multiplicity counts: a vector with m copies has m - 1 neighbours at 0.
    """
    vec = vectors if vectors is not None else cut_lineage(_vectors(df, features, key))
    return knn(vec, list(features), k, leaf)[0]


def smote(df: DataFrame, features, label: str = LABEL, k: int = 5, seed: int = 42, key: str = KEY,
          leaf: int = LEAF) -> DataFrame:
    """Balance a binary-labelled frame by synthesising minority rows.

    Returns the original rows plus synthetic rows (``is_synthetic`` = 1) with
    the given feature columns as DOUBLE. With fewer than k+1 minority rows,
    k shrinks to n_min - 1; a single minority row is replicated.
    """
    spark = df.sparkSession
    feats = list(features)
    base = df.select(key, label, *[F.col(f).cast("double").alias(f) for f in feats])
    any_null = None
    for f in feats:
        any_null = F.col(f).isNull() if any_null is None else (any_null | F.col(f).isNull())
    counts = base.groupBy(label).agg(F.count(F.lit(1)).alias("n"),
                                     F.count(F.when(any_null, 1)).alias("n_null")).collect()
    if any(r["n_null"] for r in counts):
        raise ValueError("SMOTE needs complete feature vectors: fill or drop missing values first")
    n_by = {r[label]: r["n"] for r in counts}
    if len(n_by) < 2:
        return base.withColumn("is_synthetic", F.lit(0))
    minority = min(n_by, key=lambda c: (n_by[c], c))
    majority = max(n_by, key=lambda c: (n_by[c], -c))
    n_min, n_new = n_by[minority], n_by[majority] - n_by[minority]
    orig = base.withColumn("is_synthetic", F.lit(0))
    if n_new <= 0:
        return orig
    mins = base.filter(F.col(label) == minority)
    vec = cut_lineage(_vectors(mins, feats, key))  # distinct vectors: built once, read by every step
    rows = dense_index(mins.join(vec.select(*feats, "_vid"), feats), md5_key(F.col(key), seed), name="_pos",
                       tiebreak=key)
    k_eff = min(k, n_min - 1)
    slices = max(1, spark.sparkContext.defaultParallelism, n_new // 1_000_000)
    draws = spark.range(0, n_new, 1, slices).withColumnRenamed("id", "_d")
    if k_eff <= 0:
        draws = draws.withColumns({"_pos": F.lit(0).cast("long"), "slot": F.lit(0)})
        picked = draws.join(rows, "_pos").withColumn("_u", F.lit(0.0))
        synth = picked.select(*[F.col(f) for f in feats], F.col("_d"))
    else:
        pair = hash60(F.col("_d"), seed) % F.lit(n_min * k_eff)
        draws = draws.withColumns({"_pos": F.floor(pair / F.lit(k_eff)).cast("long"),
                                   "slot": (pair % F.lit(k_eff)).cast("int"),
                                   "_u": uniform(F.col("_d"), "gap", seed)})
        nn = knn_table(mins, feats, k_eff, leaf, key, vectors=vec)
        vecs = vec.select(F.col("_vid").alias("nb_vid"), *[F.col(f).alias(f"_nb_{f}") for f in feats])
        picked = draws.join(rows, "_pos").join(nn, ["_vid", "slot"]).join(vecs, "nb_vid")
        synth = picked.select(*[(F.col(f) + F.col("_u") * (F.col(f"_nb_{f}") - F.col(f))).alias(f) for f in feats],
                              F.col("_d"))
    synth = synth.select(
        (F.lit(-1) - F.col("_d")).cast("long").alias(key),
        F.lit(minority).cast(dict(base.dtypes)[label]).alias(label), *feats, F.lit(1).alias("is_synthetic"))
    return orig.unionByName(synth)
