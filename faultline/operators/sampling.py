"""Deterministic splits, dense indexes and oversampling without single-task windows.

Dense index
-----------
A ``row_number()`` over a whole class runs in one task. Instead rows are
ordered by an md5 hex key and bucketed by its first five hex digits:

1. count rows per (prefix columns, bucket)   — partial aggregate, tiny output, written once
2. running offsets over that count table     — by blocks of 4,096 buckets
3. ``row_number`` inside (prefix, bucket)   — one shuffle, a million-way parallel
4. index = offset + row_number - 1

md5 spreads keys uniformly, so buckets are balanced. Keys must be unique
per row (a unit id, or a draw id for resampled copies), so a group of copies
never lands in one bucket.

Draws
-----
With-replacement draws are ``spark.range(N)`` rows whose position is
``md5(draw_id|seed) mod n``, equi-joined to the dense index — one shuffle
join, no driver loop, reproducible across task retries and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.draws import hash60, key_string
from faultline.schema import FLAG_COLS, KEY, LABEL
from faultline.session import cut_lineage


def md5_key(*parts) -> Column:
    return F.md5(key_string(*parts))


#: Hex digits of a bucket's prefix and of the blocks that hold 4,096 buckets each, the same for every table (the index
#: does not depend on them): a bucket of 1e12 rows holds a million.
DIGITS, BLOCK_DIGITS = 5, 2


def dense_index(df: DataFrame, key: Column, prefix_cols=(), restart: bool = True, name: str = "idx",
                tiebreak: str | None = KEY, with_total: str | None = None) -> DataFrame:
    """0-based dense index of rows ordered by (prefix_cols, key).

    restart=True  -> index restarts at 0 for every prefix value (rank within class)
    restart=False -> one global index in (prefix_cols, key) order
    ``with_total`` adds the row count of the row's prefix group.
    """
    prefix_cols = list(prefix_cols)
    keyed = df.withColumns({"_k": key, "_b": F.substring(key, 1, DIGITS)})
    counts = keyed.groupBy(*prefix_cols, "_b").agg(F.count(F.lit(1)).alias("_c"))
    order = [*prefix_cols, "_b"]
    # written once: read twice below, and no filter on the prefix is carried through it into the expressions of ``df``
    counts = cut_lineage(counts.withColumn("_s", F.substring("_b", 1, BLOCK_DIGITS)))
    blocks = counts.groupBy(*prefix_cols, "_s").agg(F.sum("_c").alias("_n"))  # at most 256 rows per prefix value
    over = Window.partitionBy(*prefix_cols).orderBy("_s") if restart else Window.orderBy(*prefix_cols, "_s")
    first = F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first")
    total = [F.sum("_n").over(Window.partitionBy(*prefix_cols)).alias(with_total)] if with_total else []
    blocks = blocks.select(*prefix_cols, "_s", first, *total)
    inside = Window.partitionBy(*prefix_cols, "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(blocks, [*prefix_cols, "_s"])
    offsets = offsets.withColumn("_off", F.col("_first") + F.col("_in")).drop("_c", "_s", "_in", "_first")
    # no broadcast hint: the offsets table has one row per (prefix, bucket); AQE turns this into a
    # broadcast join at runtime only when its materialised size is under the threshold
    # a left join for the same reason: rows without a prefix or key find no offset and are dropped by their index
    joined = keyed.join(offsets, on=order, how="left")
    ord_cols = [F.col("_k")] + ([F.col(tiebreak)] if tiebreak and tiebreak in df.columns else [])
    rn = F.row_number().over(Window.partitionBy(*order).orderBy(*ord_cols))
    return joined.withColumn(name, F.col("_off") + rn - 1).filter(F.col(name).isNotNull()).drop("_k", "_b", "_off")


def stratified_split(df: DataFrame, label: str = LABEL, key: str = KEY, test_frac: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``: per class, the first round(test_frac * n_class) rows in md5(key|seed) order."""
    idx = dense_index(df, md5_key(F.col(key), seed), [label], restart=True, name="_rank",
                      tiebreak=key, with_total="_n")
    return idx.withColumn("is_test", (F.col("_rank") + 1) <= F.round(F.lit(test_frac) * F.col("_n"))) \
        .drop("_rank", "_n")


def train_test(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    s = stratified_split(df, **kw)
    return s.filter(~F.col("is_test")).drop("is_test"), s.filter(F.col("is_test")).drop("is_test")


def _draws(spark, n_draws: int, n_source: int, seed, tag=None, extra: dict | None = None,
           slices: int | None = None) -> DataFrame:
    """``n_draws`` rows (draw_id, pos) with pos uniform in [0, n_source)."""
    slices = slices or n_draws // 1_000_000 + spark.sparkContext.defaultParallelism
    d = spark.range(0, n_draws, 1, slices).withColumnRenamed("id", "draw_id")
    parts = [F.col("draw_id")] + ([tag] if tag is not None else []) + [seed]
    d = d.withColumn("pos", hash60(*parts) % F.lit(n_source))
    if extra:
        d = d.withColumns({k: F.lit(v) for k, v in extra.items()})
    return d


def oversample_uniform(df: DataFrame, n_target: int, seed: int = 42, key: str = KEY) -> DataFrame:
    """``n_target`` rows drawn uniformly with replacement (adds ``draw_id``)."""
    n = df.count()
    if n == 0:
        raise ValueError("cannot resample an empty table")
    src = dense_index(df, md5_key(F.col(key), seed), name="pos", tiebreak=key)
    draws = _draws(df.sparkSession, n_target, n, seed)
    return draws.join(src, "pos", "inner").drop("pos")


def class_targets(n_by_class: dict, n_target: int, boost: float = 1.5, positive=1) -> dict:
    """failures = int(N * rate * boost); the rest healthy."""
    total = sum(n_by_class.values())
    pos = int(n_target * (n_by_class.get(positive, 0) / total) * boost)
    return {c: (pos if c == positive else n_target - pos) for c in n_by_class}


def oversample_by_class(df: DataFrame, targets: dict, label: str = LABEL, seed: int = 42,
                        key: str = KEY, n_by: dict | None = None) -> DataFrame:
    """Keep every original row, add (target_c - n_c) draws with replacement per class.

    Output has ``is_draw`` (0 original, 1 drawn), ``draw_id`` (original key, or
    the draw number 0..extra-1 within the class) and ``_seq``: the row's dense
    position within its (is_draw, class) block — the source index for
    originals, the draw number for draws — so new ids need no further pass.
    """
    spark = df.sparkSession
    if n_by is None:
        n_by = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    short = {c: t for c, t in targets.items() if t < n_by.get(c, 0)}
    if short:
        raise ValueError(f"target below current count for classes {sorted(short)}")
    src = dense_index(df, md5_key(F.col(key), seed), [label], restart=True, name="pos", tiebreak=key)
    draws = None
    for c, t in sorted(targets.items()):
        extra = t - n_by.get(c, 0)
        if extra <= 0:
            continue
        d = _draws(spark, extra, n_by[c], seed, tag=F.lit(c), extra={label: c})
        draws = d if draws is None else draws.unionByName(d)
    originals = src.withColumns({"is_draw": F.lit(0), "draw_id": F.col(key), "_seq": F.col("pos")}).drop("pos")
    if draws is None:
        return originals
    drawn = (draws.join(src, [label, "pos"], "inner").drop("pos")
             .withColumns({"is_draw": F.lit(1), "_seq": F.col("draw_id")}))
    return originals.unionByName(drawn.select(*originals.columns))


def block_ids(df: DataFrame, sizes: dict, block_cols=("is_draw", LABEL), seq: str = "_seq",
              id_col: str = KEY, product_prefix: str = "S", product_base: int = 50000) -> DataFrame:
    """Ids 1..N when each (block) already has a dense ``seq``: id = block offset + seq + 1.

    ``sizes`` maps block tuples to their row counts (driver scalars); offsets
    follow the sorted block order. A narrow projection — no shuffle.
    """
    expr, off = None, 0
    for blk in sorted(sizes):
        cond = None
        for c, v in zip(block_cols, blk):
            cond = (F.col(c) == F.lit(v)) if cond is None else (cond & (F.col(c) == F.lit(v)))
        expr = F.when(cond, F.lit(off)) if expr is None else expr.when(cond, F.lit(off))
        off += sizes[blk]
    i = expr.otherwise(F.lit(None).cast("long")) + F.col(seq)
    return df.withColumns({id_col: (i + 1).cast("long"),
                           "product_id": F.concat(F.lit(product_prefix), (i + F.lit(product_base)).cast("string"))})


def top_up(df: DataFrame, n_target: int, seed: int = 42, key=None) -> DataFrame:
    """If short of ``n_target`` rows, add uniform draws from the frame itself.

    ``key`` are the columns that together identify a row (default: is_draw, the
    label and draw_id, as far as the frame has them). Added rows have
    ``is_draw`` 2 and their draw number as ``draw_id``, so they share their key
    with no row of the frame.
    """
    n = df.count()
    if n >= n_target:
        return df
    key = key or [c for c in ("is_draw", LABEL, "draw_id") if c in df.columns]
    src = df.withColumn("_row", md5_key(*[F.col(c) for c in key]))
    extra = oversample_uniform(src.drop("draw_id", "is_draw"), n_target - n, seed + 1, key="_row").withColumn("is_draw", F.lit(2))
    return df.unionByName(extra.select(*df.columns))


def sequence_ids(df: DataFrame, order_key: Column, prefix_cols=(), id_col: str = KEY,
                 product_prefix: str = "S", product_base: int = 50000) -> DataFrame:
    """New ids 1..N in (prefix_cols, order_key) order and product ids ``S{base + i}``."""
    idx = dense_index(df, order_key, prefix_cols, restart=False, name="_i", tiebreak=None)
    return idx.withColumns({
        id_col: F.col("_i") + 1,
        "product_id": F.concat(F.lit(product_prefix), (F.col("_i") + F.lit(product_base)).cast("string")),
    }).drop("_i")


def head_n(df: DataFrame, n: int, id_col: str = KEY) -> DataFrame:
    """Deterministic trim: keep rows whose dense id is <= n (no bare ``limit``)."""
    return df.filter(F.col(id_col) <= n)


def reassign_flags(df: DataFrame, originals: DataFrame, seed: int = 42, label: str = LABEL,
                   key: str = KEY, flags=FLAG_COLS, row_key: str = KEY, n_fail: int | None = None) -> DataFrame:
    """Failed rows get the joint flag pattern of one bootstrap-drawn original failure; healthy get 0."""
    fails = originals.filter(F.col(label) == 1).select(key, *flags)
    n_fail = fails.count() if n_fail is None else n_fail
    out = df.drop(*[f for f in flags if f in df.columns])
    zeros = {f: F.lit(0) for f in flags}
    if n_fail == 0:
        return out.withColumns(zeros)
    pool = dense_index(fails, md5_key(F.col(key), seed), name="_pos", tiebreak=key).drop(key)
    is_fail = F.col(label) == 1
    picked = out.withColumn("_pos", F.when(is_fail, hash60(F.col(row_key), "flags", seed) % F.lit(n_fail)))
    joined = picked.join(pool, "_pos", "left")
    return joined.withColumns({f: F.when(is_fail, F.col(f)).otherwise(F.lit(0)).cast("int") for f in flags}) \
        .drop("_pos")


def resample_to(df: DataFrame, n_target: int = 20000, seed: int = 42, label: str = LABEL,
                key: str = KEY, boost: float = 1.5) -> DataFrame:
    """Grow a table to ``n_target`` rows the way the original 20k script does.

    Per-class random oversampling (failures = int(N * rate * 1.5)) keeping all
    originals; if a class target is below its size, uniform sampling of the
    whole table instead. New ids 1..N run over the blocks (originals by class,
    then draws by class), inside a block in source-index / draw order, with
    product ids S50000+i. Subtype flags of failed rows are re-drawn jointly
    from the original failures; healthy rows get 0. Block sizes are driver
    scalars, so no count of the grown table and no id pass are needed.
    """
    n_by = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n_by.values())
    if total >= n_target:
        return df
    targets = class_targets(n_by, n_target, boost)
    base = df.drop(*[f for f in FLAG_COLS if f in df.columns], "product_id")
    if all(t >= n_by.get(c, 0) for c, t in targets.items()):
        grown = oversample_by_class(base, targets, label, seed, key, n_by=n_by)
        sizes = {(0, c): n for c, n in n_by.items()}
        sizes.update({(1, c): t - n_by[c] for c, t in targets.items() if t > n_by[c]})
    else:  # whole rows are drawn: flags and product ids stay, only the sequence id is new
        grown = oversample_uniform(df, n_target, seed, key).withColumnRenamed(key, "source_unit_id")
        grown = grown.withColumns({"is_draw": F.lit(1), key: F.col("draw_id") + 1})
        flags = [f for f in FLAG_COLS if f in grown.columns]
        return grown.select(*[c for c in grown.columns if c not in flags], *flags)
    grown = grown.withColumnRenamed(key, "source_unit_id")
    ids = block_ids(grown, sizes, ("is_draw", label), "_seq", key)
    ids = head_n(ids.drop("_seq"), n_target, key)
    return reassign_flags(ids, df, seed, label, key=key, row_key=key, n_fail=n_by.get(1, 0))
