"""Classification metrics as DataFrames.

The only pass over the scored rows is the confusion-matrix ``groupBy``
(partial aggregation, output bounded by classes^2). Every other metric is
derived from that tiny table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ND = 6


def confusion_long(df: DataFrame, label: str = "label", pred: str = "pred", classes=None) -> DataFrame:
    """(label, pred, n) over the full class x class grid (absent cells = 0)."""
    counts = df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")) \
        .agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        # distinct class values: at most a handful of ints, bounded by the number of classes
        labs = counts.select(F.col("label").alias("c")).union(counts.select(F.col("pred").alias("c")))
        classes = sorted(r.c for r in labs.distinct().collect() if r.c is not None)
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], "label INT, pred INT")
    return (F.broadcast(grid).join(counts, ["label", "pred"], "left")
            .select("label", "pred", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred", classes=None) -> DataFrame:
    """Rows = true class, one column ``pred_<c>`` per predicted class."""
    long = confusion_long(df, label, pred, classes)
    cls = classes or sorted(r.pred for r in long.select("pred").distinct().collect())
    return (long.groupBy("label").pivot("pred", cls).agg(F.sum("n"))
            .select("label", *[F.col(str(c)).cast("bigint").alias(f"pred_{c}") for c in cls]))


def _per_class(long: DataFrame) -> DataFrame:
    tp = long.groupBy(F.col("label").alias("cls")).agg(
        F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
    pp = long.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = tp.join(pp, "cls", "full")
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return j.select("cls", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred", classes=None) -> DataFrame:
    """Per-class precision/recall/F1/support + accuracy, macro and weighted averages."""
    long = confusion_long(df, label, pred, classes)
    pc = _per_class(long)  # every class of the truth or the predictions
    tot = long.agg(F.sum("n").alias("n_total"),
                   F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("n_correct"))
    per = pc.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                    F.col("support").cast("bigint").alias("support"))
    # macro / weighted over labels present in truth or prediction (sklearn's label set)
    macro = pc.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                       F.avg("f1").alias("f1"), F.sum("support").cast("bigint").alias("support")) \
        .select(F.lit("macro avg").alias("class"), "precision", "recall", "f1", "support")
    weighted = pc.agg(
        F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("precision"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("recall"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1"),
        F.sum("support").cast("bigint").alias("support")) \
        .select(F.lit("weighted avg").alias("class"), "precision", "recall", "f1", "support")
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     F.try_divide(F.col("n_correct").cast("double"), F.col("n_total")).alias("f1"),
                     F.col("n_total").cast("bigint").alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("class", *[F.round(c, ND).alias(c) for c in ("precision", "recall", "f1")], "support")


def summary_scores(df: DataFrame, label: str = "label", pred: str = "pred", positive: int = 1,
                   classes=None) -> DataFrame:
    """accuracy, binary F1 for ``positive``, macro F1, micro F1 — one row."""
    pc = _per_class(confusion_long(df, label, pred, classes))
    agg = pc.agg(F.sum("support").alias("n_total"), F.sum("tp").alias("n_correct"),
                 F.avg("f1").alias("f1_macro"),
                 F.max(F.when(F.col("cls") == positive, F.col("f1"))).alias("f1_binary"))
    acc = F.try_divide(F.col("n_correct").cast("double"), F.col("n_total"))
    return agg.select(F.round(acc, ND).alias("accuracy"),
                      F.round(F.coalesce("f1_binary", F.lit(0.0)), ND).alias("f1_binary"),
                      F.round("f1_macro", ND).alias("f1_macro"),
                      F.round(acc, ND).alias("f1_micro"))


def false_negatives(df: DataFrame, label: str = "label", pred: str = "pred", positive: int = 1) -> DataFrame:
    return df.filter((F.col(label) == positive) & (F.col(pred) != positive))


def report_from_matrix(spark, matrix, classes=None) -> DataFrame:
    """Explode a confusion matrix (list of rows, true x pred) into (label, pred) rows."""
    classes = classes or list(range(len(matrix)))
    cells = [(classes[i], classes[j], int(matrix[i][j])) for i in range(len(matrix)) for j in range(len(matrix))]
    cells_df = spark.createDataFrame(cells, "label INT, pred INT, n INT")
    return cells_df.filter(F.col("n") > 0) \
        .select("label", "pred", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).drop("i")
