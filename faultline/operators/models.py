"""Detector (stage 1), diagnoser (stage 2) and model-derived reports on MLlib.

* features are assembled and standardised inside a ``Pipeline`` (F1);
* the detector is an ensemble of boosted trees, chosen by a seeded random
  subset of a 27-point grid with 3 folds for recall of the failure class
  (:mod:`faultline.operators.boosting`); MLlib's ``RandomForestClassifier`` is
  the fallback, with a search of its own, and ``GBTClassifier`` an option (F2, F3);
* the diagnoser boosts class-weighted trees for all types together on labelled
  failures, probabilities by softmax (F4, F5); ``RandomForestClassifier`` is the fallback;
* scoring is a ``transform`` — the probability of class 1 is read with
  ``vector_to_array`` and thresholded at 0.25 (F6) — and the cascade scores
  both models in one plan (F8), then applies the rule overrides (F9-F12).
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.labels import failure_code
from faultline.operators.boosting import GRID, BoostedModel, Search, Spec, fit_many
from faultline.operators.boosting import search as search_points
from faultline.operators.features import align_to, labelled_failures
from faultline.operators.sampling import dense_index, md5_key
from faultline.schema import FAILURE_TYPES, KEY, LABEL, MODEL_FEATURES, PHYSICS_ALIASES
from faultline.session import for_training

SEED = 42
THRESHOLD = 0.25
#: The grid of the forest fallback; unlimited depth is Spark's maximum, 30.
FOREST_GRID = {"trees": [100, 200], "depth": [30, 10, 20]}
# Training knobs for tree learners that do not change the model: cache each row's node id between
# levels (no re-walk of the trees; the cache is checkpointed every 10 iterations when a checkpoint
# folder is set) and split more nodes per pass over the data (fewer jobs for deep trees).
TREE_KNOBS = {"cacheNodeIds": True, "maxMemoryInMB": 1024, "checkpointInterval": 10}
# The forest over all balanced rows walks its trees again: its cache takes 4 bytes a row and tree, kept twice and checkpointed.
FOREST_KNOBS = TREE_KNOBS | {"cacheNodeIds": False}


def assemble(features, scaled: bool = True):
    """VectorAssembler (+ StandardScaler with mean) stages."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep")]
    if scaled:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    else:
        stages[0].setOutputCol("features")
    return stages


def detector_grid(gbt: GBTClassifier):
    """The 27-point grid: trees x depth x learning rate."""
    return (ParamGridBuilder().addGrid(gbt.maxIter, GRID["trees"]).addGrid(gbt.maxDepth, GRID["depth"])
            .addGrid(gbt.stepSize, GRID["rate"]).build())


def sample_grid(grid, n: int = 4, seed: int = SEED):
    """Seeded random subset of a param grid (randomised search)."""
    rng = random.Random(seed)
    return rng.sample(grid, min(n, len(grid)))


@dataclass
class Detector:
    model: PipelineModel
    features: list
    threshold: float = THRESHOLD
    best_params: dict | None = None

    def transform(self, df: DataFrame, prob_col: str = "detector_prob", pred_col: str = "detector_pred") -> DataFrame:
        scored = self.model.transform(align_to(df, self.features, keep=[c for c in df.columns
                                                                          if c not in self.features]))
        p1 = vector_to_array(F.col("probability"))[1]
        return scored.withColumns({prob_col: p1, pred_col: (p1 >= F.lit(self.threshold)).cast("int"),
                                   "detector_default": F.col("prediction").cast("int")}) \
            .drop("raw_features", "features", "rawPrediction", "probability", "prediction")

    def importances(self, spark) -> DataFrame:
        imp = self.model.stages[-1].featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.features, [float(x) for x in imp])),
                                     "feature STRING, importance DOUBLE")


@dataclass
class BoostedDetector:
    """Stage 1 as boosted trees; ``search`` holds the points, held-out scores and recalls it was chosen by."""

    model: BoostedModel
    threshold: float = THRESHOLD
    best_params: dict | None = None
    search: Search | None = None

    @property
    def features(self) -> list:
        return self.model.features

    def transform(self, df: DataFrame, prob_col: str = "detector_prob", pred_col: str = "detector_pred") -> DataFrame:
        rows = align_to(df, self.features, keep=[c for c in df.columns if c not in self.features])
        rows = rows.withColumn(prob_col, F.get(self.model.probabilities(rows), F.lit(1)))
        return rows.withColumns({pred_col: (F.col(prob_col) >= self.threshold).cast("int"), "detector_default": (F.col(prob_col) > 0.5).cast("int")})

    def importances(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.features, self.model.importances())), "feature STRING, importance DOUBLE")


def fit_boosted_detector(train: DataFrame, features=MODEL_FEATURES, label: str = LABEL, params: dict | None = None, n_draws: int = 4,
                         folds: int = 3, seed: int = SEED, key: str = KEY) -> BoostedDetector:
    """Stage 1 by boosted trees: a given point (trees, depth, rate), or the winner of the randomised search."""
    if params:
        spec = Spec(params["trees"], params["depth"], params["rate"])
        return BoostedDetector(fit_many(train, features, label, [spec], key)[0][0], best_params=dict(params))
    found = search_points(train, features, label, n_draws, folds, seed, key)
    return BoostedDetector(found.model, best_params=found.best, search=found)


def fit_detector(train: DataFrame, features=MODEL_FEATURES, label: str = LABEL, search: bool = False,
                 n_draws: int = 4, folds: int = 3, algo: str = "gbt", params: dict | None = None,
                 seed: int = SEED, parallelism: int | None = None) -> Detector:
    """Stage 1 by MLlib (GBT; ``algo='rf'`` for the forest fallback); see ``fit_boosted_detector`` for the main one."""
    data = for_training(train.select(F.col(label).cast("double").alias("label"),
                               *[F.col(f).cast("double").alias(f) for f in features]))
    if algo == "gbt":
        clf = GBTClassifier(labelCol="label", featuresCol="features", seed=seed, **TREE_KNOBS)
    else:
        clf = RandomForestClassifier(labelCol="label", featuresCol="features", seed=seed, **FOREST_KNOBS)
    for k, v in (params or {}).items():
        clf.set(clf.getParam(k), v)
    pipe = Pipeline(stages=[*assemble(features), clf])
    best = None
    if parallelism is None:  # candidate fits in flight: enough to keep the cores busy between jobs
        parallelism = max(2, min(8, train.sparkSession.sparkContext.defaultParallelism // 2))
    if search:
        grid = sample_grid(detector_grid(clf) if algo == "gbt" else
                           ParamGridBuilder().addGrid(clf.numTrees, FOREST_GRID["trees"])
                           .addGrid(clf.maxDepth, FOREST_GRID["depth"]).build(), n_draws, seed)
        ev = MulticlassClassificationEvaluator(labelCol="label", metricName="recallByLabel", metricLabel=1.0)
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=[{clf.getParam(p.name): v for p, v in m.items()}
                                                                for m in grid],
                            evaluator=ev, numFolds=folds, seed=seed, parallelism=parallelism)
        cvm = cv.fit(data)
        i = max(range(len(cvm.avgMetrics)), key=lambda j: cvm.avgMetrics[j])
        best = {p.name: v for p, v in grid[i].items()}
        model = cvm.bestModel
    else:
        model = pipe.fit(data)
    return Detector(model, list(features), best_params=best)


def class_weights(df: DataFrame, label: str = "failure_type") -> DataFrame:
    """Balanced weights n / (k * n_c) per class (one tiny aggregate)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return counts.withColumn("class_weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


@dataclass
class Diagnoser:
    model: PipelineModel
    features: list

    def transform(self, df: DataFrame, out: str = "diagnosis") -> DataFrame:
        scored = self.model.transform(align_to(df, self.features, keep=[c for c in df.columns
                                                                          if c not in self.features]))
        return scored.withColumn(out, F.col("prediction").cast("int")) \
            .drop("raw_features", "features", "rawPrediction", "probability", "prediction")

    def importances(self, spark) -> DataFrame:
        imp = self.model.stages[-1].featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.features, [float(x) for x in imp])),
                                     "feature STRING, importance DOUBLE")


@dataclass
class BoostedDiagnoser:
    """Stage 2 as boosted trees, one a type and round."""

    model: BoostedModel

    @property
    def features(self) -> list:
        return self.model.features

    def transform(self, df: DataFrame, out: str = "diagnosis", probabilities: str | None = None) -> DataFrame:
        """The most likely type (the first of equal ones); optionally the probabilities of all types."""
        rows = align_to(df, self.features, keep=[c for c in df.columns if c not in self.features])
        name = probabilities or "__types"
        rows = rows.withColumn(name, self.model.probabilities(rows))
        rows = rows.withColumn(out, (F.array_position(name, F.array_max(name)) - 1).cast("int"))
        return rows if probabilities else rows.drop(name)

    def importances(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.features, self.model.importances())), "feature STRING, importance DOUBLE")


def diagnoser_frame(df: DataFrame) -> DataFrame:
    """Labelled failures with their type code 0..4 (``failure_type``)."""
    return labelled_failures(df).withColumn("failure_type", failure_code())


def fit_diagnoser(failures: DataFrame, features=MODEL_FEATURES, num_trees: int = 100, depth: int = 5, rate: float = 0.1,
                  weighted: bool = True, key: str = KEY) -> BoostedDiagnoser:
    """Stage 2: class-weighted boosted trees on labelled failures."""
    weights = class_weights(failures).select("failure_type", F.col("class_weight").alias("__weight"))
    rows = failures.select(key, "failure_type", *features).fillna(0.0, subset=list(features)).join(F.broadcast(weights), "failure_type")  # <= 5 rows
    spec = Spec(num_trees, depth, rate, classes=len(FAILURE_TYPES))
    return BoostedDiagnoser(fit_many(rows, features, "failure_type", [spec], key, weight="__weight" if weighted else None)[0][0])


def fit_forest_diagnoser(failures: DataFrame, features=MODEL_FEATURES, num_trees: int = 100, seed: int = SEED) -> Diagnoser:
    """Stage 2 fallback: class-weighted random forest on labelled failures."""
    w = F.broadcast(class_weights(failures).select("failure_type", "class_weight"))  # <= 5 rows
    data = for_training(failures.join(w, "failure_type").select(
        F.col("failure_type").cast("double").alias("label"), "class_weight",
        *[F.col(f).cast("double").alias(f) for f in features]).fillna(0.0, subset=list(features)))
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="class_weight",
                                numTrees=num_trees, seed=seed, **TREE_KNOBS)
    return Diagnoser(Pipeline(stages=[*assemble(features), rf]).fit(data), list(features))


def cascade(df: DataFrame, detector: Detector, diagnoser: Diagnoser) -> DataFrame:
    """Stage 1 probability/flag, stage 2 type for flagged rows, then rule overrides."""
    from faultline.operators.rules import apply_overrides
    s = diagnoser.transform(detector.transform(df))
    s = s.withColumn("diagnosis", F.when(F.col("detector_pred") == 1, F.col("diagnosis")))
    return apply_overrides(s, "detector_pred", "diagnosis", "detector_prob")


# ---------------------------------------------------------------- reports
def top_k(importances: DataFrame, k: int = 10) -> DataFrame:
    """Top-k features by importance (TakeOrdered: the limit is the feature)."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def physics_in_top(importances: DataFrame, k: int = 5) -> DataFrame:
    """Are the physics features among the top k? One row per physics feature."""
    spark = importances.sparkSession
    alias_rows = [(phys, a) for phys, names in PHYSICS_ALIASES.items() for a in names]
    aliases = F.broadcast(spark.createDataFrame(alias_rows, "physics STRING, feature STRING"))  # fixed, 10 rows
    ranked = importances.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    top = ranked.filter(F.col("rank") <= k)
    j = aliases.join(top, "feature", "left")
    return j.groupBy("physics").agg(F.max(F.col("rank").isNotNull()).alias("in_top"),
                                    F.min("rank").alias("best_rank"))


def permutation_importance(df: DataFrame, scorer, features, label: str, repeats: int = 10, seed: int = SEED,
                           key: str = KEY) -> DataFrame:
    """Mean accuracy drop when one feature column is permuted.

    Repeat r maps the row at dense position p to the row at rank(md5(p|r)) — a
    seeded shuffle built with joins, one for all features: ``repeats`` copies
    of the table are moved. A copy becomes one row per feature only after the
    join, in the stage that scores it.
    """
    base = dense_index(df, md5_key(F.col(key), seed), name="_pos", tiebreak=key)
    baseline = scorer(base).agg(F.avg((F.col("_pred") == F.col(label)).cast("double")).alias("acc")).first()["acc"]
    expanded = base.select("_pos", F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("_rep"))
    perm_rows = dense_index(expanded, md5_key(F.col("_pos"), F.col("_rep"), seed), ["_rep"], restart=True, name="_src", tiebreak="_pos")
    vals = base.select(F.col("_pos").alias("_src"), *[F.col(f).alias(f"_v_{f}") for f in features])
    rows = base.join(perm_rows.join(vals, "_src"), "_pos")
    rows = rows.withColumn("_feat", F.explode(F.array(*[F.lit(f) for f in features])))
    permuted = rows.withColumns({f: F.when(F.col("_feat") == f, F.col(f"_v_{f}")).otherwise(F.col(f))
                                 for f in features})
    acc = scorer(permuted).groupBy("_feat", "_rep").agg(
        F.avg((F.col("_pred") == F.col(label)).cast("double")).alias("acc"))
    return acc.groupBy(F.col("_feat").alias("feature")).agg(
        (F.lit(baseline) - F.avg("acc")).alias("importance_mean"),
        F.stddev_pop(F.lit(baseline) - F.col("acc")).alias("importance_std"))
