"""Versioned folder of fitted models.

A version is a folder of its own, written model by model; its row in the
manifest is appended last. Readers take the newest version of the manifest, so a
half-written version is never seen, and an older one stays readable while a
newer one is written. Everything is Parquet (MLlib models in their own format)
on whatever file system the root names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultline.operators.boosting import BoostedModel
from faultline.operators.guard import GuardModel, load_guard, save_guard
from faultline.operators.models import BoostedDetector, BoostedDiagnoser, Detector, Diagnoser

_MANIFEST = "version long, folder string, detector string, diagnoser string, guard boolean, threshold double"


@dataclass
class StoredModels:
    version: int
    detector: BoostedDetector | Detector | None
    diagnoser: BoostedDiagnoser | Diagnoser | None
    guard: GuardModel | None


def manifest(spark: SparkSession, root: str):
    """The complete versions; empty for a new root."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _kind(model) -> str | None:
    if model is None:
        return None
    return "boosted" if isinstance(model.model, BoostedModel) else "pipeline"


def _save(model, spark: SparkSession, path: str) -> None:
    if _kind(model) == "boosted":
        model.model.save(spark, path)
    elif model is not None:
        model.model.write().save(f"{path}/pipeline")
        spark.createDataFrame([(list(model.features),)], "features array<string>").write.parquet(f"{path}/features")


def write_models(models: dict, spark: SparkSession, folder: str) -> None:
    """The models of a version: detector, diagnoser and guard, each optional. Nothing shows them to readers yet."""
    _save(models.get("detector"), spark, f"{folder}/detector")
    _save(models.get("diagnoser"), spark, f"{folder}/diagnoser")
    if models.get("guard") is not None:
        save_guard(models["guard"], spark, f"{folder}/guard")


def publish(spark: SparkSession, root: str, detector=None, diagnoser=None, guard: GuardModel | None = None) -> int:
    """Write a new version and list it in the manifest; returns its number."""
    last = manifest(spark, root).agg(F.max("version")).first()[0]
    version = 1 if last is None else last + 1
    name = f"version-{version:06d}-{uuid.uuid4().hex}"
    write_models({"detector": detector, "diagnoser": diagnoser, "guard": guard}, spark, f"{root}/{name}")
    row = (version, name, _kind(detector), _kind(diagnoser), guard is not None, None if detector is None else float(detector.threshold))
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def load(spark: SparkSession, root: str, version: int | None = None) -> StoredModels:
    """The newest complete version, or a given one. Of versions published at the same time under one number, the last folder by name counts."""
    listed = manifest(spark, root)
    if version is not None:
        listed = listed.filter(F.col("version") == version)
    row = listed.orderBy(F.desc("version"), F.desc("folder")).first()
    if row is None:
        raise FileNotFoundError(f"no complete version in {root}")
    at = f"{root}/{row.folder}"

    def read(kind, name, boosted, pipeline):
        if kind == "boosted":
            return boosted(BoostedModel.load(spark, f"{at}/{name}"))
        if kind == "pipeline":
            return pipeline(PipelineModel.load(f"{at}/{name}/pipeline"), list(spark.read.parquet(f"{at}/{name}/features").first().features))
        return None

    return StoredModels(row.version, read(row.detector, "detector", lambda m: BoostedDetector(m, row.threshold), lambda m, f: Detector(m, f, row.threshold)),
                        read(row.diagnoser, "diagnoser", BoostedDiagnoser, Diagnoser), load_guard(spark, f"{at}/guard") if row.guard else None)
