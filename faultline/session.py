"""Session helpers.

Cluster jobs read ``spark.checkpoint.dir`` from the session (a shared folder
the cluster names). Only when it is unset — local runs and tests — do we pick
a folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def _heap_gb() -> int:
    """Half of the machine's memory, at least 2 GB: a local master runs everything in the driver, next to its Python workers."""
    return max(2, os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // (2 << 30))


def get_spark(master: str | None = None, app: str = "faultline",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one sized for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or max(8, cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", f"{_heap_gb()}g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    A local master (tests, bench) with the setting unset gets a folder of its
    own; on a cluster the setting is required, because executors cannot see a
    folder that exists only on the driver.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="faultline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(conf)
    return conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the shared checkpoint folder (not created yet)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="faultline-pkg-"), "faultline_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def cut_lineage(df):
    """Materialise ``df`` into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Partitions of training rows; models that draw per partition depend on it, so it is the same on every cluster.
TRAIN_PARTITIONS = 64


def for_training(df, partitions: int = TRAIN_PARTITIONS):
    """Rows dealt and sorted by their own values, so that a fitted model does not depend on the machine."""
    return df.repartition(partitions, *df.columns).sortWithinPartitions(*df.columns)
