"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that can be changed on a running session. Memory, cores and the checkpoint folder belong to
# the cluster.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # File contents cross to Python workers in batches bounded by size, not only by row count.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}

# Settings that must be given when a session is built. Recording a Python call site for every Column call
# costs more than planning a query with a few hundred expressions.
BUILD_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_lumaforge_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lumaforge-code-"), "lumaforge_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("lumaforge", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._lumaforge_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder: the session's own, else ``spark.checkpoint.dir``.

    Only a single-process local master may fall back to a temporary folder, since executors on other
    machines could not read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="lumaforge-ckpt-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
