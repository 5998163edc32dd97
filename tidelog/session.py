"""Spark sessions, shipping this package to workers, and cutting lineage in a folder that survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tidelog", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution in UTC; on a cluster the master and sizes come from its own configuration."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    # Checkpoints go with the last reference to them.
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, which need not share the driver's folders or path."""
    context = spark.sparkContext
    if not getattr(context, "_tidelog_shipped", False):
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tidelog-")) / "tidelog.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._tidelog_shipped = True
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir`` where it is set.

    Only a local master without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder; later reads survive lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
