"""Settings for a session the caller owns, and the folder its executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Where they differ from Spark's defaults.
SETTINGS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.fallback.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession, **overrides: str) -> SparkSession:
    """Apply the runtime SQL settings. Master and memory are the launcher's business."""
    for name, value in {**SETTINGS, **overrides}.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` as the cluster sets it.

    Without that setting, and without a call of ``use_folder``, this is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder.rstrip("/")
    folder = context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def use_folder(spark: SparkSession, folder: str) -> SparkSession:
    """Name the folder for intermediate tables where the launcher has set none."""
    try:
        shared_folder(spark)
    except RuntimeError:
        spark.sparkContext.setCheckpointDir(folder)
    return spark
