"""Sessions, and what Python workers need to import this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("fathomgrid")
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return shipped(builder.getOrCreate())


def shipped(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it (clusters may install it instead).

    Workers use one BLAS thread each unless told otherwise: tasks are the unit of parallel work.
    """
    known = spark.sparkContext.environment
    known.setdefault("OMP_NUM_THREADS", "1")
    paths = [p for p in known.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark
