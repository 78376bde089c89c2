"""A session with the settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, name: str = "lodestrand", **settings: str) -> SparkSession:
    """Get or make a session; settings given by the caller or the cluster win."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, unless their path has it already: once for each context."""
    import os
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_lodestrand", False):
        return
    with tempfile.TemporaryDirectory() as folder:  # the driver's own: Spark takes a copy and serves it to the executors
        package = Path(folder) / "lodestrand"
        shutil.copytree(root / "lodestrand", package / "lodestrand", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(folder) / "lodestrand-package"), "zip", package)
        target = Path(context._temp_dir) / "lodestrand-package.zip"
        shutil.copy(archive, target)
    context.addPyFile(str(target))
    context._lodestrand = True
