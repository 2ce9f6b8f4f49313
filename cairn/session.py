"""Session builder used by tests and the bench; a cluster supplies its own session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cairn") -> SparkSession:
    """A local session with UTC time and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the workers this package where their search path lacks it: once for each Spark context.

    The driver serves the archive for as long as the context lives, so it stays until the process ends.
    """
    root = Path(__file__).resolve().parent.parent
    paths = {Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    context = spark.sparkContext
    if root in paths or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix=f"{__package__}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    held = context.environment.get("PYTHONPATH")  # for the Python workers that streams start beside the driver
    context.environment["PYTHONPATH"] = os.pathsep.join([str(root), held] if held else [str(root)])
    context.addPyFile(shutil.make_archive(f"{folder}/{__package__}", "zip", root, __package__))
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
