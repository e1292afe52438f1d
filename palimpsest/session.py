"""A session with the settings that the engine's results rely on, and the package for its workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("palimpsest")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package once a session, for clusters on which it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_palimpsest_archive_shipped", False):
        return
    name = f"{tempfile.mkdtemp(prefix='palimpsest-')}/palimpsest-archive.zip"
    with zipfile.ZipFile(name, "w") as packed:
        for path in sorted(PACKAGE.rglob("*.py")):
            packed.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(name)
    context._palimpsest_archive_shipped = True
