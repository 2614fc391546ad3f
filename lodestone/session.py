"""Spark sessions and the shipping of this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every operator assumes (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    return builder.config(map=fixed | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a Spark context: Python workers import it to run Arrow functions."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(archive))
    context._lodestone_shipped = True
