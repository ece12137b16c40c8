"""Sessions, and the package's way to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("citeloom")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, where their PYTHONPATH doesn't hold it; once per context."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    context = spark.sparkContext
    if getattr(context, "_citeloom_shipped", False):
        return
    fd, path = tempfile.mkstemp(suffix=".zip", prefix="citeloom-")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as out:
        for file in [*sorted((ROOT / "citeloom").rglob("*.py")), *ROOT.glob("corpus_pipeline.py")]:
            out.write(file, file.relative_to(ROOT))
    context.addPyFile(path)
    context._citeloom_shipped = True
