"""Makes this package importable by Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Once for each Spark context: nothing if PYTHONPATH holds the package already, a path in local mode, else a zip by addPyFile."""
    context = spark.sparkContext
    if getattr(context, "_tarnspark_shipped", False):
        return
    if str(ROOT) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        if context.master.startswith("local[") or context.master == "local":
            context.environment["PYTHONPATH"] = str(ROOT)
        else:
            packed = Path(tempfile.mkdtemp()) / "tarnspark.zip"
            with zipfile.ZipFile(packed, "w") as z:
                for p in sorted((ROOT / "tarnspark").rglob("*.py")):
                    z.write(p, p.relative_to(ROOT))
            context.addPyFile(str(packed))
    context._tarnspark_shipped = True
