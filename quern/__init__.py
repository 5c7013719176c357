"""quern: a Spark-first engine for document retrieval analytics."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, once; they may run where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quern-package-")) / "quern.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._quern_shipped = True
