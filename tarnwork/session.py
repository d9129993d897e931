"""What a Spark session needs before the library's Python functions run on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each Spark context, so that they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tarnwork_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="ship-")) / f"{here.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(path))
    sc._tarnwork_shipped = True
