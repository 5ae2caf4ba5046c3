"""Give executors this package where they can't import it already."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once an application, unless they start with it on their path."""
    here = str(ROOT)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or here in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    where = Path(tempfile.mkdtemp(prefix="lumenforge-")) / "lumenforge.zip"
    with zipfile.ZipFile(where, "w") as out:
        for p in sorted((ROOT / "lumenforge").rglob("*.py")):
            out.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(where))
    _SHIPPED.add(app)
    return spark
