"""Give Python workers this package when it is not installed on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors through Spark's own file server, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_quarrylens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarrylens-")  # on the driver, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = os.path.join(folder, "quarrylens_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("quarrylens") / p.relative_to(root)))
    sc.addPyFile(out)
    sc._quarrylens_shipped = True
