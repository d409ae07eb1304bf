"""Sends this package to the executors, once for each Spark context.

Python functions of operators are pickled by name, so that workers must be able to import the
package even where it is not installed and not on their path.
"""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_LOCK = threading.Lock()


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    with _LOCK:
        if getattr(sc, "_notelattice_sent", False):
            return
        at = Path(tempfile.mkdtemp(prefix="notelattice-")) / "notelattice.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, Path(PACKAGE.name) / p.relative_to(PACKAGE))
        sc.addPyFile(str(at))
        sc._notelattice_sent = True
