"""What a session needs before it runs this package's Python on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each session's context; they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_dispersa_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="dispersa-code-"), "dispersa_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("dispersa", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._dispersa_shipped = True
