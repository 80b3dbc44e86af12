"""Makes the package importable in Python workers that weren't started beside it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package to the workers through the driver's file server, once a session.

    Nothing is done where the search path that workers inherit has it already.
    """
    app = spark.sparkContext.applicationId
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or str(ROOT) in known or os.path.abspath(os.getcwd()) == str(ROOT):
        return
    path = Path(tempfile.mkdtemp()) / "sieve_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "sieve").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
