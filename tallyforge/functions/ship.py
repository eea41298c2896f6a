"""Getting the package's code to Python workers that do not have it."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session once, as a zip that executors fetch from the driver."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(top):  # already running from a zip
        return
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".py"))
    digest = hashlib.sha256()
    for f in files:
        with open(f, "rb") as source:
            digest.update(f.encode() + source.read())
    key = (spark.sparkContext.applicationId, digest.hexdigest()[:16])
    if key in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{os.path.basename(top)}-{key[1]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, os.path.relpath(f, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(key)
