"""Makes this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources with the application, once per context; Spark's file server hands
    them to executors that come later as well."""
    context = spark.sparkContext
    if context not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tidemark-")
        path = os.path.join(folder, f"tidemark-{os.getpid()}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path("tidemark") / p.relative_to(root))
        context.addPyFile(path)
        _shipped.add(context)
    return spark
