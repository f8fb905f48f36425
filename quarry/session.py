"""Makes the package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: Python functions of its modules need it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json", ".txt") and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
