"""Makes this package importable on the executors of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package's sources along once for each application, so that
    Python workers find it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / "tidemark_sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(str(path))
    _shipped[sc.applicationId] = str(path)
