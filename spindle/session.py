"""Getting this package to where Spark's Python workers run."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors through Spark, unless their PYTHONPATH has it already."""
    here = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(_ROOT) in here or app in _shipped:
        return
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((_ROOT / "spindle").rglob("*.py")):
            z.write(path, path.relative_to(_ROOT))
    target = Path(tempfile.mkdtemp(prefix="spindle-")) / "spindle_package.zip"  # on the driver; Spark serves it from there
    target.write_bytes(raw.getvalue())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
