"""Ship this package to executors that can't import it themselves."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the job, once a context."""
    context = spark.sparkContext
    if getattr(context, "_lamina_shipped", False):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, p.relative_to(HERE.parent))
    path = Path(tempfile.mkdtemp(prefix="lamina-code-")) / "lamina.zip"
    path.write_bytes(held.getvalue())
    context.addPyFile(str(path))
    context._lamina_shipped = True
