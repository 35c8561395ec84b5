"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="offersieve-")) / "offersieve_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        context.addPyFile(str(target))
        # Rows are whole documents: 10,000 of them, the default, are too many for one batch.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        _sent.add(context.applicationId)
    return spark
