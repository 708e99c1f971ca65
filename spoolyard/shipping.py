"""Let the executors' Python import this package."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows of an Arrow batch: texts can be long, and a worker holds a batch of them. A session that asks for less keeps its own.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Spark's file server hands the package's modules to the executors, once a context; batches are kept small."""
    if not 0 < int(spark.conf.get(BATCH_CONF, "10000")) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_spoolyard_shipped", False):
        return
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    at = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
    Path(at).write_bytes(packed.getvalue())
    sc.addPyFile(at)
    sc._spoolyard_shipped = True
