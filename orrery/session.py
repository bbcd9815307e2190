"""Makes a session ready for this package: Python workers find its code and get batches of bounded size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Of an Arrow batch on its way to a Python worker. Spark's own 64 MB, several times over, is much for an executor's memory.
BATCH_BYTES = 4 << 20
_DONE: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Lets workers import the package: by its path in local mode, else by a zip that Spark serves, once an application.

    It also bounds Arrow batches to BATCH_BYTES, so that memory doesn't depend on how long the texts of a batch's rows are.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    here = Path(__file__).resolve().parent
    if sc.master.startswith("local[") or sc.master == "local":
        sc.environment.setdefault("PYTHONPATH", str(here.parent))
    elif sc.applicationId not in _DONE:
        folder = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder, "orrery_code.zip")
        with zipfile.ZipFile(path, "w") as out:
            for f in sorted(here.rglob("*.py")):
                out.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(path))
        _DONE.add(sc.applicationId)
    return spark
