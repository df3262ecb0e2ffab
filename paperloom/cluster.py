"""What a session on a cluster needs: this package's code on the executors, and folders that all of them see."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so that they need no installation of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_paperloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    name = f"{tempfile.mkdtemp(prefix='paperloom-')}/paperloom.zip"  # read by the driver, which serves it to the executors
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"paperloom/{p.relative_to(top)}")
    sc.addPyFile(name)
    sc._paperloom_shipped = True


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of 2,000 rows, unless the user set a number: 10,000 whole texts fill a worker's memory."""
    if spark.conf.get(ROWS) == "10000":
        spark.conf.set(ROWS, "2000")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, below spark.checkpoint.dir; where that is unset, only local
    mode gets one of its own, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    out = f"{path.rstrip('/')}/paperloom-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, out))
    return out


_FOLDERS: list = []


@atexit.register
def _sweep() -> None:
    """What a query left for its reader goes when the application ends."""
    for spark, path in _FOLDERS:
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
