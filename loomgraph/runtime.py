"""Session helpers: code shipping, the folder that driver and executors share, and lineage cuts through it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_swept: set[str] = set()


#: Rows and bytes of an Arrow batch: texts can be long, and a batch is held by the JVM and by the Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that workers can import it wherever they run, and bound Arrow batches."""
    sc = spark.sparkContext
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size, None) is None or not 0 < _bytes(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))


def _bytes(size: str) -> int:
    """Bytes of a size as Spark writes it; 0 if it has another unit."""
    number = size.strip().lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(number[-1:], 0)
    number = number[:-1] if scale else number
    return int(number) << scale if number.isdigit() else 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomgraph-shared-")
        sc.setCheckpointDir(at)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/") if "://" in at or at.startswith("file:") else "file://" + os.path.abspath(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder, which goes when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/loomgraph/{app}"
    if app not in _swept:
        _swept.add(app)
        fs, at = _filesystem(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a saved table that no other plan reads any more, as the rounds of an iteration leave them."""
    path = getattr(df, "_saved_at", None)
    if path:
        fs, at = _filesystem(df.sparkSession, path)
        fs.delete(at, True)
