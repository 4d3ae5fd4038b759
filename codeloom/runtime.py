"""Session helpers shared by all operators: shared storage, code shipping, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Documents can be very long, so batches stay small.
ARROW_ROWS = 512
#: A side is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only a local[...] session, where driver and executors are one process, may go
    without the setting; it gets a temporary folder.
    """
    key = "spark.checkpoint.dir"
    conf = spark.sparkContext.getConf()
    path = spark.conf.get(key, None) or conf.get(key)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="codeloom-")
    return _own_dirs[app]


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers and bound Arrow batches."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="codeloom-zip-"), "codeloom.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"codeloom/{p.relative_to(root)}")
        sc.addPyFile(target)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return spark


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/codeloom/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage ends here,
    so a lost executor costs only its running tasks."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * row_bytes <= limit


def checked_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit, otherwise df itself
    (a shuffled join then, with AQE splitting skewed partitions)."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if small_enough(rows, row_bytes, limit) else df


def filesystem(uri: str):
    """The Arrow file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
