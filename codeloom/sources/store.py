"""Published versions of a set of tables: written whole, then swapped in by one small pointer."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file that names the published version, and seconds after which an unfinished version may be taken over.
POINTER, CLAIM_SECONDS = "CURRENT", 3_600


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def generation(spark: SparkSession, root: str) -> int:
    """The number of the published version; 0 before the first."""
    fs, path = _files(spark, root)
    pointer = path(f"{root}/{POINTER}")
    if not fs.exists(pointer):
        return 0
    stream = fs.open(pointer)
    try:
        return int(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, by their number and a sum of 64-bit hashes."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    columns = sorted(a.columns)
    mark = lambda df: tuple(df.select(F.xxhash64(*[F.to_json(F.struct(*columns)) if columns else F.lit(0)]).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first())
    return mark(a) == mark(b)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], seen: int, skip_same: bool = True) -> int:
    """Writes all tables as version seen + 1, then moves the pointer; readers of older versions
    aren't disturbed. If every table holds the rows of the published version, nothing is
    published and seen is returned.

    A version belongs to the writer that creates its CLAIM file, which is one step of the file
    system: a second writer of the same version fails there, before it writes anything.
    """
    if generation(spark, root) != seen:
        raise RuntimeError(f"version {seen} isn't the published one any more")
    if skip_same and seen and all(_exists(spark, f"{root}/v{seen:08d}/{n}") and _same(snapshot(spark, root, n, seen), df) for n, df in tables.items()):
        return seen
    now = seen + 1
    fs, path = _files(spark, root)
    fs.mkdirs(path(f"{root}/v{now:08d}"))
    claim = path(f"{root}/v{now:08d}/CLAIM")
    if fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
        fs.delete(claim, False)
    try:
        fs.create(claim, False).close()
    except Exception as e:
        raise RuntimeError(f"version {now} is being written by another writer") from e
    try:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{root}/v{now:08d}/{name}")
    except BaseException:
        fs.delete(claim, False)
        raise
    fresh = path(f"{root}/{POINTER}.{now}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(str(now).encode()))
    stream.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = context.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(context.Options.Rename, 1)
    options[0] = context.Options.Rename.OVERWRITE
    target.rename(fresh, path(f"{root}/{POINTER}"), options)
    return now


def _exists(spark: SparkSession, at: str) -> bool:
    fs, path = _files(spark, at)
    return fs.exists(path(at))


def snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of one version, the published one by default; it stays the same while others are published."""
    version = generation(spark, root) if version is None else version
    if version < 1:
        raise RuntimeError("nothing is published yet")
    return spark.read.parquet(f"{root}/v{version:08d}/{name}")
