"""Exact deduplication: groups of a 128-bit content hash, checked byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fresh, once
from codeloom.runtime import checked_broadcast, prepare, stage

#: Shares that one group's rows are dealt to, so that no task holds a whole hot group.
SALTS = 64


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of: Callable[[Column], Column] = content_hash, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Rows group by hash_of(text); then the smallest and the largest text of each group
    of two or more are compared byte by byte, and a group in which they differ (a
    collision) is regrouped by the text itself. keep picks the smallest ("min") or the
    largest ("max") id. Null texts count as empty, and empty texts are equal to each
    other. Of rows equal in id and text exactly one is kept. A null id loses to any
    other; if all ids of a group are null, one of its rows is kept. Only columns of
    fixed width are shuffled, apart from the texts of groups of two or more, which
    partial aggregation first brings down to two per group and task.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("i", "t", hash_of(F.col("t")).alias("h"))
    slim = rows.select("i", "h", F.sha2(F.col("t").cast("binary"), 256).alias("sha"))
    cells = stage(slim.groupBy("h", "i", "sha").agg(F.count("*").alias("n")), "exact-cells")

    sizes = cells.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    multiple = stage(sizes, "exact-multiple")
    texts = rows.select("h", "t").join(checked_broadcast(multiple, 40), "h", "left_semi")
    split = texts.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("h")
    split = stage(split, "exact-collisions")
    cells = cells.withColumn("x", F.lit(""))
    if not split.isEmpty():
        whole = rows.join(split, "h", "left_semi").groupBy("h", "i", "t").agg(F.count("*").alias("n"))
        whole = whole.select("h", "i", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), "n", F.col("t").alias("x"))
        cells = cells.join(split, "h", "left_anti").unionByName(whole)

    cells = cells.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)))
    pick = F.min if keep == "min" else F.max
    part = cells.groupBy("h", "x", "salt").agg(pick("i").alias("k"), F.sum("n").alias("n"))
    total = part.groupBy("h", "x").agg(pick("k").alias("keep_id"), F.sum("n").alias("group_size"))
    dealt = part.select("h", "x", "salt").join(total, ["h", "x"])
    out = cells.join(dealt, ["h", "x", "salt"])
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    out = out.select("i", "keep_id", "group_size", "sha", copy)
    return out.select(F.col("i").alias(id_col), "keep_id", "group_size", (F.col("i").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns.

    A null text equals an empty one, also beside it under one id. Of rows equal in id and
    text that are to stay, the smallest by its other columns does (common.once). Columns
    of docs may have any names. An empty table stays empty.
    """
    groups = exact_groups(docs, id_col, text_col, keep)
    key = lambda i, sha: F.unhex(F.md5(F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("-")), sha).cast("binary")))
    gone = groups.where(~F.col("kept")).select(key(F.col(id_col), F.col("text_sha256")).alias("k"), F.col("keep_id").eqNullSafe(F.col(id_col)).alias("again"))
    gone = stage(gone.distinct(), "exact-gone")
    own = key(F.col(id_col).cast("long"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    name = fresh(docs, "gone")
    out = docs.join(checked_broadcast(gone.where("not again").select(F.col("k").alias(name)), 64), own == F.col(name), "left_anti")
    return once(out, own, gone.where("again").select("k"))
