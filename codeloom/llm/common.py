"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeloom.runtime import checked_broadcast, stage

#: Keys at most that join_counted takes as hot.
HOT_KEYS = 50_000


def map_columns(df: DataFrame, schema: str, run: Callable[[Iterator[list[list]]], Iterator[list]]) -> DataFrame:
    """df.mapInArrow where run sees each batch as lists, one per column, and yields lists for schema.

    Integers stay exact beside nulls, which pandas would turn into floats.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run([c.to_pylist() for c in b.columns] for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(go, schema)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits that name a row by its id and text, nulls told apart from empty ones."""
    parts = F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("+"), F.col(text_col)), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("|", *parts).cast("binary"))).alias("row")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose row_key is in dropped's column row; all columns of docs stay.

    dropped is broadcast when its counted rows are few enough, else the join shuffles.
    """
    name = fresh(docs, "gone")
    gone = stage(dropped.select(F.col("row").alias(name)).distinct(), "dropped")
    return docs.join(checked_broadcast(gone, 64), row_key(id_col, text_col) == F.col(name), "left_anti")


def once(docs: DataFrame, key: Column, repeated: DataFrame) -> DataFrame:
    """docs with one row for each key in repeated (one column of distinct keys); rows of other keys all stay.

    Of rows with one key the smallest stays, column by column in their order and nulls
    first, so the choice is defined; partial aggregation brings a hot key down to one row
    a task. Columns that have no order (maps) are chosen from any of the rows.
    """
    if repeated.isEmpty():
        return docs
    name, own = fresh(docs, "again"), fresh(docs, "own")
    again = checked_broadcast(repeated.toDF(name), 64)
    ordered = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    loose = [c for c in docs.columns if c not in ordered]
    picks = [F.min(F.struct(*[F.col(f"`{c}`") for c in ordered])).alias("x"), *[F.first(f"`{c}`").alias(f"l{i}") for i, c in enumerate(loose)]]
    keyed = docs.withColumn(own, key)
    picked = keyed.join(again, F.col(own) == F.col(name), "left_semi").groupBy(own).agg(*picks)
    one = picked.select(*[(F.col("x").getField(c) if c in ordered else F.col(f"l{loose.index(c)}")).alias(c) for c in docs.columns])
    return keyed.join(again, F.col(own) == F.col(name), "left_anti").drop(own).unionByName(one)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """left joined with right, which has one row for each key and in n the rows of left that have it.

    Keys with more than 1 / HOT_KEYS of the rows, of which there can be no more than
    HOT_KEYS, are joined by broadcast; all other keys are small and may be shuffled.
    n isn't in the result. Both sides are read twice, so they should be staged tables.
    """
    bound = (right.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS + 1
    hot = F.broadcast(right.where(F.col(n) > bound).drop(n))
    rest = left.join(F.broadcast(right.where(F.col(n) > bound).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(right.where(F.col(n) <= bound).drop(n), keys))
