"""Definition lookup, listing and scoping over symbols and files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(c, _UPPER, _LOWER)


def normalise_scope(path: str | None) -> str | None:
    """'./src/' -> 'src'; '.' and None -> everything (None); a blank path stays blank and matches nothing."""
    if path is None or not path.strip():
        return path
    path = path.strip()
    while path.startswith("./"):
        path = path[2:].lstrip("/")
    path = path.rstrip("/")
    return None if path in ("", ".") else path


def is_file_scope(scope: str, files: DataFrame | None = None) -> bool:
    """Whether a scope names a file: what files holds decides (a file, or something below it), else
    a dot in the last part."""
    if files is not None:
        own = F.max((F.col("relative_path") == scope).cast("int")), F.max(F.startswith("relative_path", F.lit(scope + "/")).cast("int"))
        exact, below = files.agg(*own).first()
        if exact or below:
            return bool(exact)
    return "." in scope.rsplit("/", 1)[-1]


def in_scope(path: Column, scope: str | None, is_file: bool | None = None, language: Column | None = None, only: str | None = None) -> Column:
    """A file by its exact path; a directory by its prefix, ASCII case aside; a language exactly."""
    scope = normalise_scope(scope)
    ok = F.lit(True)
    if scope is not None and not scope.strip():
        ok = F.lit(False)
    elif scope is not None:
        is_file = is_file_scope(scope) if is_file is None else is_file
        ok = path == scope if is_file else ascii_lower(path).startswith(ascii_lower(F.lit(scope + "/")))
    return ok & (language == only) if only is not None else ok


def located(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files, "file_id")


def find_symbol(hits: DataFrame, name: str, match: str = "exact") -> DataFrame:
    """exact: the name; prefix: a word of the name begins so; fuzzy: a part of the name, ASCII case aside."""
    if match == "exact":
        cond = F.col("name") == name
    elif match == "prefix":
        # the words asked for follow each other in the name; the last may be the beginning of one
        asked = [w for w in re.split(r"[^\w]|_", name.lower()) if w]
        words = F.split(F.lower("name"), r"[^\p{L}\p{N}]+")
        at = lambda w, i: (F.get(w, i + len(asked) - 1).startswith(asked[-1])) & (F.slice(w, i + 1, F.lit(len(asked) - 1)) == F.array(*map(F.lit, asked[:-1])) if asked[:-1] else F.lit(True))
        cond = F.exists(F.transform(words, lambda w, i: F.coalesce(at(words, i), F.lit(False))), lambda x: x) if asked else F.lit(False)
    elif match == "fuzzy":
        cond = ascii_lower(F.col("name")).contains(ascii_lower(F.lit(name)))
    else:
        raise ValueError(f"unknown match {match!r}")
    return hits.where(cond)


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def file_tree(files: DataFrame, depth: int = 3, per_directory: int = 200) -> DataFrame:
    """(dir, name, is_dir, omitted, depth_exhausted): entries down to depth, directories first, cut
    per directory; omitted counts what the cut leaves out, depth_exhausted marks directories at
    the last level, whose entries aren't listed."""
    parts = F.split("relative_path", "/")
    levels = files.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(depth)))).alias("n"))
    entries = levels.select(
        F.array_join(F.slice("p", F.lit(1), F.col("n") - 1), "/").alias("dir"), F.element_at("p", F.col("n")).alias("name"), (F.col("n") < F.size("p")).alias("is_dir"), ((F.col("n") < F.size("p")) & (F.col("n") == depth)).alias("depth_exhausted")
    ).distinct()
    by = Window.partitionBy("dir")
    ranked = entries.withColumn("rank", F.row_number().over(by.orderBy(F.col("is_dir").desc(), "name"))).withColumn("total", F.count("*").over(by))
    return ranked.where(F.col("rank") <= per_directory).select("dir", "name", "is_dir", F.greatest(F.col("total") - per_directory, F.lit(0)).alias("omitted"), "depth_exhausted")


def skeleton(symbols: DataFrame) -> DataFrame:
    """Top-level declarations: those without a parent, with one that the file doesn't declare,
    or with one that is only a module (a package) there."""
    own = symbols.where("kind <> 'module'").select(F.col("file_id").alias("pf"), F.col("name").alias("pn")).distinct()
    return symbols.join(own, (F.col("file_id") == F.col("pf")) & (F.col("parent") == F.col("pn")), "left_anti")
