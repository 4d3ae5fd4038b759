"""Facets, percentiles, areas, byte-budgeted pages, keys of findings, tests by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_test(path: Column, name: Column) -> Column:
    """Whether a path or a name looks like a test's: a test folder in any case, a file's name by
    one of the usual forms (only ...Test. with its capital), a symbol called test or test_..."""
    file = F.element_at(F.split(path, "/"), -1)
    low = F.lower(file)
    by_path = F.lower(path).rlike(r"(?:^|/)(?:tests|test|__tests__)/") | file.rlike(r"^[^.]+Test(?:\.|$)") | low.rlike(r"^test_|^test(?:\.|$)|^[^.]*_test(?:\.|$)|\.test\.|\.spec\.")
    return by_path | (F.lower(name) == "test") | F.lower(name).startswith("test_")


def affected_tests(walked: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Of walked(node, depth), the tests, nearest first in depth, path, line, id; modules are no tests."""
    at = walked.withColumnRenamed("node", "symbol_id").join(symbols, "symbol_id").join(files, "file_id")
    return at.where(is_test(F.col("relative_path"), F.col("name")) & (F.col("kind") != "module")).orderBy("depth", "relative_path", "line", "symbol_id")


def facets(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """(facet, value, n): each facet counts the rows that the other facets' choices leave.

    Rows are counted once by all facets together; the cuts work on those counts."""
    counts = df.groupBy(*chosen).agg(F.count("*").alias("n"))
    out = []
    for facet in chosen:
        own = counts
        for other, values in chosen.items():
            if other != facet and values:
                own = own.where(F.col(other).isin(*values))
        out.append(own.groupBy(F.lit(facet).alias("facet"), F.col(facet).cast("string").alias("value")).agg(F.sum("n").alias("n")))
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def nearest_rank(df: DataFrame, key: str, value: str, newest: list[Column], shares: list[int], samples: int = 500) -> DataFrame:
    """Percentiles by nearest rank over the newest samples of each key, a bounded window."""
    recent = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where(F.col("__n") <= samples)
    ranks = Window.partitionBy(key).orderBy(value)
    ranked = recent.select(key, value, F.row_number().over(ranks).alias("__r"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    picks = [F.max(F.when(F.col("__r") == F.ceil(F.col("n") * p / F.lit(100)), F.col(value))).alias(f"p{p}") for p in shares]
    return ranked.groupBy(key, "n").agg(*picks)


def areas(files: DataFrame, most: int = 8) -> list[tuple[str, int]]:
    """(folder, files): top folders; while one holds more than half of the files and there is room,
    it is cut one folder deeper. The driver sees only the counts of the current folders."""
    folders = files.select(F.slice(F.split("relative_path", "/"), F.lit(1), F.size(F.split("relative_path", "/")) - 1).alias("d"))

    def below(prefix: list[str]) -> list[tuple[tuple[str, ...], int]]:
        depth = len(prefix)
        own = folders.where(F.slice("d", 1, depth) == F.array(*map(F.lit, prefix))) if prefix else folders
        got = own.groupBy(F.slice("d", 1, depth + 1).alias("a")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(most + 1)
        return [(tuple(r["a"]), r["n"]) for r in got.collect()]

    now, done = dict(below([])), set()
    total = folders.count()
    while len(now) < most:
        big = next((a for a, n in now.items() if 2 * n > total and a and a not in done), None)
        if big is None:
            break
        done.add(big)
        parts = below(list(big))
        if len(parts) < 2 and parts and parts[0][0] == big or len(now) - 1 + len(parts) > most:
            continue
        del now[big]
        now.update(parts)
    return sorted((("/".join(a) or ".", n) for a, n in now.items()), key=lambda x: (-x[1], x[0]))


def within_bytes(df: DataFrame, order: list[str], size: Column, budget: int = 24_000) -> DataFrame:
    """The first rows of a total order whose sizes (1 at least) add up to the budget at most.

    No more than budget rows can fit, so the running sum sees that many rows only."""
    head = df.withColumn("bytes", F.greatest(size, F.lit(1)).cast("long")).orderBy(*order).limit(budget)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("total_bytes", F.sum("bytes").over(w)).where(F.col("total_bytes") <= budget)


def finding_key(*fields: Column) -> Column:
    """SHA-256 over fields, each after its length in bytes, so no two lists of fields read alike."""
    parts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def first_callees(relations: DataFrame, most: int = 8) -> DataFrame:
    """(from_symbol_id, callees): the first distinct names each symbol calls, by line, as one text."""
    calls = relations.where("kind = 'calls'").groupBy("from_symbol_id", "to_name").agg(F.min("line").alias("line"))
    w = Window.partitionBy("from_symbol_id").orderBy("line", "to_name")
    top = calls.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    listed = top.groupBy("from_symbol_id").agg(F.sort_array(F.collect_list(F.struct("k", "to_name"))).alias("l"))
    return listed.select("from_symbol_id", F.array_join(F.col("l.to_name"), ", ").alias("callees"))


def join_points(uses: DataFrame, declares: DataFrame) -> DataFrame:
    """(user_id, value, n_declarers, declarer_id) for uses(user_id, value) of a value that
    declares(declarer_id, value) holds. Declarations are counted per value before the join, so a
    common value costs one row per use; declarer_id is the smallest, and the only one if n is 1."""
    known = declares.groupBy("value").agg(F.countDistinct("declarer_id").alias("n_declarers"), F.min("declarer_id").alias("declarer_id"))
    return uses.select("user_id", "value").distinct().join(known, "value").select("user_id", "value", "n_declarers", "declarer_id")
