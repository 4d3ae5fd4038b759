"""Clone groups: equal normalised token sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens and lines that a body must have.
MIN_TOKENS, MIN_LINES = 40, 6


def tokens(text: Column) -> Column:
    """Words, numbers and single other visible characters."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}_][\p{L}\p{N}_]*|\p{N}+|[^\s\p{L}\p{N}_])"), F.lit(1))


def normalise(t: Column, policy: str) -> Column:
    """exact: texts; broad: identifiers as I, numbers as L; consistent: identifiers by first use."""
    if policy == "exact":
        return t
    name = lambda x: x.rlike(r"^[\p{L}_]")
    number = lambda x: x.rlike(r"^\p{N}")
    if policy == "broad":
        return F.transform(t, lambda x: F.when(name(x), "I").when(number(x), "L").otherwise(x))
    if policy != "consistent":
        raise ValueError(f"unknown policy {policy!r}")
    return _by_first_use(t)


def _by_first_use(t: Column) -> Column:
    """Names by the order of their first use, numbers as L. Arrow batches: a lookup in a column of
    arrays or maps walks all of it, which is quadratic in a text's names."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for words in rows:
            at: dict[str, int] = {}
            made = []
            for x in () if words is None else words:
                if x[0].isalpha() or x[0] == "_":
                    made.append(f"#{at.setdefault(x, len(at) + 1)}")
                else:
                    made.append("L" if x[0].isnumeric() else x)
            out.append(made)
        return pd.Series(out)

    return run(t)


def clone_groups(bodies: DataFrame, key: str, text: str, policy: str = "exact", min_tokens: int = MIN_TOKENS, min_lines: int = MIN_LINES, language: str | None = None) -> DataFrame:
    """(fingerprint, members, first, weight) of groups of two bodies or more, in one language.

    Groups are counted by a 256-bit fingerprint, with sums before the shuffle, so a hot group
    is never gathered. The weight is the tokens that all but one member repeat.
    """
    own = F.col(language) if language else F.lit("")
    t = bodies.select(F.col(key).alias("k"), own.alias("language"), tokens(F.col(text)).alias("t"), F.size(F.split(text, "\n")).alias("lines"))
    t = t.where((F.size("t") >= min_tokens) & (F.col("lines") >= min_lines))
    sequence = F.concat_ws("\x1e", F.coalesce("language", F.lit("")), F.array_join(normalise(F.col("t"), policy), "\x1f"))
    t = t.select("k", F.size("t").cast("long").alias("n"), F.sha2(sequence, 256).alias("fingerprint"))
    g = t.groupBy("fingerprint").agg(F.count("*").alias("members"), F.min("k").alias("first"), F.min("n").alias("n_tokens")).where("members > 1")
    return g.withColumn("weight", F.col("n_tokens") * (F.col("members") - 1))
