"""Identifier words, token estimates, hashes and scores as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import prepare, stage

#: Constants of the BM25 weighting.
K1, B = 1.2, 0.75


def split_identifier(name: Column) -> Column:
    """Lower-case words of an identifier: cut at other characters, at a lower-case letter or
    digit before a capital, and before the last capital of an acronym that a word follows."""
    cut = F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    cut = F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(cut), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def search_words(name: Column) -> Column:
    """The words and, when there are several, all of them glued."""
    words = split_identifier(name)
    return F.when(F.size(words) > 1, F.concat(words, F.array(F.array_join(words, "")))).otherwise(words)


def git_blob_hash(content: Column) -> Column:
    data = content.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(data).cast("string").cast("binary"), F.unhex(F.lit("00")), data))


def estimate_tokens(text: Column) -> Column:
    """A quarter of each run of ASCII letters and digits, rounded up, plus one for each other
    visible character."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    of_runs = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + F.floor((F.length(r) + 3) / 4))
    return of_runs + F.length(F.regexp_replace(text, r"[A-Za-z0-9\s]+", "")).cast("long")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def bm25(docs: DataFrame, key: str, words: Column, terms: list[str], prefix: bool = False) -> DataFrame:
    """(key, matched, score) of rows that hold a term; a lower score is a better match.

    Texts are split once: a row becomes its length and one count a term, which are written
    down; N, the mean length and the terms' document counts are one sum over those.
    """
    prepare(docs.sparkSession)
    same = lambda t: (lambda w: w.startswith(t)) if prefix else (lambda w: w == F.lit(t))
    counts = [F.size(F.filter("w", same(t))).alias(f"f{i}") for i, t in enumerate(terms)]
    src = stage(docs.select(key, words.alias("w")).select(key, F.size("w").alias("d"), *counts), "bm25-counts")
    total = src.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), *[F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"n{i}") for i in range(len(terms))]).first()
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        df = total[f"n{i}"] or 0
        idf = math.log((total["n"] - df + 0.5) / (df + 0.5))
        f = F.col(f"f{i}").cast("double")
        score = score - (idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / (total["mean"] or 1.0)))
        matched = matched + (F.col(f"f{i}") > 0).cast("int")
    return src.where(" OR ".join(f"f{i} > 0" for i in range(len(terms)))).select(key, matched.alias("matched"), score.alias("score"))


def reciprocal_ranks(left: DataFrame, right: DataFrame, key: str, alpha: float, k: int = 10) -> DataFrame:
    """(key, score): weighted reciprocal-rank fusion of two ranked frames (key, rank)."""
    a, b = left.select(key, F.col("rank").alias("ra")), right.select(key, F.col("rank").alias("rb"))
    one = lambda weight, r: F.coalesce(F.lit(float(weight)) / (k + F.col(r)), F.lit(0.0))
    return a.join(b, key, "full_outer").select(key, (one(1 - alpha, "ra") + one(alpha, "rb")).alias("score"))
