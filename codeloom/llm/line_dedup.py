"""Line deduplication: later copies of maximal repeated runs of lines, found by distributed prefix doubling.

Every document is a sequence of line numbers. Prefix doubling ranks the suffixes of all
sequences by their first 1, 2, 4, ... lines: the rank of the first 2k lines is the rank
of the pair (rank of k lines here, rank of k lines further on). Ranks come from a
distributed sort of the distinct pairs. Suffixes whose prefix is unique drop out, as
nothing that long repeats there, and the doubling goes on until no prefix repeats.

The suffixes that share their first m lines are an interval of the suffix array; the first
of them, by document id and place, is the copy that stays. From each place the longest run
is looked for whose first copy is an earlier one and doesn't overlap it. If a run has such
a copy, so have the shorter ones from there, so its length is found bit by bit, downwards
from the last doubling: an interval of m lines is cut by the ranks of the 2**j lines that
follow. Intervals stay as long as a length of theirs is open.

The lines of each such run that holds min_words words or more are deleted; by default every
repeated run counts, single lines included. Runs within the run of an earlier place aren't
maximal and aren't listed. Lines without words are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import HOT_KEYS, join_counted, map_columns, once, row_key
from codeloom.runtime import checked_broadcast, prepare, small_enough, stage

#: Words of a run of lines that counts as repeated: every line with a word, so all repeated runs.
MIN_WORDS = 1


def ordered(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with name, a number that grows with columns: a range-partitioned sort, numbered in place."""
    out = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in columns]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in columns])
    return stage(out.withColumn(name, F.monotonically_increasing_id()), f"ordered-{name}")


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, with n; counts are summed before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def _firsts(df: DataFrame, keys: list[str]) -> DataFrame:
    """_repeated with the first suffix f of each key."""
    return df.groupBy(*keys).agg(F.min(F.struct("g", "p")).alias("f"), F.count("*").alias("n")).where("n > 1")


def _past(at: str, length: Column) -> Column:
    """Whether the suffix at begins after the run of length lines from f, and thus doesn't overlap it."""
    return F.expr(f"{at}g > f.g") | (F.expr(f"{at}g = f.g") & (F.expr(f"{at}p - f.p") >= length))


def _with(left: DataFrame, right: DataFrame, keys: list[str], row_bytes: int = 96) -> DataFrame:
    """join_counted, where rows of left without a match, which have rare keys or a null, stay. A
    right side that is small enough is broadcast as a whole."""
    if small_enough(right.count(), row_bytes):
        return left.join(F.broadcast(right.drop("n")), keys, "left")
    bound = (right.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS + 1
    hot, none = right.where(F.col("n") > bound).drop("n"), F.expr(" OR ".join(f"{k} IS NULL" for k in keys))
    rest = left.where(~none).join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    rest = rest.join(right.where(F.col("n") <= bound).drop("n"), keys, "left")
    return left.join(F.broadcast(hot), keys).unionByName(rest).unionByName(left.where(none), allowMissingColumns=True)


def _windows(words: list[int], places: list[int], least: int) -> list[tuple[int, int]]:
    """(first, length) of the shortest runs of least words that begin or end at each of the
    lines, which are neighbours where places follow on. Deleting those that have an earlier
    copy gives the same lines; tests compare the two."""
    out, n = set(), len(words)
    start = 0
    while start < n:
        end = start + 1
        while end < n and places[end] == places[end - 1] + 1:
            end += 1
        total = [0]
        for w in words[start:end]:
            total.append(total[-1] + w)
        size, j = end - start, 0
        for i in range(size):  # shortest run from i on
            j = max(j, i)
            while j < size and total[j + 1] - total[i] < least:
                j += 1
            if j == size:
                break
            out.add((start + i, j + 1 - i))
        i = 0
        for j in range(size):  # shortest run up to j
            if total[j + 1] < least:
                continue
            while total[j + 1] - total[i + 1] >= least:
                i += 1
            out.add((start + i, j + 1 - i))
        start = end
    return sorted(out)


def doubled(held: DataFrame) -> list[DataFrame]:
    """By level k the suffixes (g, p) whose first 2**k lines repeat, with the rank r of these lines and
    earlier, whether they have an earlier copy without overlap. held: (g, p, r) of repeated lines."""
    at = held.select("g", "p", "r")
    named = _with(at, stage(_firsts(at, ["r"]), "rank-firsts"), ["r"])
    levels = [stage(named.select("g", "p", "r", _past("", F.lit(1)).alias("earlier")), "ranks")]
    while True:
        at, size = levels[-1].drop("earlier"), 1 << len(levels) - 1
        pairs = stage(at.join(at.select("g", (F.col("p") - size).alias("p"), F.col("r").alias("r2")), ["g", "p"]), "rank-pairs")
        names = ordered(_firsts(pairs, ["r", "r2"]), ["r", "r2"], "rank")
        if names.isEmpty():
            return levels
        named = _with(pairs, names, ["r", "r2"]).where("rank IS NOT NULL")
        levels.append(stage(named.select("g", "p", F.col("rank").alias("r"), _past("", F.lit(2 * size)).alias("earlier")), "ranks"))


def longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """(g, p, m): the length m of the longest run from each place that has an earlier copy without
    overlap, for places where there is one. levels: what doubled gave."""
    # state: intervals of the suffixes that share m lines, named c; own: the suffix's length is m or, if bits are left, more
    state, keys = None, ["m", "c", "r"]
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        new = levels[k].withColumn("own", F.col("earlier"))
        if k + 1 < len(levels):
            longer = levels[k + 1].where("earlier").select("g", "p", F.lit(True).alias("more"))
            new = new.join(longer, ["g", "p"], "left").withColumn("own", F.col("earlier") & F.col("more").isNull())
        new = new.select("g", "p", "own", F.lit(size).alias("m"), F.col("r").alias("c"))
        if state is not None:
            there = levels[k].select("g", F.col("p").alias("z"), "r")
            tried = stage(state.withColumn("z", F.col("p") + F.col("m")).join(there, ["g", "z"], "left").drop("z"), "runs-tried")
            cut = tried.where("r IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("g", "p")).alias("f"), F.max(F.when(F.col("own"), F.struct("g", "p"))).alias("l"), F.count("*").alias("n"))
            # if any suffix of its own is past the first copy, the last one is
            some = F.coalesce(_past("l.", F.col("m") + size), F.lit(False))
            cut = cut.where("n > 1").select(*keys, "f", "n", F.when(some, F.monotonically_increasing_id()).alias("name"))
            tried = _with(tried, stage(cut, "runs-cut"), keys)
            grows = F.coalesce(F.col("own") & _past("", F.col("m") + size), F.lit(False))
            stays = F.struct((F.col("own") & ~grows).alias("own"), "m", "c")
            grown = F.struct(grows.alias("own"), (F.col("m") + size).alias("m"), F.col("name").alias("c"))
            both = F.when(F.col("name").isNull(), F.array(stays)).otherwise(F.array(stays, grown))
            new = new.unionByName(tried.select("g", "p", F.explode(both).alias("x")).select("g", "p", "x.*"))
        state = stage(new if k else new.where("own"), "runs-open")
        if k:
            open_ = state.groupBy("m", "c").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1")
            state = _with(state, stage(open_, "runs-intervals"), ["m", "c"], 56).where("any").drop("any")
    return state.select("g", "p", "m")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, gone, runs): per row_key the places of the lines to delete and the first and last line of
    each maximal run they come from, for rows that lose any."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("i"), row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    numbers = ordered(src.groupBy("i", "row").agg(F.count("*").alias("n")), ["i", "row"], "g").select("row", "g", "n")
    src = once(src, F.col("row"), numbers.where("n > 1").select("row"))
    words = lambda x: F.size(F.filter(F.split(x, r"[ \t-\r]+"), lambda w: w != ""))
    line = lambda x, q: F.struct(q.alias("q"), F.unhex(F.md5(x.cast("binary"))).alias("h"), words(x).alias("w"))
    # places count lines with words only, so runs reach across blank ones
    lines = src.select("row", F.posexplode(F.filter(F.transform(F.split("t", "\n"), line), lambda x: x.w > 0)).alias("p", "x"))
    lines = stage(lines.select("row", "p", "x.*"), "lines")
    twice = ordered(_repeated(lines.select("h"), ["h"]), ["h"], "r")
    held = lines.join(checked_broadcast(twice.drop("n"), 48), "h") if small_enough(twice.count(), 48) else join_counted(lines, twice, ["h"])
    held = stage(held.join(numbers, "row").select("g", "q", "p", "w", "r"), "repeated-lines")

    def maximal(batches: Iterator[list[list]]) -> Iterator[list]:
        for gs, rows in batches:
            out = [[], [], []]
            for g, own in zip(gs, rows, strict=True):
                own = sorted((x["p"], x["q"], x["w"], x["m"]) for x in own)
                total, gone, runs, past = [0, *accumulate(x[2] for x in own)], [], [], 0
                for i, (_, first, _, m) in enumerate(own):
                    # the m lines from here repeat, so they are neighbours in own
                    if m and i + m > past and total[i + m] - total[i] >= min_words:
                        gone += [x[1] for x in own[max(i, past) : i + m]]
                        past = i + m
                        runs.append({"first": first, "last": own[past - 1][1]})
                if runs:
                    out[0].append(g)
                    out[1].append(gone)
                    out[2].append(runs)
            yield out

    found = held.drop("r").join(longest_earlier(doubled(held)), ["g", "p"], "left")
    found = found.groupBy("g").agg(F.collect_list(F.struct("p", "q", "w", "m")).alias("l"), F.max("m").alias("top")).where("top > 0").select("g", "l")
    found = map_columns(found, "g long, gone array<int>, runs array<struct<first: int, last: int>>", maximal)
    return stage(found.join(numbers, "g").select("row", "gone", "runs"), "gone-lines")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: id, text without later copies of repeated runs, n_lines, n_removed, n_runs.

    The first copy stays: smallest id (null last), then place. Rows equal in id and text
    are one document, so both keep or lose the same lines. Null texts count as empty and
    give an empty text; lines without words stay. Lines compare by 128-bit digests. n_runs
    counts the maximal runs that are later copies; repeated_lines has their places.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words).select("row", "gone", F.size("runs").cast("long").alias("runs"))
    src = docs.select(F.col(id_col).cast("long").alias("i"), row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = gone.agg(F.sum(F.size("gone") * 4 + 64)).first()[0] or 0
    out = src.join(checked_broadcast(gone, 1, rows=size), "row", "left").withColumn("l", F.split("t", "\n"))
    kept = F.array_join(F.filter("l", lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept)
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return out.select(F.col("i").alias(id_col), text.alias("text"), F.size("l").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(removed).alias("n_removed"), F.coalesce("runs", F.lit(0).cast("long")).alias("n_runs"))
