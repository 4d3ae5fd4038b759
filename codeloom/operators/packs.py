"""Responses under a budget of tokens, and context packs around a symbol."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators.dashboard import is_test

# Levels of detail from least to most.
LEVELS = ("overview", "summary", "detailed")
#: Definitions that a pack opens, related symbols that one walk brings in at most, and levels of calls.
DEFINITIONS, RELATED, TEST_DEPTH = 3, 500, 8


@dataclass(frozen=True)
class Evidence:
    """A row that may be shown: a fragment of a file or a fact about a symbol."""

    score: float
    path: str
    start: int
    end: int
    symbol: int
    role: str = ""
    fragment: bool = True
    level: str = "detailed"


def rank_and_dedup(rows: Iterable[Evidence]) -> list[Evidence]:
    """Best score first, to a millionth and not-a-number last, then by path and place; without
    repeats, and without fragments inside a better one of the same symbol and role."""
    score = lambda r: math.inf if math.isnan(r.score) else -round(r.score * 1e6)
    kept: dict[tuple, list[Evidence]] = {}
    out = []
    for r in sorted(rows, key=lambda r: (score(r), not r.fragment, r.path, r.start, -r.end, r.symbol, r.role)):
        own = kept.setdefault((r.symbol, r.fragment, r.path, r.role), [])
        if not any((o.start <= r.start and r.end <= o.end) if r.fragment else (o.start, o.end) == (r.start, r.end) for o in own):
            own.append(r)
            out.append(r)
    return out


def dedup_fragments(df: DataFrame) -> DataFrame:
    """rank_and_dedup over a table (score, path, start, end, symbol, role): fragments that no better
    or equal one of the same symbol, path and role contains. A symbol has few fragments."""
    q = lambda c: F.when(F.isnan(c), F.lit(-(2**62))).otherwise(F.round(F.col(c) * 1e6).cast("long"))
    a = df.withColumn("q", q("score")).distinct()
    b = a.select("symbol", "path", "role", *[F.col(c).alias(f"o_{c}") for c in ("q", "start", "end")])
    inside = (F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end"))
    better = (F.col("o_q") > F.col("q")) | ((F.col("o_q") == F.col("q")) & ((F.col("o_start") < F.col("start")) | ((F.col("o_start") == F.col("start")) & (F.col("o_end") > F.col("end")))))
    out = a.join(b, ["symbol", "path", "role"], "left").groupBy(*a.columns).agg(F.max(F.coalesce(inside & better, F.lit(False))).alias("covered"))
    return out.where("NOT covered").drop("covered", "q")


@dataclass
class Selection:
    rows: list[Evidence]
    total: int
    next_offset: int | None
    dropped: int = 0
    degraded: int = 0
    spent: int = 0
    needed: int | None = None
    over_budget: bool = False


def select(rows: Iterable[Evidence], cost: Callable[[list[Evidence], bool], int], offset: int = 0, limit: int = 50, max_tokens: int | None = None, detail: str = "detailed") -> Selection:
    """A page of ranked rows that costs max_tokens at most.

    cost renders rows (and whether more would follow) and counts its tokens. Over the budget
    the last row gives up its detail level by level, then the one before it; once all are at
    the lowest level, rows go from the end. needed says what one row would cost if none fits.
    """
    every = rank_and_dedup(rows)
    page = [replace(r, level=detail) for r in every[offset : offset + limit]]
    more = lambda n: offset + n < len(every)
    out, spent, over = list(page), 0, False
    if max_tokens is not None:
        states = _cheaper(page)
        spent = cost(out, more(len(out)))
        while spent > max_tokens:
            if (cheaper := next(states, None)) is None:
                over = True
                break
            out = cheaper
            spent = cost(out, more(len(out)))
    needed = cost([replace(page[0], level=LEVELS[0])], more(1)) if page and not out and max_tokens is not None else None
    end = offset + len(out)
    return Selection(out, len(every), end if end < len(every) else None, len(page) - len(out), sum(r.level != detail for r in out), spent, needed, over)


def _cheaper(rows: list[Evidence]):
    """Ever cheaper versions of a page."""
    rows = list(rows)
    for i in reversed(range(len(rows))):
        for level in reversed(LEVELS[: LEVELS.index(rows[i].level)]):
            rows[i] = replace(rows[i], level=level)
            yield list(rows)
    while rows:
        rows.pop()
        yield list(rows)


def context_pack(starts: DataFrame, hits: DataFrame, symbols: DataFrame, files: DataFrame, depth: int = 1, related: int = RELATED) -> DataFrame:
    """(symbol_id, roles, hop, certain): what surrounds the start symbols, each symbol once.

    Walks over resolved relations bring callees, dependencies, callers and references, tests
    among the last two; names that weren't resolved to one symbol bring their smallest
    candidate as uncertain. Roles are united, hop is the least distance.
    """
    sure = hits.where("resolution = 'resolved'").select("from_symbol_id", "target_id", "kind")
    calls = sure.where("kind = 'calls'").select(F.col("from_symbol_id").alias("src"), F.col("target_id").alias("dst"))
    others = sure.where("kind <> 'calls'").select(F.col("from_symbol_id").alias("src"), F.col("target_id").alias("dst"))
    back = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = [starts.select("node", F.lit("definition").alias("role"), F.lit(0).alias("hop"), F.lit(True).alias("certain"))]
    for role, edges in (("callee", calls), ("dependency", others), ("caller", back(calls)), ("reference", back(others))):
        walked = G.walk(edges, starts, depth, budget=related).where("depth > 0").orderBy("depth", "node").limit(related)
        parts.append(walked.select("node", F.lit(role).alias("role"), F.col("depth").alias("hop"), F.lit(True).alias("certain")))
    unsure = hits.where("resolution = 'ambiguous' AND target_id IS NOT NULL").join(starts, F.col("from_symbol_id") == F.col("node"), "left_semi")
    parts.append(unsure.select(F.col("target_id").alias("node"), F.when(F.col("kind") == "calls", "callee").otherwise("dependency").alias("role"), F.lit(1).alias("hop"), F.lit(False).alias("certain")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    at = symbols.select(F.col("symbol_id").alias("node"), "name", "kind", "file_id").join(files.select("file_id", "relative_path"), "file_id")
    named = every.join(at, "node")
    test = F.col("role").isin("caller", "reference") & is_test(F.col("relative_path"), F.col("name")) & (F.col("kind") != "module")
    named = named.withColumn("roles", F.when(test, F.array("role", F.lit("test"))).otherwise(F.array("role")))
    out = named.groupBy(F.col("node").alias("symbol_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("roles"), F.min("hop").alias("hop"), F.max("certain").alias("certain"))
    # a start is its definition and nothing else, whatever leads back to it
    return out.withColumn("roles", F.when(F.array_contains("roles", "definition"), F.array(F.lit("definition"))).otherwise(F.col("roles")))


def pack_scores(pack: DataFrame, order: list[Column]) -> DataFrame:
    """pack with score: definitions 1000 - i, related symbols 500 - j, uncertain ones 100 - k, by their order."""
    from pyspark.sql import Window

    group = F.when(F.array_contains("roles", "definition"), 1000).when(F.col("certain"), 500).otherwise(100)
    head = pack.withColumn("base", group)
    rank = F.row_number().over(Window.partitionBy("base").orderBy("hop", *order)) - 1
    return head.withColumn("score", (F.col("base") - F.least(rank, F.lit(99))).cast("double")).drop("base")


def budget_line(s: Selection, max_tokens: int | None) -> str:
    """What a cut response says about its budget."""
    if max_tokens is None:
        return ""
    parts = [f"Budget: {s.spent} of {max_tokens} tokens"]
    parts += [f"{s.degraded} shown in less detail"] * bool(s.degraded) + [f"{s.dropped} left out"] * bool(s.dropped)
    parts += [f"raise max_tokens to {s.needed}"] * (s.needed is not None) + [f"next offset {s.next_offset}"] * (s.next_offset is not None)
    return "; ".join(parts)
