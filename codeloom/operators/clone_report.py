"""Clone analysis beyond equal sequences: evidence, verdicts, subgroups, and partly equal blocks.

Bodies are rows (symbol_id, language, relative_path, name, line, end_line, tokens, context) as
sources.parsers.callable_tokens gives them. Groups may be hot: members are compared with the
first one by position, in rows, and never gathered.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.runtime import prepare, stage

#: Token-bearing lines and tokens that a body must have; members and values of a subgroup listing; excerpts.
MIN_LINES, MIN_TOKENS = 6, 40
SUBGROUPS, MEMBERS, VALUES = 8, 10, 3
EXCERPT_LINES, EXCERPT_CHARS = 3, 120
#: Tokens of a window and windows of the partial search at most; what goes beyond is reported.
WINDOW, MAX_WINDOWS = 24, 2_000_000
POLICIES = ("exact", "consistent", "broad")


def _is_name(t: Column) -> Column:
    return t["kind"] == "word"


def normalised(tokens: Column, own: Column, policy: str) -> Column:
    """exact: the texts; broad: names as I, literals as L; consistent: names by first use, the
    body's own name as 0, literals as L. Keywords can't be told from names here and count as names."""
    literal = lambda t: t["kind"].isin("string", "number")
    if policy == "exact":
        return F.transform(tokens, lambda t: t["text"])
    if policy == "broad":
        return F.transform(tokens, lambda t: F.when(_is_name(t), "I").when(literal(t), "L").otherwise(t["text"]))
    if policy != "consistent":
        raise ValueError(f"unknown policy {policy!r}")

    @F.pandas_udf("array<string>")
    def numbered(rows: pd.Series, names: pd.Series) -> pd.Series:
        # in Arrow batches: lookups in a column of arrays or maps are quadratic in a body's names
        out = []
        for body, name in zip(rows, names, strict=True):
            at = {name: 0}
            out.append([f"#{at.setdefault(t['text'], len(at))}" if t["kind"] == "word" else "L" if t["kind"] in ("string", "number") else t["text"] for t in body])
        return pd.Series(out)

    return numbered(tokens, own)


def eligible(bodies: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Bodies with min_tokens tokens on min_lines lines, with n_tokens and n_lines."""
    out = bodies.withColumn("n_tokens", F.size("tokens")).withColumn("n_lines", F.size(F.array_distinct(F.transform("tokens", lambda t: t["line"]))))
    return out.where((F.col("n_tokens") >= min_tokens) & (F.col("n_lines") >= min_lines))


def skipped(candidates: DataFrame, bodies: DataFrame, languages: list[str]) -> DataFrame:
    """(symbol_id, reason) of functions that aren't compared: no token source for the language, no
    body found at the indexed place, several bodies there, or too small."""
    at = bodies.groupBy("symbol_id").agg(F.count("*").alias("n"))
    small = eligible(bodies).select("symbol_id", F.lit(True).alias("ok")).distinct()
    out = candidates.join(at, "symbol_id", "left").join(small, "symbol_id", "left")
    reason = F.when(~F.col("language").isin(*languages), "no_token_source").when(F.col("n").isNull(), "boundary_not_found").when(F.col("n") > 1, "ambiguous_boundary").when(F.col("ok").isNull(), "below_threshold")
    return out.select("symbol_id", reason.alias("reason")).where("reason IS NOT NULL")


def members(bodies: DataFrame, policy: str = "broad", min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(group_id, symbol_id, ...): bodies in groups of two or more with equal language and sequence.

    Groups are named by 256 bits of both; the sequences behind a name are compared through
    the smallest and the largest of them, and a name that stands for several is refined by
    the sequence itself.
    """
    prepare(bodies.sparkSession)
    own = eligible(bodies, min_lines, min_tokens)
    seq = F.array_join(normalised(F.col("tokens"), F.col("name"), policy), "\x1f")
    own = stage(own.withColumn("seq", seq).withColumn("group_id", F.sha2(F.concat_ws("\x1e", "language", "seq"), 256)), "clone-bodies")
    sizes = own.groupBy("group_id").agg(F.count("*").alias("n"), (F.min("seq") != F.max("seq")).alias("mixed")).where("n > 1")
    out = own.join(sizes, "group_id").withColumn("group_id", F.when(F.col("mixed"), F.concat_ws("-", "group_id", F.xxhash64("seq").cast("string"))).otherwise(F.col("group_id")))
    return out.drop("n", "mixed", "seq")


def ranked_groups(found: DataFrame) -> DataFrame:
    """(group_id, members, first, by_lines, by_tokens, call_only): groups of members with their weights:
    the least lines times members, and the tokens that all but one repeat. Groups whose bodies
    are flat calls only come last; else by lines, tokens and the first member's place."""
    words = F.transform("tokens", lambda t: t["text"])
    flow = F.array(*[F.lit(x) for x in ("if", "for", "while", "match", "switch", "=", "return", "yield", "try")])
    flat = ~F.arrays_overlap(F.slice(words, F.greatest(F.array_position(words, ")"), F.lit(1)).cast("int") + 1, F.size(words)), flow)
    at = F.struct("relative_path", "line", "symbol_id")
    g = found.withColumn("flat", flat).groupBy("group_id").agg(
        F.count("*").alias("members"), F.min(at).alias("first"), (F.min("n_lines") * F.count("*")).alias("by_lines"), (F.min("n_tokens") * (F.count("*") - 1)).alias("by_tokens"), F.min("flat").alias("call_only"), F.max("flat").alias("some_flat")
    )
    return g.orderBy("call_only", F.col("by_lines").desc(), F.col("by_tokens").desc(), "first.relative_path", "first.line")


def _positions(found: DataFrame) -> DataFrame:
    """A row for each token of each member, with its role by what stands beside it."""
    beside = lambda i: F.coalesce(F.try_element_at("tokens", i)["text"], F.lit(""))
    rows = found.select("group_id", "symbol_id", "name", "tokens", F.posexplode("tokens").alias("pos", "t"))
    before = F.when(F.col("pos") > 0, beside(F.greatest(F.col("pos"), F.lit(1)))).otherwise("")
    after = beside(F.col("pos") + 2)
    text = F.col("t.text")
    role = (
        F.when(F.col("t.kind") == "string", F.when(text.rlike(r"\$\{|\{\w|\$\w|`"), "interpolated_string").otherwise("literal_value"))
        .when(F.col("t.kind") == "number", "literal_value")
        .when(F.col("t.kind") != "word", "punctuation")
        .when(text == F.col("name"), "declaration")
        .when(before.isin(".", "->", "::") & (after != "("), "member")
        .when((after == "(") & ~before.isin("function", "def", "fn", "func", "fun"), "callee")
        .when(before.isin(":", "new", "->", "<", "extends", "as") | after.isin("::", "<"), "type")
        .otherwise("name")
    )
    return rows.select("group_id", "symbol_id", "pos", text.alias("text"), F.col("t.kind").alias("kind"), role.alias("role"))


def evidence(found: DataFrame) -> DataFrame:
    """(group_id, identifier_pattern, differing, contexts, types_differ): what differs between members.

    Members are aligned with the group's first one token by token. identifier_pattern is
    identical, one_to_one (each name of the first stands for one name of a member and the
    other way round) or not_one_to_one; differing maps kinds of difference to the number of
    positions that show them; a position whose tokens have several roles is mixed_role.
    """
    prepare(found.sparkSession)
    at = stage(_positions(found), "clone-positions")
    first = found.groupBy("group_id").agg(F.min(F.struct("relative_path", "line", "symbol_id")).alias("f")).select("group_id", F.col("f.symbol_id").alias("head"))
    by_place = at.groupBy("group_id", "pos").agg((F.min("text") != F.max("text")).alias("differs"), F.min("role").alias("lo"), F.max("role").alias("hi"), F.min("kind").alias("k1"), F.max("kind").alias("k2"))
    kind = F.when(F.col("k1") != F.col("k2"), "literal_category").when(F.col("lo") != F.col("hi"), "mixed_role").otherwise(F.col("lo"))
    counts = by_place.where("differs").groupBy("group_id", kind.alias("kind")).agg(F.count("*").alias("n"))
    differing = counts.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.col("n").cast("long").alias("n"))))).alias("differing"))
    names = at.where("kind = 'word'")
    heads = names.join(first, "group_id").where("symbol_id = head").select("group_id", "pos", F.col("text").alias("of_head"))
    pairs = names.join(heads, ["group_id", "pos"]).groupBy("group_id", "symbol_id", "of_head", "text").agg(F.count("*").alias("n"))
    ahead = pairs.groupBy("group_id", "symbol_id", "of_head").agg(F.count("*").alias("n")).groupBy("group_id").agg(F.max("n").alias("ahead"))
    back = pairs.groupBy("group_id", "symbol_id", "text").agg(F.count("*").alias("n")).groupBy("group_id").agg(F.max("n").alias("back"))
    same = pairs.groupBy("group_id").agg(F.min(F.col("of_head") == F.col("text")).alias("same"))
    pattern = F.when(F.col("same"), "identical").when((F.col("ahead") <= 1) & (F.col("back") <= 1), "one_to_one").otherwise("not_one_to_one")
    contexts = found.groupBy("group_id").agg(F.countDistinct("context").alias("contexts"))
    out = same.join(ahead, "group_id").join(back, "group_id").join(contexts, "group_id").join(differing, "group_id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return out.select("group_id", pattern.alias("identifier_pattern"), F.coalesce("differing", none).alias("differing"), "contexts")


# Kinds of difference that make a group suspicious, with the reason given, in order.
REASONS = (
    ("mixed_role", "mixed_role_differences"), ("member", "member_names_differ"), ("callee", "callee_names_differ"), ("type", "type_names_differ"),
    ("literal_category", "literal_categories_differ"), ("literal_value", "literal_values_differ"), ("interpolated_string", "interpolated_strings_differ"),
)


def verdicts(found: DataFrame) -> DataFrame:
    """(group_id, verdict, reasons): suspicious with every reason that holds, else real."""
    groups = ranked_groups(found).select("group_id", "call_only", "some_flat")
    e = evidence(found).join(groups, "group_id")
    has = lambda k: F.coalesce(F.element_at("differing", k), F.lit(0)) > 0
    held = [F.when(F.col("identifier_pattern") == "not_one_to_one", "identifier_pattern_differs"), *[F.when(has(k), r) for k, r in REASONS]]
    held += [F.when(F.col("contexts") > 1, "enclosing_context_differs"), F.when(F.col("call_only"), "call_only_bodies"), F.when(~F.col("call_only") & F.col("some_flat"), "call_shape_mixed")]
    bad = F.array_compact(F.array(*held))
    good = F.array(F.when(F.col("identifier_pattern") == "identical", "identical_tokens").otherwise("consistent_renaming"), F.lit("same_context"))
    return e.select("group_id", F.when(F.size(bad) > 0, "suspicious").otherwise("real").alias("verdict"), F.when(F.size(bad) > 0, bad).otherwise(good).alias("reasons"))


def warnings(found: DataFrame, policy: str) -> DataFrame:
    """(group_id, code): what a reader should know about a group before trusting it."""
    e = evidence(found)
    sizes = found.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("relative_path").alias("paths"), F.min("n_lines").alias("lines"), F.max(F.lower("relative_path").rlike(r"(?:^|/)(?:tests?|__tests__)/")).alias("tests"))
    has = lambda k: F.coalesce(F.element_at("differing", k), F.lit(0)) > 0
    codes = [
        F.when(F.col("identifier_pattern") == "not_one_to_one", "names_not_one_to_one"), F.when(has("literal_value"), "literal_values_normalised"), F.when(has("callee"), "different_callees"), F.when(has("type"), "different_types"),
        F.when(has("mixed_role"), "mixed_roles"), F.when(F.col("contexts") > 1, "different_contexts"), F.when(F.col("paths") == 1, "one_file"), F.when(F.col("tests"), "in_tests"),
        F.when(F.col("lines") < 2 * MIN_LINES, "short_bodies"), F.when(F.col("n") > MEMBERS, "many_members"), F.when(F.lit(policy == "broad"), "broad_policy"),
    ]
    return e.join(sizes, "group_id").select("group_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def subgroups(found: DataFrame) -> DataFrame:
    """(group_id, subgroup, members, first, values): members parted by what they have at the positions
    that separate them (callees, members, types and literals that differ); names don't separate.

    A group without such positions is one subgroup. The largest SUBGROUPS of a group are listed.
    """
    prepare(found.sparkSession)
    at = stage(_positions(found), "clone-positions")
    apart = at.groupBy("group_id", "pos").agg((F.min("text") != F.max("text")).alias("differs"), F.max(F.col("role").isin("callee", "member", "type", "literal_value", "interpolated_string")).alias("separates")).where("differs AND separates")
    own = at.join(apart.select("group_id", "pos"), ["group_id", "pos"]).groupBy("group_id", "symbol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("v"))
    every = found.select("group_id", "symbol_id").join(own, ["group_id", "symbol_id"], "left").withColumn("v", F.coalesce("v", F.array().cast("array<string>")))
    parts = every.withColumn("key", F.md5(F.array_join("v", "\x1f"))).groupBy("group_id", "key").agg(F.count("*").alias("members"), F.min("symbol_id").alias("first"), F.slice(F.min("v"), 1, VALUES).alias("values"))
    w = Window.partitionBy("group_id").orderBy(F.col("members").desc(), "first")
    return parts.withColumn("subgroup", F.row_number().over(w)).where(F.col("subgroup") <= SUBGROUPS).select("group_id", "subgroup", "members", "first", "values")


def partial_blocks(bodies: DataFrame, policy: str = "broad", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(symbol_id, line, end_line, of_symbol, of_line, tokens): parts of bodies that repeat an earlier one.

    Windows of normalised tokens meet the first place that has the same window; windows that
    follow each other in step on both sides join into one block, which so can't be
    extended on either side. Windows of a body's own whole copies are left to the groups. The
    first max_windows windows, by file and place, are searched.
    """
    prepare(bodies.sparkSession)
    own = bodies.where(F.size("tokens") >= window).withColumn("seq", normalised(F.col("tokens"), F.col("name"), "exact" if policy == "exact" else "broad"))
    body = F.md5(F.array_join("seq", "\x1f"))
    head = own.withColumn("body", body).groupBy("language", "body").agg(F.min(F.struct("relative_path", "line", "symbol_id")).alias("h")).select("language", "body", F.col("h.symbol_id").alias("head"))
    once = own.withColumn("body", body).join(head, ["language", "body"]).where("symbol_id = head")
    lines = F.transform("tokens", lambda t: t["line"])
    starts = F.sequence(F.lit(1), F.size("seq") - window + 1)
    rows = once.select("language", "relative_path", "symbol_id", "line", "seq", lines.alias("lines"), F.explode(starts).alias("pos"))
    rows = rows.select("language", "relative_path", "symbol_id", "line", "pos", F.get("lines", F.col("pos") - 1).alias("l1"), F.get("lines", F.col("pos") + window - 2).alias("l2"), F.md5(F.array_join(F.slice("seq", F.col("pos"), window), "\x1f")).alias("h"))
    rows = stage(rows.orderBy("relative_path", "line", "symbol_id", "pos").limit(max_windows), "clone-windows")
    first = rows.groupBy("language", "h").agg(F.min(F.struct("relative_path", "line", "symbol_id", "pos", "l1")).alias("f"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(first, ["language", "h"]).where((F.col("f.symbol_id") != F.col("symbol_id")) | (F.col("pos") >= F.col("f.pos") + window))
    # windows in step with one earlier body lie on one diagonal
    step = later.select("symbol_id", "pos", "l1", "l2", F.col("f.symbol_id").alias("of_symbol"), F.col("f.l1").alias("of_line"), (F.col("pos") - F.col("f.pos")).alias("diagonal"))
    w = Window.partitionBy("symbol_id", "of_symbol", "diagonal").orderBy("pos")
    runs = step.withColumn("run", F.col("pos") - F.row_number().over(w))
    blocks = runs.groupBy("symbol_id", "of_symbol", "diagonal", "run").agg(F.min("l1").alias("line"), F.max("l2").alias("end_line"), F.min("of_line").alias("of_line"), (F.count("*") + window - 1).alias("tokens"), F.min("pos").alias("pos"))
    # of blocks that cover each other the longer one stays
    wide = Window.partitionBy("symbol_id").orderBy("pos", F.col("tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("tokens")
    kept = blocks.withColumn("before", F.max(end).over(wide)).where(F.col("before").isNull() | (end > F.col("before")))
    return kept.select("symbol_id", "line", "end_line", "of_symbol", "of_line", "tokens")


def excerpt(source: Column, line: Column, end_line: Column) -> Column:
    """The first lines of a body, cut in number and width."""
    lines = F.slice(F.split(source, "\n"), line, F.least(end_line - line + 1, F.lit(EXCERPT_LINES)))
    return F.transform(lines, lambda x: F.substring(F.rtrim(x), 1, EXCERPT_CHARS))


def reviewed_page(groups: DataFrame, decisions: DataFrame, key: Column, limit: int = 20, offset: int = 0, include_reviewed: bool = False) -> DataFrame:
    """A page (limit 1 to 100) of groups whose key isn't suppressed by decisions(identity, suppressed);
    reviews are applied before paging, so a page is full as long as there are groups."""
    known = decisions.where("suppressed").select(F.col("identity").alias("key")).distinct()
    keyed = groups.withColumn("key", key)
    left = keyed if include_reviewed else keyed.join(known, "key", "left_anti")
    return left.orderBy(F.col("by_lines").desc(), F.col("by_tokens").desc(), "group_id").offset(offset).limit(min(100, max(1, limit)))
