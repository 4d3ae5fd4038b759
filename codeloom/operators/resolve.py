"""Resolution of relations by evidence, and queries on resolved relations.

A relation names its target. What it can mean depends on its evidence, its caller's file and
its language alone, so relations that agree in those are one question; and definitions that
agree in all that questions look at (name, language, file, kind, parent, visibility) are one
answer with a count and a smallest id. Questions meet answers in an equi-join on name and
language; the number of pairs follows the distinct ones, not relations times homonyms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.runtime import prepare, stage

#: Columns of evidence that a relations table may have, with what their absence means.
EVIDENCE = {
    "qualifier": ("string", None),
    "target_path": ("string", None),
    "target_language": ("string", None),
    "module": ("string", None),
    "target_kind": ("string", None),
    "target_module": ("string", None),
    "join_kind": ("string", None),
    "member": ("boolean", False),
    "not_field": ("boolean", False),
    "top_level": ("boolean", False),
    "external": ("boolean", False),
    "targets_parsed": ("boolean", True),
}
_SYMBOL = {"parent": ("string", None), "end_line": ("long", None), "byte_len": ("long", 0), "file_scoped": ("boolean", False), "col": ("long", 1)}
#: Levels of supertypes that an inherited member is looked for on.
ANCESTORS = 8
#: Supertype links that the driver follows itself, a few MB; beyond it every level is a join.
DRIVER_ROWS = 200_000
_CALLABLE = ("function", "method")
#: What no type extends or implements, in the languages that would otherwise offer it.
_NO_TYPE, _TYPED = ("method", "function", "field", "variable", "constant"), ("csharp", "cpp")


def _filled(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    have = set(df.columns)
    return df.select("*", *[F.lit(v).cast(t).alias(c) for c, (t, v) in columns.items() if c not in have])


def with_evidence(relations: DataFrame) -> DataFrame:
    """Adds the evidence columns that are missing, as unknown or false."""
    return _filled(relations, EVIDENCE)


def targets(symbols: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Definitions with what the predicates ask of them; one row per symbol.

    local: a variable of a function, nested: a function inside another one (both are seen in
    their own file only), shadowed: a module beside a like-named definition, type_modules:
    parents of the type that holds it, modules: names of its file's modules. All come from
    windows and groups of one file.
    """
    s = _filled(symbols, _SYMBOL).join(files.select("file_id", "language", "relative_path"), "file_id")
    inner = Window.partitionBy("file_id", "parent", "name")
    s = s.withColumn("shadowed", (F.col("kind") == "module") & (F.sum((F.col("kind") != "module").cast("int")).over(inner) > 0))
    # an earlier callable that ends later holds a function; on one line columns decide
    one = F.col("line") == F.col("end_line")
    call = s.where(F.col("kind").isin(*_CALLABLE)).select("file_id", "symbol_id", "line", "col", "end_line", "byte_len")
    # rows at one place see only those strictly before it: totals by place first
    places = call.groupBy("file_id", "line", "col").agg(F.max("end_line").alias("end"), F.max(F.when(one, F.col("col") + F.col("byte_len"))).alias("right"))
    ahead = Window.partitionBy("file_id").orderBy("line", "col").rowsBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("file_id", "line").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select("file_id", "line", "col", F.max("end").over(ahead).alias("end_before"), F.max("right").over(beside).alias("right_before"))
    s = s.join(places, ["file_id", "line", "col"], "left")
    nested = (F.col("end_before") > F.col("end_line")) | (one & (F.col("right_before") >= F.col("col") + F.col("byte_len")))
    s = s.withColumn("nested", (F.col("kind") == "function") & F.coalesce(nested, F.lit(False))).drop("end_before", "right_before")
    holders = s.groupBy(F.col("file_id"), F.col("name").alias("parent")).agg(
        F.max(F.col("kind").isin(*_CALLABLE)).alias("by_callable"),
        F.max(~F.col("kind").isin(*_CALLABLE, "variable", "constant", "field")).alias("by_other"),
        F.collect_set(F.col("parent")).alias("type_modules"),
    )
    s = s.join(holders, ["file_id", "parent"], "left")
    s = s.withColumn("local", (F.col("kind") == "variable") & F.coalesce(F.col("by_callable") & ~F.col("by_other"), F.lit(False))).drop("by_callable", "by_other")
    return s.join(_file_modules(s, aliases), "file_id", "left")


def _module_names(s: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(file_id, module): names and aliases of the modules of each file."""
    own = s.where("kind = 'module'").select("file_id", "symbol_id", F.col("name").alias("module"))
    named = own.select("file_id", "module")
    return named if aliases is None else named.unionByName(own.drop("module").join(aliases, "symbol_id").select("file_id", F.col("alias").alias("module"))).distinct()


def _file_modules(s: DataFrame, aliases: DataFrame | None) -> DataFrame:
    return _module_names(s, aliases).groupBy("file_id").agg(F.collect_set("module").alias("modules"))


def supertypes(relations: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(ancestor, language, above): what types name as their supertypes."""
    at = symbols.join(files.select("file_id", "language"), "file_id").select(F.col("symbol_id").alias("from_symbol_id"), F.col("name").alias("ancestor"), "language")
    links = relations.where(F.col("kind").isin("extends", "implements")).select("from_symbol_id", F.col("to_name").alias("above"))
    return links.join(at, "from_symbol_id").select("ancestor", "language", "above").distinct()


def ancestors(up: DataFrame, types: DataFrame) -> DataFrame:
    """(qualifier, language, ancestor, depth): supertypes by name of types (qualifier, language),
    the type itself at 0, at most ANCESTORS levels up, each at its least depth."""
    spark = prepare(up.sparkSession)
    types = stage(types.select("qualifier", "language").distinct(), "asked-types")
    if up.count() <= DRIVER_ROWS and types.count() <= DRIVER_ROWS // 8:
        above: dict[tuple[str, str], list[str]] = {}
        for name, language, higher in up.collect():
            above.setdefault((language, name), []).append(higher)
        rows = []
        for qualifier, language in types.collect():
            depths, level = {qualifier: 0}, [qualifier]
            for depth in range(1, ANCESTORS + 1):
                level = [x for x in {h for n in level for h in above.get((language, n), ())} if x not in depths]
                depths |= dict.fromkeys(level, depth)
            rows += [(qualifier, language, name, depth) for name, depth in depths.items()]
        return spark.createDataFrame(rows, "qualifier string, language string, ancestor string, depth int")
    frontier = stage(types.select("qualifier", "language", F.col("qualifier").alias("ancestor"), F.lit(0).alias("depth")), "ancestors")
    seen = frontier
    for depth in range(1, ANCESTORS + 1):
        reached = frontier.join(up, ["ancestor", "language"]).select("qualifier", "language", F.col("above").alias("ancestor")).distinct()
        frontier = stage(reached.join(seen.select("qualifier", "language", "ancestor"), ["qualifier", "language", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "ancestors")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@dataclass
class Targets:
    """What questions are asked of, made once for a version of the index and stored with it.

    flat: targets() by symbol, answers: the same grouped with n and low, by_alias: modules by
    alias, inside: (qualifier, target_module) whose file declares the module, members:
    (ancestor, language, to_name) that types declare, up: supertypes().
    """

    flat: DataFrame
    answers: DataFrame
    by_alias: DataFrame | None
    inside: DataFrame
    members: DataFrame
    up: DataFrame


def index_targets(relations: DataFrame, symbols: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> Targets:
    prepare(symbols.sparkSession)
    symbols = _filled(symbols, _SYMBOL)
    sets = ("type_modules", "modules")
    defs = targets(symbols, files, aliases)
    flat = stage(defs.select("symbol_id", "line", "col", *[F.array_sort(c).alias(c) if c in sets else F.col(c) for c in _ANSWER]), "targets")
    grouped = lambda df, *more: df.groupBy(*more, *_ANSWER).agg(F.count("*").alias("n"), F.min("symbol_id").alias("low"))
    by_alias = None
    if aliases is not None:
        modules = flat.where("kind = 'module'").join(aliases.select("symbol_id", "alias"), "symbol_id").where("alias <> name")
        by_alias = stage(grouped(modules, "alias"), "targets-by-alias")
    holders = symbols.where(F.col("parent").isNull()).select("file_id", F.col("name").alias("qualifier")).distinct()
    inside = holders.join(_module_names(symbols, aliases), "file_id").select("qualifier", F.col("module").alias("target_module")).distinct()
    members = flat.where(F.col("parent").isNotNull()).select(F.col("parent").alias("ancestor"), "language", F.col("name").alias("to_name")).distinct()
    return Targets(flat, stage(grouped(flat), "target-answers"), by_alias, stage(inside, "targets-inside"), stage(members, "target-members"), stage(supertypes(relations, symbols, files), "supertypes"))


def inherited(questions: DataFrame, index: Targets) -> DataFrame:
    """(qualifier, want, to_name, holder): the nearest supertypes that declare a name which the
    qualifier doesn't declare itself."""
    asked = questions.where(F.col("qualifier").isNotNull()).select("qualifier", F.col("want").alias("language"), "to_name").distinct()
    asked = stage(asked, "asked-members")
    up = ancestors(index.up, asked)
    declared = asked.join(up, ["qualifier", "language"]).join(index.members, ["ancestor", "language", "to_name"])
    nearest = declared.groupBy("qualifier", "language", "to_name").agg(F.min("depth").alias("depth"))
    found = declared.join(nearest.where("depth > 0"), ["qualifier", "language", "to_name", "depth"])
    return found.select("qualifier", F.col("language").alias("want"), "to_name", F.col("ancestor").alias("holder")).distinct()


_ASK = ["kind", "to_name", "qualifier", "target_path", "module", "target_kind", "target_module", "member", "not_field", "top_level"]
_ANSWER = ["name", "language", "file_id", "relative_path", "kind", "parent", "file_scoped", "shadowed", "nested", "local", "type_modules", "modules"]


def _key(*columns: Column) -> Column:
    """128 bits over columns, nulls told apart."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in columns]))


def asked(relations: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Relations that may have a target in the index, with from_file, want (language) and q, the key of their question."""
    callers = symbols.join(files.select("file_id", "language"), "file_id").select(F.col("symbol_id").alias("from_symbol_id"), F.col("file_id").alias("from_file"), F.col("language").alias("from_language"))
    rel = with_evidence(relations).where("NOT external AND targets_parsed").join(callers, "from_symbol_id")
    rel = rel.withColumn("want", F.coalesce("target_language", "from_language"))
    return rel.withColumn("q", _key(*[F.col(c) for c in (*_ASK, "from_file", "want")]))


def matches(rel: DataFrame, index: Targets) -> DataFrame:
    """(q, answer columns, n, low): answers to the distinct questions of rel (see asked).

    The members of an answer are counted in n; low is the smallest symbol id.
    """
    q = stage(rel.select("q", "from_file", "want", *_ASK).distinct(), "questions")
    # the qualifier's own file may declare the wanted module instead of the target's
    q = q.join(index.inside.withColumn("qualifier_inside", F.lit(True)), ["qualifier", "target_module"], "left").withColumn("qualifier_inside", F.coalesce("qualifier_inside", F.lit(False)))
    t = index.answers.select(*[F.col(c).alias(f"t_{c}") for c in _ANSWER], "n", "low")
    same = (F.col("to_name") == F.col("t_name")) & (F.col("want") == F.col("t_language"))
    generic = F.coalesce(F.col("t_parent").startswith(F.concat("qualifier", F.lit("<"))), F.lit(False))
    held = F.col("qualifier").isNull() | F.coalesce(F.col("t_parent") == F.col("qualifier"), F.lit(False)) | generic
    hits = q.join(t, same & held)
    up = inherited(q, index)
    hits = hits.unionByName(q.join(up, ["qualifier", "want", "to_name"]).join(t, same & (F.col("t_parent") == F.col("holder")) & ~generic).drop("holder"))
    if index.by_alias is not None:
        t2 = index.by_alias.select("alias", *[F.col(c).alias(f"t_{c}") for c in _ANSWER], "n", "low")
        modules = q.where("target_kind = 'module' AND target_path IS NULL")
        hits = hits.unionByName(modules.join(t2, (F.col("to_name") == F.col("alias")) & (F.col("want") == F.col("t_language")) & held).drop("alias"))
    path = F.concat(F.lit("/"), F.translate("t_relative_path", "-", "_"))
    own = F.col("t_file_id") == F.col("from_file")
    holds = lambda a, c: F.coalesce(F.array_contains(a, F.col(c)), F.lit(False))
    ok = (
        (F.col("target_path").isNull() | (F.col("target_path") == F.col("t_relative_path")))
        & (F.col("module").isNull() | F.coalesce(F.col("t_parent") == F.col("module"), F.lit(False)) | holds("t_type_modules", "module") | path.contains(F.concat(F.lit("/"), "module", F.lit("/"))) | path.contains(F.concat(F.lit("/"), "module", F.lit("."))))
        & (~F.col("member") | (F.col("t_kind") == "method"))
        & (~F.col("not_field") | (F.col("t_kind") != "field"))
        & (~F.col("top_level") | ~F.col("t_kind").isin("method", "field"))
        & (~F.col("t_file_scoped") | own)
        & (F.col("target_kind").isNull() | (F.col("target_kind") == F.col("t_kind")))
        & (F.col("target_module").isNull() | holds("t_modules", "target_module") | (F.col("qualifier_inside") & ~F.col("t_parent").eqNullSafe(F.col("qualifier"))))
        & ~((F.col("kind") == "calls") & (F.col("t_kind") == "module"))
        & ~(F.col("kind").isin("extends", "implements") & F.col("t_language").isin(*_TYPED) & F.col("t_kind").isin(*_NO_TYPE))
        & (own | ~(F.col("t_local") | F.col("t_nested")))
        & ~(F.col("t_shadowed") & (F.col("kind") != "imports") & F.col("target_kind").isNull())
    )
    return hits.where(ok).select("q", *[F.col(f"t_{c}") for c in _ANSWER], "n", "low")


def candidates(relations: DataFrame, symbols: DataFrame, files: DataFrame, aliases: DataFrame | None = None, universe: DataFrame | None = None, index: Targets | None = None) -> DataFrame:
    """(relation_id, symbol_id, file_id, line, col): every definition each of relations may mean.

    It writes out what relation_hits only counts, so it is for relations filtered before;
    universe is then the table with all of them, which supertypes are read from. index
    saves making one.
    """
    index = index or index_targets(relations if universe is None else universe, symbols, files, aliases)
    rel = asked(relations, symbols, files)
    keys = ["file_id", "name", "kind", "file_scoped", "shadowed", "nested", "local"]
    found = matches(rel, index).select("q", F.col("t_parent").alias("parent"), *[F.col(f"t_{k}").alias(k) for k in keys])
    f, m = found.distinct().alias("f"), index.flat.alias("m")
    same = F.col("f.parent").eqNullSafe(F.col("m.parent"))
    for k in keys:
        same = same & (F.col(f"f.{k}") == F.col(f"m.{k}"))
    pairs = f.join(m, same).select("q", "m.symbol_id", "m.file_id", "m.line", "m.col").distinct()
    return rel.select("relation_id", "q").join(pairs, "q").drop("q")


def relation_hits(relations: DataFrame, symbols: DataFrame, files: DataFrame, aliases: DataFrame | None = None, universe: DataFrame | None = None, index: Targets | None = None) -> DataFrame:
    """Relations with n_candidates, target_id, n_files, target_file, resolution and evidence.

    universe and index as for candidates.
    """
    index = index or index_targets(relations if universe is None else universe, symbols, files, aliases)
    rel = asked(relations, symbols, files)
    found = matches(rel, index)
    each = found.groupBy("q").agg(F.sum("n").alias("n_candidates"), F.min("low").alias("target_id"), F.countDistinct("t_file_id").alias("n_files"), F.min("t_file_id").alias("target_file"))
    known = rel.select("relation_id", "q").join(each, "q").drop("q")
    zero = F.lit(0).cast("long")
    out = with_evidence(relations).join(known, "relation_id", "left").withColumn("n_candidates", F.coalesce("n_candidates", zero)).withColumn("n_files", F.coalesce("n_files", zero))
    declared = F.coalesce("qualifier", "target_path", "module", "target_module").isNotNull()
    one = (F.col("n_candidates") == 1) & ~F.col("member")
    shared = (F.col("join_kind") == "http") & (F.col("n_candidates") > 1)
    resolution = F.when(F.col("external"), "external").when(F.col("n_candidates") == 0, "unresolved").when(shared, "ambiguous").when(one, "resolved").otherwise("ambiguous")
    evidence = (
        F.when(F.col("external"), "syntax")
        .when(F.col("n_candidates") == 0, "none")
        .when(shared, "candidates")
        .when(one, F.when(declared, "declared").otherwise("name"))
        .when(F.col("member"), "receiver")
        .otherwise("candidates")
    )
    return out.withColumn("resolution", resolution).withColumn("evidence", evidence)


def preview(found: DataFrame, files: DataFrame, k: int = 3) -> DataFrame:
    """The first k candidates of each relation by path and line."""
    w = Window.partitionBy("relation_id").orderBy("relative_path", "line", "symbol_id")
    return found.join(files, "file_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def resolved_edges(hits: DataFrame) -> DataFrame:
    """(src, dst) of relations with one proven target."""
    return hits.where(F.col("resolution") == "resolved").select(F.col("from_symbol_id").alias("src"), F.col("target_id").alias("dst"))


def file_imports(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (src_file, dst_file): imports, neither external nor of members, whose candidates
    lie in one file, be they one or several; a file's imports of itself are no edges."""
    callers = symbols.select(F.col("symbol_id").alias("from_symbol_id"), F.col("file_id").alias("src_file"))
    sure = hits.where("kind = 'imports' AND NOT external AND NOT member AND n_files = 1").join(callers, "from_symbol_id")
    return sure.select("src_file", F.col("target_file").alias("dst_file")).where("src_file <> dst_file").distinct()


#: Kinds that a dead-code report may name. Methods are left out: implementations are called through their interface.
DEAD_KINDS = ("function", "class", "struct", "interface", "enum", "trait", "type_alias")
#: Names that a toolchain calls itself.
RUNTIME_NAMES = ("main",)


def dead_symbols(symbols: DataFrame, files: DataFrame, hits: DataFrame, is_test: Column, kinds: tuple[str, ...] = DEAD_KINDS) -> DataFrame:
    """Definitions of kinds that no relation in the index refers to; hits as of relation_hits over all relations.

    A name is told apart by identity if several symbols bear it, one of them of kinds, and
    each relation that names it has exactly one candidate and isn't a member's. Then only the
    meant symbols are in use, a symbol's calls of itself aside. Any other name is in use as a
    whole when something names it, but a call from a like-named sole definition is a
    recursion and doesn't count. is_test is a condition on relative_path and name.
    """
    prepare(hits.sparkSession)
    said = stage(hits.where("NOT external").select("relation_id", "from_symbol_id", "kind", "to_name", "member", "n_candidates", "target_id"), "said")
    names = symbols.groupBy("name").agg(F.count("*").alias("homonyms"), F.max(F.col("kind").isin(*kinds)).alias("wanted"))
    unsure = said.where("member OR n_candidates <> 1").select(F.col("to_name").alias("name")).distinct()
    told = names.where("homonyms > 1 AND wanted").select("name").join(unsure, "name", "left_anti")
    callers = symbols.select(F.col("symbol_id").alias("from_symbol_id"), F.col("name").alias("caller"))
    # once for each name, caller's name and kind of use, so a hot name is no hot key
    uses = said.join(callers, "from_symbol_id").groupBy(F.col("to_name").alias("name"), (F.col("kind") != "calls").alias("plain"), (F.col("caller") == F.col("to_name")).alias("self")).count()
    by_name = uses.join(names, "name").where("plain OR NOT self OR homonyms > 1").select("name").distinct().join(told, "name", "left_anti")
    meant = said.join(told.withColumnRenamed("name", "to_name"), "to_name").where("NOT (kind = 'calls' AND target_id = from_symbol_id)").select(F.col("target_id").alias("symbol_id")).distinct()
    # definitions at one line of a file with one name are one to the report
    at = symbols.select("symbol_id", "file_id", "line", "name")
    meant = meant.join(at, "symbol_id").select("file_id", "line", "name").distinct()
    own = symbols.where(F.col("kind").isin(*kinds) & ~F.col("name").isin(*RUNTIME_NAMES)).join(files.select("file_id", "relative_path"), "file_id").where(~is_test)
    return own.join(by_name, "name", "left_anti").join(meant, ["file_id", "line", "name"], "left_anti")


def possible_entry_points(dead: DataFrame, hints: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(symbol_id, framework, rule, evidence) of hints on dead symbols whose requirement holds: none,
    or the manifest declares the package and its constraint's first number isn't below the least
    major version. A constraint without a number holds."""
    declared = dependencies.select(F.col("manifest_path").alias("requires_manifest"), F.col("name").alias("requires_package"), "version", F.lit(True).alias("declared"))
    rows = hints.join(dead.select("symbol_id"), "symbol_id", "left_semi").join(declared, ["requires_manifest", "requires_package"], "left")
    major = F.regexp_extract("version", r"^[^0-9]*([0-9]+)", 1)
    holds = F.col("requires_package").isNull() | (F.col("declared") & F.when(F.coalesce(major, F.lit("")) == "", True).otherwise(major.cast("long") >= F.col("requires_min_major")))
    return rows.where(F.coalesce(holds, F.lit(False))).select("symbol_id", "framework", "rule", "evidence")
