"""The tools of the engine as methods with arguments, over one snapshot of an index.

Each tool takes plain arguments and returns a DataFrame; render() gives a page of one as a
table or plain text. batch() runs several. A workspace holds the graph tables of a snapshot
and, where given, sources, literals, embeddings and reviews.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import formats
from codeloom.functions import text as T
from codeloom.operators import clone_report, dashboard, depend, lookup, notes, packs, resolve, search
from codeloom.operators import graph as G
from codeloom.runtime import prepare, stage
from codeloom.sources import parsers, store, tree

#: Rows of a page, similar hits at most, answers that the cache holds.
PAGE, TOP_K, CACHE = 50, 100, 256
#: Similarity from which a like question may be answered from the cache, and its lead over the next one.
NEAR, MARGIN = 0.95, 0.02


@dataclass(frozen=True)
class Tool:
    name: str
    category: str
    when: str
    arguments: dict[str, str]
    tags: tuple[str, ...] = ()


def _tool(name: str, category: str, when: str, tags: str, /, **arguments: str) -> Tool:
    return Tool(name, category, when, arguments, tuple(tags.split()))


_SCOPE = {"path": "string?", "language": "string?"}
_PAGED = {"limit": "int?", "offset": "int?"}
# The tools, what they are for and what they take ("?" marks what may be left out).
TOOLS = {
    t.name: t
    for t in (
        _tool("list_symbols", "lookup", "what a file or folder declares", "list symbols file folder", path="string?", kind="string?", language="string?", **_PAGED),
        _tool("find_symbol", "lookup", "where a name is declared", "definition exact prefix fuzzy", name="string", match="string?", **_SCOPE),
        _tool("search_symbols_like", "search", "a name half remembered, ranked", "words partial ranked", query="string", **_SCOPE, **_PAGED),
        _tool("search_symbols", "search", "the older name of search_symbols_like", "words partial ranked", query="string", **_SCOPE, **_PAGED),
        _tool("hybrid_search_like", "search", "code by meaning and name, or an exact phrase in quotes", "meaning semantic phrase", query="string", alpha="float?", **_SCOPE, **_PAGED),
        _tool("hybrid_search", "search", "the older name of hybrid_search_like", "meaning semantic phrase", query="string", alpha="float?", **_SCOPE, **_PAGED),
        _tool("semantic_search", "search", "code by meaning only", "meaning similarity", query="string", top_k="int?", **_SCOPE),
        _tool("find_references", "relations", "all that refers to a name", "references imports broad", symbol="string", depth="int?", **_SCOPE, **_PAGED),
        _tool("find_calls", "relations", "what a function calls", "callees outgoing", function="string", depth="int?", **_SCOPE, **_PAGED),
        _tool("find_callers", "relations", "what calls a function", "callers incoming", function="string", depth="int?", **_SCOPE, **_PAGED),
        _tool("impact_analysis", "relations", "what a change of a symbol may break", "impact tests blast", symbol="string", depth="int?", **_SCOPE),
        _tool("build_context_pack", "relations", "all that is needed to work on a symbol", "context pack", symbol="string", depth="int?", max_tokens="int?", **_SCOPE),
        _tool("reindex", "index", "to bring the index up to date now", "refresh update", force="bool?"),
        _tool("get_indexing_status", "index", "what the index holds and what failed", "status health"),
        _tool("get_file_skeleton", "lookup", "the outline of a file", "outline skeleton", path="string"),
        _tool("get_project_overview", "lookup", "a first look at a project", "overview digest", path="string?", k="int?"),
        _tool("get_file_tree", "lookup", "the folders of a project", "tree folders", depth="int?"),
        _tool("find_dead_code", "quality", "what nothing refers to", "dead unused", include_reviewed="bool?", **_SCOPE, **_PAGED),
        _tool("find_duplicate_code", "quality", "code that repeats", "duplicate clone copy", policy="string?", include_reviewed="bool?", **_SCOPE, **_PAGED),
        _tool("get_dependency_graph", "relations", "what a module imports", "imports cycles graph", path="string", depth="int?"),
        _tool("batch", "meta", "several tools at once", "several", calls="list"),
        _tool("discover_tool_categories", "meta", "what kinds of tools there are", "help"),
        _tool("get_tool_schema", "meta", "what a tool takes", "help schema", name="string"),
        _tool("select_tools", "meta", "which tools a task needs", "help choose", task="string"),
    )
}
# Tasks by words that speak for them, and the tools they need; the first that fits best wins.
TASKS = (
    ("who calls|callers|called by|call sites", ("find_callers",)), ("what does .* call|callees|calls made", ("find_calls",)), ("impact|break|blast|affect|safe to (?:change|remove|delete)|refactor|rename", ("impact_analysis",)),
    ("references|usages|used|uses of", ("find_references",)), ("dead|unused|unreferenced", ("find_dead_code",)), ("duplicat|clone|copy|copies|repeated", ("find_duplicate_code",)),
    ("import|depend|cycle|module graph", ("get_dependency_graph",)), ("outline|skeleton|structure of (?:the )?file", ("get_file_skeleton",)), ("overview|orient|get started|new to", ("get_project_overview", "get_file_tree")),
    ("folder|director|file tree|layout", ("get_file_tree",)), ("status|health|index(?:ed|ing)?|failed to parse", ("get_indexing_status",)), ("refresh|reindex|stale|update the index", ("reindex",)),
    ("context|before working|understand", ("build_context_pack",)), ("defined|definition|declared|where is", ("find_symbol",)), ("list|all symbols", ("list_symbols",)),
    ("similar|meaning|semantic|about|how (?:do|does|is)", ("hybrid_search_like",)), ("search|find|look ?up|name", ("search_symbols_like",)),
)


@dataclass
class Workspace:
    """A snapshot of an index and its tools."""

    spark: SparkSession
    files: DataFrame
    symbols: DataFrame
    relations: DataFrame
    aliases: DataFrame | None = None
    sources: DataFrame | None = None  # file_id, text, content_hash, indexed_hash
    literals: DataFrame | None = None
    issues: DataFrame | None = None
    dependencies: DataFrame | None = None
    entry_points: DataFrame | None = None
    embeddings: DataFrame | None = None  # symbol_id, model, vector
    decisions: DataFrame | None = None  # identity, suppressed
    embed: Callable[[list[str]], list[list[float]]] | None = None
    refresh: Callable[[bool], DataFrame] | None = None
    generation: int = 1
    _hits: DataFrame | None = field(default=None, repr=False)
    _targets: resolve.Targets | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        prepare(self.spark)
        keep = [c for c in ("col", "end_line", "parent") if c not in self.symbols.columns]
        self.symbols = self.symbols.select("*", *[F.lit(None if c != "col" else 1).cast("string" if c == "parent" else "long").alias(c) for c in keep])
        self.cache = QueryCache()

    # ---- shared parts

    @property
    def located(self) -> DataFrame:
        return self.symbols.join(self.files.select("file_id", "relative_path", "language"), "file_id")

    def hits(self) -> DataFrame:
        """All relations with what they resolve to, worked out once for a snapshot."""
        if self._hits is None:
            self._hits = stage(resolve.relation_hits(self.relations, self.symbols, self.files, self.aliases, index=self.targets()), "workspace-hits")
        return self._hits

    def targets(self) -> resolve.Targets:
        if self._targets is None:
            self._targets = resolve.index_targets(self.relations, self.symbols, self.files, self.aliases)
        return self._targets

    def scoped(self, df: DataFrame, path: str | None, language: str | None) -> DataFrame:
        scope = lookup.normalise_scope(path)
        is_file = lookup.is_file_scope(scope, self.files) if scope and scope.strip() else None
        return df.where(lookup.in_scope(F.col("relative_path"), path, is_file, F.col("language"), language))

    def _starts(self, name: str, path: str | None, language: str | None) -> DataFrame:
        return self.scoped(self.located, path, language).where(F.col("name") == name).select(F.col("symbol_id").alias("node"))

    def _shown(self, hits: DataFrame) -> DataFrame:
        """Hits with the place and name of their caller."""
        caller = self.located.select(F.col("symbol_id").alias("from_symbol_id"), F.col("name").alias("from_name"), "relative_path", "language")
        return hits.join(caller, "from_symbol_id")

    def _page(self, df: DataFrame, order: list, limit: int | None, offset: int | None) -> DataFrame:
        return df.orderBy(*order).offset(offset or 0).limit(min(1_000, max(1, limit or PAGE)))

    # ---- lookup

    def list_symbols(self, path: str | None = None, kind: str | None = None, language: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """Declarations below a path, by path and line; without one all but those in dot folders."""
        df = self.scoped(self.located, path, language) if path is not None else self.located.where(~F.col("relative_path").startswith("."))
        df = df.where(F.col("language") == language) if path is None and language else df
        return self._page(df.where(F.col("kind") == kind) if kind else df, ["relative_path", "line", "col", "symbol_id"], limit, offset)

    def symbols_in_files(self, paths: list[str]) -> DataFrame:
        return self.located.where(F.col("relative_path").isin(*paths)).orderBy("relative_path", "line", "symbol_id")

    def symbols_by_ids(self, ids: list[int]) -> DataFrame:
        """Symbols by id; unknown ids are passed over."""
        return self.located.where(F.col("symbol_id").isin(*ids)).orderBy("symbol_id")

    def find_symbol(self, name: str, match: str = "exact", path: str | None = None, language: str | None = None) -> DataFrame:
        return lookup.find_symbol(self.scoped(self.located, path, language), name, match).orderBy("relative_path", "line", "symbol_id")

    def symbol_detail(self, symbol_id: int) -> dict[str, DataFrame]:
        """A symbol with its first references and what it relates to."""
        own = self.symbols_by_ids([symbol_id])
        near = self.hits().where((F.col("from_symbol_id") == symbol_id) | ((F.col("target_id") == symbol_id) & (F.col("resolution") == "resolved")))
        references = self._shown(near.where(F.col("target_id") == symbol_id)).orderBy("relative_path", "line", "relation_id").limit(notes.DETAIL_REFERENCES)
        related = near.where(F.col("from_symbol_id") == symbol_id).select("to_name", "kind", "resolution").distinct().orderBy("to_name", "kind").limit(notes.DETAIL_RELATED)
        return {"symbol": own, "references": references, "related": related}

    def get_file_skeleton(self, path: str) -> DataFrame:
        """A file's top-level declarations with their first line, where the source still is the indexed one."""
        own = lookup.skeleton(self.symbols_in_files([path]).drop("language"))
        if self.sources is not None:
            own = own.join(notes.snippets(own, self.sources, 1).select("symbol_id", "signature_line"), "symbol_id", "left")
        return own.orderBy("line", "symbol_id")

    def get_project_overview(self, path: str | None = None, k: int = 8) -> DataFrame:
        """The most called top-level declarations of each file."""
        fan = self.relations.where("kind = 'calls'").groupBy(F.col("to_name").alias("name")).agg(F.count("*").alias("fan_in"))
        return depend.top_k_per_file(lookup.skeleton(self.scoped(self.located, path, None)), fan, k).orderBy("relative_path", "rank")

    def get_file_tree(self, depth: int = 3) -> DataFrame:
        return lookup.file_tree(self.files, depth).orderBy("dir", F.col("is_dir").desc(), "name")

    # ---- search

    def search_symbols_like(self, query: str, path: str | None = None, language: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return self._page(search.search_symbols(self.scoped(self.located, path, language), query), search.ORDER, limit, offset)

    search_symbols = search_symbols_like

    def hybrid_search_like(self, query: str, alpha: float | None = None, path: str | None = None, language: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """Names and similarity fused; without embeddings by name only."""
        vector = self.embed([query])[0] if self.embed and self.embeddings is not None else None
        hits = search.hybrid_search(self.scoped(self.located, path, language), query, self.embeddings, vector, alpha)
        return self._page(hits, [F.col("exact").desc(), F.col("score").desc(), "relative_path", "line", "symbol_id"], limit, offset)

    hybrid_search = hybrid_search_like

    def semantic_search(self, query: str, top_k: int = 10, path: str | None = None, language: str | None = None) -> DataFrame:
        if self.embed is None or self.embeddings is None:
            raise ValueError("no embedding model")
        return search.semantic_ranking(self.scoped(self.located, path, language), self.embeddings, self.embed([query])[0], min(TOP_K, max(1, top_k)))

    def search_literals(self, phrase: str, path: str | None = None, language: str | None = None) -> DataFrame:
        """Literals that hold a phrase, with the symbol around each, if any."""
        if self.literals is None:
            raise ValueError("no literals")
        rows = self.literals.join(self.files.select("file_id", "relative_path", "language"), "file_id").join(self.symbols.select("symbol_id", "name", "kind"), "symbol_id", "left")
        return search.search_literals(self.scoped(rows, path, language), "literal_id", "text", phrase, ["relative_path", "line"])

    # ---- relations

    def _walk(self, name: str, kinds: str, back: bool, depth: int, path: str | None, language: str | None) -> DataFrame:
        """Relations hop by hop: at depth 1 by name (proven homonyms elsewhere aside), then over resolved ones."""
        starts, hits = self._starts(name, path, language), self.hits().where(kinds)
        if not back:
            first = hits.join(starts.withColumnRenamed("node", "from_symbol_id"), "from_symbol_id", "left_semi")
        else:
            first = hits.where(F.col("to_name") == name)
            first = depend.outside_scope(first, starts) if path or language else first
        first = stage(first.withColumn("depth", F.lit(1)), "walk-hits")
        out = first
        edges = hits.where("resolution = 'resolved'")
        for level in range(2, min(max(depth, 1), G.MAX_DEPTH) + 1):
            reached = out.where(F.col("depth") == level - 1)
            reached = reached.select(F.col("from_symbol_id").alias("node")) if back else reached.where("resolution = 'resolved'").select(F.col("target_id").alias("node"))
            key = "target_id" if back else "from_symbol_id"
            more = edges.join(reached.distinct(), F.col(key) == F.col("node"), "left_semi").join(out.select("relation_id"), "relation_id", "left_anti")
            more = stage(more.withColumn("depth", F.lit(level)), "walk-hits")
            if more.isEmpty():
                break
            out = out.unionByName(more)
        return self._shown(out)

    def _relations(self, name: str, kinds: str, back: bool, depth: int | None, path, language, limit, offset) -> DataFrame:
        return self._page(self._walk(name, kinds, back, depth or 1, path, language), ["depth", "relative_path", "line", "col", "relation_id"], limit, offset)

    def find_references(self, symbol: str, depth: int | None = None, path: str | None = None, language: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return self._relations(symbol, "true", True, depth, path, language, limit, offset)

    def find_callers(self, function: str, depth: int | None = None, path: str | None = None, language: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return self._relations(function, "kind = 'calls'", True, depth, path, language, limit, offset)

    def find_calls(self, function: str, depth: int | None = None, path: str | None = None, language: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return self._relations(function, "kind = 'calls'", False, depth, path, language, limit, offset)

    def find_dependencies(self, symbol: str, path: str | None = None, language: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return self._relations(symbol, "kind <> 'calls'", False, 1, path, language, limit, offset)

    def relation_candidates(self, relation_id: int) -> DataFrame:
        """All that one relation may mean, by path and line."""
        found = resolve.candidates(self.relations.where(F.col("relation_id") == relation_id), self.symbols, self.files, self.aliases, self.relations, self.targets())
        return found.join(self.located.select("symbol_id", "name", "kind", "relative_path"), "symbol_id").orderBy("relative_path", "line", "symbol_id")

    def impact_analysis(self, symbol: str, depth: int | None = None, path: str | None = None, language: str | None = None, limit: int | None = None, offset: int | None = None) -> dict[str, DataFrame]:
        """Pages of callers, references and tests that may be affected, each on its own."""
        walked = self._walk(symbol, "true", True, depth or packs.TEST_DEPTH, path, language)
        first = walked.groupBy("from_symbol_id").agg(F.min("depth").alias("depth")).withColumnRenamed("from_symbol_id", "node")
        tests = dashboard.affected_tests(first, self.symbols, self.files)
        return {
            "callers": self.find_callers(symbol, 1, path, language, limit, offset),
            "references": self.find_references(symbol, 1, path, language, limit, offset),
            "tests": self._page(tests, ["depth", "relative_path", "line", "symbol_id"], limit, offset),
        }

    def build_context_pack(self, symbol: str, depth: int = 1, max_tokens: int | None = None, path: str | None = None, language: str | None = None, limit: int = PAGE) -> tuple[str, packs.Selection]:
        """(text, selection): definitions with source, then what is around them, within a budget of tokens."""
        starts = self._starts(symbol, path, language).orderBy("node").limit(packs.DEFINITIONS)
        pack = packs.context_pack(starts, self.hits(), self.symbols, self.files, depth)
        rows = packs.pack_scores(pack.join(self.located, "symbol_id"), [F.col("relative_path"), F.col("line"), F.col("symbol_id")])
        lines = notes.snippets(self.symbols, self.sources, 40) if self.sources is not None else self.symbols.select("symbol_id", F.lit(None).cast("string").alias("signature_line"), F.lit(None).cast("array<string>").alias("snippet"))
        held = rows.join(lines, "symbol_id", "left").orderBy(F.col("score").desc()).limit(packs.RELATED).collect()
        known = {r["symbol_id"]: r for r in held}
        rows = [packs.Evidence(r["score"], r["relative_path"], int(r["line"]), int(r["end_line"] or r["line"]), r["symbol_id"], ",".join(r["roles"])) for r in held]

        def text(shown: list[packs.Evidence], more: bool) -> str:
            out = []
            for e in shown:
                r = known[e.symbol]
                out.append(f"{e.path}:{e.start} {r['kind']} {r['name']} [{e.role}]{'' if r['certain'] else ' uncertain'}")
                if e.level != "overview" and r["signature_line"]:
                    out.append("  " + r["signature_line"])
                if e.level == "detailed" and "definition" in e.role and r["snippet"]:
                    out += ["  " + x for x in r["snippet"][1:]]
            return "\n".join(out + ["more follows"] * more)

        chosen = packs.select(rows, lambda s, m: formats.count_tokens(text(s, m)), limit=limit, max_tokens=max_tokens)
        body = text(chosen.rows, chosen.next_offset is not None)
        return "\n".join(filter(None, (body, packs.budget_line(chosen, max_tokens)))), chosen

    def get_dependency_graph(self, path: str, depth: int = 1) -> DataFrame:
        imports = resolve.file_imports(self.hits(), self.symbols)
        scope = lookup.normalise_scope(path) or ""
        return depend.dependency_graph(imports, self.files, scope, depth, lookup.is_file_scope(scope, self.files))

    def export_dependency_graph(self, path: str, depth: int = 1, form: str = "dot") -> str:
        rows = self.get_dependency_graph(path, depth).collect()
        cyclic = {(r["src"], r["dst"]) for r in rows if r["back"]}
        write = {"dot": formats.dot, "mermaid": formats.mermaid}
        return write[form]([(r["src"], r["dst"]) for r in rows], cyclic)

    # ---- quality

    def find_dead_code(self, path: str | None = None, language: str | None = None, include_reviewed: bool = False, limit: int | None = None, offset: int | None = None) -> DataFrame:
        dead = resolve.dead_symbols(self.symbols, self.files, self.hits(), dashboard.is_test(F.col("relative_path"), F.col("name")))
        dead = dead.join(self.files.select("file_id", "language"), "file_id")
        dead = self.scoped(dead, path, language).withColumn("identity", dashboard.finding_key(F.lit("dead_code"), F.col("language"), F.col("relative_path"), F.col("kind"), F.col("parent"), F.col("name")))
        if self.decisions is not None and not include_reviewed:
            dead = dead.join(self.decisions.where("suppressed").select("identity"), "identity", "left_anti")
        page = self._page(dead, ["relative_path", "line", "symbol_id"], limit, offset)
        if self.entry_points is None or self.dependencies is None:
            return page
        hints = resolve.possible_entry_points(page, self.entry_points, self.dependencies).groupBy("symbol_id").agg(F.array_sort(F.collect_set(F.concat_ws(": ", "framework", "rule"))).alias("entry_points"))
        return page.join(hints, "symbol_id", "left").orderBy("relative_path", "line", "symbol_id")

    def find_duplicate_code(self, path: str | None = None, language: str | None = None, policy: str = "consistent", include_reviewed: bool = False, limit: int | None = None, offset: int | None = None) -> DataFrame:
        if self.sources is None:
            raise ValueError("no sources")
        full = self.files.join(self.sources.select("file_id", "text"), "file_id")
        bodies = parsers.callable_tokens(full, self.scoped(self.located, path, language).select("symbol_id", "file_id", "name", "kind", "parent", "line", "end_line"))
        found = stage(clone_report.members(bodies, policy), "clone-members")
        groups = clone_report.ranked_groups(found).join(clone_report.verdicts(found), "group_id")
        none = self.spark.createDataFrame([], "identity string, suppressed boolean")
        return clone_report.reviewed_page(groups, self.decisions if self.decisions is not None else none, dashboard.finding_key(F.lit("duplicate"), F.col("group_id")), limit or 20, offset or 0, include_reviewed)

    # ---- index

    def reindex(self, force: bool = False) -> DataFrame:
        if self.refresh is None:
            raise ValueError("this snapshot has no source tree")
        return self.refresh(force)

    def get_indexing_status(self) -> dict[str, DataFrame]:
        """Counts by language, issues by kind, dependencies by manifest, and embeddings by model."""
        counts = self.files.join(self.symbols.select("file_id", "symbol_id"), "file_id", "left").groupBy("language").agg(F.countDistinct("file_id").alias("files"), F.count("symbol_id").alias("symbols"))
        out = {"languages": counts.withColumn("generation", F.lit(self.generation)).orderBy("language")}
        if self.issues is not None:
            out["issues"] = self.issues.groupBy("issue_kind").agg(F.count("*").alias("n"), F.min("relative_path").alias("first")).orderBy("issue_kind")
        if self.dependencies is not None:
            out["dependencies"] = self.dependencies.groupBy("manifest_path").agg(F.count("*").alias("n")).orderBy("manifest_path")
        if self.embeddings is not None:
            out["embeddings"] = self.embeddings.groupBy("model").agg(F.countDistinct("symbol_id").alias("n"))
        return out

    # ---- meta

    def batch(self, calls: list[dict]) -> list[object]:
        """Runs calls ({tool, arguments}) in order; a failing one gives its error. reindex and batch are refused."""
        out: list[object] = []
        for call in calls:
            name = call.get("tool", "")
            try:
                if name not in TOOLS or name in ("batch", "reindex"):
                    raise ValueError(f"{name!r} can't run in a batch")
                out.append(getattr(self, name)(**call.get("arguments", {})))
            except Exception as e:
                out.append(e)
        return out

    def discover_tool_categories(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for t in TOOLS.values():
            out.setdefault(t.category, []).append(t.name)
        return out

    def get_tool_schema(self, name: str) -> Tool:
        return TOOLS[name]

    def select_tools(self, task: str, floor: float = 0.6) -> list[tuple[str, dict[str, str]]]:
        """Tools for a task, with arguments read from it: by rules, else by similarity of their descriptions."""
        low = task.lower()
        found = [tools for pattern, tools in TASKS if re.search(rf"\b(?:{pattern})", low)]
        if found:
            return [(t, argument_hints(t, task)) for t in found[0]]
        if self.embed is not None:
            names = list(TOOLS)
            vectors = self.embed([task, *[f"{TOOLS[n].when} {' '.join(TOOLS[n].tags)}" for n in names]])
            scores = [(sum(a * b for a, b in zip(vectors[0], v, strict=True)), n) for n, v in zip(names, vectors[1:], strict=True)]
            best = max(scores)
            if best[0] >= floor:
                return [(best[1], argument_hints(best[1], task))]
        return [("hybrid_search_like", {"query": task})]

    def render(self, df: DataFrame, name: str, columns: list[str], form: str = "toon") -> str:
        """A page as a table or as plain lines."""
        rows = [tuple(r) for r in df.select(*columns).collect()]
        if form not in ("toon", "text"):
            raise ValueError(f"format must be toon or text, not {form!r}")
        return formats.encode_table(name, columns, rows) if form == "toon" else "\n".join("  ".join("" if v is None else str(v) for v in r) for r in rows)


def argument_hints(tool: str, task: str) -> dict[str, str]:
    """Arguments that a task names: code in backquotes or code-like words as the name, paths as the path."""
    quoted = re.findall(r"`([^`]+)`", task)
    words = [w.strip(".,;:!?()'\"") for w in task.split()]
    paths = [w for w in [*quoted, *words] if "/" in w or re.fullmatch(r"[\w-]+\.[a-z]{1,4}", w)]
    names = [w for w in [*quoted, *words] if w not in paths and (w in quoted or search.looks_like_code(w))]
    takes, out = TOOLS[tool].arguments, {}
    for key in ("symbol", "function", "name"):
        if key in takes and names:
            out[key] = re.sub(r"\(\)$", "", names[0])
    if "query" in takes:
        out["query"] = names[0] if names else task
    if "path" in takes and paths:
        out["path"] = paths[0]
    return out


class QueryCache:
    """Answers by an exact key, or by a like question that is near enough and clearly the nearest.

    A key holds the generation, so a new snapshot never sees older answers; the least recently
    used answer goes first.
    """

    def __init__(self, size: int = CACHE):
        self.size, self.rows = size, OrderedDict()

    @staticmethod
    def key(generation: int, tool: str, arguments: dict) -> str:
        return hashlib.sha256(json.dumps([generation, tool, arguments], sort_keys=True, default=str).encode()).hexdigest()

    def put(self, generation: int, tool: str, arguments: dict, answer: object, vector: list[float] | None = None) -> None:
        k = self.key(generation, tool, arguments)
        rest = {a: v for a, v in arguments.items() if a != "query"}
        self.rows[k] = (generation, tool, json.dumps(rest, sort_keys=True, default=str), vector, answer)
        self.rows.move_to_end(k)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)

    def get(self, generation: int, tool: str, arguments: dict, vector: list[float] | None = None) -> object | None:
        k = self.key(generation, tool, arguments)
        if k in self.rows:
            self.rows.move_to_end(k)
            return self.rows[k][4]
        if vector is None:
            return None
        rest = json.dumps({a: v for a, v in arguments.items() if a != "query"}, sort_keys=True, default=str)
        size = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
        near = sorted(((sum(a * b for a, b in zip(vector, v, strict=True)) / size(vector) / size(v), k) for k, (g, t, r, v, _) in self.rows.items() if v is not None and (g, t, r) == (generation, tool, rest)), reverse=True)
        if near and near[0][0] >= NEAR and (len(near) < 2 or near[0][0] - near[1][0] >= MARGIN):
            self.rows.move_to_end(near[0][1])
            return self.rows[near[0][1]][4]
        return None


def index_tree(spark: SparkSession, root: str, at: str, rules: list[str] | None = None, force: bool = False, paths: list[str] | None = None) -> DataFrame:
    """Indexes a source tree into the store at a folder and publishes it; returns a summary (indexed,
    skipped, gone, issues, generation).

    Files whose hash is stored are skipped unless forced. With paths only those are looked at.
    Unread files keep their last rows. If nothing changed, nothing is published.
    """
    prepare(spark)
    now = store.generation(spark, at)
    old = {n: store.snapshot(spark, at, n) for n in ("sources", "parsed", "issues", "dependencies")} if now else None
    if paths is None:
        scanned, gone_paths = tree.scan_tree(spark, root, rules), []
    else:
        scanned, gone_paths = tree.scan_paths(spark, root, paths, rules)
    read = stage(tree.decoded(scanned).select("relative_path", "modified", "content_hash", "text", "issue", "issue_line"), "read")
    stored = old["sources"] if old else read.limit(0).select("relative_path", "content_hash", "text")
    changed = stage(tree.changed_files(read, stored, force), "changed")
    if paths is None:
        gone = tree.missing_files(stored, read).select("relative_path")
    else:
        below = F.lit(False)
        for p in gone_paths:
            below = below | (F.col("relative_path") == p) | F.startswith("relative_path", F.lit(p + "/"))
        gone = stored.where(below).select("relative_path")
    gone = stage(gone, "gone")
    n_changed, n_gone, n_read = changed.count(), gone.count(), read.count()
    if n_changed or n_gone or not now:
        touched = changed.select("relative_path").unionByName(gone)
        parsed = stage(parsers.parse_files(changed), "parsed")
        sources = changed.where("text IS NOT NULL").select("relative_path", "content_hash", "text")
        bad = changed.where("issue IS NOT NULL").select("relative_path", F.col("issue").alias("issue_kind"), F.concat(F.lit("line "), F.col("issue_line").cast("string")).alias("detail"))
        issues = bad.unionByName(parsers.graph_tables(parsed).issues)
        packages = tree.dependencies(changed.where("text IS NOT NULL")).select("manifest_path", "language", "name", "version", "issue")
        if old:
            sources, parsed = tree.upsert(old["sources"], sources, touched), tree.upsert(old["parsed"], parsed, touched)
            issues = tree.merge_issues(old["issues"], issues, touched)
            packages = tree.upsert(old["dependencies"], packages, touched.withColumnRenamed("relative_path", "manifest_path"), "manifest_path")
        now = store.publish(spark, at, {"sources": sources, "parsed": parsed, "issues": issues, "dependencies": packages}, now)
    n_issues = store.snapshot(spark, at, "issues").count()
    return spark.createDataFrame([(n_changed, n_read - n_changed, n_gone, n_issues, now)], "indexed long, skipped long, gone long, issues long, generation int")


def open_index(spark: SparkSession, at: str, root: str | None = None, rules: list[str] | None = None, version: int | None = None, **more) -> Workspace:
    """The workspace of a published version; every table is of that one."""
    version = store.generation(spark, at) if version is None else version
    tables = {n: store.snapshot(spark, at, n, version) for n in ("sources", "parsed", "issues", "dependencies")}
    g = parsers.graph_tables(tables["parsed"])
    sources = tables["sources"].select(F.xxhash64("relative_path").alias("file_id"), "text", "content_hash", T.git_blob_hash(F.col("text")).alias("indexed_hash"))
    refresh = (lambda force: index_tree(spark, root, at, rules, force)) if root else None
    return Workspace(spark, g.files, g.symbols, g.relations, sources=sources, literals=g.literals, issues=tables["issues"], dependencies=tables["dependencies"].where("name IS NOT NULL"), refresh=refresh, generation=version, **more)


__all__ = ["TOOLS", "QueryCache", "Tool", "Workspace", "argument_hints", "index_tree", "open_index"]
