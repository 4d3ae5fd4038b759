"""The tools over a small tree, indexed, changed and indexed again."""

import pytest
from pyspark.sql import functions as F

from codeloom import engine as E
from codeloom.operators import search

BODY = "    total = 0\n    for item in items:\n        if item > limit:\n            total = total + item * 2\n        else:\n            total = total - item\n    total = total + 1\n    return total\n"
TREE = {
    "src/core.py": "from util import helper\nclass Job:\n    def run(self):\n        return helper(1)\ndef start():\n    return Job()\n",
    "src/util.py": f"# helps a lot\ndef helper(items, limit=3):\n{BODY}def other(items, limit=3):\n{BODY}def unused(x):\n    return 'nothing at all'\n",
    "tests/test_core.py": "from core import start\ndef test_start():\n    start()\n",
    "requirements.txt": "numpy>=1.2\n", "lib/a.go": "package p\nfunc Go1() { Go2() }\nfunc Go2() {}\n", "bad.py": "def (", "docs/readme.md": "# Top\nsee [core](../src/core.py)\n",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root, at = tmp_path_factory.mktemp("tree"), f"file://{tmp_path_factory.mktemp('store')}/i"
    for name, text in TREE.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    summary = E.index_tree(spark, str(root), at).first()
    assert summary.indexed == len(TREE) and summary.issues == 1 and summary.generation == 1
    return root, at


@pytest.fixture(scope="module")
def work(spark, index):
    embed = search.hashed_embedder(16)
    w = E.open_index(spark, index[1], str(index[0]), embed=embed)
    rows = w.symbols.select("symbol_id", "name").collect()
    w.embeddings = spark.createDataFrame([(r.symbol_id, "m", v) for r, v in zip(rows, embed([r.name for r in rows]), strict=True)], "symbol_id long, model string, vector array<float>")
    return w


def names(df, column="name"):
    return [r[column] for r in df.collect()]


def test_lookup_tools(work):
    assert names(work.list_symbols("src/core.py")) == ["core", "Job", "run", "start"]
    assert names(work.list_symbols(kind="class")) == ["Job"] and names(work.list_symbols("src", language="go")) == []
    assert names(work.find_symbol("helper"), "relative_path") == ["src/util.py"] and names(work.find_symbol("elp", "fuzzy")) == ["helper"]
    assert [(r.name, r.signature_line) for r in work.get_file_skeleton("src/core.py").collect()] == [("core", "from util import helper"), ("Job", "class Job:"), ("start", "def start():")]
    assert names(work.get_project_overview("src/util.py", 2))[0] == "helper"
    assert {(r.dir, r.name) for r in work.get_file_tree(2).collect()} >= {("", "src"), ("src", "core.py")}
    one = work.find_symbol("start").first()
    detail = work.symbol_detail(one.symbol_id)
    assert names(detail["references"], "from_name") == ["test_core", "test_start"] and names(detail["related"], "to_name") == ["Job"]
    assert names(work.symbols_by_ids([one.symbol_id, -1])) == ["start"]


def test_search_tools(work):
    assert names(work.search_symbols_like("help")) == ["helper"] and names(work.search_symbols("helper")) == ["helper"]
    assert names(work.hybrid_search_like("start"))[0] == "start" and names(work.semantic_search("unused", 1)) == ["unused"]
    assert names(work.search_literals("nothing AT all")) == ["unused"]


def test_relation_tools(work):
    assert names(work.find_callers("helper"), "from_name") == ["run"]
    assert names(work.find_calls("run"), "to_name") == ["helper"]
    assert sorted(names(work.find_references("start"), "from_name")) == ["test_core", "test_start"]
    assert names(work.find_callers("helper", depth=5), "depth") == [1]
    impact = work.impact_analysis("start")
    assert names(impact["tests"]) == ["test_start"] and len(names(impact["references"], "from_name")) == 2
    relation = work.find_callers("helper").first()
    assert names(work.relation_candidates(relation.relation_id)) == ["helper"]
    edges = {(r.src, r.dst, r.back) for r in work.get_dependency_graph("tests/test_core.py", 3).collect()}
    assert edges == {("tests/test_core.py", "src/core.py", False), ("src/core.py", "src/util.py", False)}
    assert {(r.src, r.dst) for r in work.get_dependency_graph("src", 1).collect()} == set()
    assert '"src/core.py" -> "src/util.py";' in work.export_dependency_graph("src/core.py") and "flowchart LR" in work.export_dependency_graph("src/core.py", form="mermaid")


def test_context_pack(work):
    text, chosen = work.build_context_pack("run")
    assert "src/core.py:3 method run [definition]" in text and "helper [callee]" in text and chosen.total == 2
    small, cut = work.build_context_pack("run", max_tokens=16)
    assert cut.degraded + cut.dropped > 0 and cut.spent <= 16 and "Budget:" in small
    none, empty = work.build_context_pack("run", max_tokens=1)
    assert empty.rows == [] and empty.needed > 1


def test_quality_tools(work, spark):
    assert names(work.find_dead_code()) == ["Go1", "other", "unused"]
    keys = work.find_dead_code("src").select("identity", F.lit(True).alias("suppressed"))
    work.decisions = keys.limit(1)
    assert names(work.find_dead_code()) == ["Go1", "unused"] and len(names(work.find_dead_code(include_reviewed=True))) == 3
    work.decisions = None
    groups = work.find_duplicate_code(policy="consistent").collect()
    assert [(g.members, g.verdict, g.reasons) for g in groups] == [(2, "real", ["consistent_renaming", "same_context"])]


def test_meta_tools(work):
    assert set(E.TOOLS) == {n for many in work.discover_tool_categories().values() for n in many} and len(E.TOOLS) == 24
    assert all(callable(getattr(work, n)) for n in E.TOOLS) and work.get_tool_schema("find_symbol").arguments["name"] == "string"
    got = work.batch([{"tool": "find_symbol", "arguments": {"name": "start"}}, {"tool": "reindex"}, {"tool": "find_symbol"}])
    assert names(got[0]) == ["start"] and isinstance(got[1], ValueError) and isinstance(got[2], TypeError)
    assert work.select_tools("who calls `helper()`?") == [("find_callers", {"function": "helper"})]
    assert work.select_tools("is it safe to remove parse_go_mod in src/x.py")[0] == ("impact_analysis", {"symbol": "parse_go_mod", "path": "src/x.py"})
    assert work.select_tools("zzz")[0][0] == "hybrid_search_like"
    assert work.render(work.find_symbol("start"), "symbols", ["name", "line"]) == "symbols[1]{name,line}:\n  start,5\n"
    assert work.render(work.find_symbol("start"), "symbols", ["name", "line"], "text") == "start  5"


def test_status_and_reindex(work, spark, index):
    root, at = index
    status = work.get_indexing_status()
    assert {r.language: r.files for r in status["languages"].collect()} == {"go": 1, "markdown": 1, "python": 4}
    assert [tuple(r) for r in status["issues"].collect()] == [("syntax_error", 1, "bad.py")]
    assert work.reindex().first()[:3] == (0, len(TREE), 0) and E.store.generation(spark, at) == 1
    (root / "src/core.py").write_text("def start():\n    return 2\n")
    (root / "bad.py").unlink()
    got = E.index_tree(spark, str(root), at, paths=["src/core.py", "bad.py"]).first()
    assert (got.indexed, got.gone, got.issues, got.generation) == (1, 1, 0, 2)
    fresh = E.open_index(spark, at)
    assert names(fresh.list_symbols("src/core.py")) == ["core", "start"] and names(work.list_symbols("src/core.py")) == ["core", "Job", "run", "start"]
    assert E.index_tree(spark, str(root), at, force=True).first().indexed == len(TREE) - 1


def test_query_cache():
    c = E.QueryCache(2)
    c.put(1, "t", {"query": "a", "path": "x"}, "A", [1.0, 0.0])
    assert c.get(1, "t", {"query": "a", "path": "x"}) == "A" and c.get(2, "t", {"query": "a", "path": "x"}) is None
    assert c.get(1, "t", {"query": "b", "path": "x"}, [0.99, 0.05]) == "A" and c.get(1, "t", {"query": "b", "path": "y"}, [1.0, 0.0]) is None
    c.put(1, "t", {"query": "c", "path": "x"}, "C", [0.999, 0.01])
    assert c.get(1, "t", {"query": "b", "path": "x"}, [1.0, 0.005]) is None
    c.put(1, "u", {"query": "d"}, "D")
    assert c.get(1, "t", {"query": "a", "path": "x"}) is None and len(c.rows) == 2
