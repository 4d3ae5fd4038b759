"""Source trees, manifests, versions, change streams and dashboard operators on small tables."""

import time

import pytest
from pyspark.sql import functions as F

from codeloom.operators import dashboard
from codeloom.sources import store, tree
from codeloom.streaming import changes


def test_scan_rules_and_decoding(spark, tmp_path):
    for name, data in {"src/a.py": b"hello\n", "k/.env": b"x", "k/id.pem": b"x", "vendor/v.py": b"x", "src/b.log": b"x", "src/keep.log": b"x", ".git/c": b"x", "bin/z": b"a\0\xff", "bad.txt": b"\xff\xfe", "big.txt": b"y" * 100}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.relative_path: r for r in tree.decoded(tree.scan_tree(spark, str(tmp_path), ["*.log", "!keep.log", "# note"], max_bytes=50)).collect()}
    assert sorted(got) == ["bad.txt", "bin/z", "src/a.py", "src/keep.log"]
    files, gone = tree.scan_paths(spark, str(tmp_path), ["src", "nope", "../x", "bad.txt"], ["*.log"])
    assert sorted(r.relative_path for r in files.collect()) == ["bad.txt", "src/a.py"] and gone == ["../x", "nope"]
    assert got["src/a.py"].content_hash == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert [(got[p].text, got[p].issue) for p in ("src/a.py", "bin/z", "bad.txt")] == [("hello\n", None), (None, None), (None, "syntax_error")]
    assert got["bad.txt"].issue_line == 1


@pytest.mark.parametrize(
    ("rule", "yes", "no"),
    [("*.log", ["a.log", "d/a.log"], ["a.logs"]), ("/out", ["out", "out/x"], ["d/out"]), ("docs/**/x.md", ["docs/x.md", "docs/a/b/x.md"], ["docs/ax.md"]), ("tmp/", ["tmp/a", "d/tmp/a"], ["tmp"])],
)
def test_rules(spark, rule, yes, no):
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r.p for r in df.where(tree.excluded(F.col("p"), [rule])).collect()} == set(yes)


def test_manifests(spark):
    files = [
        ("Cargo.toml", '[dependencies]\nserde = "1"\nx = { version = "2", optional = true }\n[dev-dependencies]\nserde = "9"\n'),
        ("a/package.json", '{"dependencies": {"left": "^1.0"}, "devDependencies": {"left": "2"}}'),
        ("requirements.txt", "# c\nnumpy>=1.2 ; python_version>'3'\nflask[async]\n-r other.txt\n"),
        ("go.mod", "module m\nrequire (\n\tx.org/y v1.2.3 // indirect\n)\nrequire z.org/w v0.1.0\n"),
        ("app.csproj", '<Project><ItemGroup><PackageReference Include="A" Version="1"/><PackageReference Include="B"><Version>2</Version></PackageReference></ItemGroup></Project>'),
        ("m-1.rockspec", 'dependencies = { "lua >= 5.1", "lpeg" } -- "no"'),
        ("composer.json", "{broken"),
        ("src/x.py", "import os"),
    ]
    rows = tree.dependencies(spark.createDataFrame(files, "relative_path string, text string")).collect()
    assert sorted((r.language, r.name, r.version) for r in rows if r.name) == [
        ("csharp", "A", "1"), ("csharp", "B", "2"), ("go", "x.org/y", "v1.2.3"), ("go", "z.org/w", "v0.1.0"), ("javascript_typescript", "left", "^1.0"),
        ("lua", "lpeg", None), ("lua", "lua", ">= 5.1"), ("python", "flask", None), ("python", "numpy", ">=1.2"), ("rust", "serde", "1"), ("rust", "x", "2"),
    ]
    assert [(r.manifest_path, r.issue) for r in rows if not r.name] == [("composer.json", "JSONDecodeError")]


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert store.generation(spark, root) == 0
    with pytest.raises(RuntimeError):
        store.snapshot(spark, root, "t")
    assert store.publish(spark, root, {"t": spark.range(3)}, 0) == 1
    old = store.snapshot(spark, root, "t")
    assert store.publish(spark, root, {"t": spark.range(5)}, 1) == 2
    assert (old.count(), store.snapshot(spark, root, "t").count(), store.snapshot(spark, root, "t", 1).count()) == (3, 5, 3)
    with pytest.raises(RuntimeError):
        store.publish(spark, root, {"t": spark.range(9)}, 1)
    assert store.generation(spark, root) == 2
    assert store.publish(spark, root, {"t": spark.range(5)}, 2) == 2 and store.publish(spark, root, {"t": spark.range(5)}, 2, skip_same=False) == 3
    (tmp_path / "store/v00000004").mkdir()
    (tmp_path / "store/v00000004/CLAIM").write_text("")
    with pytest.raises(RuntimeError, match="another writer"):
        store.publish(spark, root, {"t": spark.range(6)}, 3)


def test_sweeps(spark):
    df = lambda rows: spark.createDataFrame(rows, "relative_path string, content_hash string")
    old, new = df([("a", "1"), ("b", "2"), ("d/c", "3"), ("e", "4")]), df([("a", "1"), ("b", "5"), ("z", "4")])
    paths = lambda f: sorted(r.relative_path for r in f.collect())
    assert paths(tree.changed_files(new, old)) == ["b", "z"] and paths(tree.changed_files(new, old, force=True)) == ["a", "b", "z"]
    assert paths(tree.missing_files(old, new)) == ["d/c", "e"] and paths(tree.missing_files(old, new, ["d"])) == ["e"]
    assert paths(tree.renamed_away(old, new)) == ["e"]


def test_enclosing(spark):
    symbols = spark.createDataFrame([(1, 1, 1, 100), (2, 1, 10, 40), (3, 1, 10, 20), (4, 2, 1, 5)], "symbol_id long, file_id long, line long, end_line long")
    places = spark.createDataFrame([(1, 1, 15), (2, 1, 35), (3, 1, 99), (4, 1, 101), (5, 2, 5), (6, 3, 1)], "place_id long, file_id long, line long")
    assert {r.place_id: r.symbol_id for r in tree.enclosing(places, symbols).collect()} == {1: 3, 2: 2, 3: 1, 4: None, 5: 4, 6: None}


def test_tests_and_areas(spark):
    rows = [("tests/a.py", "x"), ("src/UserTest.java", "x"), ("src/a_test.go", "x"), ("src/a.spec.ts", "x"), ("src/a.py", "test_x"), ("src/contest.py", "tests"), ("src/latest/a.py", "f")]
    df = spark.createDataFrame(rows, "p string, n string")
    assert [r[0] for r in df.select(dashboard.is_test(F.col("p"), F.col("n"))).collect()] == [True] * 5 + [False] * 2
    files = spark.createDataFrame([(p,) for p in ["a/x/1", "a/x/2", "a/y/3", "a/y/4", "b/5", "6"]], "relative_path string")
    assert dashboard.areas(files) == [("a/x", 2), ("a/y", 2), (".", 1), ("b", 1)]
    assert dashboard.areas(files.limit(0)) == []


def test_merge():
    assert changes.merge(["a"], False, ["b", "a"]) == (["a", "b"], False)
    assert changes.merge([], True, ["b"]) == ([], True)
    assert changes.merge([str(i) for i in range(256)], False, ["x"]) == ([], True)


def test_debounced_stream(spark, tmp_path):
    schema = "root string, ts timestamp, path string, event_kind string"
    sec = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [[(0, "a", "modify"), (1, "b", "modify"), (2, "z", "access"), (10, "c", "create")], [(11, "a", "modify"), (12, ".git/q", "modify")], [(59, "d", "modify")], [(300, "e", "modify")], [(301, "e", "modify")]]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([("r", sec(s), p, k) for s, p, k in rows], "root string, t string, path string, event_kind string")
        df.select("root", F.col("t").cast("timestamp").alias("ts"), "path", "event_kind").coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.05)
    events = changes.distill(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = changes.debounced_changes(events, 3).writeStream.format("memory").queryName("batches").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    got = [(r.n, r.paths) for r in spark.table("batches").orderBy("began").collect()]
    assert got == [(2, ["a", "b"]), (2, ["a", "c"]), (1, ["d"])]


def test_nested_and_imported_rules():
    assert tree.nested_rules("a/b", ["*.log", "!/keep.log", "x/y/", "# c", ""]) == ["/a/b/**/*.log", "!/a/b/keep.log", "/a/b/x/y/"]
    assert tree.expand_rules(["a", tree.IMPORT_LINE, "b"], ["g1", "!g2"]) == ["a", "g1", "!g2", "b"]


def test_issues_and_upsert(spark):
    issues = lambda rows: spark.createDataFrame(rows, "relative_path string, issue_kind string, detail string")
    handled = spark.createDataFrame([("a",), ("b",)], "relative_path string")
    got = tree.merge_issues(issues([("a", "syntax_error", "old"), ("c", "read_failure", "kept")]), issues([("b", "syntax_error", "1"), ("b", "syntax_error", "2")]), handled)
    assert sorted(map(tuple, got.collect())) == [("b", "syntax_error", "2"), ("c", "read_failure", "kept")]
    rows = lambda x: spark.createDataFrame(x, "relative_path string, name string")
    assert sorted(map(tuple, tree.upsert(rows([("a", "f"), ("a", "g"), ("c", "h")]), rows([("a", "n")]), handled).collect())) == [("a", "n"), ("c", "h")]
