"""Source trees as DataFrames: scan, exclusion rules, decoding, content hashes, manifests."""

from __future__ import annotations

import json
import os
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import prepare

#: Larger files aren't read; the environment may set another bound in bytes.
MAX_BYTES, MAX_BYTES_ENV = 16 << 20, "CODELOOM_MAX_FILE_BYTES"
# Folders and files that are never indexed, whatever the rules say: secrets, packages of others, tools' state.
EXCLUDED_FOLDERS = "secrets secret .aws node_modules vendor .git target .next .claude".split() + [".codeloom"]
EXCLUDED_FILES = "**/.env **/.env.* **/*.pem **/*.key **/credentials.json **/appsettings.*.json **/*.pfx **/*.snk **/gradle.properties **/*.env.local **/config/secrets.yaml".split()
#: The file of a tree that holds its own rules, and the line in it that stands for the rules of .gitignore.
RULES_FILE, IMPORT_LINE = ".codeloomignore", "@import-gitignore"


def read_bound() -> int:
    """MAX_BYTES, or what the environment asks for if that is a positive number."""
    asked = os.environ.get(MAX_BYTES_ENV, "")
    return int(asked) if asked.isascii() and asked.isdigit() and int(asked) > 0 else MAX_BYTES


def expand_rules(rules: list[str], gitignore: list[str]) -> list[str]:
    """rules with the import line replaced by the lines of .gitignore, where it stands."""
    return [x for r in rules for x in (gitignore if r.strip() == IMPORT_LINE else [r])]


def nested_rules(folder: str, lines: list[str]) -> list[str]:
    """Rules of an ignore file in folder as rules of the root: a pattern stays below the folder."""
    out = []
    for line in lines:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        sign, body = ("!", text[1:]) if text.startswith("!") else ("", text)
        anchored = "/" in body.rstrip("/")
        out.append(f"{sign}/{folder}/{'' if anchored else '**/'}{body.lstrip('/')}")
    return out


def rule_regex(pattern: str) -> str:
    """A gitignore-style pattern as a regular expression over relative paths."""
    body = pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i])), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if pattern.endswith("/") else "(?:/|$)")


def excluded(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a path excludes it ('!' includes again); fixed folders and files always are."""
    out = F.lit(False)
    for rule in rules:
        text = rule.strip()
        if text and not text.startswith("#"):
            out = F.when(path.rlike(rule_regex(text.removeprefix("!"))), F.lit(not text.startswith("!"))).otherwise(out)
    fixed = "(?:^|/)(?:" + "|".join(re.escape(d) for d in EXCLUDED_FOLDERS) + ")/|" + "|".join(rule_regex(f) for f in EXCLUDED_FILES)
    return path.rlike(fixed) | out


def _named(files: DataFrame, root: str) -> DataFrame:
    base = re.sub(r"^[a-z0-9]+:/*(?=/)", "", root.rstrip("/"))
    prefix = "^(?:[a-z0-9]+:/*(?=/))?" + re.escape(base) + "/"
    # what a link leads to outside the root has no path below it
    inside = files.where(F.col("path").rlike(prefix))
    return inside.select(F.regexp_replace("path", prefix, "").alias("relative_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def scan_tree(spark: SparkSession, root: str, rules: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """(relative_path, modified, size, content) of the files under root that no rule excludes
    and that aren't over max_bytes; path and size are filtered before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= (read_bound() if max_bytes is None else max_bytes))
    return _named(files, root).where(~excluded(F.col("relative_path"), rules or []))


def scan_paths(spark: SparkSession, root: str, paths: list[str], rules: list[str] | None = None, max_bytes: int | None = None) -> tuple[DataFrame, list[str]]:
    """What the changed paths of a batch hold now: (files as of scan_tree, paths that are gone).

    A path may be a file, a folder (all below it) or gone; paths that leave the root count as
    gone. A batch has few paths (streaming.changes.MOST_PATHS), which the driver looks up.
    """
    store = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = store.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there, gone = [], []
    for p in sorted(set(paths)):
        safe = p and not p.startswith("/") and ".." not in p.split("/")
        (there if safe and fs.exists(store.Path(f"{root.rstrip('/')}/{p}")) else gone).append(p.rstrip("/"))
    if not there:
        return spark.createDataFrame([], "relative_path string, modified timestamp, size long, content binary"), gone
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{root.rstrip('/')}/{p}" for p in there])
    files = files.where(F.col("length") <= (read_bound() if max_bytes is None else max_bytes))
    return _named(files, root).where(~excluded(F.col("relative_path"), rules or [])), gone


def decoded(files: DataFrame) -> DataFrame:
    """Adds text, issue, issue_line and content_hash (the Git blob id). A file with a zero byte is
    binary: no text, no issue. Other invalid UTF-8 has the issue 'syntax_error' and the line of
    its first bad byte."""
    zero = F.position(F.unhex(F.lit("00")).cast("string"), F.col("content").cast("string")) > 0
    text = F.try_validate_utf8(F.col("content").cast("string"))
    header = F.concat(F.lit("blob "), F.octet_length("content").cast("string"), F.unhex(F.lit("00")).cast("string")).cast("binary")
    bad = ~zero & text.isNull()

    @F.pandas_udf("int")
    def line(contents: pd.Series) -> pd.Series:
        out = []
        for c in contents:
            try:
                bytes(c or b"").decode()
                out.append(None)
            except UnicodeDecodeError as e:
                out.append(bytes(c).count(b"\n", 0, e.start) + 1)
        return pd.Series(out, dtype="Int32")

    out = files.withColumn("text", F.when(~zero, text)).withColumn("issue", F.when(bad, "syntax_error"))
    out = out.withColumn("issue_line", line(F.when(bad, F.col("content"))))
    return out.withColumn("content_hash", F.sha1(F.concat(header, F.col("content"))))


def merge_issues(stored: DataFrame, found: DataFrame, handled: DataFrame) -> DataFrame:
    """(relative_path, issue_kind, detail): stored issues of paths that weren't handled, and those
    found; one row for each path and kind."""
    kept = stored.join(handled.select("relative_path").distinct(), "relative_path", "left_anti").unionByName(found)
    return kept.groupBy("relative_path", "issue_kind").agg(F.max("detail").alias("detail"))


def upsert(stored: DataFrame, fresh: DataFrame, replaced: DataFrame, key: str = "relative_path") -> DataFrame:
    """stored without the rows of replaced keys, and fresh ones: a file's rows change as a whole."""
    return stored.join(replaced.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def changed_files(now: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Files whose (relative_path, content_hash) isn't stored; all with force."""
    return now if force else now.join(stored.select("relative_path", "content_hash").distinct(), ["relative_path", "content_hash"], "left_anti")


def missing_files(stored: DataFrame, now: DataFrame, unreadable: list[str] | None = None) -> DataFrame:
    """Stored files no longer seen, except those under folders that couldn't be read."""
    gone = stored.join(now.select("relative_path").distinct(), "relative_path", "left_anti")
    for folder in unreadable or []:
        gone = gone.where(~F.startswith("relative_path", F.lit(folder.rstrip("/") + "/")))
    return gone


def renamed_away(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Stored files that are gone while a new path has the same content: old ends of renames."""
    fresh = now.join(stored.select("relative_path").distinct(), "relative_path", "left_anti").select("content_hash").distinct()
    return missing_files(stored, now).join(fresh, "content_hash", "left_semi")


def _toml(text: str) -> list[tuple[str, str | None]]:
    data, out = tomllib.loads(text), []
    tables = [data, *(data.get("target") or {}).values(), data.get("workspace") or {}]
    for t in tables:
        for key in ("dependencies", "dev-dependencies", "build-dependencies"):
            out += [(k, v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None) for k, v in (t.get(key) or {}).items()]
    return out


def _json(text: str, keys: tuple[str, ...]) -> list[tuple[str, str | None]]:
    data = json.loads(text)
    return [(k, v if isinstance(v, str) else None) for key in keys for k, v in (data.get(key) or {}).items()]


def _requirements(text: str) -> list[tuple[str, str | None]]:
    out = []
    for line in text.splitlines():
        m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([^;#]*)", line)
        if m:
            out.append((m[1], m[2].strip() or None))
    return out


def _go(text: str) -> list[tuple[str, str | None]]:
    block = "\n".join(re.findall(r"^require\s*\(([^)]*)\)", text, re.MULTILINE)) + "\n" + "\n".join(re.findall(r"^require\s+([^(\n]+)$", text, re.MULTILINE))
    return [(m[1], m[2]) for m in re.finditer(r"^\s*(\S+)\s+(v\S+)", block, re.MULTILINE)]


def _csproj(text: str) -> list[tuple[str, str | None]]:
    out = []
    for e in ET.fromstring(text).iter():
        if e.tag.rsplit("}", 1)[-1] == "PackageReference" and e.get("Include"):
            inner = next((c.text for c in e if c.tag.rsplit("}", 1)[-1] == "Version"), None)
            out.append((e.get("Include"), e.get("Version") or inner))
    return out


def _rockspec(text: str) -> list[tuple[str, str | None]]:
    found = re.search(r"\bdependencies\s*=\s*\{(.*?)\}", re.sub(r"--[^\n]*", "", text), re.DOTALL)
    out = []
    for a, b in re.findall(r"\"([^\"]*)\"|'([^']*)'", found[1] if found else ""):
        name, _, rest = (a or b).strip().partition(" ")
        out.append((name, rest.strip() or None))
    return out


def manifest_format(path: str) -> tuple[str, object] | None:
    """(language, parser) of a manifest by its file name."""
    name = path.rsplit("/", 1)[-1]
    fixed = {
        "Cargo.toml": ("rust", _toml),
        "package.json": ("javascript_typescript", lambda t: _json(t, ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))),
        "composer.json": ("php", lambda t: _json(t, ("require", "require-dev"))),
        "requirements.txt": ("python", _requirements),
        "go.mod": ("go", _go),
    }
    if name in fixed:
        return fixed[name]
    return ("csharp", _csproj) if name.endswith(".csproj") else ("lua", _rockspec) if name.endswith(".rockspec") else None


def dependencies(files: DataFrame) -> DataFrame:
    """(manifest_path, language, name, version, issue) of files(relative_path, text); of a name
    that occurs again the first stays. A manifest that can't be parsed gives one row with issue."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["relative_path"], b["text"], strict=True):
                if (found := manifest_format(path)) is None:
                    continue
                try:
                    seen = dict(reversed(found[1](text or "")))
                    rows += [(path, found[0], k, v, None) for k, v in seen.items()]
                except (ValueError, AttributeError, ET.ParseError) as e:
                    rows.append((path, found[0], None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["manifest_path", "language", "name", "version", "issue"], dtype=object)

    wanted = F.col("relative_path").rlike(r"(?:^|/)(?:Cargo\.toml|package\.json|composer\.json|requirements\.txt|go\.mod|[^/]+\.csproj|[^/]+\.rockspec)$")
    return files.where(wanted).select("relative_path", "text").mapInPandas(run, "manifest_path string, language string, name string, version string, issue string")


def enclosing(places: DataFrame, symbols: DataFrame, bucket: int = 32) -> DataFrame:
    """places(place_id, file_id, line) with the innermost symbol(symbol_id, file_id, line, end_line)
    around each: latest start, then earliest end, then largest id; null outside all.

    Spans are cut into buckets of lines, so the join is on equal (file, bucket)."""
    spans = symbols.select("symbol_id", "file_id", F.col("line").alias("s"), F.col("end_line").alias("e"))
    spans = spans.withColumn("k", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.col("e") / bucket))))
    near = places.withColumn("k", F.floor(F.col("line") / bucket)).join(spans, ["file_id", "k"])
    best = near.where((F.col("line") >= F.col("s")) & (F.col("line") <= F.col("e"))).groupBy("place_id").agg(F.max(F.struct("s", -F.col("e"), "symbol_id")).alias("b"))
    return places.join(best.select("place_id", F.col("b.symbol_id").alias("symbol_id")), "place_id", "left")

