"""Notes and their links, federated search, findings with stable numbers, stale files, previews."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.runtime import prepare

#: Nodes of a note graph, lines of a preview, references and related symbols of a detail page, blocks of a page.
NOTE_NODES, PREVIEW_LINES, DETAIL_REFERENCES, DETAIL_RELATED, BLOCKS_PAGE = 5_000, 400, 40, 12, 25

_CODE = re.compile(r"(?ms)^(```|~~~).*?(?:^\1|\Z)|`[^`\n]*`")
_LINK = re.compile(r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]|(?<!!)\[[^\]]*\]\(\s*<?([^)\s>#]+)[^)]*\)")
_TAG = re.compile(r"(?:^|(?<=\s))#([A-Za-z][\w/-]*)")


def read_note(path: str, text: str) -> tuple[str, list[str], list[str]]:
    """(title, tags, link targets) of a Markdown note: from its front matter, first heading or file
    name; tags and links outside of code."""
    front = re.match(r"---\n(.*?)\n---(?:\n|\Z)", text, re.DOTALL)
    head, body = (front[1], text[front.end() :]) if front else ("", text)
    bare = _CODE.sub(" ", body)
    title = re.search(r"(?m)^title:\s*[\"']?(.+?)[\"']?\s*$", head) or re.search(r"(?m)^#\s+(.+?)\s*$", bare)
    listed = re.search(r"(?ms)^tags:[ \t]*(\[[^\]]*\]|(?:\n\s+-[^\n]*)+|[^\n]+)", head)
    tags = [t for t in re.split(r"[\s,\[\]\"']+|^-|\n\s+-\s*", listed[1]) if t and t != "-"] if listed else []
    tags += _TAG.findall(bare)
    links = [(a or b).strip() for a, b in _LINK.findall(bare) if not re.match(r"[a-z]+:", b or "")]
    name = re.sub(r"\.md$", "", path.rsplit("/", 1)[-1])
    return title[1] if title else name, sorted({t.lstrip("#") for t in tags}), list(dict.fromkeys(links))


def read_notes(files: DataFrame) -> DataFrame:
    """(path, title, tags, links) of files(path, text)."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *read_note(p, t or "")) for p, t in zip(b["path"], b["text"], strict=True)], columns=["path", "title", "tags", "links"])

    return files.select("path", "text").mapInPandas(run, "path string, title string, tags array<string>, links array<string>")


def note_links(notes: DataFrame) -> DataFrame:
    """(src, dst) between notes: a link names a path, with or without its extension and below the
    linking note's folder or the root, or a file name that only one note has."""
    every = notes.select(F.col("path").alias("dst"), F.regexp_replace("path", r"\.md$", "").alias("key"))
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    target = F.regexp_replace(F.regexp_replace("link", r"\.md$", ""), r"^\./", "")
    asked = notes.select(F.col("path").alias("src"), F.explode("links").alias("link"), folder.alias("folder")).withColumn("t", target)
    near = asked.join(every, F.concat("folder", "t") == F.col("key")).select("src", "link", "dst")
    root = asked.join(every, F.regexp_replace("t", "^/", "") == F.col("key")).select("src", "link", "dst")
    by_path = near.unionByName(root).groupBy("src", "link").agg(F.min("dst").alias("dst"))
    names = every.groupBy(F.element_at(F.split("key", "/"), -1).alias("name")).agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1")
    rest = asked.join(by_path.select("src", "link"), ["src", "link"], "left_anti")
    by_name = rest.join(names, rest.t == names.name).select("src", "link", "dst")
    return by_path.unionByName(by_name).where("src <> dst").select("src", "dst").distinct()


def note_list(notes: DataFrame, links: DataFrame, modified: DataFrame) -> DataFrame:
    """(path, title, folder, backlinks, modified), newest first."""
    back = links.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("backlinks"))
    out = notes.join(back, "path", "left").join(modified.select("path", "modified"), "path", "left")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return out.select("path", "title", folder.alias("folder"), F.coalesce("backlinks", F.lit(0).cast("long")).alias("backlinks"), "modified").orderBy(F.col("modified").desc_nulls_last(), "path")


def note_graph(links: DataFrame, nodes: int = NOTE_NODES) -> DataFrame:
    """Links among the most linked notes."""
    ends = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node")))
    kept = ends.groupBy("node").count().orderBy(F.col("count").desc(), "node").limit(nodes).select("node")
    return links.join(kept.toDF("src"), "src", "left_semi").join(kept.toDF("dst"), "dst", "left_semi")


def federated(query: str, surfaces: dict[str, tuple[DataFrame, Column]], limit: int = 10) -> DataFrame:
    """(surface, path, name, line, rank, total): rows of each surface (path, name, line) whose text
    column holds the query, case aside; each place once, with the total before the cut."""
    out = None
    for surface, (df, text) in surfaces.items():
        hits = df.where(F.contains(F.lower(text), F.lit(query.lower()))).select("path", "name", F.col("line").cast("int").alias("line")).distinct()
        total = hits.agg(F.count("*").alias("total"))
        first = hits.orderBy(F.length("name"), "path", "line", "name").limit(limit)
        w = Window.orderBy(F.length("name"), "path", "line", "name")
        part = first.withColumn("rank", F.row_number().over(w)).crossJoin(F.broadcast(total)).select(F.lit(surface).alias("surface"), "path", "name", "line", "rank", "total")
        out = part if out is None else out.unionByName(part)
    return out


def finding_list(clones: DataFrame, dead: DataFrame, text: str = "", folder: str = "", kinds: list[str] = (), order: str = "weight", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, facets) of findings: clone groups (identity, paths, name, kind, weight) and dead symbols
    alike. text and folder match any path of a group; facets count before the choice of kinds."""
    every = clones.unionByName(dead)
    hit = F.exists("paths", lambda p: F.contains(F.lower(p), F.lit(text.lower()))) | F.contains(F.lower("name"), F.lit(text.lower()))
    base = every.where(hit & F.exists("paths", lambda p: F.startswith(p, F.lit(folder))))
    facets = base.groupBy(F.lit("kind").alias("facet"), F.col("kind").alias("value")).agg(F.count("*").alias("n"))
    chosen = base.where(F.col("kind").isin(*kinds)) if kinds else base
    by = [F.col(order).desc() if order == "weight" else F.col(order), "identity"]
    return chosen.orderBy(*by).offset(offset).limit(limit), facets


def dead_confidence(dead: DataFrame) -> DataFrame:
    """Adds confidence to dead(name, kind, relative_path, visibility, source): low in tooling paths,
    for names like entry points, or where the file names it again; medium if it's public, of
    unknown visibility, or no function; else high."""
    tooling = F.lower("relative_path").rlike(r"(?:^|/)(?:scripts?|tools?|build|benches|examples?|migrations|\.github)/")
    entry = F.lower("name").rlike(r"^(?:main|run|start|init|setup|handler|configure|register)$|^on[A-Z_]")
    word = F.concat(F.lit(r"\b\Q"), F.col("name"), F.lit(r"\E\b"))
    again = F.coalesce(F.regexp_count("source", word), F.lit(0)) > 1
    medium = F.col("visibility").isNull() | (F.col("visibility") == "public") | (F.col("kind") != "function")
    return dead.withColumn("confidence", F.when(tooling | entry | again, "low").when(medium, "medium").otherwise("high"))


def numbered(identities: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, identity, number): numbers of findings, kept for known ones; new ones take the next free
    numbers of their kind, in order of identity. Numbers are never used again."""
    top = known.groupBy("kind").agg(F.max("number").alias("top"))
    fresh = identities.select("kind", "identity").distinct().join(known.select("kind", "identity"), ["kind", "identity"], "left_anti")
    w = Window.partitionBy("kind").orderBy("identity")
    new = fresh.join(top, "kind", "left").select("kind", "identity", (F.coalesce("top", F.lit(0)) + F.row_number().over(w)).cast("int").alias("number"))
    return known.select("kind", "identity", F.col("number").cast("int").alias("number")).unionByName(new)


def save_review(events: DataFrame, fresh: DataFrame, seen: int) -> DataFrame:
    """events with fresh ones (identity, state, at, ...) behind, as the next revision; fails if someone
    else wrote since revision seen. Reviews are only ever appended."""
    now = events.agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]
    if now != seen:
        raise RuntimeError(f"revision {seen} isn't the latest any more")
    return events.unionByName(fresh.withColumn("revision", F.lit(seen + 1)))


def review_history(events: DataFrame, identity: str) -> DataFrame:
    return events.where(F.col("identity") == identity).orderBy(F.col("at").desc(), F.col("revision").desc())


def review_diagnostics(events: DataFrame, current: DataFrame) -> DataFrame:
    """(problem, n): reviews of findings that are gone (current: identity, fingerprint), and ones whose
    fingerprint has changed since."""
    latest = events.groupBy("identity").agg(F.max(F.struct("at", "revision", "fingerprint")).alias("l")).select("identity", F.col("l.fingerprint").alias("was"))
    state = latest.join(current.select("identity", "fingerprint"), "identity", "left")
    problem = F.when(F.col("fingerprint").isNull(), "gone").when(F.col("fingerprint") != F.col("was"), "changed").otherwise("current")
    return state.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


def stale_files(files: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(relative_path, modified) of files changed after they were indexed (last_indexed_at)."""
    return files.join(on_disk.select("relative_path", "modified"), "relative_path").where("modified > last_indexed_at").select("relative_path", "modified")


def preview(files: DataFrame, line: int = 1, lines: int = PREVIEW_LINES) -> DataFrame:
    """(relative_path, lines) of files(relative_path, text, content_hash, indexed_hash): from a line on, at
    most PREVIEW_LINES, only of files that still are what was indexed."""
    part = F.slice(F.split("text", "\n"), max(1, line), min(max(1, lines), PREVIEW_LINES))
    return files.where("content_hash = indexed_hash").select("relative_path", part.alias("lines"))


def snippets(symbols: DataFrame, sources: DataFrame, lines: int = 12) -> DataFrame:
    """(symbol_id, signature_line, snippet): a definition's first lines, from sources(file_id, text,
    content_hash, indexed_hash) whose bytes still have the indexed hash."""
    sure = sources.where("content_hash = indexed_hash").select("file_id", F.split("text", "\n").alias("all"))
    own = symbols.join(sure, "file_id")
    count = F.least(F.coalesce(F.col("end_line") - F.col("line") + 1, F.lit(1)), F.lit(lines)).cast("int")
    return own.select("symbol_id", F.trim(F.get("all", F.col("line").cast("int") - 1)).alias("signature_line"), F.slice("all", F.col("line").cast("int"), F.greatest(count, F.lit(1))).alias("snippet"))


def leading_comment(lines: Column, line: Column, most: int = 12) -> Column:
    """The block of comment lines right above a line, markers taken off; empty without one."""
    above = F.reverse(F.slice(lines, F.greatest(line - most, F.lit(1)), F.least(line - 1, F.lit(most))))
    marked = F.transform(above, lambda x: F.trim(x))
    run = F.aggregate(marked, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("l")), lambda a, x: F.struct((a["on"] & x.rlike(r"^(?://|#|\*|/\*|--|\"\"\")")).alias("on"), F.when(a["on"] & x.rlike(r"^(?://|#|\*|/\*|--|\"\"\")"), F.concat(a["l"], F.array(x))).otherwise(a["l"]).alias("l")), lambda a: a["l"])
    return F.array_join(F.transform(F.reverse(run), lambda x: F.trim(F.regexp_replace(x, r"^[/#*\-!\"\s]+|\*/$", ""))), " ")


def signature(lines: Column, line: Column) -> Column:
    """Up to three lines of a declaration, to its first {, ; or closing colon."""
    text = F.array_join(F.transform(F.slice(lines, line, F.lit(3)), lambda x: F.trim(x)), " ")
    return F.trim(F.regexp_replace(text, r"\s*(?:\{|;|(?<=\)):|:$).*$", ""))


def file_listing(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(relative_path, language, content_hash) of indexed files that today's rules don't exclude."""
    from codeloom.sources.tree import excluded

    return files.where(~excluded(F.col("relative_path"), rules or [])).select("relative_path", "language", "content_hash").orderBy("relative_path")


def change_marker(generation: int, options: dict[str, object]) -> str:
    """A key that changes whenever a cached report may: from the generation and the options."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([generation, options], sort_keys=True, default=str).encode()).hexdigest()


def blocks_page(blocks: DataFrame, page: int, size: int = BLOCKS_PAGE) -> DataFrame:
    """One page of partial blocks of a snapshot, the longest first."""
    return blocks.orderBy(F.col("tokens").desc(), "symbol_id", "line").offset(max(0, page) * size).limit(size)


