"""Sinks: Markdown vaults of notes, incident files, and assets read as symbols."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import filesystem, prepare

#: Entries of a folder's map, files of the index and relations of a note at most; the file that lists what the vault wrote.
MAP_ENTRIES, INDEX_FILES, NOTE_RELATIONS, MANIFEST = 100, 100, 50, ".vault.json"
#: Bytes of an incident, and of the JSON chunk of a model file.
INCIDENT_BYTES, MODEL_JSON = 2_048, 8 << 20
# Extensions of models and of other assets.
MODELS, ASSETS = ("gltf", "glb"), "png jpg jpeg gif webp svg ico ttf otf woff woff2 mp3 wav ogg mp4 webm bin ktx2 hdr".split()

_SECRETS = (
    (re.compile(r"(?i)\b(password|passwd|secret|token|api_?key|authorization)\b(\s*[:=]\s*)(?:bearer\s+)?[\"']?[^\s\"',;]+"), r"\1\2[redacted]"),
    (re.compile(r"\bAKIA[A-Z0-9]{12,}"), "[redacted]"),
    (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.DOTALL), "[redacted]"),
    (re.compile(r"(?<=://)[^/\s:@]+:[^/\s@]+(?=@)"), "[redacted]"),
    (re.compile(r"/(?:home|Users)/[^/\s]+"), "/~"),
)


def redact(text: str) -> str:
    """text without what looks like a secret or a user's folder."""
    for pattern, instead in _SECRETS:
        text = pattern.sub(instead, text)
    return text


def incident(kind: str, detail: str) -> str:
    """A redacted incident as JSON of at most INCIDENT_BYTES bytes."""
    detail = redact(detail)
    while len(out := json.dumps({"kind": redact(kind)[:64], "detail": detail}, ensure_ascii=False).encode()) > INCIDENT_BYTES:
        detail = detail[: max(0, len(detail) - max(1, (len(out) - INCIDENT_BYTES) // 4))]
    return out.decode()


def write_incidents(incidents: DataFrame, folder: str) -> DataFrame:
    """One file for each of incidents(kind, detail), named by its content; returns their paths."""
    prepare(incidents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            paths = []
            for kind, detail in zip(b["kind"], b["detail"], strict=True):
                body = incident(kind or "", detail or "")
                paths.append(f"{root}/{hashlib.sha256(body.encode()).hexdigest()[:32]}.json")
                with store.open_output_stream(paths[-1]) as f:
                    f.write(body.encode())
            yield pd.DataFrame({"path": paths})

    return incidents.select("kind", "detail").mapInPandas(run, "path string")


def note_name(path: str) -> str:
    return "files/" + re.sub(r"[^\w./-]", "_", path) + ".md"


def notes(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(note, body): a Markdown note for each file with its declarations and links to the files it
    imports and is imported by, at most NOTE_RELATIONS of each."""
    listed = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "name"))).alias("s"))
    path = files.select("file_id", "relative_path")
    ahead = imports.join(path.toDF("dst_file", "other"), "dst_file").groupBy(F.col("src_file").alias("file_id")).agg(F.array_sort(F.collect_set("other")).alias("ahead"))
    behind = imports.join(path.toDF("src_file", "other"), "src_file").groupBy(F.col("dst_file").alias("file_id")).agg(F.array_sort(F.collect_set("other")).alias("behind"))
    rows = files.join(listed, "file_id", "left").join(ahead, "file_id", "left").join(behind, "file_id", "left")
    clean = lambda c: F.regexp_replace(c, r"[^\w./-]", "_")
    links = lambda c, title: F.when(F.size(c) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(F.transform(F.slice(c, 1, NOTE_RELATIONS), lambda x: F.concat(F.lit("- [["), F.lit("files/"), clean(x), F.lit("]]"))), "\n"), F.lit("\n"))).otherwise("")
    declared = F.when(F.size("s") > 0, F.concat(F.lit("\n## Declarations\n\n"), F.array_join(F.transform(F.slice("s", 1, MAP_ENTRIES), lambda x: F.concat(F.lit("- "), x["kind"], F.lit(" `"), x["name"], F.lit("` line "), x["line"].cast("string"))), "\n"), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("# "), F.col("relative_path"), F.lit("\n\nlanguage: "), F.col("language"), F.lit("\n"), F.coalesce(declared, F.lit("")), F.coalesce(links(F.col("ahead"), "Imports"), F.lit("")), F.coalesce(links(F.col("behind"), "Imported by"), F.lit("")))
    return rows.select(F.concat(F.lit("files/"), clean(F.col("relative_path")), F.lit(".md")).alias("note"), body.alias("body"))


def maps(files: DataFrame) -> DataFrame:
    """(note, body): a map for each folder with its files, and the index of folders."""
    folder = F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1)
    own = files.select(folder.alias("folder"), "relative_path").groupBy("folder").agg(F.array_sort(F.collect_set("relative_path")).alias("f"), F.count("*").alias("n"))
    name = F.concat(F.lit("maps/"), F.when(F.col("folder") == "", "root").otherwise(F.regexp_replace("folder", r"[^\w./-]", "_")))
    entries = F.array_join(F.transform(F.slice("f", 1, MAP_ENTRIES), lambda x: F.concat(F.lit("- [[files/"), F.regexp_replace(x, r"[^\w./-]", "_"), F.lit("]]"))), "\n")
    body = F.concat(F.lit("# "), F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), F.lit("\n\n"), entries, F.when(F.col("n") > MAP_ENTRIES, F.concat(F.lit("\n\n"), (F.col("n") - MAP_ENTRIES).cast("string"), F.lit(" more"))).otherwise(""), F.lit("\n"))
    each = own.select(F.concat(name, F.lit(".md")).alias("note"), body.alias("body"))
    top = own.select(name.alias("m"), "n").orderBy(F.col("n").desc(), "m").limit(INDEX_FILES)
    index = top.agg(F.array_sort(F.collect_list("m")).alias("m")).select(F.lit("index.md").alias("note"), F.concat(F.lit("# Index\n\n"), F.array_join(F.transform("m", lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n"), F.lit("\n")).alias("body"))
    return each.unionByName(index)


def write_vault(pages: DataFrame, folder: str) -> list[str]:
    """Writes pages(note, body) below folder; returns the notes that a reader had changed.

    The manifest holds a hash of each note as written. A note whose file differs from it was
    edited and is left alone, a file the vault doesn't know is refused, and notes no longer
    wanted are removed unless edited. The driver handles names and hashes; texts stay with tasks.
    """
    store, root = filesystem(folder)
    from pyarrow import fs

    store.create_dir(root, recursive=True)
    at = f"{root}/{MANIFEST}"
    known = json.loads(store.open_input_stream(at).read()) if store.get_file_info(at).type == fs.FileType.File else {}
    prepare(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        for b in batches:
            rows = []
            for note, body in zip(b["note"], b["body"], strict=True):
                safe = PurePosixPath(note)
                if safe.is_absolute() or ".." in safe.parts:
                    raise ValueError(f"a note outside the vault: {note}")
                target, data = f"{root}/{note}", body.encode()
                now = store.open_input_stream(target).read() if store.get_file_info(target).type == fs.FileType.File else None
                conflict = now is not None and hashlib.sha256(now).hexdigest() != known.get(note) and now != data
                if not conflict and now != data:
                    store.create_dir(os.path.dirname(target), recursive=True)
                    with store.open_output_stream(target) as f:
                        f.write(data)
                rows.append((note, known.get(note, "") if conflict else hashlib.sha256(data).hexdigest(), conflict))
            yield pd.DataFrame(rows, columns=["note", "hash", "conflict"])

    done = pages.select("note", "body").mapInPandas(run, "note string, hash string, conflict boolean").collect()
    wanted = {r["note"] for r in done}
    for note, hashed in known.items():
        target = f"{root}/{note}"
        if note not in wanted and store.get_file_info(target).type == fs.FileType.File and hashlib.sha256(store.open_input_stream(target).read()).hexdigest() == hashed:
            store.delete_file(target)
    with store.open_output_stream(at) as f:
        f.write(json.dumps({r["note"]: r["hash"] for r in sorted(done) if r["hash"]}).encode())
    return sorted(r["note"] for r in done if r["conflict"])


def model_json(data: bytes) -> dict | None:
    """The JSON of a glTF file, or of the first chunk of a binary one; None if it is none."""
    try:
        if data[:4] == b"glTF":
            magic, version, length = struct.unpack_from("<4sII", data)
            size, kind = struct.unpack_from("<I4s", data, 12)
            if version != 2 or length != len(data) or kind != b"JSON" or size > MODEL_JSON or 20 + size > len(data):
                return None
            data = data[20 : 20 + size]
        found = json.loads(data.decode()) if len(data) <= MODEL_JSON else None
        return found if isinstance(found, dict) else None
    except (ValueError, struct.error):
        return None


def assets(files: DataFrame) -> DataFrame:
    """(relative_path, name, kind, parent, content_hash, issue) of files(relative_path, size, modified, content).

    Every asset is one symbol of kind asset, whose hash is its size and time; a glTF model adds
    its nodes, materials and animations. A model that can't be read has an issue.
    """
    prepare(files.sparkSession)
    extension = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    own = files.where(extension.isin(*MODELS, *ASSETS)).select("relative_path", F.concat_ws(":", F.lit("asset"), "size", F.unix_micros("modified")).alias("content_hash"), F.when(extension.isin(*MODELS), F.col("content")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, hashed, content in zip(b["relative_path"], b["content_hash"], b["content"], strict=True):
                name, found = path.rsplit("/", 1)[-1], None
                model = content is not None
                found = model_json(bytes(content)) if model else None
                rows.append((path, name, "asset", None, hashed, "syntax_error" if model and found is None else None))
                for key, kind in (("nodes", "model_node"), ("materials", "material"), ("animations", "animation")):
                    many = (found or {}).get(key)
                    rows += [(path, str(x["name"]), kind, name, hashed, None) for x in (many if isinstance(many, list) else []) if isinstance(x, dict) and x.get("name")]
            yield pd.DataFrame(rows, columns=["relative_path", "name", "kind", "parent", "content_hash", "issue"], dtype=object)

    return own.mapInPandas(run, "relative_path string, name string, kind string, parent string, content_hash string, issue string")
