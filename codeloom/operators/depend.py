"""Import graphs of files and folders, classes of import targets, declared and installed packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.versions import satisfaction
from codeloom.operators import graph as G

#: Levels and nodes of a dependency graph at most.
MAX_DEPTH, MAX_NODES = 32, 5_000


def collapse(path: Column, folder: str) -> Column:
    """A file below folder as the folder, which counts as one module."""
    prefix = folder.rstrip("/")
    return F.when(path.startswith(prefix + "/"), F.lit(prefix)).otherwise(path)


def dependency_graph(imports: DataFrame, files: DataFrame, module: str, depth: int = 1, is_file: bool = True, nodes: int = MAX_NODES) -> DataFrame:
    """(src, dst, depth, back): edges reached from a module, a file or a folder taken as one.

    back marks edges to a module at the same or a smaller depth; they are listed and not
    followed. Modules beyond nodes, by depth and name, are left out with their edges.
    """
    path = F.col("relative_path") if is_file else collapse(F.col("relative_path"), module)
    named = files.select("file_id", path.alias("name"))
    edges = imports.join(named.toDF("src_file", "src"), "src_file").join(named.toDF("dst_file", "dst"), "dst_file").where("src <> dst").select("src", "dst").distinct()
    start = edges.sparkSession.createDataFrame([(module.rstrip("/"),)], "node string")
    walked = G.walk(edges, start, min(max(depth, 1), MAX_DEPTH)).orderBy("depth", "node").limit(nodes)
    a, b = walked.select(F.col("node").alias("src"), F.col("depth").alias("da")), walked.select(F.col("node").alias("dst"), F.col("depth").alias("db"))
    return edges.join(a, "src").join(b, "dst").where(F.col("da") < depth).select("src", "dst", (F.col("da") + 1).alias("depth"), (F.col("db") <= F.col("da")).alias("back"))


def import_targets(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """(relation_id, to_name, target): what each import leads to: file, external, ambiguous, unresolved,
    or restated where its file already imports that file by a surer relation."""
    callers = symbols.select(F.col("symbol_id").alias("from_symbol_id"), F.col("file_id").alias("src_file"))
    own = hits.where("kind = 'imports'").join(callers, "from_symbol_id")
    sure = (F.col("n_files") == 1) & ~F.col("external") & ~F.col("member")
    known = own.where(sure).select("src_file", F.col("to_name").alias("to_name"), F.lit(True).alias("known")).distinct()
    out = own.join(known, ["src_file", "to_name"], "left")
    target = F.when(F.col("external"), "external").when(sure, "file").when(F.col("known"), "restated").when(F.col("n_candidates") > 0, "ambiguous").otherwise("unresolved")
    return out.select("relation_id", "to_name", target.alias("target"))


def weighted_modules(imports: DataFrame, files: DataFrame, depth: int = 1, focus: str | None = None, hops: int = 1, nodes: int = MAX_NODES) -> DataFrame:
    """(src, dst, weight): file imports rolled up to folders of a depth (1 to 6), without edges of a
    folder to itself; with focus only what lies within hops of it, and the heaviest nodes first."""
    folder = F.array_join(F.slice(F.split("relative_path", "/"), F.lit(1), F.greatest(F.lit(1), F.least(F.lit(min(max(depth, 1), 6)), F.size(F.split("relative_path", "/")) - 1))), "/")
    named = files.select("file_id", F.when(F.contains("relative_path", F.lit("/")), folder).otherwise(F.lit(".")).alias("name"))
    rolled = imports.join(named.toDF("src_file", "src"), "src_file").join(named.toDF("dst_file", "dst"), "dst_file").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    if focus is not None:
        both = rolled.select("src", "dst").unionByName(rolled.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = G.walk(both, rolled.sparkSession.createDataFrame([(focus,)], "node string"), hops).select("node")
        rolled = rolled.join(near.toDF("src"), "src", "left_semi").join(near.toDF("dst"), "dst", "left_semi")
    ends = rolled.select(F.col("src").alias("node"), "weight").unionByName(rolled.select(F.col("dst").alias("node"), "weight"))
    kept = ends.groupBy("node").agg(F.sum("weight").alias("w")).orderBy(F.col("w").desc(), "node").limit(nodes).select("node")
    return rolled.join(kept.toDF("src"), "src", "left_semi").join(kept.toDF("dst"), "dst", "left_semi").select("src", "dst", "weight")


def affected_by_diff(changed: DataFrame, hits: DataFrame, symbols: DataFrame, files: DataFrame, depth: int = 8) -> DataFrame:
    """Tests (as of dashboard.affected_tests) that reach a symbol of the changed paths (relative_path)
    over resolved relations, backwards."""
    from codeloom.operators.dashboard import affected_tests

    touched = files.join(changed.select("relative_path").distinct(), "relative_path", "left_semi")
    starts = symbols.join(touched.select("file_id"), "file_id", "left_semi").select(F.col("symbol_id").alias("node"))
    back = hits.where("resolution = 'resolved'").select(F.col("target_id").alias("src"), F.col("from_symbol_id").alias("dst"))
    return affected_tests(G.walk(back, starts, depth), symbols, files)


def declared(dependencies: DataFrame, name: str) -> DataFrame:
    """(manifest_path, language, version) of manifests that declare a package."""
    return dependencies.where(F.col("name") == name).select("manifest_path", "language", "version").orderBy("manifest_path", "language")


def package_report(declared_: DataFrame, installed: DataFrame, pinned: DataFrame) -> DataFrame:
    """(manifest_path, name, constraint, installed, pinned, satisfied): each declared package
    (manifest_path, name, version) with the newest installed version (name, version) by text order,
    the version a lock file pins (name, version), and whether the installed one meets the
    constraint: true, false, or null where it can't be told."""
    have = installed.groupBy("name").agg(F.max("version").alias("installed"))
    locked = pinned.groupBy("name").agg(F.max("version").alias("pinned"))
    out = declared_.select("manifest_path", "name", F.col("version").alias("constraint")).join(have, "name", "left").join(locked, "name", "left")
    return out.select("manifest_path", "name", "constraint", "installed", "pinned", F.when(F.col("installed").isNotNull(), satisfaction(F.col("installed"), F.col("constraint"))).alias("satisfied"))


def import_origins(imports: DataFrame, provided: DataFrame, own_modules: DataFrame) -> DataFrame:
    """(module, origin, package): imports(module) as a module of the project, of an installed
    package that provides it (package, module), or unknown; the project comes first."""
    own = own_modules.select("module", F.lit(True).alias("own")).distinct()
    packages = provided.groupBy("module").agg(F.min("package").alias("package"))
    out = imports.select("module").distinct().join(own, "module", "left").join(packages, "module", "left")
    origin = F.when(F.col("own"), "project").when(F.col("package").isNotNull(), "package").otherwise("unknown")
    return out.select("module", origin.alias("origin"), F.when(F.col("own").isNull(), F.col("package")).alias("package"))


def execution_order(hits: DataFrame, limit: int = 5_000) -> DataFrame:
    """Rows of a walk in the order a reader would follow: depth, path, line, column."""
    return hits.orderBy("depth", "relative_path", "line", "col", "relation_id").limit(limit)


def outside_scope(hits: DataFrame, starts: DataFrame) -> DataFrame:
    """hits without those proven to mean a like-named definition that isn't among starts (node)."""
    proven = (F.col("resolution") == "resolved") & F.col("node").isNull()
    return hits.join(starts.select("node").distinct(), F.col("target_id") == F.col("node"), "left").where(~proven).drop("node")


def relation_page(hits: DataFrame, limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of relations by path, line, column and id, and their exact number."""
    return hits.orderBy("relative_path", "line", "col", "relation_id").offset(offset).limit(limit), hits.count()


def http_relations(points: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to add, to drop) of synthetic calls (user_id, declarer_id, kind, value): what
    join points(symbol_id, kind, value, role) say now against the stored ones."""
    side = lambda role, name: points.where(F.col("role") == role).select(F.col("symbol_id").alias(name), "kind", "value").distinct()
    now = side("uses", "user_id").join(side("declares", "declarer_id"), ["kind", "value"]).select("user_id", "declarer_id", "kind", "value")
    keys = ["user_id", "declarer_id", "kind", "value"]
    return now.join(stored, keys, "left_anti"), stored.select(*keys).join(now, keys, "left_anti")


def top_k_per_file(symbols: DataFrame, fan_in: DataFrame, k: int = 8) -> DataFrame:
    """(relative_path, symbol_id, rank): top-level symbols of each file by how many calls name them."""
    s = symbols.join(fan_in, "name", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0).cast("long")))
    w = Window.partitionBy("relative_path").orderBy(F.col("fan_in").desc(), "line", "symbol_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("relative_path", "symbol_id", "name", "fan_in", "rank")
