"""Graph tables over the driver's star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from codeloom.runtime import prepare, stage

#: The same definitions for Spark SQL and DuckDB. Every evidence column of relations is filled
#: somewhere, so each rule of resolution has rows to work on.
FILES = """
SELECT CAST(n_nationkey AS BIGINT) AS file_id,
       replace(lower(r_name), ' ', '_') || '/' || CASE WHEN n_nationkey % 12 = 7 THEN 'tests/' ELSE '' END || replace(lower(n_name), ' ', '_') || '.src' AS relative_path,
       CASE n_regionkey WHEN 0 THEN 'rust' WHEN 1 THEN 'csharp' WHEN 2 THEN 'cpp' WHEN 3 THEN 'python' ELSE 'go' END AS language
FROM nation JOIN region ON n_regionkey = r_regionkey"""
SYMBOLS = """
SELECT p_partkey * 8 AS symbol_id, p_partkey % 25 AS file_id, p_name AS name,
       CASE p_size % 11 WHEN 0 THEN 'variable' WHEN 1 THEN 'field' WHEN 3 THEN 'method' ELSE 'function' END AS kind,
       CASE WHEN p_size % 11 < 4 THEN CASE WHEN p_size % 5 = 0 THEN p_brand || '<T>' ELSE p_brand END END AS parent,
       p_partkey % 1000 + 1 AS line, CAST(p_size AS BIGINT) AS col,
       CASE WHEN p_size % 17 <> 0 THEN p_partkey % 1000 + 1 + p_size % 30 END AS end_line, CAST(10 AS BIGINT) AS byte_len, p_size % 13 = 0 AS file_scoped FROM part
UNION ALL
SELECT min(p_partkey) * 8 + 4, p_partkey % 25, p_brand, CASE WHEN min(p_partkey) % 3 = 0 THEN 'function' ELSE 'class' END,
       CASE WHEN min(p_partkey) % 4 = 0 THEN 'nation_' || CAST(p_partkey % 25 AS STRING) END, min(p_partkey) % 1000 + 1, CAST(1 AS BIGINT), min(p_partkey) % 1000 + 5, CAST(40 AS BIGINT), false
FROM part GROUP BY p_brand, p_partkey % 25
UNION ALL
SELECT CAST(n_nationkey AS BIGINT) * 8 + 5, CAST(n_nationkey AS BIGINT), 'nation_' || CAST(n_nationkey AS STRING), 'module', CAST(NULL AS STRING), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST(1 AS BIGINT), false FROM nation
UNION ALL
SELECT CAST(n_nationkey AS BIGINT) * 8 + 6, CAST(n_nationkey AS BIGINT), 'nation_' || CAST(n_nationkey AS STRING), 'class', CAST(NULL AS STRING), CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST(9 AS BIGINT), CAST(1 AS BIGINT), false FROM nation WHERE n_nationkey % 4 = 0
UNION ALL
SELECT s_suppkey * 8 + 1, CAST(s_nationkey AS BIGINT), s_name, 'class', CAST(NULL AS STRING), s_suppkey % 500 + 1, CAST(1 AS BIGINT), s_suppkey % 500 + 20, CAST(30 AS BIGINT), false FROM supplier
UNION ALL
SELECT c_custkey * 8 + 2, CAST(c_nationkey AS BIGINT), c_name, CASE c_custkey % 5 WHEN 0 THEN 'interface' WHEN 1 THEN 'struct' ELSE 'class' END, CAST(NULL AS STRING), c_custkey % 700 + 1, CAST(1 AS BIGINT), c_custkey % 700 + 9, CAST(30 AS BIGINT), false FROM customer
UNION ALL
SELECT o_orderkey * 8 + 3, o_custkey % 25, 'order_' || CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 10 = 9 THEN 'function' ELSE 'method' END, c_name, o_orderkey % 2000 + 1, CAST(5 AS BIGINT), o_orderkey % 2000 + 1 + o_orderkey % 40, CAST(20 AS BIGINT), false
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
_NONE = "CAST(NULL AS STRING)"
RELATIONS = f"""
SELECT ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 2 AS relation_id, l_orderkey * 8 + 3 AS from_symbol_id,
       CASE WHEN l_linenumber % 3 = 0 THEN 'references' ELSE 'calls' END AS kind, p_name AS to_name,
       CAST(l_linenumber AS BIGINT) AS line, CAST(1 AS BIGINT) AS col,
       CASE WHEN l_partkey % 13 = 0 THEN p_brand END AS qualifier,
       CASE WHEN l_returnflag = 'R' THEN relative_path END AS target_path, CASE WHEN l_returnflag = 'R' THEN language END AS target_language,
       CASE WHEN l_partkey % 31 = 0 THEN split_part(relative_path, '/', 1) WHEN l_partkey % 41 = 0 THEN p_brand WHEN l_partkey % 43 = 0 THEN 'nation_' || CAST(l_suppkey % 25 AS STRING) END AS module,
       CASE WHEN l_partkey % 23 = 0 THEN 'function' END AS target_kind, CASE WHEN l_partkey % 37 = 0 THEN 'nation_' || CAST(l_suppkey % 25 AS STRING) WHEN l_partkey % 39 = 0 THEN 'mod_' || CAST(l_suppkey % 25 AS STRING) END AS target_module,
       l_quantity > 45 AS member, l_partkey % 7 = 0 AS not_field, l_partkey % 19 = 0 AS top_level,
       (l_linestatus = 'F' AND l_tax >= 0.07) AS external, l_orderkey % 50 <> 0 AS targets_parsed
FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_tax) AS l_tax, max(l_quantity) AS l_quantity
      FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey) AS l JOIN part ON l_partkey = p_partkey JOIN files ON file_id = l_suppkey % 25
UNION ALL
SELECT p_partkey * 32 + 31, p_partkey * 8, 'calls', 'order_' || CAST(p_partkey * 3 AS STRING), CAST(2 AS BIGINT), CAST(1 AS BIGINT),
       {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, false, false, false, false, true FROM part
UNION ALL
SELECT CAST(a.n_nationkey AS BIGINT) * 32 + 17 + 2 * k, CAST(a.n_nationkey AS BIGINT) * 8 + 5, CASE WHEN k < 3 THEN 'imports' ELSE 'references' END,
       CASE WHEN k = 1 THEN 'mod_' ELSE 'nation_' END || CAST(b.n_nationkey AS STRING), CAST(k AS BIGINT) + 1, CAST(1 AS BIGINT),
       {_NONE}, {_NONE}, f.language, {_NONE}, CASE WHEN k = 1 THEN 'module' END, {_NONE}, false, false, false, k = 2 AND a.n_nationkey % 3 = 0, true
FROM nation a CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks JOIN nation b ON b.n_nationkey = (a.n_nationkey * (k + 2) + 3 + 4 * k) % 25 JOIN files f ON f.file_id = b.n_nationkey
UNION ALL
SELECT min(p_partkey) * 32 + 29, min(p_partkey) * 8 + 4, CASE WHEN min(p_partkey) % 2 = 0 THEN 'extends' ELSE 'implements' END, 'Brand#' || substr(p_brand, 8, 1) || CAST((CAST(substr(p_brand, 7, 1) AS INT) + 1) % 5 + 1 AS STRING),
       CAST(1 AS BIGINT), CAST(1 AS BIGINT), {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, false, false, false, false, true
FROM part GROUP BY p_brand, p_partkey % 25"""
ALIASES = "SELECT CAST(n_nationkey AS BIGINT) * 8 + 5 AS symbol_id, 'mod_' || CAST(n_nationkey AS STRING) AS alias FROM nation"
#: Hints that a runtime calls a symbol, and what manifests declare.
ENTRY_POINTS = """
SELECT s_suppkey * 8 + 1 AS symbol_id, 'web' AS framework, 'handler' AS rule, s_name AS evidence, 'm' || CAST(s_suppkey % 3 AS STRING) AS requires_manifest,
       'pkg' || CAST(s_suppkey % 4 AS STRING) AS requires_package, CAST(s_suppkey % 5 AS INT) AS requires_min_major FROM supplier WHERE s_suppkey % 2 = 0"""
DEPENDENCIES = """
SELECT 'm' || CAST(r_regionkey % 3 AS STRING) AS manifest_path, 'js' AS language, 'pkg' || CAST(r_regionkey AS STRING) AS name,
       CASE r_regionkey WHEN 0 THEN '^3.1' WHEN 1 THEN '*' WHEN 2 THEN '~> 2.0' WHEN 3 THEN 'dev-main' ELSE '1' END AS version FROM region"""

_TABLES = "region nation customer supplier part orders lineitem files"


@dataclass
class Graph:
    files: DataFrame
    symbols: DataFrame
    relations: DataFrame
    aliases: DataFrame
    entry_points: DataFrame
    dependencies: DataFrame


_built: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph tables, written once for a session and folder as an index would store them.

    Tables are passed as arguments, so no view of the session's is touched.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        made = _build(prepare(spark), sf_dir)
        _built[key] = Graph(*[stage(getattr(made, f), f"graph-{f}") for f in ("files", "symbols", "relations", "aliases", "entry_points", "dependencies")])
    return _built[key]


def _build(spark: SparkSession, sf_dir: str) -> Graph:
    frames: dict[str, DataFrame] = {}

    def frame(name: str) -> DataFrame:
        if name not in frames:
            frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return frames[name]

    def build(sql: str) -> DataFrame:
        used = set(re.findall(rf"\b(?:FROM|JOIN)\s+({_TABLES.replace(' ', '|')})\b", sql))
        return spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({_TABLES.replace(' ', '|')})\b", r"\1 {\2}", sql), **{t: frame(t) for t in used})

    frames["files"] = build(FILES)
    return Graph(frames["files"], *[build(s) for s in (SYMBOLS, RELATIONS, ALIASES, ENTRY_POINTS, DEPENDENCIES)])


def with_graph(body: str) -> str:
    """DuckDB SQL: body over the graph tables."""
    tables = {"files": FILES, "symbols": SYMBOLS, "relations": RELATIONS, "symbol_aliases": ALIASES, "symbol_entry_points": ENTRY_POINTS, "dependencies": DEPENDENCIES}
    named = ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in tables.items())
    return f"WITH RECURSIVE {named} {body}".replace("AS STRING", "AS VARCHAR")
