"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.bpe import encode_documents
from codeloom.llm.decontam import contamination
from codeloom.llm.exact_dedup import exact_groups
from codeloom.llm.html_text import extract_pages
from codeloom.llm.idblocks import read_ids, write_ids
from codeloom.llm.line_dedup import drop_repeated_lines
from codeloom.llm.quality import score_quality
from codeloom.llm.secrets import find_secrets
from codeloom.llm.simhash import near_groups
from codeloom.llm.toxicity import fit, score_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return encode_documents(_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN, with_ids=False)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    files = write_ids(_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.json"))
    return read_ids(files, with_ids=False)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_toxicity, op3_bpe, op4_secrets, op5_token_blocks, op6_exact_dedup, op7_line_dedup, op8_decontamination, op9_html_text, op10_simhash)
}

ORACLE: dict[str, str] = {
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_decontamination": """
        WITH low AS (
            SELECT doc_id, row_number() OVER () AS r,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        it AS (
            SELECT item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark),
        ip AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM it WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + 12], ' ') AS s FROM ip),
        ns AS (SELECT DISTINCT n FROM iw),
        dp AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM low),
        dw AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM dp, ns WHERE p + n - 1 <= len(w)),
        hit AS (SELECT r, p, iw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
        pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(l, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM low LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
    """,
}
