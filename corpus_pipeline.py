"""A corpus-preparation pipeline of text operators, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, decontam, exact_dedup, simhash, toxicity
from codeloom.llm.common import once, row_key, without
from codeloom.runtime import prepare, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold of the toxicity classifier.

    The model learns from this stage's own rows; without labels of both kinds it gives every
    text the share of label 1. Null and empty texts get the score of a text without words,
    repeated rows the same score each. An empty table stays empty.
    """
    prepare(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(model, F.col("text")) < toxicity.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id (null ids last); null and
    empty texts are equal, and of rows equal in id and text one stays. An empty table stays empty."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) one document.

    It is the row with the smallest id (null last), of rows with one id that with the
    smallest row key, of rows equal in id and text the smallest by the other columns. Null,
    empty and blank texts are one group. An empty table stays empty.
    """
    groups = stage(simhash.similar_groups(docs, words=5, least=0.8, with_row=True).groupBy("row", "keep_row").count(), "near-groups")
    left = without(docs, groups.where("row <> keep_row"))
    return once(left, row_key(), groups.where("row = keep_row and count > 1").select("row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark, however long they are.

    A window is 13 consecutive words of an item, or a shorter item as a whole. Null and
    empty texts hold none and stay; repeated rows go or stay together. An empty benchmark
    drops nothing.
    """
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_row=True)
    return without(docs, found.where("n_hit > 0"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of the ids and of the decoded bytes; none
    for null and empty texts. Repeated rows give repeated results."""
    import public_tokenizers as vocab

    return bpe.encode_documents(docs, vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", tokenize),
]

#: SQL can express neither a trained classifier nor XXH64 fingerprints or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
