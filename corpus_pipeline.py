"""A cleaning pipeline over `documents`: each stage reads the Parquet files that the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`, and what
they drop is gone for the stages after them. The last returns one row per document that is left.

In every stage an empty table gives an empty result, rows of null text count as empty texts, repeated rows are rows of their own
where nothing else is said, and other columns, whatever their names and values, are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebench.llm import bpe, common, decontamination, line_dedup, ngram_join, quality


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained quality classifier keeps, those with a score of just the threshold included.

    A null or empty text is scored by its metadata. Without labels every document stays.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents have; n_chars follows the text.

    A null text becomes the empty one. A repeated row counts as a document each time. A line that exactly ten have goes.
    """
    kept = line_dedup.LineIndex(spark, 10).insert(docs).apply(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity connect, the one with the smallest doc_id.

    Texts without words are in no group and all stay. Of repeated rows one stays; ties are described at `one_of_each`.
    """
    return ngram_join.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of the benchmark occurs. Texts without words stay, and all do if the benchmark is empty."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left; a null text has no tokens."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", accepted),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", uncontaminated),
    ("BPE encoding", encoded),
]
#: The classifier and the tokenizer can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.work_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, folder, f"stage-{i + 1}")
    return docs
