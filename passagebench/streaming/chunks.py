"""Chunking and token counts on streams: both are row transforms, so the batch operators run unchanged; no state is kept.

Statistics over the whole corpus (document frequencies, percentiles over documents, intervals) stay with batch plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import chunking


def documents_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def chunk_stream(docs: DataFrame, strategy: str = "fixed", **params) -> DataFrame:
    return chunking.chunk(docs, strategy, **params)
