"""Incremental scans: only files that arrive or change are parsed and chunked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from twinfold.operators.chunking import chunk_markdown


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id string, markdown string") -> DataFrame:
    """New Parquet rows (doc_id, markdown) of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def chunk_stream(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Chunks of arriving documents, batch by batch, to an idempotent sink."""
    return chunk_markdown(docs).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
