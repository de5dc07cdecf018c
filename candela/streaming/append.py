"""Incremental ingest: a stream of documents appended to a chunk table, where known chunk ids are skipped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from candela.operators.chunking import text_pieces
from candela.functions import text as T
from pyspark.sql import functions as F


def chunk_rows(docs: DataFrame) -> DataFrame:
    pieces = text_pieces(docs.select(F.struct("doc_id", "source").alias("unit_id"), "text"))
    at = F.col("unit_id.doc_id").cast("int")
    return pieces.select(T.chunk_id(F.col("unit_id.source"), at, F.col("piece")).alias("id"), F.col("unit_id.source").alias("source"), F.col("unit_id.doc_id").alias("doc_id"), F.col("piece").alias("text"))


def append_new(docs: DataFrame, target: str) -> None:
    """Appends the chunks whose id is not yet in the target, so a replayed batch adds nothing."""
    chunks = chunk_rows(docs).dropDuplicates(["id"])
    try:
        chunks = chunks.join(docs.sparkSession.read.parquet(target).select("id"), "id", "left_anti")
    except AnalysisException:  # the first batch
        pass
    chunks.write.mode("append").parquet(target)


def append_stream(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return docs.writeStream.foreachBatch(lambda batch, _: append_new(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
