"""Incremental ingest of crawled question/answer files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaestor.operators.rank import postings
from quaestor.sources.readers import QA


def crawled(spark: SparkSession, folder: str, delay: str = "7 days") -> DataFrame:
    """New JSON files of a folder as a stream, each source URL once within the delay.

    The watermark bounds the state of seen URLs; a row older than that is dropped as late.
    """
    rows = spark.readStream.schema(QA).json(folder)
    return rows.where(F.col("crawl_date").isNotNull()).withWatermark("crawl_date", delay).dropDuplicatesWithinWatermark(["source_url"])


def maintain_postings(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of each batch to an index, one folder a batch: a batch that runs again replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        docs = batch.select(F.col("uid"), F.col("question.question_title").alias("question_title"), F.col("question.question_body").alias("question_body"))
        postings(docs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
