"""Stateless text operators on streams: the same column functions run on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions.text import prepare, script_presence


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text with unified apostrophes and letters, script; batch or stream."""
    return docs.select("doc_id", prepare(F.col("text")).alias("text"), script_presence(F.col("text")).alias("script"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is now, once, exactly once by the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
