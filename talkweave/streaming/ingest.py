"""New export files to messages, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkweave.operators.ingest import parse_exports
from talkweave.sources.exports import explode_lines, file_name
from talkweave.sources.tables import write_messages


def stream_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming ``workspace_id, text`` of every export file that appears in ``folder``."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.txt")
        .load(folder)
    )
    as_text = F.col("content").cast("string")
    return raw.select(
        F.regexp_extract("path", file_name(0), 1).alias("workspace_id"),
        F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode("content", "ISO-8859-1")).alias("text"),
    )


def ingest_exports(spark: SparkSession, folder: str, messages_path: str, checkpoint: str) -> StreamingQuery:
    """Parse the files that came since the last run into the message table.

    A file is a whole workspace, so a batch overwrites exactly the workspaces it holds and
    a replayed batch writes the same rows again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        messages, rejects = parse_exports(explode_lines(batch))
        write_messages(messages, messages_path)
        rejects.write.mode("overwrite").parquet(f"{messages_path}_rejects/batch_id={batch_id}")

    return (
        stream_exports(spark, folder)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
