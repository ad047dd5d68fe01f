"""Message and vector tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.plans.ordered import block_of, top_rows


def write_messages(messages: DataFrame, path: str) -> None:
    """One directory per workspace; re-ingest replaces only the workspaces it brings.

    A large workspace is written by many tasks, one per block of lines.
    """
    (
        messages.repartition("workspace_id", block_of("seq"))
        .sortWithinPartitions("workspace_id", "seq")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("workspace_id")
        .parquet(path)
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("workspace_id", F.col("workspace_id").cast("string"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` put in or replaced, matched on ``keys``.

    Of several changes with one key the one with the largest hash of all columns stays, so a rerun agrees.
    """
    order = F.xxhash64(*changes.columns).desc()
    once = top_rows(changes, keys, [order], 1).select(*changes.columns)
    return current.join(once.select(*keys), keys, "left_anti").unionByName(once)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors by workspace, sorted by person so a person filter skips row groups."""
    (
        vectors.repartition("workspace_id", F.pmod(F.xxhash64("message_id"), F.lit(256)))
        .sortWithinPartitions("workspace_id", "person_id", "message_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("workspace_id")
        .parquet(path)
    )


def person_timeline(messages: DataFrame, workspace_id: str, sender: str) -> DataFrame:
    """All messages of one person in time order; the filter prunes to one workspace."""
    return messages.filter(
        (F.col("workspace_id") == workspace_id) & (F.col("sender") == sender)
    ).orderBy("ts", "seq")


def partners(people: DataFrame, excluded: DataFrame) -> DataFrame:
    """People of each workspace except the one named for it in ``excluded``."""
    return people.join(excluded, ["workspace_id", "sender"], "left_anti")
