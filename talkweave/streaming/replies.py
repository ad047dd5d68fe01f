"""Reply events of a message stream, equal to the batch result.

A turn is classified by its first message and the first message of the turn before it, so
all a batch needs from the past is the last turn of each workspace: one row per workspace,
kept as a table next to the output.  The batch itself runs the batch operator, which splits
a hot workspace over many tasks; a keyed streaming state would hand it to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkweave.operators.turns import turn_events, turns
from talkweave.schema import BLOCK_ROWS

WS = "workspace_id"


def _previous(batch: DataFrame, state_path: str, batch_id: int) -> DataFrame | None:
    if batch_id == 0:
        return None
    return batch.sparkSession.read.parquet(f"{state_path}/batch_{batch_id - 1}")


def process_batch(
    batch: DataFrame, batch_id: int, state_path: str, out_path: str, block: int = BLOCK_ROWS
) -> None:
    """Write the events of one micro-batch and the last turn of each workspace.

    Output and state are named by batch, so a batch run twice leaves the same files.
    ``seq`` must grow from batch to batch within a workspace.
    """
    rows = batch.select(WS, "seq", "sender", "ts", "text").withColumn("_carried", F.lit(False))
    carried = _previous(batch, state_path, batch_id)
    if carried is not None:
        rows = rows.unionByName(
            carried.select(
                WS, "seq", "sender", F.col("first_ts").alias("ts"), F.lit("").alias("text"), F.lit(True).alias("_carried")
            )
        )
    found = turn_events(turns(rows, block), block)
    fresh = found
    if carried is not None:
        # The carried turn was reported when it began.
        fresh = found.join(
            carried.select(WS, F.col("seq").alias("first_seq")), [WS, "first_seq"], "left_anti"
        )
    fresh.select(WS, "first_seq", "sender", "previous_sender", "gap_seconds", "kind").write.mode("overwrite").parquet(
        f"{out_path}/batch_id={batch_id}"
    )
    last_seq = rows.groupBy(WS).agg(F.max("seq").alias("seq"))
    last_turn = found.groupBy(WS).agg(
        F.max_by("sender", "turn_no").alias("sender"), F.max_by("first_ts", "turn_no").alias("first_ts")
    )
    last_turn.join(last_seq, WS).write.mode("overwrite").parquet(f"{state_path}/batch_{batch_id}")


def stream_reply_events(
    messages: DataFrame, state_path: str, out_path: str, checkpoint: str, block: int = BLOCK_ROWS
) -> StreamingQuery:
    """Start the stream over usable messages; read the events back from ``out_path``."""
    return (
        messages.writeStream.foreachBatch(
            lambda batch, batch_id: process_batch(batch, batch_id, state_path, out_path, block)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
