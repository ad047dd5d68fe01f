"""Turns and reply events.

A turn is a run of messages by one sender, whatever the pauses inside it.  The gap of a
turn is measured from the first message of the turn before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions.text import is_noise
from talkweave.plans.ordered import block_of, with_neighbours
from talkweave.schema import BLOCK_ROWS

SESSION_GAP_SECONDS = 30 * 60
PICKUP_CAP_SECONDS = 4 * 60 * 60


# Messages in a part of the text of a turn.
TURN_PART = 4096


def usable_messages(messages: DataFrame) -> DataFrame:
    """Messages people wrote: no system lines, no media or deletion placeholders."""
    return messages.filter(~F.col("is_system") & ~is_noise(F.col("text")))


def number_turns(
    messages: DataFrame,
    block: int = BLOCK_ROWS,
    split_after_seconds: int | None = None,
) -> DataFrame:
    """Add ``turn_no`` and the dense ``pos`` (both 0-based, in file order) to every message.

    Rows are shuffled once, by workspace and block of ``seq``.  Whether a block opens a new
    turn depends on the last row of the block before it, which a table with one row per
    block supplies.  ``split_after_seconds`` also ends a turn after a pause that long.
    """
    rows = messages.withColumn("_blk", block_of("seq", block))
    inside = Window.partitionBy("workspace_id", "_blk").orderBy("seq")

    def starts(previous_sender: Column, previous_ts: Column) -> Column:
        changed = previous_sender != F.col("sender")
        if split_after_seconds is not None:
            pause = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(
                previous_ts.cast("timestamp")
            )
            changed = changed | (pause > split_after_seconds)
        return changed

    rows = (
        rows.withColumn("_ps", F.lag("sender").over(inside))
        .withColumn("_pt", F.lag("ts").over(inside))
        .withColumn("_new", F.coalesce(starts(F.col("_ps"), F.col("_pt")), F.lit(False)).cast("bigint"))
        .drop("_ps", "_pt")
    )
    rows = rows.withColumn(
        "_local", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    rows = rows.withColumn("_rn", F.row_number().over(inside) - 1)
    edges = rows.groupBy("workspace_id", "_blk").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by(F.struct("sender", "ts"), "seq").alias("head"),
        F.max_by(F.struct("sender", "ts"), "seq").alias("tail"),
        F.sum("_new").alias("inner_starts"),
    )
    across = Window.partitionBy("workspace_id").orderBy("_blk")
    edges = (
        edges.withColumn("before", F.lag("tail").over(across))
        .withColumn("sender", F.col("head.sender"))
        .withColumn("ts", F.col("head.ts"))
        .withColumn(
            "opens",
            F.when(F.col("before").isNull(), 0)
            .otherwise(starts(F.col("before.sender"), F.col("before.ts")).cast("int"))
            .cast("bigint"),
        )
        .withColumn("_upto", F.sum(F.col("inner_starts") + F.col("opens")).over(across))
        .withColumn("_seen", F.sum("rows").over(across))
        .select(
            "workspace_id",
            "_blk",
            (F.col("_upto") - F.col("inner_starts")).alias("_base"),
            (F.col("_seen") - F.col("rows")).alias("_first"),
        )
    )
    return (
        rows.join(edges, ["workspace_id", "_blk"])
        .withColumn("turn_no", (F.col("_base") + F.col("_local")).cast("bigint"))
        .withColumn("pos", (F.col("_first") + F.col("_rn")).cast("bigint"))
        .drop("_new", "_local", "_base", "_blk", "_rn", "_first")
    )


def turns(messages: DataFrame, block: int = BLOCK_ROWS, **kwargs) -> DataFrame:
    """One row per turn: sender, first time, message and character counts."""
    rows = messages.select("workspace_id", "seq", "sender", "ts", F.length("text").alias("_len"))
    return turns_of(number_turns(rows, block, **kwargs))


def turns_of(numbered: DataFrame) -> DataFrame:
    """The turns of messages that ``number_turns`` has numbered; they carry ``text`` or its length ``_len``."""
    if "_len" not in numbered.columns:
        numbered = numbered.withColumn("_len", F.length("text"))
    return (
        numbered.groupBy("workspace_id", "turn_no")
        .agg(
            F.first("sender").alias("sender"),
            F.min("seq").alias("first_seq"),
            F.min_by("ts", "seq").alias("first_ts"),
            F.count(F.lit(1)).alias("msg_count"),
            (F.sum(F.col("_len") + 1) - 1).alias("text_length"),
        )
    )


def turn_texts(messages: DataFrame, block: int = BLOCK_ROWS, part: int = TURN_PART) -> DataFrame:
    """Text of each turn, joined by spaces, in parts of ``part`` messages counted from its first.

    A turn of ordinary length has one part.  A sender alone in a workspace for millions of
    messages makes one turn, whose text comes in many.  ``block`` only bounds the scan.
    """
    numbered = number_turns(messages.select("workspace_id", "seq", "sender", "ts", "text"), block)
    sized = numbered.groupBy("workspace_id", "turn_no").agg(F.min("pos").alias("_from"), F.count(F.lit(1)).alias("_n"))
    long = sized.filter(F.col("_n") > part).drop("_n")
    return (
        numbered.join(long, ["workspace_id", "turn_no"], "left")
        .withColumn("part_no", F.coalesce(F.floor((F.col("pos") - F.col("_from")) / part), F.lit(0)).cast("bigint"))
        .groupBy("workspace_id", "turn_no", "part_no")
        .agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY seq)").alias("text"))
    )


def people_of(messages: DataFrame) -> DataFrame:
    """Distinct senders of usable messages per workspace."""
    return messages.select("workspace_id", "sender").distinct()


def mentions(messages: DataFrame, people: DataFrame, block: int = BLOCK_ROWS, numbered: DataFrame | None = None) -> DataFrame:
    """Per turn, the first name (alphabetically) that some ``@`` in it spells.

    The match ignores case, needs no right word boundary and may run over any number of messages of the turn.
    ``numbered`` are the messages as ``number_turns`` gives them, where the caller has them already.
    """
    if numbered is None:
        numbered = number_turns(messages.select("workspace_id", "seq", "sender", "ts", "text"), block)
    return named_in(at_tails(numbered, people, block), people)


def at_tails(numbered: DataFrame, people: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """``workspace_id, turn_no, sender, tail``: what follows each ``@`` of a turn, as far as a name can reach.

    A turn is read in pieces of ``block`` messages, or of more than the longest name has characters.  Such a piece is
    longer than a name, so what runs over its end lies in the next one, whose first characters are carried over.  Of a
    message without ``@`` only as much is kept as a name that runs into it could cover.  One pass over each text.
    """
    longest = people.select(F.max(F.length(F.lower("sender")))).first()[0] or 0
    body = F.lower("text")
    kept = F.when(F.contains("text", F.lit("@")), body).otherwise(F.substr(body, F.lit(1), F.lit(longest)))
    pieces = (
        numbered.select("workspace_id", "turn_no", "sender", "pos", kept.alias("_text"))
        .groupBy("workspace_id", "turn_no", block_of("pos", max(block, longest + 1)).alias("_piece"))
        .agg(F.first("sender").alias("sender"), F.expr("listagg(_text, ' ') WITHIN GROUP (ORDER BY pos)").alias("_text"))
    )
    onward = Window.partitionBy("workspace_id", "turn_no").orderBy("_piece")
    pieces = pieces.withColumn("_next", F.lead(F.substr("_text", F.lit(1), F.lit(longest))).over(onward))
    reach = F.lit(f"(?s)@(?=(.{{0,{longest}}}))")
    tails = F.regexp_extract_all(F.concat_ws(" ", "_text", "_next"), reach, F.lit(1))
    at = pieces.filter(F.contains("_text", F.lit("@"))).select("workspace_id", "turn_no", "sender", F.explode_outer(F.array_distinct(tails)).alias("tail"))
    return at.filter("tail is not null")


def named_in(tails: DataFrame, people: DataFrame) -> DataFrame:
    """The person each turn mentions: an equality join of one candidate per length of name, so no tail meets all names."""
    lengths = people.groupBy("workspace_id").agg(
        F.collect_set(F.length(F.lower("sender"))).alias("_lengths"), F.count(F.lit(1)).alias("speakers")
    )
    candidates = (
        tails.withColumnRenamed("sender", "_turn_sender")
        .join(lengths.filter("speakers > 2"), "workspace_id")
        .withColumn("_len", F.explode("_lengths"))
        .filter(F.length("tail") >= F.col("_len"))
        .select("workspace_id", "turn_no", "_turn_sender", F.substr(F.col("tail"), F.lit(1), F.col("_len")).alias("_name"))
        .distinct()
    )
    names = people.select("workspace_id", F.lower("sender").alias("_name"), F.col("sender").alias("_person"))
    return (
        candidates.join(names, ["workspace_id", "_name"])
        .filter(F.col("_person") != F.col("_turn_sender"))
        .groupBy("workspace_id", "turn_no")
        .agg(F.min("_person").alias("mentioned"))
    )


def turn_events(turn_table: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Classify each turn against the one before it.

    ``kind`` is ``first``, ``skip`` (clock went back), ``pickup`` (new session, answered
    within four hours), ``initiation`` (new session otherwise) or ``burst``.
    """
    near = with_neighbours(turn_table, "turn_no", 1, 0, block)
    w = Window.partitionBy("workspace_id", "_blk").orderBy("turn_no")
    near = near.withColumn("previous_sender", F.lag("sender").over(w)).withColumn(
        "_pts", F.lag("first_ts").over(w)
    )
    gap = F.unix_seconds(F.col("first_ts").cast("timestamp")) - F.unix_seconds(
        F.col("_pts").cast("timestamp")
    )
    return (
        near.filter("_own")
        .withColumn("gap_seconds", gap)
        .withColumn("kind", event_kind(F.col("previous_sender"), F.col("sender"), F.col("gap_seconds")))
        .drop("_blk", "_own", "_pts")
    )


def event_kind(previous_sender: Column, sender: Column, gap: Column) -> Column:
    return (
        F.when(previous_sender.isNull(), "first")
        .when(gap < 0, "skip")
        .when(
            gap > SESSION_GAP_SECONDS,
            F.when((previous_sender != sender) & (gap <= PICKUP_CAP_SECONDS), "pickup").otherwise(
                "initiation"
            ),
        )
        .when(previous_sender != sender, "burst")
        .otherwise("skip")
    )


def attributed_events(events: DataFrame, mention_table: DataFrame) -> DataFrame:
    """Reply events with ``target``: the mentioned person, else the previous sender."""
    return (
        events.filter(F.col("kind").isin("pickup", "burst"))
        .join(mention_table, ["workspace_id", "turn_no"], "left")
        .withColumn("target", F.coalesce("mentioned", "previous_sender"))
    )
