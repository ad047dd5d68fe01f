"""Context around hits: windows, merged ranges, blocks, exchanges and excerpts.

Positions are dense per workspace, so a window is arithmetic on positions and a lookup is
an equality join; no range join and no window over a whole workspace is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions.scores import score_or_zero
from talkweave.functions.text import is_noise, strip
from talkweave.plans.ordered import (
    block_of,
    dense_position,
    keep_evenly,
    running_before,
    seq_levels,
    time_levels,
    top_rows,
    with_neighbours,
)
from talkweave.schema import BLOCK_ROWS

WS = "workspace_id"
BEFORE, AFTER = 3, 4
ADJACENT = 2


def timeline(messages: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Messages with ``pos`` in time order and ``n``, the size of the workspace."""
    return dense_position(
        messages, [WS], [F.col("ts"), F.col("seq")], time_levels("ts", "seq", block), "pos", "n"
    )


def hit_windows(hits: DataFrame, line: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """``start`` (included) and ``end`` (excluded) of the rows around each hit found."""
    placed = hits.join(line.select(WS, "message_id", "pos", "n"), [WS, "message_id"])
    return placed.withColumn("start", F.greatest(F.lit(0), F.col("pos") - before)).withColumn(
        "end", F.least(F.col("n"), F.col("pos") + after + 1)
    )


def merge_intervals(windows: DataFrame, block: int = BLOCK_ROWS, gap: int = ADJACENT) -> DataFrame:
    """Ranges of one request that overlap or lie within ``gap`` rows become one.

    Equal ranges are folded first; the running end crosses block edges through the block
    table, so one request may hold any number of ranges.
    """
    part = ["request_id", WS]
    distinct = windows.groupBy(*part, "start", "end").agg(F.max("score").alias("score"))
    rows = distinct.withColumn("_blk", block_of("start", block))
    order = [F.col("start"), F.col("end")]
    rows = running_before(rows, part, "_blk", order, {"_reach": ("max", F.col("end"))})
    opens = (F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap)).cast("bigint")
    rows = rows.withColumn("_opens", opens)
    rows = running_before(rows, part, "_blk", order, {"_before": ("sum", F.col("_opens"))})
    return (
        rows.withColumn("range_no", F.col("_before") + F.col("_opens") - 1)
        .groupBy(*part, "range_no")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
    )


def range_rows(ranges: DataFrame, line: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Timeline rows of each range by equality on position.

    A long range is cut into blocks before its positions are listed.
    """
    first, last = block_of("start", block), block_of(F.col("end") - 1, block)
    pieces = ranges.withColumn("_b", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start"), F.col("_b") * block)
    hi = F.least(F.col("end"), (F.col("_b") + 1) * block) - 1
    listed = pieces.withColumn("pos", F.explode(F.sequence(lo, hi))).drop("_b")
    return listed.join(line, [WS, "pos"])


def _contains_person(text: Column, person: Column) -> Column:
    return F.contains(F.lower(text), F.lower(person))


def context_blocks(
    hits: DataFrame,
    line: DataFrame,
    min_score: float = 0.0,
    max_blocks: int = 5,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """``request_id, block_no, text``: excerpts around the hits of each request.

    ``hits``: ``request_id, workspace_id, message_id, score, speaker, ts, snippet,
    target_person`` with a bounded number of hits per request.  A range stays when its best
    score reaches ``min_score`` or the person speaks or is named in it; hits missing from
    the timeline follow as plain snippets under the same rule.
    """
    person = hits.groupBy("request_id").agg(F.first("target_person").alias("target_person"))
    ranges = merge_intervals(hit_windows(hits, line), block)
    rows = range_rows(ranges, line.select(WS, "pos", "sender", "text"), block).join(person, "request_id")
    about = (F.lower("sender") == F.lower("target_person")) | _contains_person(F.col("text"), F.col("target_person"))
    blocks = (
        rows.withColumn("_line", F.concat("sender", F.lit(": "), "text"))
        .groupBy("request_id", WS, "range_no")
        .agg(
            F.max("score").alias("score"),
            F.bool_or(F.coalesce(about, F.lit(False))).alias("about"),
            F.min("start").alias("start"),
            F.expr("listagg(_line, '\n') WITHIN GROUP (ORDER BY pos)").alias("text"),
        )
        .withColumn("text", strip(F.col("text")))
        .filter((F.col("text") != "") & ((score_or_zero(F.col("score")) >= min_score) | F.col("about")))
        .select("request_id", F.lit(0).alias("kind"), F.col("start").cast("double").alias("place"), F.lit("").alias("tie"), "text")
    )
    known = line.select(WS, "message_id")
    missing = hits.join(known, [WS, "message_id"], "left_anti")
    fallback = F.concat(
        "speaker", F.lit(" ("), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("): "), "snippet"
    )
    keeps = (score_or_zero(F.col("score")) >= min_score) | _contains_person(F.col("text"), F.col("target_person"))
    snippets = (
        missing.withColumn("text", fallback)
        .filter(F.coalesce(keeps, F.lit(False)))
        .groupBy("request_id", "text")
        .agg(F.max("score").alias("score"), F.min("message_id").cast("string").alias("tie"))
        .select("request_id", F.lit(1).alias("kind"), (-F.col("score")).alias("place"), "tie", "text")
    )
    return top_rows(
        blocks.unionByName(snippets), ["request_id"], [F.col("kind"), F.col("place"), F.col("tie")], max_blocks, "block_no"
    ).select("request_id", F.col("block_no").cast("bigint").alias("block_no"), "text")


def context_blocks_qa(
    hits: DataFrame, line: DataFrame, max_blocks: int = 5, block: int = BLOCK_ROWS
) -> DataFrame:
    """Messages of the first ``max_blocks`` ranges, noise left out, with ``is_hit``."""
    windows = hit_windows(hits, line)
    ranges = top_rows(
        merge_intervals(windows, block), ["request_id"], [F.col("start"), F.col(WS)], max_blocks, "block_no"
    )
    rows = range_rows(ranges, line.select(WS, "pos", "sender", "ts", "text"), block)
    centres = windows.select("request_id", WS, "pos").distinct().withColumn("is_hit", F.lit(True))
    return (
        rows.filter(~is_noise(F.col("text")))
        .join(centres, ["request_id", WS, "pos"], "left")
        .select(
            "request_id",
            F.col("block_no").cast("bigint").alias("block_no"),
            "pos",
            F.col("sender").alias("speaker"),
            F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"),
            "text",
            F.coalesce("is_hit", F.lit(False)).alias("is_hit"),
        )
    )


def render_blocks(rows: DataFrame) -> DataFrame:
    """One text per block; the hit itself is marked."""
    line = F.concat(
        F.when(F.col("is_hit"), ">>> ").otherwise("    "), "speaker", F.lit(" ("), "ts", F.lit("): "), "text"
    )
    return (
        rows.withColumn("_line", line)
        .groupBy("request_id", "block_no")
        .agg(F.expr("listagg(_line, '\n') WITHIN GROUP (ORDER BY pos)").alias("text"))
    )


def row_windows(line: DataFrame, before: int = BEFORE, after: int = AFTER, block: int = BLOCK_ROWS) -> DataFrame:
    """Frame around every row: first and last position and characters inside."""
    near = with_neighbours(line.select(WS, "pos", F.length("text").alias("_len")), "pos", before, after, block)
    w = Window.partitionBy(WS, "_blk").orderBy("pos").rowsBetween(-before, after)
    return (
        near.withColumn("first_pos", F.min("pos").over(w))
        .withColumn("last_pos", F.max("pos").over(w))
        .withColumn("chars", F.sum("_len").over(w))
        .filter("_own")
        .select(WS, "pos", "first_pos", "last_pos", "chars")
    )


def paired_exchanges(line: DataFrame, look_back: int = 8, block: int = BLOCK_ROWS) -> DataFrame:
    """Every usable message with the nearest earlier one by someone else, eight rows back at most."""
    near = with_neighbours(line.select(WS, "pos", "message_id", "sender", "text"), "pos", look_back, 0, block)
    readable = ~is_noise(F.col("text"))
    w = Window.partitionBy(WS, "_blk").orderBy("pos").rowsBetween(-look_back, -1)
    earlier = F.collect_list(F.when(readable, F.struct("sender", "text"))).over(w)
    near = near.withColumn("_earlier", earlier).filter(F.col("_own") & readable)
    others = F.filter("_earlier", lambda m: m["sender"] != F.col("sender"))
    other = F.when(F.size(others) > 0, F.element_at(others, -1))
    own = F.concat(F.lit("["), "sender", F.lit("]: "), "text")
    before = F.concat(F.lit("["), other["sender"], F.lit("]: "), other["text"], F.lit("\n"))
    return near.select(
        WS, "pos", "message_id", "sender", F.concat(F.coalesce(before, F.lit("")), own).alias("exchange")
    )


def exchange_partners(line: DataFrame, look_back: int = 8, block: int = BLOCK_ROWS) -> DataFrame:
    """Like ``paired_exchanges`` without texts: ``partner_id`` is the message that led to each, null where none did.

    ``line`` says by ``readable`` which messages have something to read, so no text is sorted or copied.
    """
    near = with_neighbours(line.select(WS, "pos", "message_id", "sender", "readable"), "pos", look_back, 0, block)
    w = Window.partitionBy(WS, "_blk").orderBy("pos").rowsBetween(-look_back, -1)
    earlier = F.collect_list(F.when(F.col("readable"), F.struct("sender", "message_id"))).over(w)
    near = near.withColumn("_earlier", earlier).filter(F.col("_own") & F.col("readable"))
    others = F.filter("_earlier", lambda m: m["sender"] != F.col("sender"))
    partner = F.when(F.size(others) > 0, F.element_at(others, -1)["message_id"])
    return near.select(WS, "pos", "message_id", "sender", partner.alias("partner_id"))


def exchange_texts(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """``chosen(workspace_id, message_id, partner_id, ...)`` with the texts of both as ``exchange``.

    Only the messages that ``chosen`` names are read into the join; keys are ids of single messages, so it stays even.
    A chosen message that ``messages`` lacks is left out; an unknown partner counts as none.
    """
    kept = [F.col(f"`{c}`") for c in chosen.columns]
    ends = [F.struct(F.lit(True).alias("own"), F.col("message_id").alias("id")), F.struct(F.lit(False).alias("own"), F.col("partner_id").alias("id"))]
    asked = chosen.withColumn("_end", F.explode(F.filter(F.array(*ends), lambda e: e["id"].isNotNull())))
    said = F.concat(F.lit("["), "sender", F.lit("]: "), "text")
    lines = messages.select(F.col(WS).alias("_ws"), F.col("message_id").alias("_id"), said.alias("_said"))
    found = asked.join(lines, (F.col(WS) == F.col("_ws")) & (F.col("_end.id") == F.col("_id")))
    # Both lines of an exchange meet again by its own message.
    sides = F.collect_list(F.struct(F.col("_end.own").alias("own"), F.col("_said").alias("said")))
    both = found.groupBy(*kept).agg(F.array_sort(sides).alias("_sides")).filter(F.element_at("_sides", -1)["own"])
    return both.select(*kept, F.array_join(F.transform("_sides", lambda m: m["said"]), "\n").alias("exchange"))


def conversation_snippets(line: DataFrame, limit: int = 4, window: int = 6, block: int = BLOCK_ROWS) -> DataFrame:
    """Excerpts that end with a person's message, spread evenly over their distinct excerpts."""
    near = with_neighbours(line.select(WS, "pos", "sender", "text"), "pos", window, 0, block)
    w = Window.partitionBy(WS, "_blk").orderBy("pos").rowsBetween(-window, 0)
    said = F.collect_list(F.concat("sender", F.lit(": "), "text")).over(w)
    candidates = (
        near.withColumn("_lines", said)
        .filter(F.col("_own") & (strip(F.col("text")) != "") & (F.size("_lines") >= 2))
        .select(WS, "sender", "pos", F.array_join("_lines", "\n").alias("snippet"))
    )
    distinct = candidates.groupBy(WS, "sender", "snippet").agg(F.min("pos").alias("first_pos"))
    ranked = dense_position(
        distinct, [WS, "sender"], [F.col("first_pos")], seq_levels("first_pos", block), "candidate", "candidates"
    )
    return ranked.filter(keep_evenly(F.col("candidate"), F.col("candidates"), F.lit(limit)))


def history_tail(turns: DataFrame, k: int, part: str = WS, order: str = "seq") -> DataFrame:
    """Last ``k`` turns of every dialogue; ``back`` counts from the end."""
    return top_rows(turns, [part], [F.col(order).desc()], k, "back")


def history_budget(turns: DataFrame, turns_kept: int = 30, fewer: int = 20, chars: int = 8000) -> DataFrame:
    """Last 30 turns, or 20 when those are too long in characters."""
    tail = history_tail(turns, turns_kept)
    total = F.sum(F.length("text")).over(Window.partitionBy(WS))
    return tail.withColumn("_chars", total).filter((F.col("_chars") <= chars) | (F.col("back") <= fewer)).drop("_chars")


def flatten_dialogue(turns: DataFrame) -> DataFrame:
    """``User: ...`` / ``Name: ...`` lines of a dialogue as one text, however many turns it has."""
    label = F.when(F.col("sender") == "user", "User").otherwise(F.col("sender"))
    return (
        turns.select(WS, "seq", F.concat(label, F.lit(": "), "text").alias("_line"))
        .groupBy(WS)
        .agg(F.expr("listagg(_line, '\n') WITHIN GROUP (ORDER BY seq)").alias("dialogue"))
    )


def summary_split(line: DataFrame, more_than: int = 24, keep: int = 10) -> DataFrame:
    """Mark the head of a long dialogue ``summarise`` and its last turns ``verbatim``."""
    head = (F.col("n") > more_than) & (F.col("pos") < F.col("n") - keep)
    return line.withColumn("use", F.when(head, "summarise").otherwise("verbatim"))


def recent_turns(line: DataFrame, k: int = 2, block: int = BLOCK_ROWS) -> DataFrame:
    """Each row with ``recent``: the ``k`` texts before it joined by spaces, null for the first."""
    near = with_neighbours(line, "pos", k, 0, block)
    w = Window.partitionBy(WS, "_blk").orderBy("pos").rowsBetween(-k, -1)
    near = near.withColumn("_recent", F.collect_list("text").over(w)).filter("_own")
    return near.withColumn(
        "recent", F.when(F.size("_recent") > 0, F.array_join("_recent", " "))
    ).drop("_recent", "_blk", "_own")
