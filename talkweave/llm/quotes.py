"""Conversations in reply order, without quoted text.

A line's quote level is the number of ``>`` it starts with (spaces between them allowed).  Lines in a row of one level
over zero are a passage; it is normalised (lower case, white space to single spaces).  A message has a passage if its
own lines hold it from the start of one to the end of the same or a later one, whatever the line breaks between: its
text, paragraphs, lines, or any run of lines, quotes between them left out.  A passage's original is the latest earlier
message of its conversation that has it, or else the first message of any other conversation that has it.  The shallowest, then longest passage
with an original decides what a message replies to; a reply goes under its original, and a conversation is read by the
path of turns from its first message down.  An attribution line (``... wrote:``) just above a quote goes with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import bind
from talkweave.llm.rows import col, cut

MARKS = r"^((?:\s?>)+)\s?"
#: Characters by which a passage and the lines it may start at find each other.
KEY = 32


def levels(text: Column) -> Column:
    """``level, line`` of each line, the marks removed."""

    def one(line):
        marks = F.regexp_extract(line, MARKS, 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(line, MARKS, "").alias("line"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _attribution(lines: Column) -> Column:
    """Whether each line says whose words follow and a quote does follow."""
    following = F.concat(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), F.slice(lines, F.size(lines), F.lit(1)))
    return F.zip_with(
        lines, following,
        lambda a, b: F.struct(a["level"].alias("level"), a["line"].alias("line"), ((a["level"] == 0) & (b["level"] > 0) & a["line"].rlike(r"\S.*:\s*$")).alias("drop")),
    )


def _passages(lines: Column) -> Column:
    """Runs of equal level as ``level, text``."""
    def cut_at(held: Column, starts: Column) -> Column:
        def passage(at, i):
            after = F.coalesce(F.get(starts, i + 1), F.size(held) + 1)
            own = F.transform(F.slice(held, at, after - at), lambda x: x["line"])
            return F.struct(F.element_at(held, at)["level"].alias("level"), F.array_join(own, "\n").alias("text"))

        return F.transform(starts, passage)

    def starts(held: Column) -> Column:
        level = lambda i: F.get(held, i - 1)["level"]
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1))), lambda i: (i == 1) | (level(i) != level(i - 1)))
        return F.when(F.size(held) > 0, places).otherwise(F.array().cast("array<int>"))

    return bind(F.filter(lines, lambda x: ~x["drop"]), lambda held: bind(starts(held), lambda found: cut_at(held, found)))


def _keys(lines: Column, at: Column) -> Column:
    """What a passage starting at line ``at`` (from 1) may begin with: ``KEY`` characters, or all of a shorter run of lines."""
    line = F.element_at(lines, at)
    runs = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(KEY), F.size(lines) - at + 1)), lambda n: F.substring(F.concat_ws(" ", F.slice(lines, at, n)), 1, KEY)
    )
    return F.when(F.length(line) >= KEY, F.array(F.substring(line, 1, KEY))).otherwise(F.array_distinct(runs))


def _offered(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """``conv_id, turn, hash`` of the runs of own lines that have the key and the length of a passage in ``asked``."""
    lines = F.filter(F.transform(F.split("text", "\n"), normal), lambda x: x != "")
    said = messages.select("conv_id", "turn", F.xxhash64("text").alias("of"), lines.alias("lines")).where(F.size("lines") > 0)
    # Keys are made before the rows multiply, so that none of these carries the whole message.
    heads = F.transform("lines", lambda x: F.substring(x, 1, KEY))
    keys = bind(heads, lambda h: F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: F.struct(i.alias("at"), _keys(F.slice(h, i, F.lit(KEY)), F.lit(1)).alias("keys"))))
    starts = said.select("conv_id", "turn", "of", F.explode(keys).alias("s")).select("conv_id", "turn", "of", "s.at", F.explode("s.keys").alias("key"))
    found = starts.join(asked.select("key", "size").distinct(), "key")
    found = found.groupBy("conv_id", "turn", "of").agg(F.collect_set(F.struct("at", "size")).alias("runs"))
    # Lines have at least one character, so these hold ``size`` characters and the break behind them, or end the text.
    ends = lambda text, size: (F.length(text) == size) | (F.substring(text, size + 1, F.lit(1)) == "\n")
    hashed = lambda text, size: F.sha2(F.translate(F.substring(text, F.lit(1), size), "\n", " "), 256)

    def run_hash(run: Column) -> Column:
        text = F.concat_ws("\n", F.slice("lines", run["at"], run["size"]))
        return bind(text, lambda t: F.when(ends(t, run["size"]), hashed(t, run["size"])))

    runs = said.join(found, ["conv_id", "turn", "of"]).select("conv_id", "turn", F.explode_outer(F.array_distinct(F.transform("runs", run_hash))).alias("hash"))
    return runs.where("hash is not null")


def link_quotes(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, turn, role, text, n_quotes, source_conv, source_turn, path`` per message.

    ``text`` is without quotes, ``n_quotes`` the number of passages, ``source_*`` the message replied to (null: none found)
    and ``path`` the turns from the start of the thread inside the conversation; ordering by ``conv_id, path`` gives
    the conversation in reply order.  Null texts are empty.  Rows that agree in conversation, turn, role and text are one message;
    rows of one turn that differ keep their own rows and the smaller text is the original.  Null conversations or turns
    are kept and neither quote nor are quoted.
    """
    rows = messages.select(col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), col(role_col).alias("role"), col(text_col).alias("text")).distinct()
    lined = rows.withColumn("lines", _attribution(levels(F.col("text"))))
    own = F.array_join(F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~x["drop"]), lambda x: x["line"]), "\n")
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    passages = F.when(quoted, F.filter(_passages(F.col("lines")), lambda p: (p["level"] > 0) & (F.length(F.trim(p["text"])) > 0)))
    body = F.when(quoted, F.trim(F.regexp_replace(own, r"\n{3,}", "\n\n"))).otherwise(F.coalesce("text", F.lit("")))
    parsed = cut(lined.select("conv_id", "turn", "role", body.alias("text"), passages.alias("passages")))
    asked = parsed.where("conv_id is not null and turn is not null and passages is not null").select(
        "conv_id", "turn", F.posexplode("passages").alias("place", "p")
    )
    said_text = normal(F.col("p.text"))
    asked = cut(asked.select(
        "conv_id", "turn", "p.level", F.length("p.text").alias("chars"), "place", F.sha2(said_text, 256).alias("hash"),
        F.substring(said_text, 1, KEY).alias("key"), F.length(said_text).alias("size"),
    ).where("size > 0").distinct())
    said = _offered(parsed.where("conv_id is not null and turn is not null"), asked)
    asked = asked.drop("key", "size")
    wanted = asked.select("hash").distinct()
    said = cut(said.join(wanted, "hash", "left_semi").distinct())
    here = asked.join(said.withColumnRenamed("turn", "found"), ["conv_id", "hash"]).where("found < turn")
    here = here.groupBy("conv_id", "turn", "level", "chars", "place").agg(F.max("found").alias("found"))
    first = said.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    keys = ["conv_id", "turn", "level", "chars", "place"]
    sources = asked.join(first, "hash", "left").join(here, keys, "left")
    there = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first"))
    sources = sources.select(
        *keys, F.when(F.col("found").isNotNull(), F.struct("conv_id", F.col("found").alias("turn"))).otherwise(there).alias("source")
    ).where("source is not null")
    best = sources.groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("chars"), "place", "source")).alias("best")).select("conv_id", "turn", "best.source")
    replies = best.where(F.col("source.conv_id") == F.col("conv_id")).select("conv_id", F.col("turn").alias("at"), F.col("source.turn").alias("up"))
    paths = _paths(replies)
    out = parsed.join(best, ["conv_id", "turn"], "left").join(paths.withColumnRenamed("at", "turn"), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "text", F.coalesce(F.size("passages"), F.lit(0)).cast("bigint").alias("n_quotes"),
        F.col("source.conv_id").alias("source_conv"), F.col("source.turn").alias("source_turn"), F.coalesce("path", F.array("turn")).alias("path"),
    )


def _paths(replies: DataFrame) -> DataFrame:
    """``conv_id, at, path`` of each reply: the turns from its thread's start to it.  Steps double each round."""
    steps = cut(replies.select("conv_id", "at", "up", F.array("at").alias("path")))
    while not steps.where("up is not null").isEmpty():
        upper = steps.select("conv_id", F.col("at").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        joined = steps.join(upper, ["conv_id", "up"], "left")
        whole = F.when(F.col("up").isNull(), F.col("path")).when(F.col("before").isNull(), F.concat(F.array("up"), "path")).otherwise(F.concat("before", "path"))
        steps = cut(joined.select("conv_id", "at", F.when(F.col("before").isNotNull(), F.col("next")).alias("up"), whole.alias("path")))
    return steps.select("conv_id", "at", "path")


