"""Voice samples: short two-person exchanges that show how someone writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions.text import bind, has_two_words, is_noise, is_pure_ack, strip, topic_marks, topic_of_marks
from talkweave.plans.ordered import top_rows, with_neighbours
from talkweave.schema import BLOCK_ROWS
from talkweave.session import materialise

WS = "workspace_id"
PERSON = [WS, "sender"]
SAME = 0.6
# Bits of a message that voice candidates ask for.
WORDY, SAYS, LONG, CONTENT = 1, 2, 4, 8

__all__ = ["dialogue_text", "exchange_score", "labelled_samples", "materialise", "shortlist", "voice_candidates", "voice_samples"]


def _facts(text: Column) -> Column:
    """What the rules below ask of a stripped message, as bits: so each message is read once, not once per window."""
    ack = is_pure_ack(text)
    asked = {WORDY: has_two_words(text), SAYS: (F.length(text) > 10) & ~ack, LONG: F.length(text) > 15, CONTENT: ~ack}
    return sum((F.when(holds, bit).otherwise(0) for bit, holds in asked.items()), F.lit(0))


def _has(message: Column, fact: int) -> Column:
    return message["facts"].bitwiseAND(F.lit(fact)) != 0


def voice_candidates(line: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Exchanges of at most four messages around every own message.

    The window starts one row before the message and looks at ten rows; reading stops at a
    third sender.  Both sides must speak, no message may be a single word, and one own
    message must say something.
    """
    text = F.col("text")
    read = line.select(WS, "pos", "sender", F.when(~is_noise(text), strip(text)).alias("text"))
    # A null entry keeps its place in the ten rows while its text is skipped.
    said = F.when(
        F.col("text").isNotNull(),
        F.struct("sender", "text", _facts(F.col("text")).alias("facts"), topic_marks(F.col("text")).alias("marks")),
    )
    near = with_neighbours(read.select(WS, "pos", "sender", said.alias("_said")), "pos", 1, 9, block)
    w = Window.partitionBy(WS, "_blk").orderBy("pos").rowsBetween(-1, 9)
    rows = near.withColumn("_rows", F.collect_list(F.struct("_said")).over(w))
    anchors = rows.filter(F.col("_own") & F.col("_said").isNotNull())

    def two_sided(first: Column) -> Column:
        """``first``, at most four messages, up to a third sender."""

        def cut(others: Column) -> Column:
            third = F.filter(others, lambda m: ~m["sender"].eqNullSafe(F.get(others, F.lit(0))["sender"]))
            return F.when(F.size(third) == 0, first).otherwise(
                F.slice(first, 1, F.array_position(first, F.get(third, F.lit(0))).cast("int") - 1)
            )

        return bind(F.filter(first, lambda m: ~m["sender"].eqNullSafe(F.get(first, F.lit(0))["sender"])), cut)

    def is_sample(exchange: Column) -> Column:
        own = lambda m: m["sender"] == F.col("sender")
        both = F.exists(exchange, lambda m: ~m["sender"].eqNullSafe(F.col("sender")))
        return both & F.forall(exchange, lambda m: _has(m, WORDY)) & F.exists(exchange, lambda m: own(m) & _has(m, SAYS))

    # Exploding a list of none or one builds the exchange once; a filter on it, also the one an
    # inner explode implies, would build it again.
    spoken = F.filter(F.transform(F.slice("_rows", 1, 10), lambda r: r["_said"]), lambda m: m.isNotNull())
    folded = bind(F.slice(spoken, 1, 4), two_sided)
    kept = anchors.select(
        *PERSON, "pos", F.explode_outer(F.filter(F.array(folded), is_sample)).alias("_exchange")
    ).filter(F.col("_exchange").isNotNull())
    person = F.col("sender")
    return kept.select(
        *PERSON, "pos",
        F.transform("_exchange", lambda m: F.struct(m["sender"].alias("sender"), m["text"].alias("text"))).alias("exchange"),
        topic_of_marks(F.transform("_exchange", lambda m: m["marks"])).alias("topic"),
        _points("_exchange", person, lambda m: _has(m, LONG), lambda m: _has(m, CONTENT)).alias("score"),
    )


def _points(exchange: Column, person: Column, is_long: Callable, is_content: Callable) -> Column:
    mine = F.filter(exchange, lambda m: m["sender"] == person)
    long_ones = F.size(F.filter(mine, is_long))
    other = F.exists(exchange, lambda m: m["sender"] != person)
    content = F.exists(mine, is_content)
    return (
        F.when(F.size(mine) >= 2, 2).otherwise(0)
        + long_ones
        + F.when(other, 1).otherwise(0)
        + F.when(content, 2).otherwise(0)
    ).cast("bigint")


def exchange_score(exchange: Column, person: Column) -> Column:
    """Points for how much the person says; the other side's words do not count."""
    return _points(exchange, person, lambda m: F.length(strip(m["text"])) > 15, lambda m: ~is_pure_ack(m["text"]))


def _texts(exchange: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(exchange, lambda m: m["text"])))


def _alike(a: Column, b: Column) -> Column:
    """More than 60 % of the texts in common, for two sets of distinct texts."""
    return bind(
        F.size(F.array_intersect(a, b)), lambda both: both > SAME * (F.size(a) + F.size(b) - both)
    )


def shortlist(pool: DataFrame, at_least: int) -> DataFrame:
    """``pos`` of those rows of ``pool`` (one per person and set of texts) from which the scan of ``voice_samples`` may add.

    ``keys`` are hashes of a set without one of its texts; a set of one or two has a key of its own.

    An exchange has at most four texts, so one that is kept shuts out itself, sets with one text less, and the sets
    that hold it and one text more, which may be any number.  Of the sets with a common subset of that kind (a key)
    at most four are shut out unless the subset itself is kept, and then all are.  Fewer than ``at_least`` are kept
    before each addition.  So where ``5 * at_least`` better sets have a key in common with a candidate, one of them
    is added before it; and of what is left, ``at_least`` kept ones shut out fewer than ``at_least * (cap + 6)``.
    Both are ranks that Spark cuts in the map tasks, and only they are shuffled, without the exchanges.
    """
    cap = 5 * at_least
    order = [F.col("score").desc(), F.col("pos")]
    keyed = pool.select(*PERSON, "pos", "score", F.size("keys").alias("held"), F.explode("keys").alias("key"))
    near = top_rows(keyed, [*PERSON, "key"], order, cap).groupBy(*PERSON, "pos", "score", "held").agg(F.count(F.lit(1)).alias("n"))
    left = near.filter("n = held").select(*PERSON, "pos", "score")
    return top_rows(left, PERSON, order, at_least * (cap + 6)).select(*PERSON, "pos")


def voice_samples(candidates: DataFrame, at_least: int = 5, at_most: int = 8) -> DataFrame:
    """``workspace_id, sender, samples``: the best exchange per topic, near copies dropped.

    People with fewer than ``at_least`` get more by a scan in score order that adds what is
    unlike all kept ones; it runs over a short list per person that holds all it can add,
    so a person with most of the candidates is no bottleneck.  Exchanges have at most four
    messages, as ``voice_candidates`` makes them.

    What is chosen is chosen by numbers and hashes; then the exchanges of the chosen rows are
    fetched by ``pos``.  ``candidates`` are read three times, so they had better be stored.
    """
    # Exchanges of equal texts shut each other out, so only the best of them can be picked.
    subsets = F.transform("texts", lambda t: F.xxhash64(F.array_remove("texts", t)))
    hashed = candidates.select(*PERSON, "pos", "score", F.explode(F.array(_texts(F.col("exchange")))).alias("texts")).select(
        *PERSON, "pos", "score",
        F.xxhash64("texts").alias("print"),
        F.xxhash64(F.lit(1), "texts").alias("second_print"),
        F.when(F.size("texts") > 2, subsets).otherwise(F.array(F.xxhash64(F.lit(2), "texts"))).alias("keys"),
    )
    one_set = [*PERSON, "print", "second_print", "keys"]
    pool = hashed.groupBy(*one_set, "score").agg(F.min("pos").alias("pos")).groupBy(*one_set).agg(
        F.max_by("pos", "score").alias("pos"), F.max("score").alias("score")
    )
    best = candidates.groupBy(*PERSON, "topic", "score").agg(F.min("pos").alias("pos")).groupBy(*PERSON, "topic").agg(
        F.max_by("pos", "score").alias("pos"), F.min("pos").alias("first_pos")
    )
    listed = shortlist(pool, at_least).withColumn("first_pos", F.lit(None).cast("bigint"))
    chosen = best.select(*PERSON, "pos", "first_pos", F.lit(False).alias("listed")).unionByName(listed.withColumn("listed", F.lit(True)))
    chosen = chosen.groupBy(*PERSON, "pos").agg(F.max("first_pos").alias("first_pos"), F.max("listed").alias("listed"))
    fetched = candidates.select(*PERSON, "pos", "exchange", "score").join(chosen, [*PERSON, "pos"]).withColumn("texts", _texts(F.col("exchange")))
    down = (-F.col("score")).alias("down")
    lists = fetched.groupBy(*PERSON).agg(
        F.array_sort(F.collect_list(F.when(F.col("first_pos").isNotNull(), F.struct(down, "first_pos", "exchange", "texts")))).alias("_best"),
        F.array_sort(F.collect_list(F.when(F.col("listed"), F.struct(down, "pos", "exchange", "texts")))).alias("_more"),
    )
    empty = F.array().cast(
        "array<struct<exchange:array<struct<sender:string,text:string>>,texts:array<string>,score:bigint>>"
    )

    def keep(acc: Column, item: Column) -> Column:
        copy = F.exists(acc, lambda k: _alike(k["texts"], item["texts"]))
        entry = F.struct(item["exchange"].alias("exchange"), item["texts"].alias("texts"), (-item["down"]).alias("score"))
        return F.when(copy, acc).otherwise(F.array_append(acc, entry))

    def add(acc: Column, item: Column) -> Column:
        there = F.exists(acc, lambda k: _alike(k["texts"], item["texts"]))
        entry = F.struct(item["exchange"].alias("exchange"), item["texts"].alias("texts"), F.lit(0).cast("bigint").alias("score"))
        return F.when((F.size(acc) >= at_least) | there, acc).otherwise(F.array_append(acc, entry))

    kept = F.aggregate("_best", empty, keep)
    return lists.select(*PERSON, F.slice(F.aggregate("_more", kept, add), 1, at_most).alias("samples"))


def labelled_samples(samples: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per sample with its context label; the default names the speaker."""
    rows = samples.select(*PERSON, F.posexplode("samples").alias("sample_no", "sample")).select(
        *PERSON, "sample_no", F.col("sample.exchange").alias("exchange"), F.col("sample.score").alias("score")
    )
    default = F.concat(F.trim(F.split("sender", ",")[0]), F.lit(" speaking"))
    if labels is None:
        return rows.withColumn("context", default)
    return rows.join(labels, [*PERSON, "sample_no"], "left").withColumn("context", F.coalesce("context", default))


def dialogue_text(sample_rows: DataFrame) -> DataFrame:
    """Samples of a person as dialogue blocks, at most eight per person."""
    said = F.transform("exchange", lambda m: F.concat(m["sender"], F.lit(": "), m["text"]))
    block = F.concat(F.lit("["), "context", F.lit("]\n"), F.array_join(said, "\n"))
    return (
        sample_rows.withColumn("_block", block)
        .groupBy(*PERSON)
        .agg(F.expr("listagg(_block, '\n\n') WITHIN GROUP (ORDER BY sample_no)").alias("dialogue"))
    )
