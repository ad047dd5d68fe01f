"""Request rows for a model outside, and merging what it returns into profiles.

The contract with the model is two tables, requests out and responses in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import token_estimate

PERSON = ["workspace_id", "sender"]

TASKS: Mapping[str, str] = {
    "personality": "From the messages below, say in a few sentences what kind of person {name} is.",
    "writing_style": "List the habits that mark how {name} writes: length, tone, spelling, emojis.",
    "chat_analysis": "Note every pattern you see in this batch of messages by {name}.",
    "chat_analysis_merge": "Merge these notes on {name} into one short description.",
    "relationship": "Describe how {name} relates to the people in these exchanges and what moves them.",
    "typing": "Describe how {name} types as JSON: capitals, abbreviations, emojis, punctuation.",
    "responses": "Say how {name} tends to answer, and on which topics, from these exchanges.",
    "sample_labels": "Give each exchange a label of two to four words for what {name} does in it.",
    "listening": "Say how {name} reacts when others share news or trouble.",
}


def prompt_rows(sampled: DataFrame, tasks: Mapping[str, str] = TASKS) -> DataFrame:
    """One request per person and task: instruction, then the sampled exchanges in order.

    ``sampled`` holds a bounded sample per person (``pos``, ``exchange``).
    """
    body = sampled.groupBy(*PERSON).agg(
        F.expr("listagg(exchange, '\n\n') WITHIN GROUP (ORDER BY pos)").alias("body")
    )
    task = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(i).alias("text")) for t, i in tasks.items()]))
    rows = body.withColumn("_task", task)
    instruction = F.replace(F.col("_task.text"), F.lit("{name}"), F.col("sender"))
    prompt = F.concat(instruction, F.lit("\n\n"), "body")
    return rows.select(
        *PERSON,
        F.col("_task.task").alias("task"),
        F.sha2(F.concat_ws("␟", *PERSON, F.col("_task.task")), 256).alias("request_id"),
        prompt.alias("prompt"),
        token_estimate(prompt).alias("est_tokens"),
    )


# Fixed value: sections dropped in this order while the prompt is too long.
DROP_ORDER = ("listening", "analysis", "writing", "personality")


def cap_sections(
    sections: DataFrame, kept: Sequence[str], limit: int = 2500, order: Sequence[str] = DROP_ORDER
) -> DataFrame:
    """Blank out whole sections in ``order`` until the rest fits ``limit`` characters.

    Adds ``size`` before and ``capped_size`` after; ``kept`` are sections never dropped.
    """
    def size(name: str) -> Column:
        return F.length(F.coalesce(F.col(name), F.lit("")))

    total = sum((size(c) for c in (*kept, *order)), F.lit(0))
    out = sections.withColumn("size", total.cast("bigint")).withColumn("capped_size", F.col("size"))
    for name in order:
        out = out.withColumn("_drop", F.col("capped_size") > limit)
        out = out.withColumn(
            "capped_size", F.when(F.col("_drop"), F.col("capped_size") - size(name)).otherwise(F.col("capped_size"))
        ).withColumn(name, F.when(F.col("_drop"), F.lit("")).otherwise(F.coalesce(F.col(name), F.lit(""))))
    return out.drop("_drop")


def cap_samples(sections: DataFrame, samples: str, limit: int = 2500, keep: int = 3) -> DataFrame:
    """Cut a sample array to its first ``keep`` entries where the prompt is still too long."""
    return sections.withColumn(
        samples, F.when(F.col("capped_size") > limit, F.slice(samples, 1, keep)).otherwise(F.col(samples))
    )


def merge_profiles(people: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Profile with new values where the response brought one; a failed response keeps the old."""
    fields = [c for c in updates.columns if c not in keys]
    fresh = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    merged = people.join(fresh, list(keys), "left")
    for c in fields:
        old = F.col(c) if c in people.columns else F.lit(None)
        merged = merged.withColumn(c, F.coalesce(F.col(f"_new_{c}"), old))
    return merged.drop(*[f"_new_{c}" for c in fields])
