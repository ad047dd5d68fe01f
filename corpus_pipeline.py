"""A corpus pipeline of five stages; each works on all rows that the one before kept.

``STAGES`` holds ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import contamination, jaccard, lines, mixture, repetition
from talkweave.llm.rows import col, cut, text_batches, unused, with_decisions


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits on long repeats.

    Null and empty texts have too few words and go.  Repeated rows each get the same verdict; no rows give no rows.
    """
    name = unused(docs, "repeats")
    return text_batches(docs).withColumn(name, repetition.repetition(F.col("text"))).where(repetition.kept(name)).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more have; ``n_chars``, where there, follows the new text.

    A null or empty text is one empty line, which always stays, so it becomes empty.  Repeated rows count each; no rows give no rows.
    """
    found, parts = lines.drop_shared_lines(docs)
    out = found.withColumn("text", parts["text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id, null last, then of the smallest digest.

    Of rows equal in id and text, the one whose other columns are smallest stays.
    """
    found = jaccard.near_copies(docs, percent=80, width=5)
    chosen = found.where("first").select("id", "digest").distinct()
    kept = with_decisions(docs, chosen, "doc_id", "text", "left_semi")
    digest = unused(kept, "digest")
    row = F.min(F.struct(*map(col, docs.columns))).alias("row")
    return kept.groupBy("doc_id", F.xxhash64("text").alias(digest)).agg(row).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts hold none and stay, as all do where the benchmark is empty.  Repeated rows share their verdict; no
    rows give no rows.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.contamination(docs, items)
    return with_decisions(docs, found.where("n_hit > 0").select("id", "digest").distinct(), "doc_id", "text", "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, with its shard and its place there.

    Null and empty texts have no words, so none of them is taken.  A null source is a source of its own; no rows give no rows.
    """
    plan = cut(mixture.mix(docs))
    return mixture.mixed_rows(docs, plan)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
]

# Components of links and the seeded draws of the mix are beyond plain SQL; tests state them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
