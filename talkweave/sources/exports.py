"""Reading folders of chat exports (one ``.txt`` file per workspace)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions.text import LINE_END
from talkweave.plans.ordered import block_of, dense_position

def file_name(folders: int) -> str:
    """Pattern of a workspace's name: that of its file, led by as many of its folders."""
    return rf"((?:[^/]+/){{{folders}}}[^/]+)\.txt$"


def read_exports(spark: SparkSession, path: str | list[str], folders: int = 0) -> DataFrame:
    """``workspace_id, text`` of every export; UTF-8, or Latin-1 when a file is not valid UTF-8.

    Files of equal names in several folders are workspaces of their own where ``folders`` says how many
    parent folders tell them apart.  One row per file, so a file must fit a task; ``read_export_lines`` has no such bound.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    as_text = F.col("content").cast("string")
    return raw.select(
        F.regexp_extract("path", file_name(folders), 1).alias("workspace_id"),
        F.when(F.is_valid_utf8(as_text), as_text)
        .otherwise(F.decode("content", "ISO-8859-1"))
        .alias("text"),
    )


def explode_lines(exports: DataFrame) -> DataFrame:
    """``workspace_id, seq, line``: one row per line, numbered from 0.

    Line separators other than LF (vertical tab, form feed, U+0085, U+2028 and so on) end a line too.
    """
    return exports.select(
        "workspace_id", F.posexplode(F.split("text", LINE_END)).alias("seq", "line")
    ).withColumn("seq", F.col("seq").cast("bigint"))


def read_export_lines(spark: SparkSession, path: str | list[str], folders: int = 0) -> DataFrame:
    """Lines of exports of any size: files are split across tasks like any text input.

    A line's place is its split's offset in the file plus its order inside the split, so
    numbering needs no task that sees a whole file.
    """
    raw = spark.read.option("pathGlobFilter", "*.txt").text(path)
    # Metadata gives the path as a URI; a plus sign there is a plus sign.
    file_path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    lines = raw.select(
        F.regexp_extract(file_path, file_name(folders), 1).alias("workspace_id"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("line"),
    )
    latin = lines.groupBy("workspace_id").agg(
        (~F.bool_and(F.is_valid_utf8("line"))).alias("_latin")
    )
    decoded = lines.join(latin, "workspace_id").withColumn(
        "line",
        F.when(F.col("_latin"), F.decode(F.col("line").cast("binary"), "ISO-8859-1")).otherwise(F.col("line")),
    )
    split = decoded.select("workspace_id", "_start", "_row", F.posexplode(F.split("line", LINE_END)).alias("_sub", "line"))
    numbered = dense_position(
        split, ["workspace_id"], [F.col("_row"), F.col("_sub")], [F.col("_start"), block_of("_row")], out="seq"
    )
    return numbered.select("workspace_id", "seq", "line")
