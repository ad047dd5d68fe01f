"""Exact copies of texts, found with two-bit counting filters; Spark functions only.

The first pass reads every text once: white space is deleted and the rest becomes a digest.  Each digest has two
places in a filter, and each place counts whether it was taken once or twice; the places taken twice are kept as
bitmap pages.  The second pass looks the digests up there: a digest that occurs twice has taken both of its places
twice, so a row with a place that was taken once has no copy and goes straight through.  Only the other rows are
shuffled, as digests without their texts, and grouped exactly.

The filter has sixteen bits a row, at most ``max_bits``.  On more rows than ``max_bits / 16`` a growing share of
the rows is suspected without cause and shuffled; results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.rows import by_size, col, cut

SPACE = r"[\x20\x09-\x0D]+"
BITS_PER_ROW = 16
PAGE_BITS = 1 << 15


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _places(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("text_sha256", F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def _twice(rows: DataFrame, bits: int) -> DataFrame:
    """``page, bitmap`` of the places that were taken at least twice, at most ``bits / 8`` bytes."""
    taken = rows.select(F.explode(F.array(*_places(bits))).alias("place")).groupBy("place").count().where("count > 1")
    page, bit = (F.col("place") / PAGE_BITS).cast("int"), F.bitmap_bit_position(F.col("place") + 1)
    return taken.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))


def _is_set(bitmap: Column, place: Column) -> Column:
    bit = F.pmod(place, F.lit(PAGE_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, bit.bitwiseAND(7)) == 1, F.lit(False))


def suspected(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``suspect``: both places of their digest were taken twice."""
    pages = F.broadcast(cut(_twice(rows, bits)))
    first, second = _places(bits)
    marked = rows.withColumns({"place1": first, "place2": second})
    for i in ("1", "2"):
        own = pages.select(F.col("page").alias(f"page{i}"), F.col("bitmap").alias(f"bitmap{i}"))
        marked = marked.join(own, (F.col(f"place{i}") / PAGE_BITS).cast("int") == F.col(f"page{i}"), "left")
    both = _is_set(F.col("bitmap1"), F.col("place1")) & _is_set(F.col("bitmap2"), F.col("place2"))
    return marked.select(*rows.columns, both.alias("suspect"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), max_bits: int = 1 << 28) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, text_sha256, carried``.

    Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]``; a null text equals an empty one.  Of
    equal texts the row with the most code points in its original text stays, then the one of the smallest id (null
    comes last); of rows equal in both exactly one stays.  ``carried`` is a struct of the columns named in
    ``carry``, so their names may be any; other columns are ignored.  No rows give no rows.
    """
    rows = cut(
        docs.select(
            col(id_col).alias("id"), F.length(F.coalesce(col(text_col), F.lit(""))).alias("size"), F.sha2(F.encode(squeezed(col(text_col)), "UTF-8"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"), (F.struct(*map(col, carry)) if carry else F.lit(None).cast("struct<none:int>")).alias("carried"),
        )
    )
    n = rows.count()
    bits = min(max_bits, max(PAGE_BITS, 1 << (n * BITS_PER_ROW - 1).bit_length()) if n else PAGE_BITS)
    marked = suspected(rows, bits)
    alone = marked.where("not suspect").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "carried"
    )
    again = marked.where("suspect").drop("suspect")
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("last"), "id", "row")).alias("best")
    groups = cut(again.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best))
    found = by_size(again, groups, "text_sha256", "group_size", n)
    told = found.select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), "text_sha256", "carried")
    return alone.unionByName(told)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return exact_copies(docs, id_col, text_col, tuple(docs.columns), **options).where("kept").select("carried.*")
