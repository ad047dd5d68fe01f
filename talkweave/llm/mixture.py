"""Mixing of sources to target weights by whole documents.

Each source's words are cut into blocks of about ``block_words`` words by a seeded hash of the document, so a
source of any size is spread over many blocks.  A source is taken whole as often as its target allows; for the
rest, permuted blocks are drawn until the next would pass the target, and that one is filled document by document.
The blocks after it go on with the words still left, without the documents that are longer, and so on until no
document fits; one more is taken if that ends nearer.  What is not drawn by whole blocks is dealt as blocks of its own.
A splitting tree then deals the exact block quotas of all sources among the output shards: each node draws the
block counts of its left half from a multivariate hypergeometric law, so every shard gets equally many blocks and
no block goes to two.  Blocks follow the permuted order; inside a shard documents are ordered by a seeded hash.
All draws depend on the seed, the ids and the texts alone, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from talkweave.llm import words as w
from talkweave.llm.rows import col, cut, digest, text_batches, unused

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 1 << 16


@F.arrow_udf(LongType())
def _size(column: pa.Array) -> pa.Array:
    parts = [np.zeros(0, np.int64)]
    for low, high in w.slices(column):
        data, offsets = w.flat(column.slice(low, high - low))
        parts.append(w.counts(w.spans(data, offsets)[0], high - low))
    return pa.array(np.concatenate(parts), pa.int64())


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights go to the sources by code point, null last, over and over.  Targets share the total size by weight; one
    that would pass ``most`` times its source stops there and the excess is shared again.  Sources that stop are the
    first ones in the order of size for weight, so running sums find them; the windows hold one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    share = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", share.cast("decimal(38,0)")).withColumn("held", F.col("source_size").cast("decimal(38,0)"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scarce = Window.orderBy(F.col("held").cast("double") / F.col("weight").cast("double"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = scarce.rowsBetween(Window.unboundedPreceding, -1)
    d = lambda c: c.cast("decimal(38,0)")
    rows = rows.select(
        "source", "source_size", "weight", "held",
        d(F.sum("held").over(every) - most * F.coalesce(F.sum("held").over(before), F.lit(0))).alias("left"),
        d(F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"),
    )
    rows = rows.withColumn("stops", d(F.col("weight") * F.col("left")) > d(most * d(F.col("held") * F.col("weights"))))
    free = [F.max(F.when(~F.col("stops"), F.col("left"))).over(every), F.max(F.when(~F.col("stops"), F.col("weights"))).over(every)]
    shared = d(F.col("weight") * free[0]).cast("double") / free[1].cast("double")
    return rows.select("source", "source_size", F.when(F.col("stops"), (most * F.col("held")).cast("double")).otherwise(shared).alias("target"))


def _place(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Documents of one block, the larger ones first, as long as they fit."""
    group = group.sort_values(["size", "place", "digest"], ascending=[False, True, True], kind="stable")
    left = group["left"].iloc[0]
    taken = []
    for size in group["size"]:
        taken.append(size <= left)
        left -= size if taken[-1] else 0
    return group[np.array(taken, bool)][["number", "block", "place", "digest", "size"]]


def _upto(blocks: DataFrame) -> DataFrame:
    """``upto, fits, edge`` of permuted blocks with ``words`` that draw on ``left``: ``edge`` is the first that does not fit."""
    blocks = blocks.withColumn("upto", F.sum("words").over(Window.partitionBy("number").orderBy("turn")))
    blocks = blocks.withColumn("fits", F.col("upto") <= F.col("left"))
    return blocks.withColumn("edge", ~F.col("fits") & (F.col("upto") - F.col("words") <= F.col("left")))


def _late(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``number, block, place, digest, size`` of the documents drawn one by one once ``blocks`` are drawn that fit.

    ``docs`` holds one row per document with words, with ``turn`` and ``left`` of its block.  A round draws the documents that
    fit in the words left: by whole blocks as far as they go, then out of the edge block.  No document up to that block
    fits any more then, so the next round starts behind it.  A round uses at least half the words left, so rounds are few.
    """
    keys = ["number", "block", "place", "digest", "size"]
    level, fit, first, late = blocks, docs.where("size <= left"), True, []
    while first or not level.isEmpty():
        edge = level.where("edge").select("number", "block", (F.col("left") - F.col("upto") + F.col("words")).alias("left"))
        filled = fit.drop("left").join(edge, ["number", "block"]).groupBy("number", "block").applyInPandas(
            _fill, "number bigint, block bigint, place bigint, digest bigint, size bigint"
        )
        if not first:
            filled = filled.unionByName(fit.join(level.where("fits").select("number", "block"), ["number", "block"], "left_semi").select(keys))
        late.append(cut(filled))
        spent = late[-1].groupBy("number").agg(F.sum("size").alias("spent"))
        of_blocks = F.max(F.when(F.col("fits"), F.col("upto"))) if first else F.lit(None)
        state = level.groupBy("number").agg(
            F.first("left").alias("left"), F.coalesce(of_blocks, F.lit(0)).alias("drawn"), F.max(F.when(F.col("edge"), F.col("turn"))).alias("after")
        )
        state = state.join(spent, "number", "left").select("number", (F.col("left") - F.col("drawn") - F.coalesce("spent", F.lit(0))).alias("left"), "after")
        # A source without an edge has drawn all that fits.
        now = cut(state)
        lefts = now if first else cut(lefts.join(now, "number", "left_anti").unionByName(now))
        fit = docs.drop("left").join(F.broadcast(now.where("after is not null and left > 0")), "number").where("turn > after and size <= left")
        level = fit.groupBy("number", "block", "turn").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        level, first = cut(_upto(level)), False
    out = late[0]
    for more in late[1:]:
        out = out.unionByName(more)
    drawn = blocks.where("fits").select("number", "block", F.col("left").alias("under"))
    rest = docs.drop("left").join(F.broadcast(lefts.select("number", "left")), "number").where("size > left and size < 2 * left")
    rest = rest.join(drawn, ["number", "block"], "left").where("under is null or size > under").join(out, keys, "left_anti")
    nearer = rest.groupBy("number").agg(F.min(F.struct("size", "place", "digest", "block")).alias("x"))
    return cut(out.unionByName(nearer.select("number", "x.block", "x.place", "x.digest", "x.size")))


def _split(seed: int):
    """Nodes of one level of the tree become their halves; a node of one shard stays."""

    def run(frames):
        for frame in frames:
            out = []
            for node in frame.itertuples(index=False):
                if node.shards == 1:
                    out.append(node)
                    continue
                quota = np.array(node.quota, np.int64)
                half = node.shards // 2
                left_size = int(quota.sum()) * half // node.shards
                rng = np.random.default_rng([seed, node.first, node.shards])
                left = np.zeros_like(quota)
                if left_size:
                    left = rng.multivariate_hypergeometric(quota, left_size, method="marginals")
                before = np.array(node.start, np.int64)
                out.append(node._replace(shards=half, quota=left.tolist()))
                out.append(node._replace(first=node.first + half, shards=node.shards - half, quota=(quota - left).tolist(), start=(before + left).tolist()))
            yield pd.DataFrame(out, columns=frame.columns)

    return run


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard, number, start, quota``: the blocks ``start .. start + quota - 1`` of source ``number`` go to the shard.

    ``quotas`` holds ``number`` (0, 1, ... without gaps) and ``quota``.  Nodes of a level are rows, split independently.
    """
    listed = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "quota"))), lambda x: x["quota"]).alias("quota"))
    nodes = listed.where(F.size("quota") > 0).select(
        F.lit(0).cast("bigint").alias("first"), F.lit(shards).cast("bigint").alias("shards"), "quota",
        F.transform("quota", lambda _: F.lit(0).cast("bigint")).alias("start"),
    )
    schema = "first bigint, shards bigint, quota array<bigint>, start array<bigint>"
    for level in range((shards - 1).bit_length()):
        if level and level % 8 == 0:
            nodes = nodes.repartition("first")
        nodes = nodes.mapInPandas(_split(seed), schema)
    cells = nodes.select(F.col("first").alias("shard"), F.posexplode(F.arrays_zip("start", "quota")).alias("number", "x"))
    return cells.select("shard", F.col("number").cast("bigint").alias("number"), "x.start", "x.quota").where("quota > 0")


def mix(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 7,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: ``id, digest, source, size, source_size, target, taken, shards``.

    ``size`` is the number of words (null: 0); ``shards`` names the shard of each copy the mix takes, so ``taken`` is
    its length times ``size`` and never over ``most`` times it.  Rows equal in id, text and source are one document of
    the mix that is taken together, each row with its own size.  A null source is a source, the last.  Empty documents
    come along where their block is drawn.  No rows give no rows.
    """
    rows = text_batches(docs).select(
        col(id_col).alias("id"), digest(col(text_col)).alias("digest"), col(source_col).alias("source"), _size(col(text_col)).alias("size")
    )
    rows = cut(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, most)
    aims = aims.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))).cast("bigint") - 1)
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    aims = cut(
        aims.withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("bigint")).withColumn(
            "blocks", F.ceil(F.greatest(F.lit(1), F.col("source_size")) / F.lit(block_words)).cast("bigint")
        )
    )
    placed = rows.join(aims.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    placed = placed.withColumn("place", _place(seed, F.col("id"), F.col("digest")))
    placed = placed.withColumn("block", F.pmod("place", "blocks"))
    # A document is all rows equal in id, text and source; one longer than the rest does not count in its block.
    units = cut(placed.groupBy("number", "block", "place", "digest").agg(F.sum("size").alias("size"), F.first("rest").alias("left"), F.first("whole").alias("whole")))
    short = F.col("size") <= F.col("left")
    blocks = units.groupBy("number", "block").agg(
        F.sum(F.when(short, F.col("size")).otherwise(0)).alias("words"), F.count(F.when(~short, 1)).alias("long"),
        F.first("left").alias("left"), F.first("whole").alias("whole"),
    )
    drawn = Window.partitionBy("number").orderBy(_place(seed + 1, F.col("number"), F.col("block")), "block")
    blocks = _upto(blocks.withColumn("turn", F.row_number().over(drawn)))
    blocks = blocks.withColumn("fits", F.col("fits") & ((F.col("words") > 0) | (F.col("long") == 0)))
    blocks = cut(blocks.withColumn("draws", F.col("whole") + F.col("fits").cast("int")))
    late = _late(units.drop("whole").where("size > 0 and left > 0").join(blocks.select("number", "block", "turn"), ["number", "block"]), blocks)
    # Documents drawn one by one make blocks of their own, numbered below zero.
    n_late = late.groupBy("number").agg(F.greatest(F.lit(1), F.round(F.sum("size") / F.lit(block_words))).cast("bigint").alias("n"))
    late = late.join(F.broadcast(n_late), "number").withColumn("home", -1 - F.pmod(_place(seed + 3, F.col("place"), F.col("digest")), "n")).drop("n", "size")
    # Passes one after another: pass p has the blocks with more than p draws, in their permuted order.
    passes = blocks.where("draws > 0").select("number", "block", "turn", F.explode(F.sequence(F.lit(1), "draws")).alias("pass"))
    own = late.select("number", F.col("home").alias("block")).distinct()
    passes = passes.unionByName(own.select("number", "block", (-F.col("block")).alias("turn"), F.lit(most + 1).alias("pass")))
    order = Window.partitionBy("number").orderBy("pass", "turn")
    passes = passes.withColumn("turn", F.row_number().over(order).cast("bigint") - 1)
    quotas = aims.select("number").join(passes.groupBy("number").agg(F.count("*").alias("quota")), "number", "left").select(
        "number", F.coalesce("quota", F.lit(0)).cast("bigint").alias("quota")
    )
    dealt = splitting_tree(quotas, shards, seed).select(
        "number", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("turn")
    )
    homes = passes.join(dealt, ["number", "turn"]).groupBy("number", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("homes")
    )
    homes = cut(homes)
    decided = blocks.where("draws > 0").select("number", "block", F.col("whole").alias("times"), "fits").join(homes, ["number", "block"])
    late = late.join(homes.select("number", F.col("block").alias("home"), F.col("homes").alias("own")), ["number", "home"]).drop("home")
    # Of a block drawn whole, documents longer than the rest stay behind.
    long = units.where("size > left").join(blocks.where("fits and long > 0").select("number", "block"), ["number", "block"], "left_semi")
    odd = late.select("number", "block", "place", "digest", "own", F.lit(False).alias("long")).unionByName(
        long.select("number", "block", "place", "digest", F.array().cast("array<bigint>").alias("own"), F.lit(True).alias("long"))
    )
    odd = odd.groupBy("number", "block", "place", "digest").agg(F.max("own").alias("own"), F.max("long").alias("long"))
    out = placed.join(decided, ["number", "block"], "left")
    out = out.join(odd, ["number", "block", "place", "digest"], "left")
    none = F.array().cast("array<bigint>")
    homes = F.coalesce(F.when(F.col("long"), F.slice("homes", F.lit(1), F.col("times"))).otherwise(F.col("homes")), none)
    homes = F.concat(homes, F.coalesce("own", none))
    return out.select("id", "digest", "source", "size", "source_size", "target", (F.size(homes) * F.col("size")).alias("taken"), homes.alias("shards"))


def mixed_rows(docs: DataFrame, plan: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of ``docs``, one row per copy taken, with ``shard`` and the order ``turn`` inside it as last columns."""
    decisions = plan.groupBy("id", "digest", F.col("source").alias("of")).agg(F.first("shards").alias("homes"))
    names = {c: unused(docs, c) for c in ("of", "homes", "shard", "turn", "copy")}
    right = decisions.select("id", "digest", F.col("of").alias(names["of"]), F.col("homes").alias(names["homes"])).alias("r")
    left = docs.alias("l")
    q = lambda c: F.col("l.`" + c.replace("`", "``") + "`")
    on = q(id_col).eqNullSafe(F.col("r.id")) & (digest(q(text_col)) == F.col("r.digest")) & q(source_col).eqNullSafe(F.col(f"r.{names['of']}"))
    joined = left.join(right, on).select(*map(q, docs.columns), F.posexplode(F.col(f"r.{names['homes']}")).alias(names["copy"], names["shard"]))
    turn = F.xxhash64(F.lit(seed + 2), col(id_col), digest(col(text_col)), F.col(names["copy"]))
    return joined.withColumn(names["turn"], turn).drop(names["copy"])


