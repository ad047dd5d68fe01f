"""Row identity, lineage cuts and connected components shared by the operators here.

A row is known by its id and the digest of its text, so null and repeated ids are safe:
rows that agree in both get the same decisions.  Column names of the caller are quoted.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.session import checkpoint_folder


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def digest(text: Column) -> Column:
    return F.xxhash64(text)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, digest, text`` of every row, whatever else the table holds."""
    return text_batches(docs).select(col(id_col).alias("id"), digest(col(text_col)).alias("digest"), col(text_col).alias("text"))


def text_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``; its session hands at most ``rows`` rows at once to Python, since whole texts are long."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def unused(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def with_decisions(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str, how: str = "left") -> DataFrame:
    """All columns of ``docs`` and those of ``decisions`` but its keys ``id`` and ``digest``.

    ``decisions`` holds one row per key and names that ``docs`` lacks.
    """
    left, right = docs.alias("docs"), decisions.alias("decided")
    same = F.col("docs.`" + id_col.replace("`", "``") + "`").eqNullSafe(F.col("decided.id")) & (
        digest(F.col("docs.`" + text_col.replace("`", "``") + "`")) == F.col("decided.digest")
    )
    joined = left.join(right, same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    kept = [F.col("docs.`" + c.replace("`", "``") + "`") for c in docs.columns]
    return joined.select(*kept, *[F.col(f"decided.{c}") for c in decisions.columns if c not in ("id", "digest")])


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that ``spark.checkpoint.dir`` names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: packed and read by column, where ``cut`` keeps whole rows."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_size(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, most: int = 50_000) -> DataFrame:
    """``rows`` and their ``groups`` (one row per ``key``, with the number of its rows in ``size``), inner.

    Groups of more than ``total / most`` rows are fewer than ``most``, so these are broadcast and their rows stay
    where they are; only rows of smaller groups are shuffled by ``key``, and no task gets more of one.
    """
    least = max(10_000, -(-total // most))
    large = F.broadcast(groups.where(F.col(size) > least))
    small = rows.join(large.select(key), key, "left_anti").join(groups.where(F.col(size) <= least), key)
    return rows.join(large, key).unionByName(small)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``, the component being one of its nodes.

    Nodes must be spread at random over the 64-bit numbers (hashes).  Each round every node steps to
    its smallest neighbour, and that one to its own, until no edge is left; labels follow the steps.
    """
    edges = cut(edges.where("a <> b").distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("of"), F.least("a", "b").alias("to"))
        step = cut(step)
        jump = step.alias("x").join(step.alias("y"), F.col("x.to") == F.col("y.of")).select("x.of", F.col("y.to").alias("to"))
        jump = cut(jump)
        labels = cut(
            labels.join(jump, labels["component"] == jump["of"], "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        )
        for end in ("a", "b"):
            moved = jump.select(F.col("of").alias(end), F.col("to").alias("new"))
            edges = edges.join(moved, end).drop(end).withColumnRenamed("new", end)
        edges = cut(edges.where("a <> b").distinct())
    return labels
