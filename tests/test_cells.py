"""Approximate search over stored cells: recall, what it opens, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.catalog import search as cat
from talkweave.operators import cells, search

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    return cat.vectors(spark, FOLDER).select("workspace_id", "message_id", "embedding").cache()


def questions(spark):
    return cat.requests(spark, FOLDER).select("query_id", "workspace_id", "embedding")


def test_recall_and_what_is_opened(spark, scratch, vectors):
    """The test vectors hardly cluster, so most cells must be opened for recall; the codes lose next to nothing."""
    book = cells.train(vectors)
    cells.write_cells(vectors, book, scratch + "/cells")
    stored = spark.read.parquet(scratch + "/cells")
    assert stored.count() == vectors.count()
    asked = questions(spark)
    found = cells.cell_topk(stored, asked, book, 8, probes=len(book.centroids) * 6 // 10)
    exact = search.cosine_topk(vectors, asked, 8)
    assert search.recall(found, exact).first()["recall"] >= 0.9
    one = cells.cell_topk(stored, asked.limit(1), book, 8, probes=3)
    scan = next(x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert "PartitionFilters: [cell" in scan
    opened = stored.filter(F.col("cell").isin([int(c) for c in book.nearest(np.array([asked.first()["embedding"]], float), 3)[0]]))
    assert 0 < opened.select(F.input_file_name()).distinct().count() < len(stored.inputFiles()) / 4


def test_all_cells_without_codes_are_exact(spark, scratch, vectors, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 50)
    book = cells.Codebook(cells.train(vectors, 9).centroids)
    cells.write_cells(vectors, book, scratch + "/cells")
    stored = spark.read.parquet(scratch + "/cells")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["message_id"], r["score"]) for r in df.collect())
    assert rows(cells.cell_topk(stored, questions(spark), book, 5, probes=9)) == rows(search.cosine_topk(vectors, questions(spark), 5))


def test_residual_codes_stand_for_their_vectors(vectors):
    book = cells.train(vectors, 20)
    units = cells._units(np.array([r["embedding"] for r in vectors.limit(300).collect()], float))
    own = book.nearest(units)[:, 0]
    codes = book.codes(units, own)
    again = book.centroids[own] + np.concatenate([book.books[s][codes[:, s]] for s in range(len(book.books))], axis=1)
    assert np.linalg.norm(units - again, axis=1).mean() < 0.6 * np.linalg.norm(units - book.centroids[own], axis=1).mean()


def test_odd_rows(spark, scratch):
    rows = [("w", 1, [1.0, 0.0]), ("w", 2, [0.0, 0.0]), ("w", 3, None), ("w", 4, [1.0]), (None, 5, [1.0, 0.0]), ("v", 6, [1.0, 0.0]), ("w", 7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "workspace_id string, message_id bigint, embedding array<double>")
    book = cells.train(df.filter("size(embedding) = 2"), 2)
    cells.write_cells(df, book, scratch + "/cells")
    stored = spark.read.parquet(scratch + "/cells")
    asked = spark.createDataFrame([("a", "w", [2.0, 0.0]), ("b", None, [1.0, 0.0]), ("c", "w", None), ("d", "w", [1.0])], "query_id string, workspace_id string, embedding array<double>")
    got = [(r["query_id"], r["message_id"], r["score"]) for r in cells.cell_topk(stored, asked, book, 2, probes=2).orderBy("rank").collect()]
    assert got == [("a", 1, 1.0), ("a", 7, 1.0)]
    assert cells.cell_topk(stored, asked.limit(0), book).count() == 0
