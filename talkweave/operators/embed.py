"""Texts to vectors: a slot for any model, and feature hashing that needs none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import tokens


def embed_with_model(
    texts: DataFrame,
    load_model: Callable[[], Callable[[list[str]], list[list[float]]]],
    key: str = "message_id",
    prefix: str = "passage: ",
    batch: int = 32,
) -> DataFrame:
    """``key, embedding`` from a model loaded once per task and called on small batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for frame in frames:
            vectors: list[list[float]] = []
            for lo in range(0, len(frame), batch):
                vectors.extend(model([prefix + t for t in frame["text"].iloc[lo : lo + batch]]))
            yield pd.DataFrame({key: frame[key], "embedding": vectors})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, embedding array<float>")


def hash_embed(texts: DataFrame, key: str = "message_id", dims: int = 256) -> DataFrame:
    """``key, embedding``: hashed token counts scaled to unit length."""
    counted = HashingTF(numFeatures=dims, inputCol="_terms", outputCol="_tf").transform(
        texts.select(key, tokens(F.col("text")).alias("_terms"))
    )
    scaled = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    return scaled.select(key, vector_to_array("_unit", "float32").alias("embedding"))
