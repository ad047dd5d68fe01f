"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("workspace_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("sender", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("is_system", T.BooleanType()),
    ]
)

STYLE = T.StructType(
    [
        T.StructField("avg_message_length", T.DoubleType()),
        T.StructField("emoji_rate", T.DoubleType()),
        T.StructField("codemix_ratio", T.DoubleType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("workspace_id", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("person_id", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

# Rows per block wherever an ordered scan is cut into bounded pieces.
BLOCK_ROWS = 1 << 16
