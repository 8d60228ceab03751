"""Column types of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK_STRUCT = T.StructType(
    [
        T.StructField("start_line", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("item_name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("was_truncated", T.BooleanType()),
    ]
)

VECTOR = T.ArrayType(T.FloatType(), True)

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("external_id", T.StringType()),
        T.StructField("embedding", VECTOR),
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("item_name", T.StringType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)

ATTRIBUTES = [f.name for f in INDEX_SCHEMA.fields if f.name not in ("external_id", "embedding")]
