"""Lines of a text as rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import split_lines


def lines(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``keep`` columns, 1-based ``line_no`` and ``line``."""
    numbered = df.select(*keep, F.posexplode(split_lines(F.col(text_col))).alias("_at", "line"))
    return numbered.select(*keep, (F.col("_at") + 1).cast("long").alias("line_no"), "line")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sums_before(lengths: pa.Array) -> pa.Array:
    """Per row, the running total before each element."""
    sizes = lengths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(flat) - flat
    ends = np.cumsum(sizes)
    starts = ends - sizes
    base = np.zeros(len(sizes), dtype=np.int64)
    base[sizes > 0] = before[starts[sizes > 0]]
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(before - np.repeat(base, sizes)))


def line_starts(text: Column) -> Column:
    """Byte offset of every line; the terminator, ``\\r`` included, counts."""
    pieces = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    lengths = F.transform(pieces, lambda x: F.octet_length(x) + 1)
    return _sums_before(F.when(text == "", F.array().cast("array<int>")).otherwise(lengths))


def line_offsets(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``keep`` columns, 1-based ``line_no`` and ``start_byte``, without a shuffle."""
    numbered = df.select(*keep, F.posexplode(line_starts(F.col(text_col))).alias("_at", "start_byte"))
    return numbered.select(*keep, (F.col("_at") + 1).cast("long").alias("line_no"), "start_byte")
