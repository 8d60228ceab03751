"""Vectors of whole numbers: scaling, exact products, best-of-many lists, bounded pieces of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import shared_path

EXACT = 2.0**53  # sums of doubles that are whole and below this are exact
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
NO_ID = MOST  # stands for a null id, so that null comes last
BLOCK_BYTES = 1 << 19  # of vectors that one product takes
PIECE_BYTES = 1 << 24  # of query vectors that are broadcast at a time


def scaled(vectors: DataFrame, scale: int, id_col: str, vector_col: str, **more: Column) -> DataFrame:
    """``id, x, d`` and ``more``: x holds floor(scale * component) as longs, d is its length.

    Rows whose vector is null or holds a null or non-finite component go.  A scaled component
    beyond a long is held at the long's end.
    """
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), *(c.alias(n) for n, c in more.items()))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))))
    return rows.where(F.col("x").isNotNull() & ~odd).withColumns({"x": whole, "d": F.size("x")})


def matrix(batch: pa.RecordBatch | pa.Table, name: str = "x") -> np.ndarray:
    """A list column whose lists are equally long."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def numbers(batch: pa.RecordBatch | pa.Table, name: str, null: int = NO_ID) -> np.ndarray:
    return np.asarray(batch.column(name).cast(pa.int64()).fill_null(null))


def ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=values == NO_ID)


def lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``, held at the ends of a long.

    No partial sum of a product exceeds the product of the lengths, so below 2^53 doubles are
    exact in any order; rows too long for that are multiplied as Python integers.
    """
    long_a, long_b = lengths(a), lengths(b)
    if not len(a) or not len(b) or long_a.max() * long_b.max() < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    wide_a, wide_b = long_a >= 2.0**26, long_b >= 2.0**26
    plain = np.ix_(~wide_a, ~wide_b)
    out[plain] = (a[~wide_a].astype(float) @ b[~wide_b].astype(float).T).astype(np.int64)
    for rows, columns in ((wide_a, np.ones(len(b), bool)), (~wide_a, wide_b)):
        if rows.any() and columns.any():
            found = a[rows].astype(object) @ b[columns].astype(object).T
            out[np.ix_(rows, columns)] = np.clip(found, LEAST, MOST).astype(np.int64)
    return out


def same_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each vector length, in blocks of at most ``BLOCK_BYTES``; order within a length stays."""
    d = numbers(batch, "d")
    for size in np.unique(d):
        some = batch if (d == size).all() else batch.take(pa.array(np.flatnonzero(d == size)))
        step = block_rows(int(size))
        for at in range(0, some.num_rows, step):
            yield some.slice(at, step)


def block_rows(d: int) -> int:
    return max(16, BLOCK_BYTES // (8 * max(1, d)))


class Best:
    """The k largest scores of each of n queries, with id and row; ties to the smaller id, then row."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LEAST)
        self.id = np.full((n, k), NO_ID)
        self.row = np.full((n, k), -1)

    def floor(self) -> np.ndarray:
        """What a score must reach to enter, by query."""
        return self.score[:, -1]

    def offer(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        last = self.score[query, -1], self.id[query, -1], self.row[query, -1]
        level = score == last[0]
        enters = (score > last[0]) | (last[2] < 0) | (level & (id_ < last[1])) | (level & (id_ == last[1]) & (row < last[2]))
        if not enters.any():
            return
        query, score, id_, row = (c[enters] for c in (query, score, id_, row))
        touched = np.unique(query)
        columns = [np.repeat(touched, self.k)] + [c[touched].ravel() for c in (self.score, self.id, self.row)]
        query, score, id_, row = (np.concatenate(pair) for pair in zip(columns, (query, score, id_, row)))
        order = np.lexsort((row, id_, ~score, row < 0, query))  # ~ turns the order round and cannot overflow
        first = np.searchsorted(query[order], touched)
        taken = order[first[:, None] + np.arange(self.k)]
        self.score[touched], self.id[touched], self.row[touched] = score[taken], id_[taken], row[taken]

    def found(self) -> tuple[np.ndarray, ...]:
        """Query, score, id and row of all that entered."""
        query, place = np.nonzero(self.row >= 0)
        return query, self.score[query, place], self.id[query, place], self.row[query, place]


def query_pieces(asked: DataFrame, count: int, d: int, name: str) -> list[DataFrame]:
    """``asked`` (with a column ``row``), stored, as tables of about ``PIECE_BYTES`` each, small
    enough to collect and broadcast one after another, however many queries there are."""
    spark, path = asked.sparkSession, shared_path(asked.sparkSession, name)
    n = max(1, -(-count * (8 * d + 64) // PIECE_BYTES))
    piece = F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    asked.withColumn("piece", piece).repartition(min(n, 1024), "piece").write.partitionBy("piece").parquet(path)
    stored = spark.read.schema(asked.withColumn("piece", piece).schema).parquet(path)
    return [stored.where(F.col("piece") == p).drop("piece") for p in range(n)]
