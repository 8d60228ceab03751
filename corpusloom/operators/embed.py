"""Embedding a text column: a pluggable model, and a deterministic offline default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import DIMENSIONS, EMBED_BATCH_SIZE
from corpusloom.schemas import VECTOR

# texts -> vectors, or (vectors, tokens used per text)
Predict = Callable[[np.ndarray], "np.ndarray | tuple[np.ndarray, np.ndarray]"]

_EMBEDDED = T.StructType(
    [T.StructField("embedding", VECTOR), T.StructField("usage_tokens", T.LongType())]
)


class Embedder(Protocol):
    dimensions: int

    def embed(self, df: DataFrame, text_col: str, mode: str) -> DataFrame:
        """``df`` with ``embedding`` and ``usage_tokens``; mode is ``document`` or ``query``."""


@dataclass(frozen=True)
class ModelEmbedder:
    """Runs ``make_predict(mode)`` once per Python worker, then batch by batch.

    A failed call fails its task, which Spark retries.  Without a ``batch_size`` of its own it takes
    that of the run's settings.
    """

    make_predict: Callable[[str], Predict]
    dimensions: int = DIMENSIONS
    batch_size: int | None = None

    def embed(self, df: DataFrame, text_col: str, mode: str = "document") -> DataFrame:
        batch_size = EMBED_BATCH_SIZE if self.batch_size is None else self.batch_size
        if batch_size <= 0:
            raise ValueError("batch_size must be positive")
        make_predict, dimensions = self.make_predict, self.dimensions

        def make() -> Callable:
            predict = make_predict(mode)

            def checked(texts: np.ndarray) -> dict[str, np.ndarray]:
                result = predict(texts)
                vectors, used = result if isinstance(result, tuple) else (result, None)
                vectors = np.asarray(vectors, dtype=np.float32)
                if vectors.shape != (len(texts), dimensions):
                    raise ValueError(
                        f"the model returned {vectors.shape} for {len(texts)} texts of {dimensions} dimensions"
                    )
                if used is None:
                    used = np.full(len(texts), np.nan)
                return {"embedding": vectors, "usage_tokens": np.asarray(used, dtype=np.float64)}

            return checked

        struct = T.StructType(
            [T.StructField("embedding", VECTOR), T.StructField("usage_tokens", T.DoubleType())]
        )
        run = predict_batch_udf(make, return_type=struct, batch_size=batch_size)
        used = F.col("_embedded.usage_tokens")
        return (
            df.withColumn("_embedded", run(F.col(text_col)))
            .withColumn("embedding", F.col("_embedded.embedding"))
            .withColumn("usage_tokens", F.when(~F.isnan(used), used.cast("long")))
            .drop("_embedded")
        )


def word_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


_SLICE_BYTES = 8 << 20  # text split into words at once


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows of bounded text size, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        limit = (ends[start - 1] if start else 0) + _SLICE_BYTES
        stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def _word_codes(words: pa.Array) -> np.ndarray:
    """The first nine hexadecimal digits of each word's MD5; each distinct word hashed once."""
    coded = words.dictionary_encode()
    digests = [int(hashlib.md5(w.encode()).hexdigest()[:9], 16) for w in coded.dictionary.to_pylist()]
    return np.array(digests, dtype=np.int64)[coded.indices.to_numpy()]


_WORD_BYTES = b"abcdefghijklmnopqrstuvwxyz0123456789"
_OTHERS_TO_SPACE = bytes(b if b in _WORD_BYTES else 32 for b in range(256))


def _split_words(texts: pa.Array) -> pa.Array:
    """``[a-z0-9]+`` runs per text, with empty strings in between.

    All bytes of other characters turn into spaces, in one step over the whole buffer.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset)
    spaced = bytes(memoryview(data)[at[0] : at[-1]] if data else b"").translate(_OTHERS_TO_SPACE)
    start = pa.py_buffer((at - at[0]).tobytes())
    plain = pa.StringArray.from_buffers(len(texts), start, pa.py_buffer(spaced))
    return pc.ascii_split_whitespace(plain)


def _hash_vectors(texts: pa.Array, dims: int) -> np.ndarray:
    """Signed bucket counts of the words of lower-case texts, at unit length."""
    split = _split_words(texts)
    words, row = split.flatten(), pc.list_parent_indices(split).to_numpy()
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    codes = _word_codes(words.filter(pa.array(filled)))
    cell = row[filled] * dims + (codes >> 4) % dims
    sums = np.bincount(cell, weights=1.0 - 2.0 * (codes & 1), minlength=len(texts) * dims)
    # Without any word bincount returns integers.
    sums = sums.reshape(len(texts), dims).astype(np.float64)
    norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0).astype(np.float32)


@dataclass(frozen=True)
class HashEmbedder:
    """Feature hashing (Weinberger et al., 2009): signed bucket counts at unit length.

    The first eight digits of a word's MD5 choose its bucket, the parity of the ninth its
    sign.  Words are split, counted and scaled a batch at a time.  A text without words
    becomes the zero vector.
    """

    dimensions: int = DIMENSIONS

    def embed(self, df: DataFrame, text_col: str, mode: str = "document") -> DataFrame:
        dims = self.dimensions

        @F.arrow_udf(VECTOR)
        def spread(texts: pa.Array) -> pa.Array:
            parts = [_hash_vectors(part, dims).ravel() for part in _slices(texts)]
            values = np.concatenate(parts) if parts else np.empty(0, np.float32)
            offsets = np.arange(0, len(texts) * dims + 1, dims, dtype=np.int32)
            return pa.ListArray.from_arrays(offsets, pa.array(values))

        text = F.col(text_col)
        return df.withColumn("embedding", spread(F.lower(text))).withColumn(
            "usage_tokens", F.size(word_tokens(text)).cast("long")
        )


def embed_documents(df: DataFrame, text_col: str, embedder: Embedder) -> DataFrame:
    return embedder.embed(df, text_col, "document")


def embed_queries(df: DataFrame, text_col: str, embedder: Embedder) -> DataFrame:
    return embedder.embed(df, text_col, "query")


def embed_query(spark, text: str, embedder: Embedder) -> list[float]:
    """The vector of one query text; an empty answer is an error."""
    row = embed_queries(spark.createDataFrame([(text,)], "text string"), "text", embedder).first()
    if row is None or row["embedding"] is None:
        raise ValueError("the model returned no embedding")
    return row["embedding"]


def token_usage(embedded: DataFrame) -> DataFrame:
    """Tokens the model reports having used, in total."""
    return embedded.agg(F.sum("usage_tokens").alias("total_tokens"))
