"""Token ids of whole texts in ORC files, in ascending document order, and what the files say.

ORC's writer encodes the ids with its integer run-length encoding, keeps a row index per
``ROW_INDEX`` rows and a Bloom filter on the document ids, so a lookup by id opens few stripes
and a full read is parallel by stripe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import part_count, text_bytes
from corpusloom.llm.tokens import crc, ids_list, worker_encoder

ROW_INDEX = 1_000
STRIPE_BYTES = 16 << 20
ROWS_EACH = 1 << 15  # documents a file
BATCH_TOKENS = 1 << 20


def write_token_ids(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    stripe_bytes: int = STRIPE_BYTES,
    bloom_fpp: float = 0.01,
) -> None:
    """Write ``part, row, doc_id, before, ids`` as ORC, files and rows ascending by id.

    Null ids come first; rows of one id are ordered by the hash of their text, then the text, so
    one id with very many rows spreads over files.  A null or empty text has the end id alone.
    Other columns are not looked at.  ``before`` counts the ids before the document in its file.
    An empty table writes no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    order = ["doc_id", "tie", "text"]
    parts = part_count(spark, rows.count(), ROWS_EACH)
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer_path), TaskContext.get().partitionId()
        row = before = 0
        for batch in batches:
            ids, held, kept, waiting = batch.column("doc_id"), [], 0, 0
            data, offsets = text_bytes(batch.column("text"))

            def block(upto: int) -> pa.RecordBatch:
                nonlocal row, before
                sizes = np.fromiter(map(len, held), np.int64, len(held))
                starts = before + np.cumsum(sizes) - sizes
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(held), part), pa.int32()),
                        pa.array(row + np.arange(len(held)), pa.int64()),
                        ids.slice(kept, upto - kept),
                        pa.array(starts, pa.int64()),
                        ids_list(held),
                    ],
                    names=["part", "row", "doc_id", "before", "ids"],
                )
                row, before = row + len(held), before + int(sizes.sum())
                return out

            for i, found in encoder.documents(data, offsets):
                held.append(found)
                waiting += len(found)
                if waiting >= BATCH_TOKENS:
                    yield block(i + 1)
                    held, kept, waiting = [], i + 1, 0
            if held:
                yield block(len(ids))

    encoded = ordered.select("doc_id", "text").mapInArrow(
        encode, "part int, row long, doc_id long, before long, ids array<int>"
    )
    (
        encoded.write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_INDEX)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows.  Filters on ``doc_id`` reach the stripes' statistics and Bloom filters."""
    return spark.read.schema("part int, row long, doc_id long, before long, ids array<int>").orc(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, from the files alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            at = np.asarray(column.offsets).astype(np.int64)
            flat = np.asarray(column.values)
            sums = [crc(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("part"),
                    batch.column("doc_id"),
                    batch.column("before"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["part", "doc_id", "before", "n_tokens", "ids_crc32"],
            )

    stored = read_token_ids(spark, path)
    rows = stored.select("part", "doc_id", "before", "ids").mapInArrow(
        digest, "part int, doc_id long, before long, n_tokens long, ids_crc32 long"
    )
    # One row a file: the sum over earlier files is the only step that looks at all of them.
    totals = stored.groupBy("part").agg(F.max(F.col("before") + F.size("ids")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return rows.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
