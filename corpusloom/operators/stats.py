"""Size reports over chunks, before any model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import BYTES_PER_TOKEN, DIMENSIONS, EMBED_BATCH_SIZE
from corpusloom.functions.text import root_component
from corpusloom.session import cut_lineage


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0).cast("long"))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def estimated_tokens(text_bytes: Column) -> Column:
    return _div(text_bytes, BYTES_PER_TOKEN)


def batch_count(rows: Column, batch_size: int) -> Column:
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return _div(rows + (batch_size - 1), batch_size)


_SUMS = ("chunks", "bytes", "truncated")


def dry_run_sums(chunks: DataFrame) -> DataFrame:
    """``root, whole`` and raw sums: a row per root, and one of everything where ``whole`` is true.

    One pass: chunks are reduced per root, and only those sums are grouped a second time, so no
    chunk is copied for the second grouping.  Nothing is rounded yet.  Without chunks: no rows.
    """
    per_root = chunks.groupBy(root_component(F.col("file_path")).alias("root")).agg(
        F.count("*").alias("chunks"), _bytes("text").alias("bytes"), F.count_if("was_truncated").alias("truncated")
    )
    sums = [F.sum(c).alias(c) for c in _SUMS]
    grouped = per_root.groupingSets([[F.col("root")], []], F.col("root"))
    return grouped.agg((F.grouping("root") == 1).alias("whole"), *sums)


def totals_of(
    sums: DataFrame,
    *,
    batch_size: int = EMBED_BATCH_SIZE,
    model: str = "hashing",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """``dry_run_totals`` from ``dry_run_sums``."""
    whole = sums.where("whole").agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in _SUMS])
    totals = whole.toDF("total_chunks", "total_characters", "truncated_chunks")
    return _labelled(totals, batch_size, model, dimensions)


def by_root_of(sums: DataFrame) -> DataFrame:
    """``dry_run_by_root`` from ``dry_run_sums``."""
    per_root = sums.where(~F.col("whole"))
    return per_root.select("root", "chunks", estimated_tokens(F.col("bytes")).alias("tokens")).orderBy("root")


def dry_run_report(chunks: DataFrame, batch_size: int = EMBED_BATCH_SIZE) -> DataFrame:
    """Both reports as one table from one pass: per root, and (``whole``) of everything.

    Tokens are rounded down and batches up in each row, so roots need not add up to the whole.
    """
    return dry_run_sums(chunks).select(
        "root",
        "whole",
        "chunks",
        F.col("bytes").alias("characters"),
        estimated_tokens(F.col("bytes")).alias("tokens"),
        batch_count(F.col("chunks"), batch_size).alias("batches"),
        "truncated",
    )


def dry_run_totals(
    chunks: DataFrame,
    *,
    batch_size: int = EMBED_BATCH_SIZE,
    model: str = "hashing",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """One row: chunk count, text bytes, estimated tokens, model calls, and run labels."""
    totals = chunks.agg(
        F.count("*").alias("total_chunks"),
        _bytes("text").alias("total_characters"),
        F.count_if("was_truncated").alias("truncated_chunks"),
    )
    return _labelled(totals, batch_size, model, dimensions)


def _labelled(totals: DataFrame, batch_size: int, model: str, dimensions: int) -> DataFrame:
    return totals.select(
        "total_chunks",
        "total_characters",
        estimated_tokens(F.col("total_characters")).alias("estimated_tokens"),
        batch_count(F.col("total_chunks"), batch_size).alias("embedding_batches"),
        "truncated_chunks",
        F.lit(model).alias("model"),
        F.lit(dimensions).alias("dimensions"),
    )


def dry_run_by_root(chunks: DataFrame) -> DataFrame:
    """Chunks and estimated tokens per root, in byte order of the root.

    Each root's tokens are rounded down, so they need not add up to the total's.
    """
    by_root = chunks.groupBy(root_component(F.col("file_path")).alias("root")).agg(
        F.count("*").alias("chunks"), _bytes("text").alias("bytes")
    )
    return by_root.select(
        "root", "chunks", estimated_tokens(F.col("bytes")).alias("tokens")
    ).orderBy("root")


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.count("*").alias("chunks"))


def truncated_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_if("was_truncated").alias("truncated_chunks"))


def skipped_by_reason(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("reason").agg(F.count("*").alias("files"))


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with its 0-based ``position`` in the given order, without one global task.

    Rows are range-partitioned and sorted, which fixes their place within a partition;
    adding the sizes of the partitions before gives the place overall.  Select only the
    columns needed: the sorted rows are written once so that both steps see the same
    partitions.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id is partition << 33 | place.
    placed = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn("position", F.col("_before") + place).drop("_at", "_part", "_before")


def batch_ids(df: DataFrame, *order: str, batch_size: int = EMBED_BATCH_SIZE) -> DataFrame:
    """``df`` with the number of the fixed-size batch each row falls in."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return with_position(df, *order).select(
        *df.columns, _div(F.col("position"), batch_size).alias("batch_id")
    )
