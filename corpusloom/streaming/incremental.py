"""Keeping an index current: new files arrive as a stream, each batch is one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusloom.config import Settings
from corpusloom.operators.embed import Embedder
from corpusloom.plans.pipelines import index_files


def keep_indexed(
    spark: SparkSession,
    files: DataFrame,
    index_path: str,
    checkpoint_path: str,
    settings: Settings = Settings(),
    embedder: Embedder | None = None,
) -> StreamingQuery:
    """Index a streaming ``file_path, source`` table batch by batch until none is left.

    A batch repeated after a failure upserts the same rows again, which changes nothing.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        index_files(spark, batch, index_path, settings, embedder)

    return (
        files.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
