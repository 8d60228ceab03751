"""The three runs: index, dry run, search."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Settings, SourceRoot
from corpusloom.functions.render import render_report
from corpusloom.operators.chunk import chunk_files
from corpusloom.operators.embed import Embedder, HashEmbedder, ModelEmbedder, embed_documents, embed_query
from corpusloom.operators.report import RunReport, RunTotals
from corpusloom.operators.search import attach_attributes, search
from corpusloom.operators.stats import batch_count, by_root_of, dry_run_sums, totals_of
from corpusloom.session import stored
from corpusloom.sources.corpus import decode, root_prefix, scan_corpus, scan_roots
from corpusloom.sources.index_table import (
    index_rows,
    last_per_id,
    read_centroids,
    read_index,
    upsert_index,
    with_ids,
)


def default_embedder(settings: Settings) -> Embedder:
    return HashEmbedder(settings.dimensions)


def run_embedder(settings: Settings, embedder: Embedder | None) -> Embedder:
    """The embedder of a run: the default one, or the one given, with the settings' batch size
    unless it names its own."""
    if embedder is None:
        return default_embedder(settings)
    if embedder.dimensions != settings.dimensions:
        warnings.warn(
            f"the embedder's vectors have {embedder.dimensions} components, the settings name {settings.dimensions}",
            stacklevel=3,
        )
    if isinstance(embedder, ModelEmbedder) and embedder.batch_size is None:
        return replace(embedder, batch_size=settings.embed_batch_size)
    return embedder


def paths_are_unique(files: DataFrame) -> bool:
    """Whether every file has its own path; reads and shuffles the paths only."""
    return files.groupBy("file_path").count().where("count > 1").isEmpty()


def corpus_index_rows(
    files: DataFrame,
    embedder: Embedder,
    settings: Settings = Settings(),
    unique_paths: bool | None = None,
    report: RunReport | None = None,
) -> DataFrame:
    """Files to index rows.  Ids are made unique before the model sees the texts.

    Equal ids within a file are resolved in its own row.  Only where two files may share a
    path must all chunks be shuffled by id as well; with ``unique_paths`` (measured, on the
    paths alone, if not given) there is no shuffle from the files to the vectors.
    """
    if unique_paths is None:
        unique_paths = paths_are_unique(files)
    chunks = with_ids(chunk_files(files, settings.max_chunk_bytes, unique=True, oversize=settings.oversize))
    if not unique_paths:
        chunks = last_per_id(chunks)
    embedded = embed_documents(chunks, "text", embedder)
    if report is not None:
        batch_size = getattr(embedder, "batch_size", None) or settings.embed_batch_size
        embedded = report.of_rows(embedded, batch_size)
    return index_rows(embedded)


def index_files(
    spark: SparkSession,
    files: DataFrame,
    index_path: str,
    settings: Settings = Settings(),
    embedder: Embedder | None = None,
    prune: bool = False,
    unique_paths: bool | None = None,
    centroids: int | None = None,
    report: RunReport | None = None,
) -> int | None:
    """Chunk, embed and upsert a corpus; the index version now current.

    With ``centroids`` the index is partitioned by as many, trained on the first rows it gets.
    A new ``report`` counts what is written on its way, see ``RunReport``.
    """
    if unique_paths is None:
        unique_paths = paths_are_unique(files)
    embedder = run_embedder(settings, embedder)
    rows = corpus_index_rows(files, embedder, settings, unique_paths, report)
    return upsert_index(spark, index_path, rows, prune, centroids)


def index_roots(
    spark: SparkSession,
    index_path: str,
    settings: Settings,
    embedder: Embedder | None = None,
    prune: bool = False,
    centroids: int | None = None,
    report: RunReport | None = None,
) -> int | None:
    """``index_files`` over directories; within one root the file system keeps paths unique.

    A ``report`` counts the files read and those skipped, by reason, as well.
    """
    prefixes = [root_prefix(r.path) for r in settings.roots]
    distinct = len(set(prefixes)) == len(prefixes)
    scanned = scan_roots(spark, settings.roots)
    files = decode(scanned if report is None else report.of_files(scanned))
    return index_files(spark, files, index_path, settings, embedder, prune, distinct, centroids, report)


@dataclass(frozen=True)
class DryRun:
    by_root: DataFrame
    totals: DataFrame


def dry_run(files: DataFrame, settings: Settings = Settings()) -> DryRun:
    """What indexing would cost; no model is called and no index opened.

    Files are read and chunked here, once; both reports are made of the sums that are kept.
    """
    batch_count(F.lit(0), settings.embed_batch_size)  # a wrong setting fails before anything is read
    chunks = chunk_files(files, settings.max_chunk_bytes, oversize=settings.oversize)
    sums = stored(dry_run_sums(chunks))
    totals = totals_of(
        sums,
        batch_size=settings.embed_batch_size,
        model=settings.model,
        dimensions=settings.dimensions,
    )
    return DryRun(by_root_of(sums), totals)


def dry_run_roots(spark: SparkSession, settings: Settings) -> DryRun:
    return dry_run(scan_corpus(spark, settings.roots), settings)


def near_rows(spark: SparkSession, index_path: str, vector: Sequence[float], nprobe: int) -> DataFrame:
    """The index rows in the partitions of the ``nprobe`` centroids nearest to a vector."""

    def nearest(number: int) -> list[int]:
        found = search(read_centroids(spark, index_path, number), vector, nprobe, id_col="centroid")
        return [r["centroid"] for r in found.collect()]  # at most nprobe rows

    return read_index(spark, index_path, probes=nearest)


def search_text(
    spark: SparkSession,
    index_path: str,
    query: str,
    settings: Settings = Settings(),
    embedder: Embedder | None = None,
    nprobe: int | None = None,
) -> DataFrame:
    """The hits of one query text, with their stored attributes, best first.

    Ids and vectors are scanned first; the few hits are then looked up by id, a predicate
    that reaches the Parquet scan.  With ``nprobe`` only the partitions of that many nearest
    centroids are scanned, of steps that are partitioned; rows of other steps all are.
    """
    vector = embed_query(spark, query, embedder or default_embedder(settings))
    index = read_index(spark, index_path)
    hits = search(near_rows(spark, index_path, vector, nprobe) if nprobe else index, vector, settings.k)
    found = hits.collect()  # at most k rows
    hits = spark.createDataFrame(found, hits.schema)
    rows = index.where(F.col("external_id").isin([r["external_id"] for r in found]))
    return attach_attributes(hits, rows).orderBy("rank")


def search_report(
    spark: SparkSession,
    index_path: str,
    query: str,
    settings: Settings = Settings(),
    embedder: Embedder | None = None,
) -> str:
    return render_report(search_text(spark, index_path, query, settings, embedder))


__all__ = [
    "DryRun",
    "RunReport",
    "RunTotals",
    "Settings",
    "SourceRoot",
    "corpus_index_rows",
    "dry_run",
    "dry_run_roots",
    "index_files",
    "index_roots",
    "search_report",
    "search_text",
]
