"""The registered queries: every operator on the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Settings, SourceRoot
from corpusloom.functions.glob import filter_paths
from corpusloom.functions.render import render_hits
from corpusloom.functions.vectors import unit
from corpusloom.operators.chunk import chunk_files
from corpusloom.operators.embed import HashEmbedder, ModelEmbedder, embed_documents, embed_queries, token_usage
from corpusloom.operators.ivf import ivf_assign, ivf_search, ivf_search_batch, ivf_train, write_by_centroid
from corpusloom.operators.lines import line_offsets, lines
from corpusloom.operators.patterns import filter_paths_by
from corpusloom.operators.search import attach_attributes, search, search_batch
from corpusloom.operators.stats import (
    batch_ids,
    chunks_per_file,
    dry_run_by_root,
    dry_run_report,
    dry_run_totals,
    skipped_by_reason,
    truncated_count,
)
from corpusloom.plans.pipelines import corpus_index_rows
from corpusloom.sources.corpus import decode, scan_roots, skipped, spread, table_corpus, union_corpora
from corpusloom.session import checkpoint_dir, stored
from corpusloom.sources.index_table import last_per_id, read_index, upsert_index, with_ids

Query = Callable[[SparkSession, str], DataFrame]

HASH_DIMS = 64
SMALL_CAP = 2_000
WHOLE = Settings(max_chunk_bytes=None)
TINY_BOUNDS = {"broadcast_bytes": 64, "cell_bytes": 128 * 8 * HASH_DIMS}  # cells of 128 vectors
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    """Register under the function's name; ``_query`` only tells it from the operator."""
    QUERIES[query.__name__.removesuffix("_query")] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Corpora made of table columns


def keys(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The keys that files are made of, dealt to as many tasks as these files need."""
    return spread(table(spark, sf_dir, name).select(key))


def text_path(extension: Column | str = ".txt") -> Column:
    end = F.lit(extension) if isinstance(extension, str) else extension
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), end))


def mixed_path() -> Column:
    third = F.col("doc_id") % 3
    return text_path(F.when(third == 0, ".rs").when(third == 1, ".md").otherwise(".txt"))


def documents_as(spark: SparkSession, sf_dir: str, path: Column) -> DataFrame:
    return table_corpus(table(spark, sf_dir, "documents"), path, F.col("text"))


def headed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings put in at fixed line numbers."""
    doc = F.col("doc_id")

    def headed(line: Column, i: Column) -> Column:
        return (
            F.when((i + doc) % 4 == 1, F.concat(F.lit("## "), F.left(line, F.lit(20))))
            .when((i + doc) % 7 == 3, F.concat(F.lit("#### "), line))
            .otherwise(line)
        )

    text = F.array_join(F.transform(F.split("text", "\n"), headed), "\n")
    return table_corpus(table(spark, sf_dir, "documents"), text_path(".md"), text)


def supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Rust file per supplier: a function, a struct, and an impl block of 2 or 40 methods."""
    key = F.col("s_suppkey").cast("string")
    lines_in_fn = (1 + F.col("s_suppkey") % 5).cast("int")
    methods = F.when(F.col("s_suppkey") % 3 == 0, 40).otherwise(2)
    method = F.transform(
        F.sequence(F.lit(1), methods),
        lambda j: F.concat(F.lit("    fn m_"), j.cast("string"), F.lit("() {\n        x\n    }\n")),
    )
    source = F.concat(
        F.lit("use std::fmt;\n\n/// doc "), key,
        F.lit("\npub fn f_"), key, F.lit("(x: i32) -> i32 {\n"),
        F.repeat(F.lit('    let s = "}";\n'), lines_in_fn),
        F.lit("}\n\nstruct S"), key, F.lit(";\nimpl S"), key, F.lit(" {\n"),
        F.array_join(method, ""),
        F.lit("}\n"),
    )
    path = F.concat(F.lit("suppliers/"), key, F.lit(".rs"))
    return table_corpus(keys(spark, sf_dir, "supplier", "s_suppkey"), path, source)


def chunk_report(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "file_path",
        "start_line",
        "end_line",
        "item_name",
        "language",
        F.octet_length("text").cast("long").alias("text_bytes"),
        F.md5("text").alias("text_md5"),
    )


# Chunking


@registered
def whole_file_chunks(spark, sf_dir):
    return chunk_report(chunk_files(documents_as(spark, sf_dir, text_path())))


@registered
def split_lines(spark, sf_dir):
    return lines(table(spark, sf_dir, "documents"), "text", "doc_id")


@registered
def line_offsets_query(spark, sf_dir):
    return line_offsets(table(spark, sf_dir, "documents"), "text", "doc_id")


@registered
def truncate_bytes(spark, sf_dir):
    chunks = chunk_files(documents_as(spark, sf_dir, text_path()), SMALL_CAP)
    return chunks.select(
        "file_path",
        F.octet_length("text").cast("long").alias("text_bytes"),
        F.md5("text").alias("text_md5"),
        "was_truncated",
    )


@registered
def truncated_chunks(spark, sf_dir):
    return truncated_count(chunk_files(documents_as(spark, sf_dir, text_path()), SMALL_CAP))


@registered
def heading_sections(spark, sf_dir):
    return chunk_report(chunk_files(headed_documents(spark, sf_dir), None))


@registered
def mixed_chunks(spark, sf_dir):
    return chunk_report(chunk_files(documents_as(spark, sf_dir, mixed_path()), None))


@registered
def decl_chunks(spark, sf_dir):
    chunks = chunk_files(supplier_sources(spark, sf_dir), None)
    return chunks.select(
        "file_path", "chunk_ord", "start_line", "end_line", "item_name", "text", "language"
    )


@registered
def impl_split(spark, sf_dir):
    members = chunk_files(supplier_sources(spark, sf_dir), None).where(F.contains("item_name", F.lit("::")))
    return members.select("file_path", "start_line", "end_line", "item_name", "text")


@registered
def preamble(spark, sf_dir):
    chunks = chunk_files(supplier_sources(spark, sf_dir), None).where("item_name = 'preamble'")
    return chunks.select("file_path", "start_line", "end_line", "text")


KINDS = """\
#![allow(dead_code)]
/* outer } % */
#[derive(Debug)]
pub struct S@ {
    pub a: u8,
}
pub(crate) enum E@ { A, B(u8) }
pub unsafe trait T@: Send {
    fn go(&self);
}
mod m@ {
    pub fn inner() {}
}
pub const C@: &str = "}";
static mut V@: u8 = 1;
type A@<T> = Vec<T>;
macro_rules! w@ {
    () => {};
}
impl T@ for S@ { fn go(&self) {} }
/// says
#[inline]
pub async unsafe fn f@<const N: usize>() where [u8; N]: Sized {
"""


@registered
def decl_kinds(spark, sf_dir):
    """A file per part with an item of every kind; the function has 2 to 5 lines, and every eighth
    file has a comment in a comment."""
    key = F.col("p_partkey").cast("string")
    inner = F.when(F.col("p_partkey") % 8 == 0, "/* inner } */ {").otherwise("{")
    body = F.repeat(F.lit("    a();\n"), (1 + F.col("p_partkey") % 4).cast("int"))
    source = F.concat(F.replace(F.replace(F.lit(KINDS), F.lit("@"), key), F.lit("%"), inner), body, F.lit("}\n"))
    corpus = table_corpus(keys(spark, sf_dir, "part", "p_partkey"), F.concat(F.lit("parts/"), key, F.lit(".rs")), source)
    return chunk_files(corpus, None).select("file_path", "chunk_ord", "start_line", "end_line", "item_name", "text")


@registered
def impl_trait_split(spark, sf_dir):
    """A file per supplier with an impl of a generic trait for a path of a trait, over 100 lines long."""
    key = F.col("s_suppkey").cast("string")
    methods = (34 + F.col("s_suppkey") % 3).cast("int")
    method = F.transform(
        F.sequence(F.lit(1), methods),
        lambda j: F.concat(F.lit("    fn m_"), j.cast("string"), F.lit("(&self) -> u8 {\n        1\n    }\n")),
    )
    source = F.concat(
        F.lit("impl<T: Into<Vec<u8>>> Make"), key, F.lit("<T> /* x for y */ for <Own"), key, F.lit(" as Owner>::Kind<T>\nwhere T: Clone {\n"),
        F.lit("    const K: usize = "), key, F.lit(";\n    type Out = Vec<T>;\n"),
        F.array_join(method, ""),
        F.lit("}\n"),
    )
    corpus = table_corpus(keys(spark, sf_dir, "supplier", "s_suppkey"), F.concat(F.lit("makers/"), key, F.lit(".rs")), source)
    return chunk_files(corpus, None).select("file_path", "chunk_ord", "start_line", "end_line", "item_name", "text")


@registered
def split_chunks(spark, sf_dir):
    """Chunks above a small cap in pieces: within the cap, under ids of their own, and nothing lost."""
    pieces = with_ids(chunk_files(documents_as(spark, sf_dir, mixed_path()), SMALL_CAP, oversize="split"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", "text"))), lambda p: p["text"])
    return pieces.groupBy("file_path").agg(
        F.md5(F.array_join(in_order, "")).alias("text_md5"),
        (F.max(F.octet_length("text")) <= SMALL_CAP).alias("within"),
        (F.count_distinct("external_id") == F.count("*")).alias("distinct_ids"),
        F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"),
    )


@registered
def last_write_wins(spark, sf_dir):
    """Two constants on one line: preamble and both items share an id, the last one stays."""
    return last_per_id(with_ids(chunk_files(constants(spark, sf_dir), None))).select(
        "external_id", "item_name", "text"
    )


@registered
def last_write_wins_in_file(spark, sf_dir):
    """The same, decided within each file's row."""
    chunks = with_ids(chunk_files(constants(spark, sf_dir), None, unique=True))
    return chunks.select("external_id", "item_name", "text")


def constants(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    source = F.concat(F.lit("const A_"), key, F.lit(": u8 = 1; const B_"), key, F.lit(": u8 = 2;\n"))
    path = F.concat(F.lit("parts/"), key, F.lit(".rs"))
    return table_corpus(keys(spark, sf_dir, "part", "p_partkey"), path, source)


# Sources


@registered
def glob_filter(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(
        "doc_id", mixed_path().alias("file_path"), F.substring_index(mixed_path(), "/", -2).alias("rel")
    )
    kept = filter_paths(paths, "rel", include=["**/*.rs", "**/*.md"], exclude=["**/fr/**"])
    return kept.select("doc_id", "file_path")


def pattern_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Patterns to include and to exclude, of every kind of key, in number with the tables."""

    def patterns(name: str, column: str, before: str, after: str) -> DataFrame:
        own = F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after))
        return table(spark, sf_dir, name).select(own.alias("pattern"))

    include = patterns("part", "p_partkey", "**/", ".md").union(patterns("nation", "n_nationkey", "??/", "?.*"))
    include = include.union(patterns("region", "r_regionkey", "**/*", ".rs"))
    exclude = patterns("supplier", "s_suppkey", "**/", ".rs").union(patterns("documents", "lang", "", "/9*.md"))
    return include, exclude


@registered
def glob_filter_table(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(
        "doc_id", mixed_path().alias("file_path"), F.substring_index(mixed_path(), "/", -2).alias("rel")
    )
    include, exclude = pattern_tables(spark, sf_dir)
    return filter_paths_by(paths, "rel", include, exclude).select("doc_id", "file_path")


def damaged_files(spark, sf_dir):
    """Documents as bytes, every fifth with a byte that no UTF-8 text has."""
    content = F.encode("text", "UTF-8")
    broken = F.concat(content, F.unhex(F.lit("FF")))
    return table(spark, sf_dir, "documents").select(
        text_path().alias("file_path"), F.when(F.col("doc_id") % 5 == 0, broken).otherwise(content).alias("content")
    )


@registered
def decoded_files(spark, sf_dir):
    return decode(damaged_files(spark, sf_dir)).select("file_path", F.md5("source").alias("source_md5"))


@registered
def skipped_files(spark, sf_dir):
    return skipped(damaged_files(spark, sf_dir))


@registered
def skipped_reasons(spark, sf_dir):
    return skipped_by_reason(skipped(damaged_files(spark, sf_dir)))


@registered
def scanned_paths(spark, sf_dir):
    """The tables' files as a corpus: all but the excluded one are read, and none is text."""
    root = SourceRoot(sf_dir, include=("**/*.parquet",), exclude=("**/region*",))
    report = skipped(scan_roots(spark, [root]))
    return report.select(F.regexp_replace("file_path", "^[^/]*/", "").alias("path_in_root"), "reason")


# Reports


@registered
def dry_run_by_root_query(spark, sf_dir):
    return dry_run_by_root(chunk_files(documents_as(spark, sf_dir, mixed_path()), None))


@registered
def dry_run_totals_query(spark, sf_dir):
    return dry_run_totals(chunk_files(documents_as(spark, sf_dir, mixed_path()), None))


@registered
def dry_run_report_query(spark, sf_dir):
    return dry_run_report(all_tables(spark, sf_dir))


def all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three tables as three roots of one corpus."""
    pages = table(spark, sf_dir, "pages")
    talks = table(spark, sf_dir, "conversations")
    corpus = union_corpora(
        documents_as(spark, sf_dir, F.concat(F.lit("documents/"), text_path())),
        table_corpus(pages, F.concat(F.lit("pages/"), F.col("page_id").cast("string")), F.col("html")),
        table_corpus(
            talks,
            F.concat(F.lit("conversations/"), F.concat_ws("-", F.col("conv_id"), F.col("turn"))),
            F.col("text"),
        ),
    )
    return chunk_files(corpus, None)


@registered
def dry_run_all_tables(spark, sf_dir):
    return dry_run_by_root(all_tables(spark, sf_dir))


@registered
def chunks_per_file_query(spark, sf_dir):
    return chunks_per_file(chunk_files(headed_documents(spark, sf_dir), None))


@registered
def batch_ids_query(spark, sf_dir):
    return batch_ids(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


# Embedding


@registered
def hash_embed(spark, sf_dir):
    embedded = embed_queries(table(spark, sf_dir, "benchmark"), "text", HashEmbedder(HASH_DIMS))
    weights = embedded.select("item_id", F.posexplode("embedding").alias("bucket", "weight"))
    return weights.where("weight <> 0").select(
        "item_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@registered
def hash_token_usage(spark, sf_dir):
    return token_usage(
        embed_documents(table(spark, sf_dir, "documents"), "text", HashEmbedder(HASH_DIMS))
    )


def text_shape(mode: str):
    """A stand-in model: length, words, lines, and whether it was asked as a query."""

    def predict(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        asked = float(mode == "query")
        rows = [(len(t), t.count(" ") + 1, t.count("\n") + 1, asked) for t in texts]
        vectors = np.array(rows, dtype=np.float32).reshape(-1, 4)
        return vectors, vectors[:, 1]

    return predict


@registered
def model_embed(spark, sf_dir):
    model = ModelEmbedder(text_shape, dimensions=4)
    embedded = embed_documents(table(spark, sf_dir, "documents"), "text", model)
    parts = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)]
    return embedded.select("doc_id", *parts, "usage_tokens")


# Index


@registered
def index_table_rows(spark, sf_dir):
    rows = corpus_index_rows(documents_as(spark, sf_dir, text_path()), HashEmbedder(HASH_DIMS), WHOLE)
    return rows.select(
        "external_id",
        F.size("embedding").alias("dimensions"),
        "file_path",
        "start_line",
        "end_line",
        "item_name",
        F.md5("chunk_text").alias("chunk_md5"),
        "language",
    )


@registered
def upsert_merge(spark, sf_dir):
    """Index all documents, then again: even ones edited in place, odd ones a line longer."""
    documents = table(spark, sf_dir, "documents")
    edited = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "e", "E")).otherwise(
        F.concat("text", F.lit("\nmore"))
    )
    first = table_corpus(documents, text_path(), F.col("text"))
    second = table_corpus(documents, text_path(), edited)
    hashing = HashEmbedder(HASH_DIMS)
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    for files in (first, second):
        upsert_index(spark, path, corpus_index_rows(files, hashing, WHOLE))
    merged = read_index(spark, path)
    return merged.select("external_id", F.md5("chunk_text").alias("chunk_md5"))


# Search


def first_vector(embeddings: DataFrame) -> list[float]:
    return embeddings.where("vec_id = 0").first()["embedding"]


def rounded(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.select(*columns, "rank", F.round("score", 6).alias("score"))


@registered
def topk_cosine(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    return rounded(search(embeddings, first_vector(embeddings), 10, id_col="vec_id"), "vec_id")


def vector_queries(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("query_id"), "embedding")


@registered
def topk_batch(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    hits = search_batch(embeddings, vector_queries(embeddings), 10, id_col="vec_id")
    return rounded(hits, "query_id", "vec_id")


@registered
def topk_batch_grid(spark, sf_dir):
    """``topk_batch`` with bounds so small that both sides are dealt into cells."""
    embeddings = table(spark, sf_dir, "embeddings")
    hits = search_batch(embeddings, vector_queries(embeddings), 10, id_col="vec_id", in_place=False, **TINY_BOUNDS)
    return rounded(hits, "query_id", "vec_id")


@registered
def topk_batch_blocks(spark, sf_dir):
    """``topk_batch`` with bounds so small that queries pass by the index in several blocks."""
    embeddings = table(spark, sf_dir, "embeddings")
    hits = search_batch(embeddings, vector_queries(embeddings), 10, id_col="vec_id", **TINY_BOUNDS)
    return rounded(hits, "query_id", "vec_id")


@registered
def unit_vectors(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding")).alias("u"))
    values = scaled.select("vec_id", F.posexplode("u").alias("pos", "value"))
    return values.select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


def label_centroids(embeddings: DataFrame) -> DataFrame:
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    by_label = embeddings.groupBy(F.col("label").alias("centroid")).agg(mean.alias("mean"))
    return by_label.select("centroid", vector_to_array("mean").alias("embedding"))


@registered
def centroid_assign(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    assigned = ivf_assign(embeddings, label_centroids(embeddings), id_col="vec_id")
    return assigned.select("vec_id", "centroid")


@registered
def centroid_assign_grid(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    centroids = stored(label_centroids(embeddings))
    assigned = ivf_assign(embeddings, centroids, id_col="vec_id", **TINY_BOUNDS)
    return assigned.select("vec_id", "centroid")


def centroid_index(spark, embeddings: DataFrame, centroids: DataFrame) -> DataFrame:
    """The vectors as a stored table partitioned by centroid, which probes prune."""
    path = f"{checkpoint_dir(spark)}/centroids-{uuid.uuid4().hex}"
    write_by_centroid(ivf_assign(embeddings, centroids, id_col="vec_id"), path, id_col="vec_id")
    return spark.read.parquet(path)


@registered
def ivf_probe(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    centroids = stored(label_centroids(embeddings))
    index = centroid_index(spark, embeddings, centroids)
    hits = ivf_search(index, centroids, first_vector(embeddings), 10, nprobe=3, id_col="vec_id")
    return rounded(hits, "vec_id")


@registered
def ivf_probe_batch(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    centroids = stored(label_centroids(embeddings))
    index = centroid_index(spark, embeddings, centroids)
    hits = ivf_search_batch(index, centroids, vector_queries(embeddings), 10, nprobe=3, id_col="vec_id")
    return rounded(hits, "query_id", "vec_id")


@registered
def ivf_probe_batch_grid(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    centroids = stored(label_centroids(embeddings))
    index = centroid_index(spark, embeddings, centroids)
    queries = vector_queries(embeddings)
    hits = ivf_search_batch(index, centroids, queries, 10, nprobe=3, id_col="vec_id", **TINY_BOUNDS)
    return rounded(hits, "query_id", "vec_id")


@registered
def ivf_kmeans_full_probe(spark, sf_dir):
    """Trained centroids, all of them probed: must equal the exact search."""
    embeddings = table(spark, sf_dir, "embeddings")
    centroids = ivf_train(embeddings, 16, max_iter=5)
    assigned = ivf_assign(embeddings, centroids, id_col="vec_id")
    hits = ivf_search_batch(assigned, centroids, vector_queries(embeddings), 10, nprobe=16, id_col="vec_id")
    return rounded(hits, "query_id", "vec_id")


@registered
def semantic_search(spark, sf_dir):
    """All documents chunked and embedded, searched with every benchmark text."""
    hashing = HashEmbedder(HASH_DIMS)
    index = corpus_index_rows(documents_as(spark, sf_dir, text_path()), hashing, WHOLE)
    queries = embed_queries(table(spark, sf_dir, "benchmark"), "text", hashing)
    hits = search_batch(index, queries, 5, query_id_col="item_id")
    return rounded(hits, "item_id", "external_id")


@registered
def render_hits_query(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    vec, label = F.col("vec_id").cast("string"), F.col("label").cast("string")
    index = embeddings.select(
        F.concat(F.lit("vec/"), vec).alias("external_id"),
        "embedding",
        F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("vectors/"), vec)).alias("file_path"),
        (F.col("label") + 1).cast("long").alias("start_line"),
        (F.col("label") + 2).cast("long").alias("end_line"),
        F.when(F.col("label") % 2 == 1, F.concat(F.lit("label_"), label)).otherwise("").alias("item_name"),
        F.concat(F.lit("label "), label, F.lit("\nvector "), vec, F.lit("\n")).alias("chunk_text"),
    )
    hits = search(index, first_vector(embeddings), 10)
    return render_hits(attach_attributes(hits, index))
