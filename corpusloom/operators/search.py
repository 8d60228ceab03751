"""Exact cosine top-k, for one query vector or for a table of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import BROADCAST_BYTES, CELL_BYTES, INDEX_BLOCK_BYTES, TOP_K
from corpusloom.functions.vectors import Rows, TopK, cosine_to, matrix, result_batches, top_k_of_batches
from corpusloom.session import checkpoint_folder, cut_lineage, stored
from corpusloom.sources import walk

SPREAD = 8  # pieces of either side of a grid's cell before these grow


def search(
    index: DataFrame,
    query: Sequence[float],
    k: int = TOP_K,
    *,
    id_col: str = "external_id",
    vec_col: str = "embedding",
    carry: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` rows most similar to ``query``: ``rank, score, <id>`` and ``carry`` columns.

    Only the id, the vector and ``carry`` are read.  Every partition keeps its own best
    ``k`` before they are merged; ties fall to the smaller id, null ids last.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    usable = index.where(F.col(vec_col).isNotNull())
    scored = usable.select(id_col, *carry, cosine_to(query)(F.col(vec_col)).alias("score"))
    scored = scored.where("score is not null")
    order = [F.desc("score"), F.asc_nulls_last(id_col)]
    best = scored.orderBy(*order).limit(k)
    # At most k rows are left, so one window over all of them is bounded.
    rank = F.row_number().over(Window.orderBy(*order))
    return best.select(rank.alias("rank"), "score", id_col, *carry)


@dataclass
class SmallVectors:
    """A table of vectors known to fit the broadcast bound."""

    ids: pa.Array
    vectors: np.ndarray


def vector_length(df: DataFrame, vec_col: str) -> int | None:
    row = df.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
    return None if row is None else row[0]


def collect_if_small(
    df: DataFrame, id_col: str, vec_col: str, dims: int, max_bytes: int
) -> SmallVectors | None:
    """The vectors, or None if they exceed ``max_bytes``; reads one row past the bound."""
    bound = max(1, max_bytes // (8 * dims))
    rows = df.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).limit(bound + 1).toArrow()
    if rows.num_rows > bound:
        return None
    return SmallVectors(rows.column(0).combine_chunks(), matrix(rows.column(1), dims, None))


def partial_schema_of(index: DataFrame, queries: DataFrame, id_col: str, query_id_col: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query", T.LongType()),
            T.StructField("query_id", queries.schema[query_id_col].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("id", index.schema[id_col].dataType),
        ]
    )


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _named(ranked: DataFrame, id_col: str, query_id_col: str) -> DataFrame:
    return ranked.select(
        F.col("query_id").alias(query_id_col), "rank", "score", F.col("id").alias(id_col)
    )


def merge_top_k(partial: DataFrame, k: int, id_col: str, query_id_col: str) -> DataFrame:
    """Best ``k`` per query row out of the partial lists, ranked."""
    return _named(_ranked(partial, k), id_col, query_id_col)


def search_batch(
    index: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    *,
    id_col: str = "external_id",
    vec_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vec_col: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    cell_bytes: int = CELL_BYTES,
    index_bytes: int = INDEX_BLOCK_BYTES,
    in_place: bool = True,
) -> DataFrame:
    """The best ``k`` rows for every query: ``<query id>, rank, score, <id>``.

    Queries within ``broadcast_bytes`` travel to the index: one pass over it, each task
    keeping ``k`` rows per query, and only those are shuffled.  More queries than that are
    stored in blocks which pass by the index rows where these lie (see ``blocked_top_k``).  If not
    ``in_place``, or if the staging folder is one that only Spark can open, both sides are dealt
    into a grid of bounded cells instead (see ``grid_top_k``).

    On all ways every query row is a search of its own, also under a repeated or null id; index
    rows with a null id are found, last among ties; repeated index rows are found each; vectors
    that are null, zero or hold a null or non-finite value are never found and find nothing.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    partial_schema = partial_schema_of(index, queries, id_col, query_id_col)
    dims = vector_length(queries, query_vec_col)
    if dims is None:
        partial = queries.sparkSession.createDataFrame([], partial_schema)
        return merge_top_k(partial, k, id_col, query_id_col)
    small = collect_if_small(queries, query_id_col, query_vec_col, dims, broadcast_bytes)
    if small is not None:
        rows = index.where(F.col(vec_col).isNotNull()).select(id_col, vec_col)
        partial = rows.mapInArrow(top_k_of_batches(small.ids, small.vectors, k), partial_schema)
        return merge_top_k(partial, k, id_col, query_id_col)
    rows = index.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    asked = queries.select(
        F.monotonically_increasing_id().alias("query"),
        F.col(query_id_col).alias("query_id"),
        F.col(query_vec_col).alias("vec"),
    )
    blocks = checkpoint_folder(queries.sparkSession, "queries") if in_place else None
    if blocks is not None and walk.reachable(blocks):
        return _named(blocked_top_k(rows, asked, k, dims, blocks, cell_bytes, index_bytes), id_col, query_id_col)
    one = F.lit(0).alias("cell")
    cells = rows.select(one, "*"), asked.select(one, "*")
    partial = grid_top_k(*cells, k, dims, partial_schema, cell_bytes, index_bytes)
    return merge_top_k(partial, k, id_col, query_id_col)


def blocked_top_k(
    index: DataFrame, queries: DataFrame, k: int, dims: int, path: str, block_bytes: int, index_bytes: int
) -> DataFrame:
    """``query, query_id, rank, score, id`` of ``(id, vec)`` rows for ``(query, query_id, vec)`` queries.

    Queries are written to ``path``, a new shared folder, in files of at most ``block_bytes``.  The
    index is read once and its rows are not shuffled: a task holds ``index_bytes`` of them at a time
    and lets all files pass by, keeping ``k`` rows of each query.  Before the shuffle a task's lists
    are cut to ``k`` a query again, so what moves is tasks x queries x ``k`` rows of a number, a
    score and an id.  A repeated task reads the same files.
    """
    rows_each = max(1, index_bytes // (8 * dims))
    kept = queries.where("vec is not null")
    kept.write.option("maxRecordsPerFile", max(1, block_bytes // (8 * dims))).parquet(path)
    asked = queries.sparkSession.read.schema(queries.schema).parquet(path)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        own: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, rows_each):
                own.append(batch.slice(at, rows_each))
                if sum(b.num_rows for b in own) >= rows_each:
                    table, own = pa.Table.from_batches(own), []
                    yield table
                    del table
        if own:
            table, own = pa.Table.from_batches(own), []
            yield table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in held(batches):
            rows = Rows(table["id"].combine_chunks(), matrix(table["vec"], dims, None))
            del table
            for block in walk.tables(path, ["query", "vec"]):
                top = TopK(matrix(block["vec"], dims, None), k)
                top.add_rows(rows)
                number = block["query"].combine_chunks()
                for batch in result_batches(top, number):
                    yield batch.select(["query_id", "score", "id"]).rename_columns(["query", "score", "id"])

    kinds = T.StructType([asked.schema["query"], T.StructField("score", T.DoubleType()), index.schema["id"]])
    partial = index.where("vec is not null").mapInArrow(run, kinds)
    return _ranked(partial, k).join(asked.select("query", "query_id"), "query")


def bounded_broadcast(counts: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A stored table of counts, marked for broadcast if its measured size allows that.

    Beyond the bound the join shuffles, and adaptive execution splits its hot partitions.
    """
    return F.broadcast(counts) if counts.count() * row_bytes <= BROADCAST_BYTES else counts


def grid_top_k(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    dims: int,
    partial_schema: T.StructType,
    cell_bytes: int = CELL_BYTES,
    piece_bytes: int = INDEX_BLOCK_BYTES,
) -> DataFrame:
    """Partial top-k lists of ``(cell, id, vec)`` rows for ``(cell, query, query_id, vec)`` queries.

    Within a cell both sides are dealt by hash into pieces of bounded size; every index
    piece meets every query piece of its cell in one group.  A cell that holds a third of
    all rows only gets more pieces, and no pair of rows is ever emitted.

    A row goes to as many groups as the other side has pieces.  So these hold ``cell_bytes`` only
    until there are ``SPREAD`` of them, enough to work at once, and grow to ``piece_bytes`` before
    there are more: what moves is in proportion to the rows until a cell has ``SPREAD`` full pieces.
    """
    rows_per_piece = max(1, cell_bytes // (8 * dims))
    rows_at_most = max(rows_per_piece, piece_bytes // (8 * dims))
    index = index.where("vec is not null")
    # Queries are read three times here, and may come from a model.
    queries = stored(queries.where("vec is not null"))

    def pieces(df: DataFrame, name: str) -> DataFrame:
        small, full = (F.ceil(F.count("*") / n) for n in (rows_per_piece, rows_at_most))
        need = F.least(small, F.greatest(full, F.lit(SPREAD)))
        return df.groupBy("cell").agg(need.cast("int").alias(name))

    # One row per cell, used by both sides.
    cells = pieces(index, "index_pieces").join(pieces(queries, "query_pieces"), "cell")
    grid = bounded_broadcast(cut_lineage(cells))

    def dealt(df: DataFrame, keys: list[str], own: str, own_name: str, other: str, other_name: str) -> DataFrame:
        # The vector takes part: rows under one id, or none, spread as well.
        number = F.pmod(F.xxhash64(*keys, "vec"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return (
            df.join(grid, "cell")
            .select("cell", *keys, "vec", number.alias(own_name), every.alias(other_name))
        )

    left = dealt(index, ["id"], "index_pieces", "i", "query_pieces", "q")
    right = dealt(queries, ["query", "query_id"], "query_pieces", "q", "index_pieces", "i")

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        top = TopK(matrix(asked["vec"], dims, None), k)
        top.add(rows["id"].combine_chunks(), matrix(rows["vec"], dims, None))
        found = list(result_batches(top, asked["query_id"].combine_chunks(), asked["query"].combine_chunks()))
        if not found:
            none = pa.array([], pa.float64())
            return pa.table(
                {"query": asked["query"][:0], "query_id": asked["query_id"][:0], "score": none, "id": rows["id"][:0]}
            )
        return pa.Table.from_batches(found)

    keys = ["cell", "i", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, partial_schema)


def attach_attributes(hits: DataFrame, index: DataFrame, id_col: str = "external_id", vec_col: str = "embedding") -> DataFrame:
    """Fetch the stored attributes of hits; wide columns are read only here.

    The planner broadcasts the hits while their estimated size allows it.
    """
    attributes = index.drop(vec_col, *[c for c in index.columns if c in hits.columns and c != id_col])
    return hits.join(attributes, id_col, "left")
