"""Centroid-partitioned approximate search: train, assign, probe, rerank exactly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import BROADCAST_BYTES, CELL_BYTES, TOP_K
from corpusloom.functions.vectors import TopK, is_zero, matrix, top_k_of_batches
from corpusloom.operators.search import (
    SmallVectors,
    bounded_broadcast,
    partial_schema_of,
    collect_if_small,
    grid_top_k,
    merge_top_k,
    search,
    search_batch,
    vector_length,
)
from corpusloom.session import cut_lineage, stored

ROWS_PER_FILE = 1_000_000
PROBE_BYTES = 32  # of one query and centroid pair, collected and sent with the queries


def ivf_train(
    vectors: DataFrame, n_centroids: int, *, vec_col: str = "embedding", seed: int = 0, max_iter: int = 20
) -> DataFrame:
    """``centroid, embedding`` rows by k-means under cosine distance."""
    usable = vectors.where(~is_zero(F.col(vec_col)))
    features = usable.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=n_centroids, distanceMeasure="cosine", seed=seed, maxIter=max_iter).fit(features)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "centroid int, embedding array<double>")


def _small_centroids(centroids: DataFrame, max_bytes: int) -> SmallVectors | None:
    dims = vector_length(centroids, "embedding")
    if dims is None:
        raise ValueError("no centroids")
    return collect_if_small(centroids.orderBy("centroid"), "centroid", "embedding", dims, max_bytes)


def nearest_centroid(vec: Column | str, centroids: SmallVectors) -> Column:
    """Number of the most similar centroid, the smallest on ties; null for a vector that has none."""
    numbers, table = centroids.ids, centroids.vectors

    @F.arrow_udf(T.IntegerType())
    def assign(column: pa.Array) -> pa.Array:
        top = TopK(matrix(column, table.shape[1]), 1)
        top.add(numbers, table)
        found = np.full(len(column), -1)
        if top.best is not None:
            found[top.best["q"].to_numpy()] = top.best["id"].to_numpy()
        return pa.array(found, pa.int32(), mask=found < 0)

    return assign(vec)


def ivf_assign(
    vectors: DataFrame,
    centroids: DataFrame,
    *,
    id_col: str = "external_id",
    vec_col: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """``vectors`` with their ``centroid``; no shuffle while the centroids fit the bound.

    Both ways score alike and go by rows: repeated and null ids keep their own centroid.  Rows
    without a vector are left out; zero and non-finite vectors have no centroid.
    """
    small = _small_centroids(centroids, broadcast_bytes)
    usable = vectors.where(F.col(vec_col).isNotNull())
    if small is not None:
        return usable.withColumn("centroid", nearest_centroid(vec_col, small))
    numbered = stored(usable.withColumn("_row", F.monotonically_increasing_id()))
    nearest = search_batch(
        centroids,
        numbered,
        1,
        id_col="centroid",
        query_id_col="_row",
        query_vec_col=vec_col,
        broadcast_bytes=broadcast_bytes,
        cell_bytes=cell_bytes,
    )
    return numbered.join(nearest.select("_row", "centroid"), "_row", "left").drop("_row")


def spread_by_centroid(assigned: DataFrame, rows_per_file: int = ROWS_PER_FILE, id_col: str = "external_id") -> DataFrame:
    """``assigned`` dealt for a write partitioned by centroid: a hot one goes to as many tasks as it
    needs.  The assignment is stored once before it is counted and dealt."""
    assigned = stored(assigned)
    files = F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files")
    sizes = assigned.groupBy(F.col("centroid").alias("_of")).agg(files)
    # Only centroids with more than one file: at most one row per rows_per_file index rows.
    hot = bounded_broadcast(cut_lineage(sizes.where("_files > 1")))
    # Zero vectors have no centroid, and may be many too.
    joined = assigned.join(hot, F.col("centroid").eqNullSafe(F.col("_of")), "left")
    salt = F.pmod(F.xxhash64(id_col), F.coalesce("_files", F.lit(1)))
    salted = joined.withColumn("_salt", salt)
    return salted.repartition("centroid", "_salt").drop("_of", "_files", "_salt")


def write_by_centroid(
    assigned: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, id_col: str = "external_id"
) -> None:
    """Parquet partitioned by centroid; a hot centroid is spread over as many files as it needs."""
    spread = spread_by_centroid(assigned, rows_per_file, id_col)
    writer = spread.write.partitionBy("centroid").option("maxRecordsPerFile", rows_per_file)
    writer.mode("errorifexists").parquet(path)


def ivf_search(
    index: DataFrame,
    centroids: DataFrame,
    query: Sequence[float],
    k: int = TOP_K,
    nprobe: int = 8,
    *,
    id_col: str = "external_id",
    vec_col: str = "embedding",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Exact top-k within the ``nprobe`` centroids nearest to the query.

    The centroid predicate prunes partitions of an index written by centroid.
    """
    probes = [r["centroid"] for r in search(centroids, query, nprobe, id_col="centroid").collect()]
    probed = index.where(F.col("centroid").isin(probes))
    return search(probed, query, k, id_col=id_col, vec_col=vec_col, carry=carry)


def ivf_search_batch(
    index: DataFrame,
    centroids: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    nprobe: int = 8,
    *,
    id_col: str = "external_id",
    vec_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vec_col: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """``ivf_search`` for a table of queries; ``<query id>, rank, score, <id>``."""
    if centroids.count() <= nprobe:  # all are probed: rows without a centroid are never found
        return search_batch(
            index,
            queries,
            k,
            id_col=id_col,
            vec_col=vec_col,
            query_id_col=query_id_col,
            query_vec_col=query_vec_col,
            broadcast_bytes=broadcast_bytes,
            cell_bytes=cell_bytes,
        )
    schema = partial_schema_of(index, queries, id_col, query_id_col)
    dims = vector_length(queries, query_vec_col)
    if dims is None:
        return merge_top_k(index.sparkSession.createDataFrame([], schema), k, id_col, query_id_col)
    # Queries go by rows, so repeated and null ids are told apart, and may come from a model.
    asked = queries.where(F.col(query_vec_col).isNotNull())
    asked = asked.select(F.col(query_id_col).alias("query_id"), F.col(query_vec_col).alias("vec"))
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()))
    probes = search_batch(
        centroids,
        asked,
        nprobe,
        id_col="centroid",
        query_id_col="query",
        query_vec_col="vec",
        broadcast_bytes=broadcast_bytes,
        cell_bytes=cell_bytes,
    ).select("query", "centroid")
    small = collect_if_small(asked, "query", "vec", dims, broadcast_bytes)
    rows = index.where(F.col(vec_col).isNotNull())
    if small is not None and len(small.ids) * nprobe * PROBE_BYTES <= broadcast_bytes:
        pairs = probes.toArrow()
        order = np.argsort(small.ids.to_numpy())
        at = np.searchsorted(small.ids.to_numpy(), pairs["query"].to_numpy(), sorter=order)
        numbers, centroid_of = order[at], pairs["centroid"].to_numpy()
        by_centroid = {int(c): np.sort(numbers[centroid_of == c]) for c in np.unique(centroid_of)}
        probed = rows.where(F.col("centroid").isin(list(by_centroid)))
        kernel = top_k_of_batches(small.ids, small.vectors, k, by_centroid)
        number = T.StructType([schema["query"], T.StructField("query_id", T.LongType()), *schema.fields[2:]])
        partial = probed.select(id_col, vec_col, "centroid").mapInArrow(kernel, number)
        partial = partial.drop("query").withColumnRenamed("query_id", "query")
        partial = partial.join(asked.select("query", "query_id"), "query")
    else:
        met = asked.join(probes, "query")
        partial = grid_top_k(
            rows.select(F.col("centroid").alias("cell"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec")),
            met.select(F.col("centroid").alias("cell"), "query", "query_id", "vec"),
            k,
            dims,
            schema,
            cell_bytes,
        )
    return merge_top_k(partial, k, id_col, query_id_col)
