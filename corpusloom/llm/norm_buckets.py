"""Exact top-k by inner product: vectors grouped by length, pruned per bucket by local cosine thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import integer_vectors as iv
from corpusloom.llm.common import part_count, shared_path, staged

PART_ROWS = 1 << 14  # vectors of a range of lengths that is written as one file
SEED_ROWS = 1 << 11  # longest vectors, whose products give every query its first threshold
FOCUS = 3  # coordinates that coordinate pruning looks at
COORDINATES_FROM = 0.7  # local cosine threshold from which coordinates prune better than lengths
QUERY_ROWS = 256  # queries that one product takes
SLACK = 1e-9  # by which thresholds give way to rounding


class Bucket:
    """Vectors of similar length, longest first; coordinates of the unit vectors are sorted when first asked for."""

    def __init__(self, x: np.ndarray, id_: np.ndarray, row: np.ndarray):
        length = iv.lengths(x)
        order = np.argsort(-length, kind="stable")
        self.x, self.id, self.row, self.length = x[order], id_[order], row[order], length[order]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def longest(self) -> float:
        return float(self.length[0])

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions by ascending value of coordinate ``f`` of the unit vectors, and the values."""
        if f not in self.sorted:
            values = self.x[:, f] / np.maximum(self.length, 1)  # whole numbers: 0 or at least 1 long
            order = np.argsort(values, kind="stable")
            self.sorted[f] = order, values[order]
        return self.sorted[f]

    def long_enough(self, least: float) -> int:
        """How many of the first vectors are at least so long."""
        return int(np.searchsorted(-self.length, -least * (1 - SLACK), side="right"))

    def feasible(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Positions whose focus coordinates allow this cosine with the unit vector ``unit``.

        Two unit vectors with an angle of at most t differ, in the angle to any axis, by at most
        t: so each coordinate of a match lies in an interval about the query's own.
        """
        reach, keep = np.arccos(min(1.0, cosine)) + 1e-6, None
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + reach)), np.cos(max(0.0, angle - reach))
            order, values = self.coordinate(int(f))
            a, b = np.searchsorted(values, low - SLACK), np.searchsorted(values, high + SLACK, side="right")
            if keep is None:
                keep = order[a:b]
            else:
                of_kept = self.x[keep, f] / np.maximum(self.length[keep], 1)
                keep = keep[(of_kept >= low - SLACK) & (of_kept <= high + SLACK)]
        return np.arange(len(self.x)) if keep is None else keep


def search_bucket(x: np.ndarray, row: np.ndarray, length: np.ndarray, first: np.ndarray, best: iv.Best, bucket: Bucket) -> None:
    """Offer ``best`` every vector of the bucket that can still enter, by the cheaper pruning for each query.

    A vector with product t to query q has a cosine of at least t / (|q| * longest of bucket).
    Above 1 the bucket holds nothing for the query; a high one leaves few feasible coordinates; a
    low one leaves the vectors that are at least t / |q| long, a prefix of the bucket.
    """
    for at in range(0, len(x), QUERY_ROWS):
        some = np.arange(at, min(at + QUERY_ROWS, len(x)))
        least = np.maximum(best.floor(), first)[some]  # what a query's results reach already
        bounded = (least > 0) & (length[some] > 0)
        cosine = np.where(bounded, least / np.maximum(length[some] * bucket.longest(), 1), 0.0)
        open_ = ~bounded | (cosine <= 1 + SLACK)
        open_ &= ~((least > 0) & (length[some] == 0))  # a zero query scores 0
        by_coordinate = open_ & (cosine >= COORDINATES_FROM)
        by_length = np.flatnonzero(open_ & ~by_coordinate)
        if len(by_length):
            reach = np.where(bounded, least / np.maximum(length[some], 1), 0.0)[by_length]
            n = bucket.long_enough(float(reach.min()))
            q = some[by_length]
            score = iv.products(x[q], bucket.x[:n])
            a, b = np.nonzero((score >= least[by_length][:, None]) & (row[q][:, None] != bucket.row[None, :n]))
            best.offer(q[a], score[a, b], bucket.id[b], bucket.row[b])
        for q in some[by_coordinate]:
            b = bucket.feasible(x[q] / length[q], float(cosine[q - at]))
            b = b[bucket.row[b] != row[q]]
            if len(b):
                score = iv.products(x[q : q + 1], bucket.x[b])[0]
                high = score >= least[q - at]
                best.offer(np.full(int(high.sum()), q), score[high], bucket.id[b[high]], bucket.row[b[high]])


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest integer inner product for each query row.

    Vectors become floor(scale * component) and are written once, in ranges of descending length,
    which are read in buckets and never shuffled again.  Queries come in broadcast pieces of
    bounded size.  The products with the longest vectors give each query a threshold; files whose
    vectors are too short for all queries of a piece are not read, buckets are pruned by the
    queries' local cosine thresholds, and what is left is verified.  Each task returns at most
    the k best of a query, and those that miss the threshold stay out.

    A row is not its own candidate, but a repeated row is; queries with one id are separate
    searches that share their query_id.  Ties fall to the smaller id, null ids last (an id of
    2^63 - 1 counts as null); a null id is no query unless ``is_query`` says so.  Vectors that are
    null or hold null or non-finite components take no part; zero and empty vectors do.  A query
    meets the vectors of its own number of components only.  Scores beyond a long are held at its
    end.  No rows or no queries: no rows.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = iv.scaled(vectors, scale, id_col, vector_col, q=F.coalesce(is_query, F.lit(False)))
    squares = F.aggregate("x", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    rows = staged(rows.withColumns({"row": F.monotonically_increasing_id(), "length": F.sqrt(squares)}), "vectors")
    total = rows.agg(F.count("*"), F.count_if("q"), F.max("d")).first()
    kind = "query long, query_id long, row long, id long, score long"
    schema = "query_id long, rank int, vec_id long, score long"
    if not total[1]:
        return spark.createDataFrame([], schema)
    parts = part_count(spark, total[0], PART_ROWS)
    order = [F.desc("length"), F.col("row")]  # the row splits ranges of equal lengths
    index = rows.select("row", "id", "d", "length", "x").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    index = staged(index, "buckets")
    seeds = spark.sparkContext.broadcast(index.orderBy(*order).limit(SEED_ROWS).toArrow())

    def first_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = seeds.value
        buckets = {}
        for batch in table.combine_chunks().to_batches():
            for block in iv.same_length(batch):
                buckets.setdefault(block.column("d")[0].as_py(), []).append(block)
        for batch in batches:
            for block in iv.same_length(batch):
                x, row = iv.matrix(block), iv.numbers(block, "row")
                best = iv.Best(len(x), k)
                for seed in buckets.get(block.column("d")[0].as_py(), []):
                    bucket = Bucket(iv.matrix(seed), iv.numbers(seed, "id"), iv.numbers(seed, "row"))
                    search_bucket(x, row, iv.lengths(x), np.full(len(x), iv.LEAST), best, bucket)
                columns = [block.column(c) for c in ("row", "id", "d", "length", "x")]
                names = ["row", "id", "d", "length", "x", "least"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best.floor())], names=names)

    queries = rows.where("q").select("row", "id", "d", "length", "x")
    known = queries.mapInArrow(first_thresholds, "row long, id long, d int, length double, x array<long>, least long")
    path = shared_path(spark, "partial")
    for number, piece in enumerate(iv.query_pieces(known, total[1], total[2], "queries")):
        table = piece.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        asked = spark.sparkContext.broadcast(table)

        def scan(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            lists = {}
            for batch in asked.value.to_batches():
                for size in np.unique(iv.numbers(batch, "d")):
                    own = batch.take(pa.array(np.flatnonzero(iv.numbers(batch, "d") == size)))
                    parts = iv.matrix(own), *(iv.numbers(own, c) for c in ("row", "id", "least"))
                    lists[int(size)] = *parts, iv.lengths(parts[0]), iv.Best(own.num_rows, k)
            for batch in batches:
                for block in iv.same_length(batch):
                    if (size := block.column("d")[0].as_py()) in lists:
                        x, row, _, first, length, best = lists[size]
                        bucket = Bucket(iv.matrix(block), iv.numbers(block, "id"), iv.numbers(block, "row"))
                        search_bucket(x, row, length, first, best, bucket)
            for x, row, id_, first, length, best in lists.values():
                query, score, found, found_row = best.found()
                columns = [pa.array(row[query]), iv.ids(id_[query]), pa.array(found_row), iv.ids(found), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "row", "id", "score"])

        long_enough = shortest(table)
        near = index if long_enough <= 0 else index.where(F.col("length") >= long_enough)
        near.mapInArrow(scan, kind).write.parquet(f"{path}/piece={number}")
        asked.unpersist()
    partial = spark.read.schema(f"{kind}, piece int").parquet(path)
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = partial.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def shortest(queries: pa.Table) -> float:
    """The least length a vector must have to reach the threshold of any of these queries; 0: any."""
    least, length = iv.numbers(queries, "least").astype(float), np.asarray(queries.column("length"))
    bounded = (least > 0) & (length > 0)
    return float((least / np.maximum(length, 1)).min() * (1 - 1e-6)) if bounded.all() else 0.0
