"""Approximate nearest neighbours: random-projection trees, one shared queue, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import part_count, staged

TREES = 16
SAMPLE = 1 << 15  # vectors the trees are grown on, at most; every vector is indexed
LEAF_SAMPLE = 48  # sampled vectors a leaf, at most
SEARCH_SHARE = 0.6  # of the index a search looks at, summed over the trees, ...
SEARCH_LEAST = 1 << 14  # ... and at least so many vectors, with repeats
CELL_ROWS = 1 << 13  # vectors of a leaf that one task scores at a time


@dataclass
class Tree:
    """Inner node i sends a vector left (child 0) if its product with ``normals[i]`` is below
    ``cuts[i]``; a child below 0 is leaf ``~child``."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.cuts) else np.full(len(x), -1)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.normals[node]) >= self.cuts[node]
            at[inner] = self.children[node, right.astype(np.int64)]
        return ~at


def grow(sample: np.ndarray, leaf_sample: int, rng: np.random.Generator) -> Tree:
    """Splits at the median of projections on the difference of two sampled vectors, until a
    node holds ``leaf_sample`` vectors or no longer splits (its vectors are equal)."""
    normals, cuts, children, leaves = [], [], [], 0
    todo = [(np.arange(len(sample)), None)]
    while todo:
        rows, place = todo.pop()
        node = None
        for _ in range(3 if len(rows) > leaf_sample else 0):
            a, b = rng.choice(len(rows), 2, replace=False)
            normal = sample[rows[a]] - sample[rows[b]]
            length = np.linalg.norm(normal)
            if length > 0:
                side = sample[rows] @ (normal / length)
                cut = np.median(side)
                right = side >= cut
                if right.any() and not right.all():
                    node = len(cuts)
                    normals.append(normal / length)
                    cuts.append(cut)
                    children.append([0, 0])
                    todo += [(rows[~right], (node, 0)), (rows[right], (node, 1))]
                    break
        if node is None:
            node, leaves = ~leaves, leaves + 1
        if place is not None:
            children[place[0]][place[1]] = node
    shape = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(
        np.array(normals).reshape(-1, shape), np.array(cuts, float), np.array(children, np.int64).reshape(-1, 2), leaves
    )


def promises(queries: np.ndarray, tree: Tree) -> np.ndarray:
    """For every query and leaf the largest margin by which the way to the leaf goes against the
    query's own side; 0 for the leaf the query falls into."""
    if not len(tree.cuts):
        return np.zeros((len(queries), 1))
    sides = queries @ tree.normals.T - tree.cuts
    inner, leaves = np.zeros(sides.shape), np.zeros((len(queries), tree.leaves))
    for node in range(len(tree.cuts)):  # children come after their parent
        for right, child in enumerate(tree.children[node]):
            against = np.maximum(-sides[:, node] if right else sides[:, node], 0)
            to, at = (inner, child) if child >= 0 else (leaves, ~child)
            to[:, at] = np.maximum(inner[:, node], against)
    return leaves


def probes(queries: np.ndarray, trees: list[Tree], share: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tree and leaf numbers each query visits: all trees' leaves wait in one queue, the smallest
    promise first, and are taken until they make up ``share`` of the index in expectation."""
    found = np.concatenate([promises(queries, tree) for tree in trees], axis=1)
    tree = np.repeat(np.arange(len(trees)), [t.leaves for t in trees])
    leaf = np.concatenate([np.arange(t.leaves) for t in trees])
    part = np.concatenate([np.full(t.leaves, 1 / t.leaves) for t in trees])
    out = []
    for row in found:
        order = np.argsort(row, kind="stable")
        taken = order[: int(np.searchsorted(np.cumsum(part[order]), min(share, len(trees)) - 1e-9)) + 1]
        out.append((tree[taken], leaf[taken]))
    return out


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal vectors get equal scores wherever they are scored."""
    dots = (vectors * query).sum(axis=1)
    return dots / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def best_of(query: np.ndarray, vectors: np.ndarray, rough: np.ndarray, ids: np.ndarray, k: int):
    """Rows and exact scores of the k best; whatever rounding could lift among them is rescored."""
    if len(rough) > k:
        bound = np.partition(rough, len(rough) - k)[len(rough) - k]
        rows = np.flatnonzero(rough >= bound - 1e-9)
    else:
        rows = np.arange(len(rough))
    scores = exact(query, vectors[rows])
    order = np.lexsort((ids[rows], -scores))[:k]
    return rows[order], scores[order]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    sample: int = SAMPLE,
    leaf_sample: int = LEAF_SAMPLE,
    share: float = SEARCH_SHARE,
    least: int = SEARCH_LEAST,
    seed: int = 0,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest cosine found for each query row.

    Trees are grown on at most ``sample`` vectors, but every vector is put into a leaf of every
    tree.  A leaf's vectors are dealt over cells of bounded size, so a vector with very many
    copies is no hot task; a query goes to every cell of its leaves.  Candidates are scored in
    blocks and only each task's k best per query leave it.

    A row is not its own candidate, but a repeated row is; queries with one id are separate
    searches, numbered together.  Ties fall to the smaller id, null ids last.  Vectors that are
    null, zero, or hold null or non-finite values take no part, nor do those whose length is not
    the most common one.  No vectors or no queries: no rows.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), is_query.alias("q")
    )
    finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["d"]
    rows = staged(rows.where(F.size("x") == dims).withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = rows.count()
    part = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 0.98 * sample / total) * (1 << 30))
    drawn = rows.where(part).orderBy("row").limit(sample).select("x").toArrow().column("x").combine_chunks()
    points = np.asarray(drawn.flatten()).reshape(-1, dims)
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    forest = [grow(points, leaf_sample, np.random.default_rng([seed, t])) for t in range(trees)]
    shared = spark.sparkContext.broadcast([(t.normals, t.cuts, t.children, t.leaves) for t in forest])
    looked = max(share, least / total)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column("x")
        return np.asarray(column.flatten()).reshape(len(column), -1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = [Tree(*t) for t in shared.value]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = matrix(part)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for t, tree in enumerate(forest):
                    leaf = pa.array(tree.leaf_of(unit).astype(np.int32))
                    number = pa.array(np.full(len(x), t, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [number, leaf, *(part.column(c) for c in ("row", "id", "x"))], names=["tree", "leaf", "row", "id", "x"]
                    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = [Tree(*t) for t in shared.value]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                x = matrix(part)
                found = probes(x / np.linalg.norm(x, axis=1, keepdims=True), forest, looked)
                for low in range(0, len(found), 16):
                    some = found[low : low + 16]
                    owner = pa.array(low + np.repeat(np.arange(len(some)), [len(t) for t, _ in some]))
                    number, leaf = (pa.array(np.concatenate(c).astype(np.int32)) for c in zip(*some))
                    own = part.take(owner)
                    yield pa.RecordBatch.from_arrays(
                        [number, leaf, *(own.column(c) for c in ("row", "id", "x"))], names=["tree", "leaf", "row", "id", "x"]
                    )

    kind = "tree int, leaf int, row long, id long, x array<double>"
    indexed = rows.select("row", "id", "x").mapInArrow(place, kind)
    cells = indexed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / CELL_ROWS).alias("cells"))
    cells = staged(cells, "cells")  # trees x leaves: bounded by the sample
    indexed = indexed.join(F.broadcast(cells), ["tree", "leaf"]).withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells")))
    asked = rows.where("q").select("row", "id", "x").mapInArrow(visit, kind).join(F.broadcast(cells), ["tree", "leaf"])
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    both = indexed.withColumn("kind", F.lit(1)).unionByName(asked.withColumn("kind", F.lit(0))).drop("cells")
    parts = part_count(spark, total * trees, 1 << 16)
    key = ["tree", "leaf", "cell"]
    both = both.repartition(parts, *key).sortWithinPartitions(*key, "kind")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # by query row: its id, candidates' rows, ids and scores

        def flushed() -> Iterator[pa.RecordBatch]:
            for some in range(0, len(best), 4096):
                names = list(best)[some : some + 4096]
                counts = [len(best[q][1]) for q in names]
                columns = [np.repeat(names, counts), np.repeat([best[q][0] for q in names], counts)]
                columns += [np.concatenate([best[q][c] for q in names]) for c in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "row", "id", "score"])
            best.clear()

        def compare(queries: list[tuple], rows_: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            for at in range(0, len(queries), 256):
                some = queries[at : at + 256]
                block = np.stack([v for _, _, v in some])
                rough = (block / np.linalg.norm(block, axis=1, keepdims=True)) @ unit.T
                for (q, q_id, v), line in zip(some, rough):
                    own = np.flatnonzero(rows_ == q)
                    if len(own):
                        other = np.delete(np.arange(len(rows_)), own)
                        picked, values = best_of(v, x[other], line[other], ids[other], k)
                        picked = other[picked]
                    else:
                        picked, values = best_of(v, x, line, ids, k)
                    new = (rows_[picked], ids[picked], values)
                    if q in best:
                        joined = [np.concatenate(pair) for pair in zip(best[q][1:], new)]
                        once = np.unique(joined[0], return_index=True)[1]
                        joined = [c[once] for c in joined]
                        order = np.lexsort((joined[1], -joined[2]))[:k]
                        new = tuple(c[order] for c in joined)
                    best[q] = (q_id, *new)

        queries, current = [], None
        for batch in batches:
            names = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in key])
            edges = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                cell = tuple(names[:, a])
                if cell != current:
                    queries, current = [], cell
                    if len(best) > 1 << 18:
                        yield from flushed()
                part = batch.slice(a, b - a)
                kinds = np.asarray(part.column("kind"))
                x = matrix(part)
                rows_ = np.asarray(part.column("row"))
                ids = np.asarray(part.column("id").fill_null(np.iinfo(np.int64).max))
                asks = int((kinds == 0).sum())
                queries += [(int(rows_[i]), int(ids[i]), x[i]) for i in range(asks)]
                if asks < len(kinds) and queries:
                    compare(queries, rows_[asks:], ids[asks:], x[asks:])
        yield from flushed()

    scored = both.mapInArrow(score, "query long, query_id long, row long, id long, score double").distinct()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    known = F.when(F.col("id") < (1 << 63) - 1, F.col("id"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), known.alias("vec_id"), "score")
