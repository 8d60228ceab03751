"""Vector arithmetic in Arrow batches: columns for one query, a block kernel for many.

Spark's higher-order functions need about a microsecond per vector element, these a few
nanoseconds; only the vectors cross to Python, and only scores come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.schemas import VECTOR

_BLOCK_CELLS = 1_000_000  # scores held at once by the kernel: few enough for a cache
_QUERY_BLOCK = 512  # queries whose hits are kept, and sorted, together
_MOST_ROWS = 16_384  # rows that a block of queries meets at once
_CANDIDATES = 1 << 18  # preselected pairs held at once, beyond those of one query
_EXACT = 8_192  # pairs whose vectors are gathered in double at once


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in double, the row of each value, and the length of each row."""
    lengths = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values, np.repeat(np.arange(len(lengths)), lengths), lengths


def _row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums per row in element order, so that equal rows have equal sums."""
    # Without any value bincount returns integers.
    return np.bincount(row, weights=values, minlength=rows).astype(np.float64, copy=False)


def usable(lengths: np.ndarray) -> np.ndarray:
    """Vectors of these lengths can be compared: not zero, and every value is finite."""
    return (lengths > 0) & np.isfinite(lengths)


def vector_lengths(vectors: np.ndarray) -> np.ndarray:
    """In double; a value that is null, NaN or infinite makes the length so."""
    lengths = np.empty(len(vectors))
    for lo in range(0, len(vectors), _EXACT):  # no second copy of all vectors
        wide = vectors[lo : lo + _EXACT].astype(np.float64, copy=False)
        lengths[lo : lo + _EXACT] = np.sqrt((wide * wide).sum(axis=1))
    return lengths


def unit_rows(vectors: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows ``at``, scaled to length one, in single precision."""
    scaled = np.empty((len(at), vectors.shape[1]), np.float32)
    for lo in range(0, len(at), _EXACT):
        own = at[lo : lo + _EXACT]
        scaled[lo : lo + _EXACT] = vectors[own] / lengths[own, None]
    return scaled


def exact_cosines(a: np.ndarray, b: np.ndarray, a_lengths, b_lengths) -> np.ndarray:
    """Row by row, in double from the stored values, in one summation order: every search scores
    by this, so equal vectors score equally whatever path brought them together."""
    return (a.astype(np.float64, copy=False) * b.astype(np.float64, copy=False)).sum(axis=1) / (a_lengths * b_lengths)


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine similarity of two vector columns; null when either is zero, null or not finite."""
    (x, row, lengths), (y, _, others) = _flat(a), _flat(b)
    if not np.array_equal(lengths, others):
        raise ValueError("vector lengths differ")
    n = len(lengths)
    scale = np.sqrt(_row_sums(x * x, row, n)) * np.sqrt(_row_sums(y * y, row, n))
    score = np.divide(_row_sums(x * y, row, n), scale, out=np.zeros(n), where=scale > 0)
    return pa.array(score, mask=~usable(scale))


@F.arrow_udf(VECTOR)
def unit(column: pa.Array) -> pa.Array:
    """The vector scaled to length one; null when it is zero or null."""
    values, row, lengths = _flat(column)
    norms = np.sqrt(_row_sums(values * values, row, len(lengths)))
    scaled = np.divide(values, norms[row], out=np.zeros(len(values)), where=norms[row] > 0)
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    lists = pa.ListArray.from_arrays(offsets, pa.array(scaled.astype(np.float32)))
    return pc.if_else(pa.array(norms > 0), lists, pa.scalar(None, lists.type))


def is_zero(column: Column) -> Column:
    return ~F.exists(column, lambda x: x != 0)


def cosine_to(query: Sequence[float]) -> Callable[[Column | str], Column]:
    """Cosine similarity of a vector column to one fixed vector; null if one is zero or not finite."""
    q = np.asarray(query, dtype=np.float64)
    length = vector_lengths(q[None])[0]

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        vectors = matrix(column, len(q))
        lengths = vector_lengths(vectors)
        live = usable(lengths) & usable(np.full(len(lengths), length))
        values = np.zeros(len(lengths))
        values[live] = exact_cosines(q[None], vectors[live], length, lengths[live])
        return pa.array(values, mask=~live)

    return score


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, dtype=np.float64) -> np.ndarray:
    """A list column as a dense matrix; any other row length is an error.

    Without ``dtype`` values keep their stored type.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and not pc.all(pc.equal(column.value_lengths(), dims)).as_py():
        raise ValueError(f"vector lengths differ from {dims}")
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return values if dtype is None else values.astype(dtype, copy=False)


class Rows:
    """Rows to be searched, made ready once for any number of queries."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = vector_lengths(vectors)
        self.live = np.flatnonzero(usable(self.norms))
        self.unit = unit_rows(vectors, self.norms, self.live)


class TopK:
    """The k best rows for each of some queries, fed block by block.

    Single-precision products only preselect: whatever could reach the top within their
    error bound is scored again in double, in a fixed summation order, so that equal
    vectors score equally and ties fall to the smaller id.

    Queries go by blocks of their own, so memory beyond queries, rows and ``k`` hits a query is
    bounded, whatever their numbers.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.norms, self.k = queries, vector_lengths(queries), k
        self.live = np.flatnonzero(usable(self.norms))
        self.slack = 2.0 * (queries.shape[1] + 8) * 2.0**-23
        self.floor = np.full(len(queries), -np.inf)
        self.parts: dict[int, pa.Table] = {}  # hits by block of queries

    def hits(self) -> Iterator[pa.Table]:
        """``q, score, id``, block by block, by query and rank."""
        for block in sorted(self.parts):
            yield self.parts[block]

    @property
    def best(self) -> pa.Table | None:
        return pa.concat_tables(self.hits()) if self.parts else None

    def add(self, ids: pa.Array, vectors: np.ndarray, only: np.ndarray | None = None) -> None:
        """Score rows against all live queries, or only against those numbered ``only``."""
        self.add_rows(Rows(ids, vectors), only)

    def add_rows(self, rows: Rows, only: np.ndarray | None = None) -> None:
        asked = self.live if only is None else np.sort(only[np.isin(only, self.live)])
        if not len(asked) or not len(rows.live):
            return
        bounds = np.flatnonzero(np.diff(asked // _QUERY_BLOCK)) + 1
        for own in np.split(asked, bounds):
            unit_queries = unit_rows(self.queries, self.norms, own)
            step = min(_MOST_ROWS, max(1, _BLOCK_CELLS // len(own)))
            for lo in range(0, len(rows.live), step):
                self._add_block(rows, slice(lo, lo + step), own, unit_queries)

    def _add_block(self, rows: Rows, part: slice, asked: np.ndarray, unit_queries: np.ndarray) -> None:
        at = rows.live[part]
        rough = unit_queries @ rows.unit[part].T
        # Compared in single precision: rounded down, so that nothing is lost.
        floor = np.nextafter((self.floor[asked] - self.slack).astype(np.float32), np.float32(-np.inf))
        near = rough >= floor[:, None]
        counts = np.count_nonzero(near, axis=1)
        many = np.flatnonzero(counts > 2 * self.k)
        if len(many):
            last = len(at) - self.k
            own = np.partition(rough[many], last, axis=1)[:, last].astype(np.float64) - 2 * self.slack
            own = np.nextafter(own.astype(np.float32), np.float32(-np.inf))
            near[many] &= rough[many] >= own[:, None]
            counts[many] = np.count_nonzero(near[many], axis=1)
        # Equal vectors may all be near: taken on by so few queries that their number is bounded.
        cuts = np.flatnonzero(np.diff(np.cumsum(counts) // _CANDIDATES)) + 1
        for own in np.split(np.arange(len(asked)), cuts):
            # Of one axis, which numpy does several times faster.
            q, r = np.divmod(np.flatnonzero(near[own[0] : own[-1] + 1]), len(at))
            if not len(q):
                continue
            q, r = asked[q + own[0]], at[r]
            exact = np.empty(len(q))
            for lo in range(0, len(q), _EXACT):
                some = slice(lo, lo + _EXACT)
                a, b = q[some], r[some]
                exact[some] = exact_cosines(self.queries[a], rows.vectors[b], self.norms[a], rows.norms[b])
            found = pa.table({"q": q, "score": exact, "id": rows.ids.take(pa.array(r))})
            self._keep(int(asked[0]) // _QUERY_BLOCK, found)

    def _keep(self, block: int, found: pa.Table) -> None:
        table = pa.concat_tables([self.parts[block], found]) if block in self.parts else found
        order = pc.sort_indices(
            table, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")]
        )
        q = table["q"].to_numpy()[order.to_numpy()]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        table = table.take(order.filter(pa.array(place < self.k))).combine_chunks()
        self.parts[block] = table
        last = place[place < self.k] == self.k - 1
        self.floor[table["q"].to_numpy()[last]] = table["score"].to_numpy()[last]


def top_k_of_batches(
    query_ids: pa.Array, queries: np.ndarray, k: int, probes: dict[int, np.ndarray] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function over ``id, vector[, centroid]`` rows.

    With ``probes`` (centroid to query numbers) a row meets only the queries that probe it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TopK(queries, k)
        for batch in batches:
            vectors = matrix(batch.column(1), queries.shape[1], None)
            if probes is None:
                top.add(batch.column(0), vectors)
                continue
            centroids = batch.column(2).to_numpy(zero_copy_only=False)
            for centroid in np.unique(centroids):
                mine = np.flatnonzero(centroids == centroid)
                asked = probes.get(int(centroid))
                if asked is not None:
                    top.add(batch.column(0).take(pa.array(mine)), vectors[mine], asked)
        yield from result_batches(top, query_ids)

    return run


def result_batches(top: TopK, query_ids: pa.Array, numbers: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """Hits by the query's number, which tells apart queries that share an id or have none."""
    for hits in top.hits():
        q = hits["q"].combine_chunks()
        found = {
            "query": q if numbers is None else numbers.take(q),
            "query_id": query_ids.take(q),
            "score": hits["score"],
            "id": hits["id"],
        }
        yield from pa.table(found).combine_chunks().to_batches()
