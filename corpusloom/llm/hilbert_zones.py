"""Centroid clustering over blocks in Hilbert order, whose boxes rule centroids out before vectors are compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import integer_vectors as iv
from corpusloom.llm.common import part_count, staged

BITS = 4  # of each component's place between its least and largest value that the curve follows
BLOCK_ROWS = 256  # vectors with one box
PART_ROWS = 1 << 15  # vectors of a range of the curve that is written as one file
WIDEST = 2.0**25  # vectors and centroids shorter than this have exact distances in doubles


def hilbert_keys(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve through the grid of side 2^bits, as rows of big-endian bytes.

    ``places``: one row a point, components in [0, 2^bits).  The walk goes from the coarsest bit
    to the finest: at each level a component with the bit set mirrors the first one, one without
    it trades places with it; a Gray code of the components' bits is the position's next digit.
    """
    x = places.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            up = (x[i] >> level) & 1 == 1
            trade = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, trade)
            x[i] ^= trade
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1] if n else len(places), np.int64)
    for level in range(bits - 1, 0, -1):
        if n:
            turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    digits = (x[None, :, :] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1
    return np.packbits(digits.reshape(bits * n, -1).T.astype(np.uint8), axis=1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids, as Python integers where vectors are long."""
    if not len(x) or iv.lengths(x).max() + iv.lengths(centroids).max() < WIDEST:
        a, b = x.astype(float), centroids.astype(float)
        square = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        return square.astype(np.int64)
    gaps = [x.astype(object) - centroid for centroid in centroids.astype(object)]
    return np.stack([(gap * gap).sum(axis=1) for gap in gaps], axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector of the box, ascending.

    A centroid whose distance to the box is larger than the largest distance from another one to
    the box's far corner is nearest to none of them.
    """
    low, high, c = low.astype(float), high.astype(float), centroids.astype(float)
    outside = np.maximum(np.maximum(low - c, c - high), 0)
    far = np.maximum(np.abs(c - low), np.abs(high - c))
    least, most = (outside * outside).sum(axis=1), (far * far).sum(axis=1)
    return np.flatnonzero(least <= most.min() * (1 + 1e-9))


def assigned(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance (held at a long's end) of every vector of a block; ties: the smaller number."""
    possible = candidates(low, high, centroids)
    found = distances(x, centroids[possible])
    nearest = found.argmin(axis=1)
    return possible[nearest], np.minimum(found[np.arange(len(x)), nearest], iv.MOST).astype(np.int64)


def zone_mapped(rows: DataFrame, total: int, bounds: list[tuple[int, int]]) -> DataFrame:
    """Blocks of ``rows`` (id, x) in Hilbert order: ``ids, x`` (all vectors end to end), ``low, high`` (the box).

    Equal keys are told apart by the row's number, so a vector with many copies is split too.
    """
    low = np.array([b[0] for b in bounds], float)
    step = np.maximum((np.array([b[1] for b in bounds], float) - low + 1) / (1 << BITS), 1e-300)
    d = len(bounds)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                places = np.clip((iv.matrix(part) - low) // step, 0, (1 << BITS) - 1)
                keys = [k.tobytes() for k in hilbert_keys(places)]
                columns = [pa.array(keys, pa.binary()), *(part.column(c) for c in ("row", "id", "x"))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "row", "id", "x"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, min(BLOCK_ROWS, iv.block_rows(d)))
        for batch in batches:
            starts = np.arange(0, batch.num_rows, step)
            ends = np.append(starts, batch.num_rows)
            x = iv.matrix(batch)
            boxes = [f.reduceat(x, starts, axis=0) if len(x) else x for f in (np.minimum, np.maximum)]
            of_blocks = np.arange(len(starts) + 1) * d
            columns = [
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
                for offsets, values in (
                    (ends, iv.ids(iv.numbers(batch, "id"))),
                    (ends * d, pa.array(x.ravel())),
                    *((of_blocks, pa.array(box.ravel())) for box in boxes),
                )
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "x", "low", "high"])

    spark = rows.sparkSession
    keys = rows.mapInArrow(keyed, "key binary, row long, id long, x array<long>")
    parts = part_count(spark, total, PART_ROWS)
    ranged = keys.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    return staged(ranged.select("id", "x").mapInArrow(blocks, "ids array<long>, x array<long>, low array<long>, high array<long>"), "zones")


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        low, high = iv.matrix(batch, "low"), iv.matrix(batch, "high")
        ids, x = batch.column("ids"), batch.column("x")
        for i in range(batch.num_rows):
            yield ids[i].values, np.asarray(x[i].values).reshape(-1, low.shape[1]), low[i], high[i]


def updated(spark: SparkSession, zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid becomes the floor of its vectors' mean, exactly; empty ones stay."""
    sent = spark.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        total, count = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for _, x, low, high in each_block(batches):
            cluster, _ = assigned(x, low, high, centroids)
            for c in np.unique(cluster):
                own = x[cluster == c]
                for part, weight in ((own >> 32, 1 << 32), (own & 0xFFFFFFFF, 1)):  # no sum overflows
                    total[c] += part.sum(axis=0).astype(object) * weight
            count += np.bincount(cluster, minlength=len(centroids))
        used = np.flatnonzero(count)
        c, place = np.repeat(used, centroids.shape[1]), np.tile(np.arange(centroids.shape[1]), len(used))
        value = pa.array([Decimal(int(v)) for v in total[used].ravel()], pa.decimal128(38, 0))
        columns = [pa.array(c.astype(np.int32)), pa.array(place.astype(np.int32)), value, pa.array(count[c])]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "value", "n"])

    found = zones.mapInArrow(sums, "cluster int, place int, value decimal(38,0), n long")
    means = found.groupBy("cluster", "place").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
    sent.unpersist()
    out = centroids.copy()
    for r in means:  # clusters x components rows
        out[r["cluster"], r["place"]] = int(r["value"]) // r["n"]
    return out


def cluster(
    vectors: DataFrame,
    clusters: int = 16,
    rounds: int = 3,
    dims: int = 64,
    seed: int = 1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 64,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Vectors of exactly ``dims`` components, none null or non-finite, become floor(scale *
    component).  Centroids start as the vectors with the smallest lowercase-hex sha256 of
    ``seed:id``; ``rounds`` times vectors go to the nearest centroid (squared distance; ties: the
    smaller number) and centroids move to the floor of their vectors' mean; then vectors are
    assigned once more.

    Vectors are ordered along a Hilbert curve once and written as blocks with their boxes.  Box
    distances leave each block the centroids that can be nearest to one of its vectors; only
    those are compared.  Blocks are never shuffled again; what a task returns is a sum for each
    cluster.  Centroids, clusters x dims numbers, are what is broadcast.

    A null id is kept, and starts a centroid only after all others.  Repeated rows are rows of
    their own; where ids are equal, the smaller vector starts first.  Fewer vectors than clusters
    give fewer centroids; no vectors: no rows.  Distances and their sums beyond a long are held at
    its end.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = iv.scaled(vectors, scale, id_col, vector_col).where(F.col("d") == dims)
    rows = staged(rows.select("id", "x", F.monotonically_increasing_id().alias("row")), "vectors")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = rows.select("x", mark.alias("mark")).orderBy(F.asc_nulls_last("mark"), "x").limit(clusters)
    centroids = np.array([r["x"] for r in starts.collect()], np.int64)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    ends = [f(F.col("x")[i]) for i in range(dims) for f in (F.min, F.max)]
    total, *ends = rows.agg(F.count("*"), *ends).first()
    zones = zone_mapped(rows, total, list(zip(ends[::2], ends[1::2])))
    for _ in range(rounds):
        centroids = updated(spark, zones, centroids)
    last = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, low, high in each_block(batches):
            cluster, distance = assigned(x, low, high, last.value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = staged(zones.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("decimal(38,0)").alias("own")).collect()
    whole = min(sum(int(r["own"]) for r in sums), iv.MOST)
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = {r["cluster"]: min(int(r["own"]), iv.MOST) for r in sums}
    by_cluster = spark.createDataFrame([(c, own[c], whole, prints[c]) for c in sorted(own)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
