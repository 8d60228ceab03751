"""Hard negatives: scored pairs sorted by (anchor, descending score, id), read once by a streaming iterator."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import integer_vectors as iv
from corpusloom.llm.common import part_count, shared_path, staged

ANCHOR_ROWS = 256  # anchors that one product takes
SORTED_ROWS = 1 << 18  # packed pairs that one sorting task reads, about
SIGN = np.uint64(1 << 63)
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
POSITIVE, NEGATIVE = 0, 1  # at equal scores a window opens before a negative is looked at


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, id_: np.ndarray) -> pa.Array:
    """Keys whose byte order is anchor, descending score, positives first, ascending id."""
    keys = np.empty(len(anchor), KEY)
    keys["anchor"] = anchor.view(np.uint64)
    keys["score"] = ~(score.view(np.uint64) ^ SIGN)
    keys["kind"] = kind
    keys["id"] = id_.view(np.uint64) ^ SIGN
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])


def unpacked(key: bytes) -> tuple[bytes, int, int, int]:
    """Anchor, score, kind and id of a key."""
    score = (1 << 63) - 1 - int.from_bytes(key[8:16], "big")
    return key[:8], score, key[16], int.from_bytes(key[17:25], "big") - (1 << 63)


def window(score: int, percent: tuple[int, int]) -> tuple[int, int]:
    """Least and largest negative score for a positive: percent[0] * p <= 100 * n <= percent[1] * p."""
    return -((-percent[0] * score) // 100), percent[1] * score // 100


def mined(records: Iterator[tuple[bytes, int]], negatives: int, percent: tuple[int, int]) -> Iterator[tuple]:
    """One pass over sorted keys: a positive opens its window, a negative goes to every open window
    it fits, a window closes when it is full or the scores have fallen below it.

    Holds the open windows of one anchor, at most as many as it has positives.
    """
    current, windows = None, []
    for key, anchor_id in records:
        anchor, score, kind, id_ = unpacked(key)
        if anchor != current:
            current, windows = anchor, []
        known = None if id_ == iv.NO_ID else id_
        if kind == POSITIVE:
            windows.append([*window(score, percent), known, score, 0])
            continue
        windows = [w for w in windows if w[4] < negatives and score >= w[0]]
        for w in windows:
            if score <= w[1]:
                w[4] += 1
                yield anchor_id, w[2], w[4], known, w[3], score


def anchor_lists(table: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """Vectors, rows, ids and labels of the anchors, by number of components."""
    out = {}
    for batch in table.combine_chunks().to_batches():
        for size in np.unique(iv.numbers(batch, "d")):
            own = batch.take(pa.array(np.flatnonzero(iv.numbers(batch, "d") == size)))
            out[int(size)] = iv.matrix(own), *(iv.numbers(own, c) for c in ("row", "id", "label"))
    return out


def scored(batches: Iterator[pa.RecordBatch], lists: dict[int, tuple]) -> Iterator[tuple]:
    """Blocks of anchors with blocks of rows: components, first anchor, scores, whether the labels
    are equal, ids and rows."""
    for batch in batches:
        for block in iv.same_length(batch):
            size = block.column("d")[0].as_py()
            if size not in lists:
                continue
            x, label = lists[size][0], lists[size][3]
            of_rows, id_, row, label_ = iv.matrix(block), *(iv.numbers(block, c) for c in ("id", "row", "label"))
            for at in range(0, len(x), ANCHOR_ROWS):
                some = slice(at, at + ANCHOR_ROWS)
                yield size, at, iv.products(x[some], of_rows), label[some][:, None] == label_[None, :], id_, row


def positive_scan(batches: Iterator[pa.RecordBatch], table: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The best k rows of its own label that a task has for each anchor, itself apart."""
    lists = anchor_lists(table)
    best = {size: iv.Best(len(own[0]), k) for size, own in lists.items()}
    for size, at, score, same, id_, row in scored(batches, lists):
        own = lists[size][1][at : at + len(score)]
        least = best[size].floor()[at : at + len(score)]
        a, b = np.nonzero(same & (score >= least[:, None]) & (own[:, None] != row[None, :]))
        best[size].offer(a + at, score[a, b], id_[b], row[b])
    for size, (_, row, id_, _) in lists.items():
        anchor, score, found, found_row = best[size].found()
        columns = [pa.array(row[anchor]), iv.ids(id_[anchor]), pa.array(found_row), iv.ids(found), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "anchor_id", "row", "id", "score"])


def pack_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = packed(iv.numbers(batch, "anchor"), iv.numbers(batch, "score"), POSITIVE, iv.numbers(batch, "id"))
        yield pa.RecordBatch.from_arrays([keys, batch.column("anchor_id")], names=["key", "anchor_id"])


class Windows:
    """Each anchor's windows, and the best negatives of each that a task has met."""

    def __init__(self, score: np.ndarray, real: np.ndarray, negatives: int, percent: tuple[int, int]):
        bounds = [[window(int(s), percent) if r else (iv.MOST, iv.LEAST) for s, r in zip(*line)] for line in zip(score, real)]
        self.low, self.high = np.moveaxis(np.clip(np.array(bounds, object).reshape(*score.shape, 2), iv.LEAST, iv.MOST).astype(np.int64), 2, 0)
        self.best = iv.Best(score.size, negatives)

    def offer(self, at: int, score: np.ndarray, other: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        """Scores of anchors from ``at`` on with a block of rows; ``other``: the labels differ."""
        some = slice(at, at + len(score))
        for j in range(self.low.shape[1]):
            owner = np.arange(at, at + len(score)) * self.low.shape[1] + j
            least = np.maximum(self.low[some, j], self.best.floor()[owner])
            a, b = np.nonzero(other & (score >= least[:, None]) & (score <= self.high[some, j][:, None]))
            self.best.offer(owner[a], score[a, b], id_[b], row[b])


def negative_scan(
    batches: Iterator[pa.RecordBatch], table: pa.Table, chosen: pa.Table, positives: int, negatives: int, percent: tuple[int, int]
) -> Iterator[pa.RecordBatch]:
    """Packed keys of the best pairs that a task has for each window, a pair once per anchor."""
    lists, windows = anchor_lists(table), {}
    anchor, score = iv.numbers(chosen, "anchor"), iv.numbers(chosen, "score")
    order = np.argsort(anchor, kind="stable")
    anchor, score = anchor[order], score[order]
    for size, (_, row, _, _) in lists.items():
        places = np.searchsorted(anchor, row)[:, None] + np.arange(positives)
        real = places < np.searchsorted(anchor, row, side="right")[:, None]
        scores = np.where(real, score[np.minimum(places, len(score) - 1)], 0)
        windows[size] = Windows(scores, real, negatives, percent)
    for size, at, score, same, id_, row in scored(batches, lists):
        windows[size].offer(at, score, ~same, id_, row)
    for size, (_, row, id_, _) in lists.items():
        slot, score, found, found_row = windows[size].best.found()
        owner = slot // positives
        once = np.unique(np.stack([owner, found_row]), axis=1, return_index=True)[1]
        keys = packed(row[owner[once]], score[once], NEGATIVE, found[once])
        yield pa.RecordBatch.from_arrays([keys, iv.ids(id_[owner[once]])], names=["key", "anchor_id"])


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of floor(scale * component).  An anchor's positives are its first
    ``positives`` other rows of its label by descending score; each is given the first
    ``negatives`` rows of other labels whose score lies within ``percent`` of its own.

    Rows are scored where they lie, in blocks, against broadcast pieces of the anchors.  A first
    pass finds the positives, and so the windows; in a second each task keeps, of each window, as
    many of its best pairs as the answer may hold.  These pairs, packed into keys (anchor,
    descending score, id), are sorted by ``repartitionAndSortWithinPartitions``; a streaming
    iterator opens the windows and emits the negatives.  No anchor's pairs are held together.

    Ties fall to the smaller id, null ids last (an id of 2^63 - 1 counts as null).  Repeated rows
    are rows of their own; an anchor that occurs twice is two anchors with one id.  Rows with a
    null label, a null vector, or null or non-finite components take no part.  Vectors of other
    lengths than the anchor's are none of its pairs.  A positive with a negative score has no
    negatives (its window is empty), one of score 0 has those of score 0.  Scores beyond a long
    are held at its end.  No rows or no anchors: no rows.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = iv.scaled(vectors, scale, id_col, vector_col, label=label, anchor=F.coalesce(is_anchor, F.lit(False)))
    rows = rows.where(F.col("label").isNotNull())
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    count, d = rows.where("anchor").agg(F.count("*"), F.max("d")).first()
    if not count:
        return spark.createDataFrame([], schema)
    index = rows.select("row", "id", "label", "d", "x")
    anchors = rows.where("anchor").select("row", "id", "label", "d", "x")
    pieces = iv.query_pieces(anchors, count, d, "anchors")
    path, keys = shared_path(spark, "positives"), shared_path(spark, "pairs")
    found = "anchor long, anchor_id long, row long, id long, score long"

    def scanned(scan, content, kind: str, to: str) -> None:
        sent = spark.sparkContext.broadcast(content)
        index.mapInArrow(lambda batches: scan(batches, sent.value), kind).write.parquet(to)
        sent.unpersist()

    for number, piece in enumerate(pieces):
        if (table := piece.toArrow()).num_rows:
            scanned(lambda batches, sent: positive_scan(batches, sent, positives), table, found, f"{path}/piece={number}")
    partial = spark.read.schema(f"{found}, piece int").parquet(path)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    chosen = partial.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    chosen = staged(chosen, "windows")
    packing = "key binary, anchor_id long"
    chosen.mapInArrow(pack_positives, packing).write.parquet(f"{keys}/kind={POSITIVE}/piece=0")
    for number, piece in enumerate(pieces):
        own = chosen.where(F.col("piece") == number).select("anchor", "score").toArrow()
        if own.num_rows:
            scan = lambda batches, sent: negative_scan(batches, *sent, positives, negatives, percent)
            scanned(scan, (piece.toArrow(), own), packing, f"{keys}/kind={NEGATIVE}/piece={number}")
    pairs = spark.read.schema(packing).parquet(keys)
    parts = part_count(spark, pairs.count(), SORTED_ROWS)
    records = pairs.rdd.map(lambda r: (bytes(r[0]), r[1]))
    ordered = records.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(ordered.mapPartitions(lambda part: mined(part, negatives, percent)), schema)
