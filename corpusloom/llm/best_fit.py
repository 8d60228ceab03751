"""Best-fit packing of token pieces into sequences under several capacities at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, staged, text_bytes
from corpusloom.llm.tokens import crc, ids_list, worker_encoder

SEQUENCE = 2048
ENCODED_BYTES = 1 << 20  # of texts whose ids are made at a time
GROUP_PIECES = 1 << 14  # pieces packed together; more gain next to nothing
WEIGHTS = (1.0, 1e-3, 1e-3)  # tokens, documents, attention


def token_pieces(
    docs: DataFrame,
    capacity: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) for every whole text.

    A text's ids end with id 0.  Only longer ones are cut: into pieces of ``capacity``, the rest
    first.  A null or empty text is one piece holding the end id; null ids stay null; other
    columns are not looked at; an empty table has no pieces.  One narrow stage, no shuffle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            rows, pieces, starts, lengths, sums, held = [], [], [], [], [], []

            def block() -> pa.RecordBatch:
                columns = [ids.take(pa.array(rows, pa.int64()))]
                columns += [pa.array(pieces, pa.int32()), pa.array(starts, pa.int64())]
                columns += [pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(ids_list(held))
                    names.append("ids")
                return pa.RecordBatch.from_arrays(columns, names=names)

            for i, found in encoder.documents(data, offsets, ENCODED_BYTES):
                first = len(found) % capacity or capacity
                bounds = [0, *range(first, len(found) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    rows.append(i)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(crc(found[a:b]))
                    if keep_ids:
                        held.append(found[a:b])
                if len(rows) >= 4096:
                    yield block()
                    rows, pieces, starts, lengths, sums, held = [], [], [], [], [], []
            if rows:
                yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(lean(cut), schema + ", ids array<int>" * keep_ids)


def fit(
    lengths: np.ndarray,
    capacity: int,
    max_docs: int,
    max_attention: float,
    rule: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS,
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, the longest placed first.

    Each open bin has three residuals: tokens, documents, and attention cost (a document costs
    the square of its length).  Of the bins where the item fits all three, ``norm`` takes that
    with the smallest weighted norm of what stays, ``dot`` that with the largest weighted dot
    product of item and residual; ties fall to the older bin.  A bin that fits nothing any more
    is closed.  Lengths must be in 1 to ``capacity`` and fit an empty bin.
    """
    full = np.array([capacity, max_docs, max_attention], float)
    scale = np.asarray(weights, float) / full**2
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    residual, names, count = np.empty((3, 1024)), np.empty(1024, np.int64), 0
    opened, smallest = 0, float(lengths.min()) if len(lengths) else 0.0
    for turn, i in enumerate(order):
        item = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        left = residual[:, :count] - item[:, None]
        fits = np.flatnonzero((left >= 0).all(axis=0))
        if len(fits):
            if rule == "norm":
                at = fits[np.argmin(scale @ left[:, fits] ** 2)]
            else:
                at = fits[np.argmax((scale * item) @ residual[:, fits])]
        else:
            if (item > full).any():
                raise ValueError(f"a piece of {lengths[i]} tokens fits no empty sequence")
            if count == residual.shape[1]:
                residual = np.concatenate((residual, np.empty_like(residual)), axis=1)
                names = np.concatenate((names, np.empty_like(names)))
            at, names[count], residual[:, count] = count, opened, full
            count, opened = count + 1, opened + 1
        bins[i], offsets[i] = names[at], capacity - residual[0, at]
        residual[:, at] -= item
        if residual[0, at] < smallest or residual[1, at] < 1 or residual[2, at] < smallest**2:
            keep = slice(at + 1, count)  # closed: those behind move up, and keep their order
            residual[:, at : count - 1], names[at : count - 1] = residual[:, keep].copy(), names[keep].copy()
            count -= 1
    return bins, offsets


def pack(
    pieces: DataFrame,
    capacity: int = SEQUENCE,
    max_docs: int | None = None,
    max_attention: float | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``pieces`` (with a column ``length``) and each one's ``sequence_id`` and ``offset``.

    Rows are dealt by a hash of a number of their own, so copies of one row and hot values of any
    column spread evenly; each group of about ``group_pieces`` is packed by itself.  Lengths only
    travel, all other columns are joined on again by the row's number.  Without ``max_docs`` and
    ``max_attention`` only tokens bind.  Columns called ``sequence_id`` or ``offset`` are replaced.
    """
    max_docs = capacity if max_docs is None else max_docs
    max_attention = float(capacity) ** 2 if max_attention is None else max_attention
    pieces = pieces.drop("sequence_id", "offset")
    numbered = staged(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group_pieces))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__row")
        bins, offsets = fit(frame["length"].to_numpy(), capacity, max_docs, max_attention, rule, weights)
        group = frame["__group"].to_numpy()
        out = {"__row": frame["__row"], "sequence_id": (group << 32) + bins, "offset": offsets}
        return pd.DataFrame(out)

    dealt = numbered.select("__row", "length", F.pmod(F.xxhash64("__row"), F.lit(groups)).alias("__group"))
    placed = dealt.groupBy("__group").applyInPandas(one, "__row long, sequence_id long, offset long")
    return numbered.join(placed, "__row").drop("__row")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, offsets`` from packed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )
