"""Helpers the operators share: tables, staging, texts as bytes, word hashes, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import threading
import time
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: what the operators call a word
SLICE_BYTES = 1 << 20  # bytes of text that one vectorised step looks at
RELEASE_SECONDS = 0.5  # between which a task gives free memory back
IDLE_SECONDS = 4.0  # after which a worker gives up what no task has asked for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Write once as Parquet and read back: later steps neither repeat the work nor lose it."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are staged."""
    for _ in range(2):  # plans go first, then the shuffles they held; the cleaner has its own thread
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def part_count(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions for so many rows, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; the text of a null id is empty."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def numbered(df: DataFrame, order: list[Column], group: list[str], name: str, parts: int) -> DataFrame:
    """``df`` with each row's place, from 1, in its group; ``group`` must come first in ``order``.

    Rows are ranged over ``parts`` partitions, so a hot group is split; places within a partition
    and counts of earlier partitions add up.  Staged: every reader sees the same places.
    """
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", at)
    ranged = staged(ranged, "ranged").withColumn("__part", F.shiftright("__at", 33))
    runs = ranged.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    joined = ranged.join(runs, ["__part", *group])
    place = (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(name)
    return joined.select(*df.columns, place)


# Texts as bytes


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of byte ranges by differences of prefix sums: no loop over ranges.

    A range's hash depends on its bytes alone, so it agrees between tasks and machines.
    """

    def __init__(self, seed: int = 1, lower: bool = False):
        codes = np.arange(256, dtype=np.uint64)
        if lower:
            codes[65:91] += np.uint64(32)
        self.codes = mixed(codes + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        self.base = 0x5851F42D4C957F2D + 2 * seed
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, SLICE_BYTES + (1 << 16))
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mixed(found + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _is_word() -> np.ndarray:
    mask = np.ones(256, bool)
    mask[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return mask


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; a text's end ends its last word."""
    word = _is_word()[data]
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:], after[:-1] = False, word[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and n + 1 offsets into them by text.

    Works on blocks of ``SLICE_BYTES``, cut between words, so memory beside the result is bounded
    unless one word is longer.
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, texts = [], [], []
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    word, at = _is_word(), 0
    while at < len(data):
        to = min(at + SLICE_BYTES, len(data))
        if to < len(data):
            gaps = np.flatnonzero(~word[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # one long word, or texts that follow each other without a gap
                bound = offsets[np.searchsorted(offsets, to, side="left")]
                more = np.flatnonzero(~word[data[to:bound]])
                to = to + int(more[0]) + 1 if len(more) else int(bound)
        low = int(np.searchsorted(offsets, at, side="right")) - 1
        high = int(np.searchsorted(offsets, to, side="left"))
        local = np.clip(offsets[low : high + 1], at, to) - at
        starts, ends, texts = word_ranges(data[at:to], local)
        found.append(hasher.ranges(data[at:to], starts, ends))
        counts += np.bincount(texts + low, minlength=len(counts))
        at = to
    return np.concatenate(found), np.concatenate(([0], np.cumsum(counts)))


def text_blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of at most about ``SLICE_BYTES``: for sums over a text.

    A longer text comes in several blocks, cut after a space; where a whole block has none, it is
    cut between characters.
    """
    for low, high in slices(offsets):
        part, local = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        at = 0
        while len(part) > SLICE_BYTES and at < len(part):
            to = min(at + SLICE_BYTES, len(part))
            if to < len(part):
                spaces = np.flatnonzero(part[at:to] == 0x20)
                if len(spaces):
                    to = at + int(spaces[-1]) + 1
                while to < len(part) and part[to] & 0xC0 == 0x80:
                    to -= 1
            yield low, high, part[at:to], np.array([0, to - at])
            at = to
        if len(part) <= SLICE_BYTES:
            yield low, high, part, local


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct key, keys ascending, and for every element its key's number."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def release() -> None:
    """Give memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def lean(function):
    """``function`` over a task's batches, giving back now and then and at its end what it no longer
    needs: freed arrays of many sizes stay with the process else, also after the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        try:
            for batch in function(batches):
                yield batch
                if time.monotonic() - last > RELEASE_SECONDS:
                    release()
                    last = time.monotonic()
        finally:
            release()

    return run


def worker_state(name: str, make):
    """What ``make`` returns, made once in this Python worker and kept for its later tasks.

    Dropped once no task has asked for it for ``IDLE_SECONDS``: workers outlive their stage, and
    what they hold would count against the memory of the stages that follow.
    """
    state = sys.modules.setdefault("corpusloom_worker_state", types.ModuleType("corpusloom_worker_state"))
    if not hasattr(state, name):
        setattr(state, name, make())
    if (old := getattr(state, f"timer of {name}", None)) is not None:
        old.cancel()

    def drop() -> None:
        state.__dict__.pop(name, None)
        gc.collect()
        release()

    timer = threading.Timer(IDLE_SECONDS, drop)
    timer.daemon = True
    timer.start()
    setattr(state, f"timer of {name}", timer)
    return getattr(state, name)


def list_binary(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays as a binary column, in the machine-independent little-endian form."""
    return pa.array([x.astype(x.dtype.newbyteorder("<")).tobytes() for x in arrays], pa.binary())


# Connected components


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b): root is the smallest node reached.

    Alternates two steps that keep connectivity: every node hands its larger neighbours to the
    smallest node it knows, then its smaller ones.  Rounds grow with the logarithm of the
    diameter.  Only minima are aggregated, and the join back is one Spark can split, so a node
    with very many neighbours is no hot task.  Every step is staged, and counted as it is written.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        # The sum hides from Spark that the minima are dealt by u already: both sides of the join
        # are then dealt for it, and the side of a hot node can be split.
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return least.select((F.col("u") + F.lit(0)).alias("u"), "m")

    def held(pairs: DataFrame, rows: int) -> tuple[DataFrame, tuple[int, int]]:
        seen = Observation()
        mark = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
        watched = pairs.observe(seen, F.count("*").alias("n"), mark.alias("mark"))
        kept = staged(watched.coalesce(max(12, rows >> 19)), "edges")
        return kept, (seen.get["n"], seen.get["mark"])

    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs, known = held(pairs.where("u <> v").distinct(), edges.sparkSession.sparkContext.defaultParallelism << 21)
    while known[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, _ = held(large.where("u <> v"), known[0])
        low = minima(large)
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        )
        pairs, now = held(small.where("u <> v").distinct(), known[0])
        if now == known:
            break
        known = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
