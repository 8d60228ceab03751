"""N-gram Jaccard join: a forest of MinHash prefix tries proposes, exact set overlap decides."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import (
    Hasher,
    components,
    lean,
    list_binary,
    mixed,
    part_count,
    slices,
    staged,
    text_bytes,
    word_hashes,
)

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 32
LONGEST_PREFIX = 12
TARGET_RECALL = 0.9999
BLOCK = 256  # classes on one side of a verification tile


def prefix_length(threshold: float, trees: int, longest: int, target: float) -> int:
    """Prefixes are shortened, from the longest, until a pair just at the threshold is found with
    the target probability: both share a prefix of d values in at least one of the tries."""
    for depth in range(longest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    return 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; a shorter text is one n-gram."""
    for low, high in slices(offsets):
        part = data[offsets[low] : offsets[high]]
        hashes, at = word_hashes(part, offsets[low : high + 1] - offsets[low], hasher)
        grams = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words):
            turn = np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 % (1 << 64))
            grams += hashes[k : k + len(grams)] * turn
        grams = mixed(grams)
        for i in range(high - low):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= words:
                found = np.sort(grams[a : b - words + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                total = np.array([b - a], np.uint64)
                for k in range(a, b):
                    total = mixed(total * np.uint64(31) ^ hashes[k : k + 1])
                yield total
            else:
                yield np.zeros(0, np.uint64)


def trie_keys(grams: np.ndarray, factors: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The first ``depth`` values of every tree's signature, folded into one key a tree."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        block = grams[None, at : at + 2048] * factors[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    labels = mixed(least).reshape(trees, depth)
    keys = np.arange(trees, dtype=np.uint64)
    for level in range(depth):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + labels[:, level])
    return keys


def tile_links(
    sets: list[np.ndarray], weights: np.ndarray, blocks: np.ndarray, cross: bool, share: Fraction
) -> tuple[np.ndarray, np.ndarray]:
    """For the classes of one tile: linked documents, and the first class reached over links.

    Overlaps of all pairs are counted at once, as products of membership blocks.  In a tile of
    two blocks (``cross``) only pairs between the blocks count.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    group = np.cumsum(new) - 1
    shared = (np.bincount(group) > 1)[group]
    group, owner = group[shared], owner[shared]
    overlap = np.zeros((n, n))
    if len(group):
        column = np.cumsum(np.concatenate(([False], group[1:] != group[:-1])))
        bounds = np.searchsorted(column, np.arange(0, column[-1] + 4096, 4096))
        for a, b in zip(bounds[:-1], bounds[1:]):
            held = np.zeros((n, 4096), np.float32)
            held[owner[a:b], column[a:b] % 4096] = 1
            overlap += held @ held.T
    union = sizes[:, None] + sizes[None, :] - overlap
    linked = overlap * share.denominator >= union * share.numerator
    np.fill_diagonal(linked, False)
    if cross:
        linked &= blocks[:, None] != blocks[None, :]
    parent = np.arange(n)
    seen = np.zeros(n, bool)
    for start in np.flatnonzero(linked.any(axis=1)):
        if seen[start]:
            continue
        seen[start], front = True, [start]
        while front:
            at = front.pop()
            near = np.flatnonzero(linked[at] & ~seen)
            parent[near], seen[near] = start, True
            front.extend(near.tolist())
    return linked @ weights, parent


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row per document: ``doc_id, text_hash, class_id, copy_id, n_links, class_no``.

    ``n_links`` counts the other documents whose set of word n-grams has a Jaccard similarity of
    at least ``threshold``; ``class_id`` is the smallest id reached over such links, ``copy_id``
    the smallest among documents with the same set; ``class_no`` numbers the classes in this run
    (null for texts without words).  Documents with equal sets are one class of
    copies from the start, so copies are never paired; links between classes carry weights.

    A text of fewer words is one n-gram; a null, empty or blank text has none, is linked to
    nothing and is its own class.  Rows with a null id take part, but name no class (null if no
    row of the class has an id).  Repeated rows are copies.  Other columns are not looked at.

    Tries are grouped by prefix; members of a group hang on its smallest member, and connected
    groups are verified exactly in tiles of at most two blocks of classes, so no group, however
    large, meets in one task, and no pairs are written: a tile returns sums and the smallest
    class each one reaches; only groups of several tiles are connected again.
    """
    spark = docs.sparkSession
    share = Fraction(str(threshold))
    depth = prefix_length(threshold, trees, LONGEST_PREFIX, target_recall)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(11)
        factors = mixed(np.arange(1, trees * depth + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            digests, sizes, keys = [], [], []
            for grams in shingle_sets(data, offsets, hasher, words):
                sizes.append(len(grams))
                if len(grams):
                    two = [mixed(grams * np.uint64(k)).sum(dtype=np.uint64) for k in (3, 5)]
                    digests.append(np.array(two, "<u8").tobytes())
                    keys.append(trie_keys(grams, factors, trees, depth).view(np.int64))
                else:
                    digests.append(None)
                    keys.append(np.zeros(0, np.int64))
            at = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64())),
                ],
                names=["doc_id", "text_hash", "digest", "size", "keys"],
            )

    described = staged(
        rows.select("doc_id", "text_hash", "text").mapInArrow(
            lean(describe), "doc_id long, text_hash long, digest binary, size long, keys array<long>"
        ),
        "described",
    )
    # Classes of copies: one row for each distinct set.
    first = F.min(F.struct("doc_id", "text_hash", "keys")).alias("first")
    copies = described.where("size > 0").groupBy("digest")
    classes = copies.agg(first, F.count("*").alias("n_docs"), F.min("doc_id").alias("copy_id"))
    classes = staged(
        classes.select(
            F.monotonically_increasing_id().alias("node"),
            "digest",
            "n_docs",
            "copy_id",
            F.col("first.doc_id").alias("doc_id"),
            F.col("first.text_hash").alias("text_hash"),
            F.col("first.keys").alias("keys"),
        ),
        "classes",
    )
    # Tries: classes that share a prefix hang on the smallest of them.
    prefixes = classes.select("node", F.explode("keys").alias("key"))
    shared = prefixes.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    proposed = prefixes.join(shared, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = staged(components(proposed), "groups")
    # Verification, tile by tile.
    tiles = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = groups.join(tiles, "root").join(classes.select("node", "doc_id", "text_hash", "n_docs"), "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    key = [rows["doc_id"].eqNullSafe(members["doc_id"]), rows["text_hash"].eqNullSafe(members["text_hash"])]
    texts = rows.join(members, key).select("root", "blocks", "block", "node", "n_docs", rows["text"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, done = Hasher(11), set()
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            kept = [i for i, node in enumerate(nodes) if not (node in done or done.add(node))]
            batch = batch.take(pa.array(kept, pa.int64()))
            data, offsets = text_bytes(batch.column("text"))
            for low, high in slices(offsets, 8 << 20):
                part = batch.slice(low, high - low)
                found = list(shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], hasher, words))
                columns = [part.column(c) for c in ("root", "blocks", "block", "node", "n_docs")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, list_binary(found)], names=["root", "blocks", "block", "node", "n_docs", "grams"]
                )

    sets = texts.mapInArrow(
        lean(sets_of), "root long, blocks long, block long, node long, n_docs long, grams binary"
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = sets.withColumn("other", other).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "blocks", "node", "n_docs", "grams"
    )
    parts = part_count(spark, groups.count(), 4096)
    placed = placed.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        current, several = None, 0  # several: the group has more than one tile

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                nodes = np.array(sorted(held), np.int64)
                blocks, weights, sets = zip(*(held[node] for node in nodes.tolist()))
                n_links, parent = tile_links(list(sets), np.array(weights, np.int64), np.array(blocks), current[1] != current[2], share)
                at = np.flatnonzero(n_links)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in (nodes[at], n_links[at], nodes[parent[at]], np.full(len(at), several))],
                        names=["node", "n_links", "parent", "several"],
                    )

        for batch in batches:
            tile = zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j")))
            nodes, blocks, weights, counts = (batch.column(c).to_pylist() for c in ("node", "block", "n_docs", "blocks"))
            grams = batch.column("grams")
            for row, name in enumerate(tile):
                if name != current:
                    yield from links()
                    held, current, several = {}, name, int(counts[row] > 1)
                if nodes[row] not in held:
                    value = np.frombuffer(grams[row].as_buffer(), "<u8").copy()
                    held[nodes[row]] = (blocks[row], weights[row], value)
        yield from links()

    verified = staged(placed.mapInArrow(lean(verify), "node long, n_links long, parent long, several long"), "links")
    linked = verified.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    found = components(verified.where("several > 0").select(F.col("node").alias("a"), F.col("parent").alias("b")))
    found = found.unionByName(verified.where("several = 0").select("node", F.col("parent").alias("root")))
    # Labels, back to every document.
    named = classes.select("node", "digest", "n_docs", "copy_id").join(found, "node", "left").join(linked, "node", "left")
    named = staged(named.withColumn("root", F.coalesce("root", "node")), "named")
    labels = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = named.join(labels, "root").select(
        "digest", "root", "class_id", "copy_id", (F.coalesce("n_links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")
    )
    alone = F.col("digest").isNull()
    out = described.select("doc_id", "text_hash", "digest").join(named, "digest", "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("root").alias("class_no"),
    )
