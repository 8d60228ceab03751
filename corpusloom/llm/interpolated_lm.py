"""Language-model scores by deleted interpolation of word bigrams, words and a uniform share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Hasher, distinct, fold, free_shuffles, mixed, slices, staged, text_bytes, word_hashes

CHUNK_TOKENS = 1 << 20  # tokens counted together before anything is shuffled
BUCKET_KEYS = 1 << 21  # distinct n-grams, about, that one task sums at a time
ROUNDS, ENOUGH = 12, 1e-4  # of expectation-maximisation: at most, and the gain in log10 a token that ends it
BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)  # a text's border, as a context and as a token
HELD_OUT, TUNING, COUNTED = 0, 1, 2  # roles of documents

CHUNKS = "chunk long, role int, rows array<long>, doc_ids array<long>, lengths array<long>, contexts array<long>, words binary, tokens binary"


def roles(doc_id: str = "doc_id"):
    """Held out if crc32 of the id is divisible by ten; of the rest a tenth tunes the weights."""
    code = fold(doc_id, 100)
    return F.when(code % 10 == 0, HELD_OUT).when(F.floor(code / 10) == 0, TUNING).otherwise(COUNTED).cast("int")


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as numbered tokens, about ``CHUNK_TOKENS`` of one role a row; longer texts are split.

    A piece remembers the token before it, so splitting changes no bigram.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, first = Hasher(21, lower=True), TaskContext.get().partitionId() << 33
        waiting: dict[int, list] = {}
        sizes: dict[int, int] = {}
        row = chunk = 0

        def emit(role: int) -> pa.RecordBatch:
            nonlocal chunk
            rows, ids, contexts, parts = zip(*waiting.pop(role))
            flat = np.concatenate(parts)
            at, inverse = distinct(flat)
            chunk += 1
            lists = [(rows, pa.int64()), (ids, pa.int64()), ([len(p) for p in parts], pa.int64())]
            lists.append((np.array(contexts, np.uint64).view(np.int64).tolist(), pa.int64()))
            columns = [pa.array([first + chunk], pa.int64()), pa.array([role], pa.int32())]
            columns += [pa.array([list(v)], pa.list_(kind)) for v, kind in lists]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in (flat[at].astype("<u8"), inverse.astype("<i4"))]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, kinds = batch.column("doc_id").to_pylist(), batch.column("role").to_pylist()
            for low, high in slices(offsets):
                hashes, at = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], hasher)
                for i in range(high - low):
                    words = np.append(hashes[at[i] : at[i + 1]], END)
                    role, context, row = kinds[low + i], BEGIN, row + 1
                    for start in range(0, len(words), CHUNK_TOKENS):
                        part = words[start : start + CHUNK_TOKENS]
                        waiting.setdefault(role, []).append((first + row, ids[low + i], context, part))
                        context = part[-1]
                        sizes[role] = sizes.get(role, 0) + len(part)
                        if sizes[role] >= CHUNK_TOKENS:
                            yield emit(role)
                            sizes[role] = 0
        for role in list(waiting):
            yield emit(role)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), roles(id_col).alias("role")
    )
    return rows.mapInArrow(cut, CHUNKS)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane: planes of zeros vanish when Spark compresses."""
    kind = values.dtype.newbyteorder("<")
    return values.astype(kind).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(blob, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(np.dtype(kind).newbyteorder("<")).ravel()


class Chunk:
    """A chunk's tokens, and the sorted distinct keys its counts are asked for by."""

    def __init__(self, row: dict):
        self.row = row
        self.words = np.frombuffer(row["words"], "<u8")
        self.tokens = np.frombuffer(row["tokens"], "<i4")
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        hashes = self.words[self.tokens]
        before = np.empty_like(hashes)
        before[1:] = hashes[:-1]
        before[self.starts] = np.array(row["contexts"], np.int64).view(np.uint64)
        self.pairs = mixed(before * np.uint64(0x9E3779B97F4A7C15) + hashes)
        self.before, self.hashes = before, hashes

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts: of words and the text's begin, and of bigrams."""
        begins = int((self.before == BEGIN).sum())
        counts = np.bincount(self.tokens, minlength=len(self.words))
        at = int(np.searchsorted(self.words, BEGIN))
        ordered = np.sort(self.pairs)
        new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        # The context of a piece that begins within a text is a word the chunk may not have.
        words, sums = np.insert(self.words, at, BEGIN), np.insert(counts, at, begins)
        inner = np.setdiff1d(self.before[self.starts], words)
        to = np.searchsorted(words, inner)
        words, sums = np.insert(words, to, inner), np.insert(sums, to, 0)
        return [(words, sums), (ordered[new], np.diff(np.append(new, len(ordered))))]


def corpus_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """Every chunk's keys answered with their counts in the whole corpus.

    A chunk's distinct keys, cut by ranges of their hash, meet those of all others and go back in
    the same order, so answers carry counts alone: ``chunk, role, kind, bucket, all, counted``
    (blobs over tuning and counted documents, and over counted ones).  Rows without a chunk give
    the number of distinct tokens of a bucket.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, (keys, counts) in enumerate(Chunk(row).asked()):
                    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                    spans = list(zip(edges[:-1], edges[1:]))
                    n = len(spans)
                    columns = [pa.array(bucket[edges[:-1]].astype(np.int64)), pa.array([row["chunk"]] * n, pa.int64())]
                    columns += [pa.array([row["role"]] * n, pa.int32()), pa.array([kind] * n, pa.int32())]
                    columns.append(pa.array([packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()))
                    columns.append(pa.array([packed(counts[a:b].astype(np.uint32)) for a, b in spans], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "role", "kind", "keys", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def sums() -> Iterator[pa.RecordBatch]:
            parts = [np.cumsum(unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in held]
            keys = np.concatenate(parts)
            first, inverse = distinct(keys)
            role = np.repeat([r["role"] for r in held], [len(p) for p in parts])
            counts = np.concatenate([unpacked(r["counts"], np.uint32) for r in held]).astype(np.int64)
            every = np.bincount(inverse, np.where(role != HELD_OUT, counts, 0), len(first)).astype(np.uint32)
            counted = np.bincount(inverse, np.where(role == COUNTED, counts, 0), len(first)).astype(np.uint32)
            ends = np.cumsum([len(p) for p in parts])
            rows = []
            for r, a, b in zip(held, ends - [len(p) for p in parts], ends):
                own = inverse[a:b]
                two = packed(counted[own]) if r["role"] == TUNING else b""
                rows.append((r["chunk"], r["role"], r["kind"], current[0], packed(every[own]), two, 0, 0))
            if current[1] == 0:
                real = keys[first] != BEGIN
                rows.append((None, 0, 0, current[0], b"", b"", int((every[real] > 0).sum()), int((counted[real] > 0).sum())))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            names = ["chunk", "role", "kind", "bucket", "all", "counted", "types", "types_counted"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["bucket"], row["kind"]) != current:
                    if held:
                        yield from sums()
                    held, current = [], (row["bucket"], row["kind"])
                held.append(row)
        if held:
            yield from sums()

    asked = chunks.mapInArrow(ask, "bucket long, chunk long, role int, kind int, keys binary, counts binary")
    dealt = asked.repartition(2 * buckets, "bucket", "kind").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(
        answer,
        "chunk long, role int, kind int, bucket long, all binary, counted binary, types long, types_counted long",
    )


def answered(chunks: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Chunks followed by their answers, together in a partition and in order."""
    empty = {"all": F.lit(None).cast("binary"), "counted": F.lit(None).cast("binary")}
    left = chunks.withColumns({"kind": F.lit(-1), "bucket": F.lit(-1).cast("long"), **empty})
    right = answers.where(F.col("chunk").isNotNull()).select("chunk", "role", "kind", "bucket", "all", "counted")
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")


def with_counts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]]:
    """Each chunk with its tokens' bigram, context and word counts."""

    def finished(head: dict, blobs: list[list[bytes]]):
        chunk = Chunk(head)
        (words, _), (pairs, _) = chunk.asked()
        single, double = (np.concatenate([unpacked(b, np.uint32) for b in x]).astype(np.float64) for x in blobs)
        look = lambda keys, counts, wanted: counts[np.searchsorted(keys, wanted)]
        return chunk, look(pairs, double, chunk.pairs), look(words, single, chunk.before), look(words, single, chunk.hashes)

    head, blobs = None, [[], []]
    for batch in batches:
        for i in range(batch.num_rows):
            kind = batch.column("kind")[i].as_py()
            if kind < 0:
                if head is not None:
                    yield finished(head, blobs)
                head, blobs = batch.slice(i, 1).to_pylist()[0], [[], []]
            else:
                blobs[kind].append(batch.column(column)[i].as_py())
    if head is not None:
        yield finished(head, blobs)


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the binary logarithm of its count."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def parts_of(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: float, types: float) -> np.ndarray:
    """Maximum-likelihood bigram and word estimates, and the uniform one with room for a new word."""
    return np.stack((pair / np.maximum(context, 1), word / max(total, 1), np.full(len(word), 1 / (types + 1))))


def learn_weights(events: DataFrame, total: int, types: int) -> np.ndarray:
    """Mixture weights by context bucket: expectation-maximisation on the tuning documents.

    Every round sums, over all tuning tokens, each estimate's share in the mixture; the sums, one
    row a bucket, are all that reaches the driver.  A bucket without tokens keeps the start.
    """
    weights = np.tile([[0.5], [0.4], [0.1]], (1, 65))
    weights[:, 0] = 0.0, 0.8, 0.2  # an unseen context has no bigram estimate
    before = -np.inf
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((5, 65))
            for batch in batches:
                for row in batch.to_pylist():
                    pair, context, word = (np.frombuffer(row[c], "<u4").astype(float) for c in ("pair", "context", "word"))
                    bucket = context_bucket(context)
                    shares = parts_of(pair, context, word, total, types) * weights[:, bucket]
                    mass = shares.sum(axis=0)
                    for k in range(3):
                        sums[k] += np.bincount(bucket, shares[k] / mass, 65)
                    sums[3] += np.bincount(bucket, minlength=65)
                    sums[4] += np.bincount(bucket, np.log10(mass), 65)
            columns = [pa.array(np.arange(65)), *(pa.array(x) for x in sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "a", "b", "c", "n", "score"])

        found = events.mapInArrow(expect, "bucket long, a double, b double, c double, n double, score double")
        found = found.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("a", "b", "c", "n", "score")]).toPandas()
        found = found[found.n > 0]
        if found.empty:
            break
        at = found.bucket.to_numpy()
        weights = weights.copy()
        weights[:, at] = found[["a", "b", "c"]].to_numpy().T / found.n.to_numpy()
        # The uniform share never vanishes: unseen words keep a probability.
        weights[2] = np.maximum(weights[2], 1e-6)
        weights /= weights.sum(axis=0)
        score = found.score.sum() / found.n.sum()
        if score - before < ENOUGH:
            break
        before = score
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are words, A-Z lower-cased, and one end.  Counts come from all documents whose role is
    not held out; weights are learned with the counts of ``COUNTED`` documents on the ``TUNING``
    ones, then used with the counts of both.  ``score`` is the sum over tokens of the log10 of
    ``w1 c(vw)/c(v) + w2 c(w)/N + w3 / (V + 1)``, the weights by the bucket of c(v).

    A null or empty text is its end; a null id counts as empty text and is held out; repeated
    rows count and are scored as often as they occur; other columns are not looked at; an empty
    table gives no rows.  If nothing is learned from, all counts are 0.
    """
    spark = docs.sparkSession
    chunks = staged(chunked(docs, id_col, text_col), "tokens")
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = {r["role"]: r["n"] for r in chunks.groupBy("role").agg(F.sum(size).alias("n")).collect()}
    total, counted = sizes.get(TUNING, 0) + sizes.get(COUNTED, 0), sizes.get(COUNTED, 0)
    everything = sum(sizes.values())
    buckets = max(4, -(-everything // BUCKET_KEYS))
    answers = staged(corpus_counts(chunks, buckets), "counts")
    free_shuffles(spark)
    found = answers.where(F.col("chunk").isNull()).agg(F.sum("types"), F.sum("types_counted")).first()
    types, types_counted = found[0] or 0, found[1] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), everything // (2 * CHUNK_TOKENS))

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, *counts in with_counts(batches, "counted"):
            for at in range(0, len(counts[0]), 1 << 20):
                blobs = [pa.array([c[at : at + (1 << 20)].astype("<u4").tobytes()], pa.binary()) for c in counts]
                yield pa.RecordBatch.from_arrays(blobs, names=["pair", "context", "word"])

    tuning = answered(chunks.where(F.col("role") == TUNING), answers.where(F.col("role") == TUNING), width)
    tuning = staged(tuning.mapInArrow(events, "pair binary, context binary, word binary"), "tuning")
    weights = learn_weights(tuning, counted, types_counted)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, pair, context, word in with_counts(batches, "all"):
            mass = (parts_of(pair, context, word, total, types) * weights[:, context_bucket(context)]).sum(axis=0)
            base = np.log10((word + 0.1) / (total + 0.1 * (types + 1)))
            by = lambda values: pa.array(np.add.reduceat(values, chunk.starts))
            rows = chunk.row
            columns = [pa.array(rows["rows"], pa.int64()), pa.array(rows["doc_ids"], pa.int64())]
            columns += [pa.array([rows["role"] == HELD_OUT] * len(rows["rows"])), pa.array(chunk.lengths)]
            columns += [by((word > 0).astype(np.int64)), by(base), by(np.log10(mass))]
            names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    judged = answered(chunks, answers, width).mapInArrow(
        judge, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = judged.groupBy("row", "doc_id", "held_out").agg(*sums)
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
