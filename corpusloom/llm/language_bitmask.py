"""Language identification by character n-grams in bit-sliced Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import distinct, fold, lean, mixed, staged, text_blocks, text_bytes, worker_state

LENGTHS = (3, 4)  # characters of an n-gram
SLOT_BITS, HASHES = 20, 3  # 2 ** 20 slots; three slots an n-gram, from 60 bits of its hash
LEAST_SHARE = 2e-5  # of a language's n-grams: so at most 50,000 n-grams a language are kept
LEAST_RATIO = 0.25  # of the n-gram's largest share in any language
UNKNOWN = "und"
HELD_ENTRIES = 1 << 21


def _letters() -> np.ndarray:
    """By code point: its lower case if it is a letter, else 0."""
    found = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            found[i] = ord(small) if len(small) == 1 else i
    return found


def gram_blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, n-gram hashes and text number (from the range's start) of each n-gram.

    N-grams stay within a word and its two borders, so long texts may come in blocks.
    """
    letters = worker_state("letters", _letters)
    for low, high, part, local in text_blocks(data, offsets):
        yield low, high, *_grams(part, local, letters)


def _grams(part: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), "<u4")
    passed = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))[offsets]
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(passed))
    row = np.zeros(len(points) + len(offsets) + 2, np.uint64)  # a border before, after and between texts
    row[np.arange(len(points)) + texts + 1] = letters[points]
    owner = np.zeros(len(row), np.int64)
    owner[np.arange(len(points)) + texts + 1] = texts
    keys, owners = [], []
    for n in LENGTHS:
        windows = len(row) - n + 1
        valid = np.ones(windows, bool)
        for k in range(1, n - 1):
            valid &= row[k : k + windows] != 0
        at = np.flatnonzero(valid)
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x100000001B3) + row[at + k] * np.uint64(0x9E3779B97F4A7C15)
        keys.append(mixed(key))
        owners.append(owner[at + 1])
    return np.concatenate(keys), np.concatenate(owners)


@dataclass
class LanguageFilters:
    """``slots[s, w]`` has bit i if language 64 w + i has an n-gram in slot s."""

    languages: list[str]
    slots: np.ndarray
    false_rates: np.ndarray

    def contained(self, keys: np.ndarray) -> np.ndarray:
        """The masks of all languages that contain each n-gram: one AND of its slots."""
        found = None
        for k in range(HASHES):
            slot = (keys >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1)
            masks = self.slots[slot.astype(np.int64)]
            found = masks if found is None else found & masks
        return found


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageFilters:
    """Filters from all of ``docs`` with a language and a text.

    A language contains an n-gram that makes up ``LEAST_SHARE`` of its n-grams, and at least
    ``LEAST_RATIO`` of the share it has anywhere.  The first rule bounds what a language keeps,
    the slots bound what reaches the driver, whatever the corpus.  Without rows no language.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = (np.concatenate(x) for x in zip(*parts))
                first, inverse = distinct(keys)
                sums = np.bincount(inverse, counts).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(first)), pa.array(keys[first].view(np.int64)), pa.array(sums)],
                    names=["lang", "gram", "n"],
                )

        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            names, langs = coded.dictionary.to_pylist(), np.asarray(coded.indices)
            data, offsets = text_bytes(batch.column("text"))
            for low, _, keys, owners in gram_blocks(data, offsets):
                owned = langs[low + owners]
                for i in range(len(names)):
                    mine = np.sort(keys[owned == i])
                    if len(mine):
                        new = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                        held.setdefault(names[i], []).append((mine[new], np.diff(np.append(new, len(mine)))))
                        waiting += len(new)
                if waiting > HELD_ENTRIES:
                    yield from merged()
                    held, waiting = {}, 0
        yield from merged()

    counts = rows.mapInArrow(lean(count), "lang string, gram long, n long")
    counts = staged(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= LEAST_SHARE)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    kept = shares.join(most, "gram").where(F.col("share") >= LEAST_RATIO * F.col("most"))
    languages = sorted((r.lang for r in totals.select("lang").collect()), key=str.encode)  # the label set
    number = F.create_map(*[F.lit(v) for i, lang in enumerate(languages) for v in (lang, i)]) if languages else None
    words = max(1, -(-len(languages) // 64))
    slots, filled = np.zeros((1 << SLOT_BITS, words), np.uint64), np.zeros(len(languages))
    if languages:
        picked = [F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND((1 << SLOT_BITS) - 1) for k in range(HASHES)]
        bits = kept.withColumn("i", number[F.col("lang")]).select("i", F.explode(F.array(*picked)).alias("slot"))
        bit = F.expr("shiftleft(1L, i % 64)")
        masks = bits.groupBy("slot", F.floor(F.col("i") / 64).alias("w")).agg(F.bit_or(bit).alias("mask"))
        for batch in masks.toArrow().to_batches():  # at most one row a slot and word
            slot, word, mask = (np.asarray(batch.column(c)) for c in ("slot", "w", "mask"))
            slots[slot, word] = mask.view(np.uint64)
        for i in range(len(languages)):
            filled[i] = ((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
    return LanguageFilters(languages, slots, filled**HASHES)


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``coverage``: a narrow stage.

    Each language's popcount over the text's n-grams is freed of expected false positives; the
    largest wins, ties going to the name first in code point order.  ``coverage`` is the winner's
    share of the n-grams, ``score`` its share of all languages' counts (0 if none was found).
    ``und`` with score 0 if the text is null or has no letter, or no language was learned.
    Columns with these names are replaced, all others kept.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((filters.languages, filters.slots, filters.false_rates))
    kept = docs.drop("lang_pred", "score", "coverage")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LanguageFilters(*shared.value)
        names = [*known.languages, UNKNOWN]
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.names.index(text_col)))
            rows = batch.num_rows
            total, hits = np.zeros(rows), np.zeros((rows, len(known.languages)))
            for low, high, keys, owners in gram_blocks(data, offsets):
                masks = known.contained(keys)
                total[low:high] += np.bincount(owners, minlength=high - low)
                for i in range(len(known.languages)):
                    bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                    hits[low:high, i] += np.bincount(owners, bit, minlength=high - low)
            clean = np.maximum((hits - total[:, None] * known.false_rates) / (1 - known.false_rates), 0)
            if known.languages:
                best = np.where(total > 0, clean.argmax(axis=1), len(names) - 1)
                top, sums = clean.max(axis=1), clean.sum(axis=1)
            else:
                best, top, sums = np.zeros(rows, int), np.zeros(rows), np.zeros(rows)
            score = np.where(sums > 0, top / np.where(sums > 0, sums, 1), 0.0)
            coverage = np.minimum(np.where(total > 0, top / np.where(total > 0, total, 1), 0.0), 1.0)
            columns = [pa.array([names[i] for i in best], pa.string()), pa.array(score), pa.array(coverage)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score", "coverage"]
            )

    schema = StructType(list(kept.schema.fields))
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("coverage", "double")):
        schema = schema.add(name, kind)
    return kept.mapInArrow(lean(label), schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    return docs.where(fold(id_col, folds) != 0)
