"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import SLICE_BYTES, Hasher, fold, lean, staged, text_blocks, text_bytes, word_ranges

WORDS, PAIRS, NUMBERS = 256, 256, 16  # features of the text view: hashed words, shape pairs, shares
SOURCES, LANGS, SIZES = 32, 16, 16  # of the metadata view
LABELLED = 16_000  # labelled rows that are collected, at most
ROUNDS, SURE = 3, 0.98  # of pseudo-labels; calibrated confidence
PASSES, CLOSE = 30, 1e-4  # passes of a round's fit, at most; share of the loss still to gain that ends it
MEMORY = 8  # steps whose curvature a fit remembers
PARTIALS = 32  # tasks of a pass, at least: each sends its sums, as wide as the features
MOST_LOST = 0.003  # of the good documents of the calibration fold may score below the threshold
RIDGE = 3.0
COUNT_BITS = SLICE_BYTES.bit_length()  # of a count of bytes in a block of texts; three are kept in a number


def tallied(row: np.ndarray, code: np.ndarray, rows: int, width: int) -> np.ndarray:
    return np.bincount(row * width + code, minlength=rows * width).reshape(rows, width)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a text: square roots of shares of hashed words and of neighbouring word shapes,
    and shares of repeats, distinct words and kinds of characters.  Sums over the whole text, in
    half precision, as they are kept."""
    rows, hasher = len(offsets) - 1, Hasher(31, lower=True)
    kinds = np.full(256, 3, np.int64)  # lower, upper, digit, sign, beyond ASCII, white space
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 0, 1, 2, 4
    kinds[[9, 10, 11, 12, 13, 32]] = 5
    counts, pairs = np.zeros((rows, WORDS)), np.zeros((rows, PAIRS))
    sums = np.zeros((rows, NUMBERS))
    # Counts of three kinds of bytes stand in one number, so that one prefix sum serves all three.
    codes = np.zeros((2, 256), np.uint64)
    for k in range(5):
        codes[k // 3, kinds == k] = 1 << COUNT_BITS * (k % 3)
    codes[1, 10] = 1 << COUNT_BITS * 2
    places = np.arange(3, dtype=np.uint64) * np.uint64(COUNT_BITS)
    for low, high, part, local in text_blocks(data, offsets):
        n = high - low
        starts, ends, text = word_ranges(part, local)
        before = np.zeros((2, len(part) + 1), np.uint64)
        for own, code in zip(before, codes):
            np.cumsum(code[part], out=own[1:])

        def counted(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            """Rows: the five kinds that are not white space, and new lines."""
            packed = (before[:, ends] - before[:, starts])[:, None] >> places[None, :, None]
            return (packed & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64).reshape(6, -1)

        of_texts = counted(local[:-1], local[1:])
        sums[low:high, :5] += of_texts[:5].T
        sums[low:high, 5] += np.diff(local) - of_texts[:5].sum(axis=0)
        sums[low:high, 6] += of_texts[5]
        if not len(starts):
            continue
        words = hasher.ranges(part, starts, ends)
        lower, upper, digit, sign, beyond = counted(starts, ends)[:5]
        size = ends - starts
        shape = np.select(
            [digit > 0, sign == size, (upper > 1) & (lower == 0), upper > 1, upper == 1, lower + beyond > 0], range(6), 6
        )
        magnitude = (size >= 2).astype(np.int64) + (size >= 4) + (size >= 8)
        shape = (shape * 3 + np.minimum(sign, 2)) * 4 + magnitude
        counts[low:high] += tallied(text, (words % np.uint64(WORDS)).astype(np.int64), n, WORDS)
        near = np.flatnonzero(text[1:] == text[:-1])
        code = (shape[near] * 101 + shape[near + 1]) * 40503 % 65521 % PAIRS
        pairs[low:high] += tallied(text[near], code, n, PAIRS)
        sums[low:high, 7] += np.bincount(text, minlength=n)
        sums[low:high, 8] += np.bincount(text[near][words[near] == words[near + 1]], minlength=n)
        far = np.flatnonzero(text[2:] == text[:-2])
        sums[low:high, 9] += np.bincount(text[far][words[far] == words[far + 2]], minlength=n)
        order = np.argsort(words, kind="stable")  # texts ascend already, so they do within equal words
        word, of = words[order], text[order]
        first = np.concatenate(([True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])))
        sums[low:high, 10] += np.bincount(of[first], minlength=n)
        sums[low:high, 11] += np.bincount(text, size, n)
    n_words, n_bytes = np.maximum(sums[:, 7], 1), np.maximum(np.diff(offsets), 1)
    numbers = sums.copy()
    numbers[:, :7] /= n_bytes[:, None]
    numbers[:, 7] = np.log1p(sums[:, 7])
    numbers[:, 8:12] /= n_words[:, None]
    numbers[:, 11] = np.log1p(numbers[:, 11])
    numbers[:, 12] = np.sqrt(numbers[:, 8])
    numbers[:, 13] = sums[:, 10] / n_words**0.8
    scaled = [np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1)) for c in (counts, pairs)]
    return np.concatenate([*scaled, numbers], axis=1).astype(np.float16).astype(np.float32)


def metadata_features(batch: pa.RecordBatch, names: tuple[str, str, str]) -> np.ndarray:
    """One-hot source, language and magnitude of the stated length; a null has a place of its own."""
    rows, hasher, parts = batch.num_rows, Hasher(32), []
    for name, width in zip(names, (SOURCES, LANGS)):
        column = batch.column(name)
        data, offsets = text_bytes(column)
        place = hasher.ranges(data, offsets[:-1], offsets[1:]) % np.uint64(width - 1)
        missing = np.asarray(column.is_null().to_numpy(zero_copy_only=False))
        parts.append(np.eye(width)[np.where(missing, width - 1, place.astype(np.int64))])
    size = batch.column(names[2]).fill_null(-1).to_numpy(zero_copy_only=False).astype(float)
    place = np.where(size >= 0, np.clip(np.log2(np.maximum(size, 1)) - 3, 0, SIZES - 2), SIZES - 1)
    return np.concatenate([*parts, np.eye(SIZES)[place.astype(np.int64)]], axis=1).reshape(rows, -1)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that their dense features stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Feature rows kept as equally long blobs, read from where Arrow holds them."""
    parts = []
    for chunk in column.chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.float16)[ends[0] // 2 : ends[-1] // 2])
    return np.concatenate(parts).reshape(rows, -1).astype(np.float32)


@dataclass
class Logistic:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale @ self.weights[1:] + self.weights[0]


def chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Logistic:
    """Ridge logistic regression by Newton's method, on standardised features."""
    n, width = x.shape
    blocks = [slice(i, i + 2048) for i in range(0, n, 2048)]
    centre = sum(x[rows].sum(axis=0, dtype=np.float64) for rows in blocks) / n
    spread = sum(((x[rows] - centre) ** 2).sum(axis=0) for rows in blocks)
    scale = np.sqrt(spread / n)
    scale[scale < 1e-9] = 1.0
    weights, penalty = np.zeros(width + 1), np.full(width + 1, ridge)
    penalty[0] = 1e-6
    for _ in range(8):
        slope, curve = -penalty * weights, np.diag(penalty)
        for rows in blocks:  # standardised block by block: no second copy of the features
            z = np.concatenate((np.ones((len(x[rows]), 1)), (x[rows] - centre) / scale), axis=1)
            p = chance(z @ weights)
            slope += z.T @ (y[rows] - p)
            curve += (z * (p * (1 - p))[:, None]).T @ z
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-4:
            break
    return Logistic(centre, scale, weights)


@dataclass
class Sums:
    """A logistic model's sums over pseudo-labelled rows, in raw features behind a leading one:
    as wide as the features, so a pass over any number of rows sends little."""

    slope: np.ndarray
    first: np.ndarray  # of the features; the leading one counts the rows
    square: np.ndarray
    loss: float

    def stack(self) -> np.ndarray:
        return np.stack((self.slope, self.first, self.square, np.full(len(self.slope), self.loss)))

    @classmethod
    def of(cls, stack: np.ndarray) -> Sums:
        return cls(*stack[:3], float(stack[3, 0]))


Teacher = tuple[Logistic, Logistic]  # a view's model and its calibration
Pool = Callable[[list[Teacher], list["np.ndarray | None"]], list["Sums | None"]]


def sums_over(pool: list[np.ndarray], teachers: list[Teacher], weights: list[np.ndarray | None], block: int = 1024) -> list[Sums | None]:
    """Per view, the sums over all rows that the other view's teacher is sure of, by its marks."""
    found: list[Sums | None] = [None, None]
    for at in range(0, len(pool[0]), block):
        views = [v[at : at + block] for v in pool]
        for view, beta in enumerate(weights):
            if beta is None:
                continue
            model, calibration = teachers[1 - view]
            sure = chance(calibration.logit(model.logit(views[1 - view])[:, None]))
            rows = (sure >= SURE) | (sure <= 1 - SURE)
            x = np.concatenate((np.ones((int(rows.sum()), 1)), views[view][rows]), axis=1)
            y, logit = (sure[rows] >= 0.5).astype(float), x @ beta
            p = chance(logit)
            loss = float(np.logaddexp(0, np.where(y > 0, -logit, logit)).sum())
            part, old = Sums(x.T @ (y - p), x.sum(axis=0), (x**2).sum(axis=0), loss), found[view]
            found[view] = part if old is None else Sums.of(old.stack() + part.stack())
    return found


class Refit:
    """``fit`` on labelled rows at hand and on sums over others, one pass of these a step.

    L-BFGS: the curvature of the labelled rows, as if the others had the same, is where each step
    starts from, and what the last steps showed corrects it; so only gradients are summed.  Begins
    at the weights of ``start``; a step that does not lower the objective enough is halved."""

    def __init__(self, x: np.ndarray, y: np.ndarray, start: Logistic):
        self.x, self.y, self.model = x, y, start
        slopes = start.weights[1:] / start.scale
        self.trial = np.concatenate(([start.weights[0] - start.centre @ slopes], slopes))
        self.at, self.step, self.best, self.gradient, self.done = None, None, np.inf, None, False
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []

    def standardise(self, sums: Sums) -> None:
        n, more, total = len(self.x), sums.first[0], sums.first[1:]
        centre = (self.x.sum(axis=0, dtype=np.float64) + total) / (n + more)
        spread = sum(((self.x[i : i + 2048] - centre) ** 2).sum(axis=0) for i in range(0, n, 2048))
        spread = spread + np.maximum(sums.square[1:] - 2 * centre * total + more * centre**2, 0)
        scale = np.sqrt(spread / (n + more))
        scale[scale < 1e-9] = 1.0
        self.model = Logistic(centre, scale, np.zeros(len(self.trial)))
        self.penalty = np.full(len(self.trial), RIDGE)
        self.penalty[0] = 1e-6
        self.at = np.concatenate(([self.trial[0] + centre @ self.trial[1:]], self.trial[1:] * scale))
        curve = sum((z * (p * (1 - p))[:, None]).T @ z for z, _, p in self.labelled(self.at))
        self.start = np.linalg.inv(curve * (1 + more / n) + np.diag(self.penalty))

    def labelled(self, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Standardised features behind a leading one, labels and chances, block by block."""
        for i in range(0, len(self.x), 2048):
            z = (self.x[i : i + 2048] - self.model.centre) / self.model.scale
            z = np.concatenate((np.ones((len(z), 1)), z), axis=1)
            yield z, self.y[i : i + 2048], chance(z @ weights)

    def direction(self) -> np.ndarray:
        """The two-loop recursion over the steps remembered."""
        q, shares = -self.gradient, []
        for s, g in reversed(self.seen):
            shares.append((s @ q) / (s @ g))
            q = q - shares[-1] * g
        q = self.start @ q
        for (s, g), share in zip(self.seen, reversed(shares)):
            q = q + s * (share - (g @ q) / (s @ g))
        return q

    def update(self, sums: Sums | None) -> None:
        if self.done:
            return
        if sums is None or not sums.first[0]:  # no row to learn from: the model stays
            self.done = True
            return
        if self.at is None:
            self.standardise(sums)
            weights = self.at
        else:
            weights = self.at + self.step
        centre, scale = self.model.centre, self.model.scale
        gradient = self.penalty * weights - np.concatenate(([sums.slope[0]], (sums.slope[1:] - centre * sums.slope[0]) / scale))
        loss = sums.loss + self.penalty @ weights**2 / 2
        for z, y, p in self.labelled(weights):
            gradient -= z.T @ (y - p)
            loss -= np.log(np.where(y > 0, p, 1 - p)).sum()
        if self.step is None or loss <= self.best + 1e-4 * (self.step @ self.gradient):
            if self.step is not None and self.step @ (gradient - self.gradient) > 0:
                self.seen = [*self.seen, (self.step, gradient - self.gradient)][-MEMORY:]
            self.best, self.at, self.gradient = loss, weights, gradient
            self.step = self.direction()
        else:
            self.step = self.step / 2
        self.model.weights = self.at
        self.done = bool(-(self.step @ self.gradient) < CLOSE * max(1.0, self.best))
        weights = self.at + self.step
        slopes = weights[1:] / scale
        self.trial = np.concatenate(([weights[0] - centre @ slopes], slopes))


@dataclass
class Views:
    """Both views' classifiers, their calibrations, the combination, and the threshold."""

    views: list[Logistic]
    calibrations: list[Logistic]
    combined: Logistic
    threshold: float

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, views)]
        return chance(self.combined.logit(np.stack(logits, axis=1))), *map(chance, logits)


def cotrain(
    labelled: list[np.ndarray],
    y: np.ndarray,
    pool: list[np.ndarray] | Pool,
    held: list[np.ndarray],
    held_y: np.ndarray,
    judged: list[np.ndarray] | None = None,
    judged_y: np.ndarray | None = None,
) -> Views:
    """Each round both views are calibrated, and each gives all pool rows it is sure of (beyond
    ``SURE``) to the other view's training rows.  ``pool`` holds the rows, or sums over them.
    ``held`` calibrates and combines the views; ``judged``, rows of its own, sets the threshold."""
    rows = pool
    if not callable(pool):
        pool = lambda teachers, weights: sums_over(rows, teachers, weights)
    models = [fit(x, y) for x in labelled]
    for turn in range(ROUNDS + 1):
        calibrations = [fit(m.logit(x)[:, None], held_y, 1.0) for m, x in zip(models, held)]
        if turn == ROUNDS:
            break
        teachers = list(zip(models, calibrations))
        learners = [Refit(x, y, m) for x, m in zip(labelled, models)]
        for _ in range(PASSES):
            found = pool(teachers, [None if one.done else one.trial for one in learners])
            for one, sums in zip(learners, found):
                one.update(sums)
            if all(one.done for one in learners):
                break
        models = [one.model for one in learners]
    logits = np.stack([c.logit(m.logit(x)[:, None]) for m, c, x in zip(models, calibrations, held)], axis=1)
    found = Views(models, calibrations, fit(logits, held_y, 1.0), 0.5)
    good = found.scores(held if judged is None else judged)[0][(held_y if judged is None else judged_y) > 0]
    found.threshold = float(min(0.5, np.quantile(good, MOST_LOST)))
    return found


def spark_pool(rows: DataFrame) -> Pool:
    """Sums over all ``rows``, with features ``a, b``: a pass is one stage without a shuffle, of tasks
    as many as the cores need, so what reaches the driver does not grow with the rows or their files."""
    tasks = max(PARTIALS, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.select("a", "b").coalesce(tasks)

    def pool(teachers: list[Teacher], weights: list[np.ndarray | None]) -> list[Sums | None]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stacks: list[np.ndarray | None] = [None, None]
            for batch in sliced(batches, 1024):
                views = [matrix(pa.chunked_array([batch.column(c)]), batch.num_rows) for c in "ab"]
                for view, sums in enumerate(sums_over(views, teachers, weights)):
                    if sums is not None:
                        old = stacks[view]
                        stacks[view] = sums.stack() if old is None else old + sums.stack()
            task = TaskContext.get().partitionId()
            found = [view for view, stack in enumerate(stacks) if stack is not None]
            blobs = pa.array([stacks[view].tobytes() for view in found], pa.binary())
            parts = [pa.array(found, pa.int32()), pa.array([task] * len(found), pa.int32())]
            yield pa.RecordBatch.from_arrays([*parts, blobs], names=["view", "task", "sums"])

        stacks: list[np.ndarray | None] = [None, None]
        found = rows.mapInArrow(lean(partial), "view int, task int, sums binary").toArrow().to_pylist()
        for row in sorted(found, key=lambda row: row["task"]):  # added up in one order, so reruns agree
            stack, old = np.frombuffer(row["sums"]).reshape(4, -1), stacks[row["view"]]
            stacks[row["view"]] = stack if old is None else old + stack
        return [None if stack is None else Sums.of(stack) for stack in stacks]

    return pool


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, str, str] = ("source", "lang", "n_chars"),
    label_col: str = "quality",
    labelled: int = LABELLED,
) -> DataFrame:
    """``docs`` with ``score, text_score, metadata_score, keep``.

    Fitted on at most ``labelled`` labelled documents, drawn by a hash of their id, and on all
    unlabelled ones: their features are staged once, and every step of a fit is one pass over them
    that ends in sums as wide as the features, whatever the number of rows; the last digits of
    these sums depend on how the rows are partitioned.  A tenth of the labelled documents drawn
    calibrates the views and combines them, another sets the threshold below which documents are
    rejected.
    Every document is scored by its whole text in one narrow stage.  Documents without an id, and
    those whose id's crc32 is divisible by ten, are never fitted on.

    Ids with several labels count by their mean, null labels and ids not at all.  A null text is
    empty.  Without labelled documents of both kinds in each of the three folds nothing can be learned: every
    score is 1 and everything is kept.  Columns with the names above are replaced.
    """
    kept = docs.drop("score", "text_score", "metadata_score", "keep")
    source, lang, size = metadata
    names = ("__source", "__lang", "__size")
    inputs = kept.withColumns(
        {
            names[0]: F.col(source).cast("string"),
            names[1]: F.col(lang).cast("string"),
            names[2]: F.col(size).cast("long"),
        }
    )
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col)
    marks = marks.agg((F.avg(label_col) >= 0.5).cast("int").alias("__y"))
    marks = marks.where(fold(id_col, 10) != 0)

    def drawn(ids: DataFrame, wanted: int) -> DataFrame:
        """At most ``wanted`` rows, those of smallest hash: so a bound on what is broadcast."""
        return ids.withColumn("__h", F.xxhash64(id_col)).orderBy("__h", id_col).limit(wanted).drop("__h")

    chosen = drawn(marks, labelled).select(id_col, F.floor(fold(id_col, 100) / 10).cast("int").alias("fold"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = text_bytes(batch.column("__text").cast(pa.string()))
            views = [f.astype(np.float16) for f in (text_features(data, offsets), metadata_features(batch, names))]
            blobs = [pa.array([row.tobytes() for row in view], pa.binary()) for view in views]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *blobs], names=["__id", "a", "b"])

    described = inputs.where(F.col(id_col).isNotNull() & (fold(id_col, 10) != 0))
    described = described.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *names)
    schema = StructType([described.schema["__id"]])
    for name in "ab":
        schema = schema.add(name, "binary")
    described = described.mapInArrow(lean(describe), schema)
    # The narrow features meet the labels, not the texts; merged at any size, so disk is in proportion.
    marks = marks.withColumnRenamed(id_col, "__id").hint("merge")
    described = staged(described.join(marks, "__id", "left"), "features")
    sample = described.where("__y is not null").join(F.broadcast(chosen.withColumnRenamed(id_col, "__id")), "__id")
    sample = sample.select(F.col("__id").cast("string").alias("id"), F.col("__y").alias("y"), "fold", "a", "b")
    # An id may be repeated in the documents: one row of it is enough, so the bound holds.
    rows = sample.groupBy("id").agg(*[F.min(c).alias(c) for c in ("y", "fold", "a", "b")]).toArrow()
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    y, part = (rows.column(c).to_numpy()[order] for c in ("y", "fold"))
    a, b = (matrix(rows.column(c), len(y))[order] if len(y) else None for c in "ab")
    del rows
    model = None
    learn, hold, judge_by = part % 5 != 0, part == 0, part == 5
    if all(len(set(y[mask].tolist())) == 2 for mask in (learn, hold, judge_by)):
        free = spark_pool(described.where("__y is null"))
        sets = [([a[mask], b[mask]], y[mask].astype(float)) for mask in (learn, hold, judge_by)]
        model = cotrain(*sets[0], free, *sets[1], *sets[2])
    columns = kept.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = [np.ones(batch.num_rows)] * 3
            keep = np.ones(batch.num_rows, bool)
            if model is not None:
                data, offsets = text_bytes(batch.column(columns.index(text_col)).cast(pa.string()))
                scores = model.scores([text_features(data, offsets), metadata_features(batch, names)])
                keep = scores[0] >= model.threshold
            own = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(
                [*own, *(pa.array(s, pa.float64()) for s in scores), pa.array(keep)],
                names=[*columns, "score", "text_score", "metadata_score", "keep"],
            )

    schema = StructType(list(kept.schema.fields))
    for name in ("score", "text_score", "metadata_score"):
        schema = schema.add(name, "double")
    return inputs.mapInArrow(lean(judge), schema.add("keep", "boolean"))
