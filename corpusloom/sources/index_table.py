"""The vector index: numbered Parquet snapshots and additions to them in one directory."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.config import BROADCAST_BYTES
from corpusloom.functions.text import external_id
from corpusloom.operators import ivf
from corpusloom.schemas import INDEX_SCHEMA
from corpusloom.session import delete_path, stored_at


def with_ids(chunks: DataFrame) -> DataFrame:
    """Chunk rows plus the id under which they are stored."""
    piece = F.col("piece") if "piece" in chunks.columns else None
    made = external_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), piece)
    return chunks.withColumn("external_id", made)


def last_per_id(chunks: DataFrame) -> DataFrame:
    """The chunk written last under each id: the later one in its file.

    Every task keeps one row per id before the shuffle, so an id that occurs in a third of
    all rows costs no more than any other.
    """
    order = Window.partitionBy("external_id").orderBy(F.desc("chunk_ord"), F.desc("item_name"), F.desc("text"))
    return chunks.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def index_rows(embedded: DataFrame) -> DataFrame:
    """Embedded chunks as index rows: id, vector and the six attributes."""
    return embedded.select(
        "external_id",
        "embedding",
        "file_path",
        "start_line",
        "end_line",
        "item_name",
        F.col("text").alias("chunk_text"),
        "language",
    )


def merge_index(old: DataFrame, new: DataFrame, prune: bool = False) -> DataFrame:
    """Rows of ``new`` plus the old rows under other ids; ids must be unique in each.

    Nothing is deleted: a chunk whose lines moved leaves its old row behind.  ``prune``
    drops the old rows of every file that occurs in ``new``.
    """
    key = "file_path" if prune else "external_id"
    replaced = new.select(key).distinct() if prune else new.select(key)
    return old.join(replaced, key, "left_anti").select(*new.columns).unionByName(new)


# What a step supersedes: all before it, rows under its ids, or rows of its files.
_SNAPSHOT, _IDS, _FILES = "v", "s", "p"
_FOLDER = re.compile(rf"step=(\d+)\.([0-9a-f]*)\.([{_SNAPSHOT}{_IDS}{_FILES}])(?:\.(\d+))?")


@dataclass(frozen=True, order=True)
class Step:
    """One folder of the index: its number, writer and kind, and the set of centroids it is partitioned by.

    Steps follow each other by number.  A writer claims its number, and the folder bears the
    writer's own name, so no two ever write into one, even where a claim is not exclusive.
    """

    number: int
    writer: str
    kind: str = field(compare=False)
    centroids: int | None = field(compare=False)
    finished: bool = field(compare=False, default=False)

    @property
    def folder(self) -> str:
        name = f"step={self.number}.{self.writer}.{self.kind}"
        return name if self.centroids is None else f"{name}.{self.centroids}"


def _hadoop(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def _steps(spark: SparkSession, path: str) -> list[Step]:
    """Every step present, in order, finished or not."""
    fs, root = _hadoop(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        if m := _FOLDER.fullmatch(status.getPath().getName()):
            done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            found.append(Step(int(m[1]), m[2], m[3], None if m[4] is None else int(m[4]), done))
    return sorted(found)


def current_version(spark: SparkSession, path: str) -> int | None:
    done = [step.number for step in _steps(spark, path) if step.finished]
    return done[-1] if done else None


def _claimed(spark: SparkSession, path: str) -> int:
    """The next number that no step and no other writer has: an empty file, made exclusively."""
    steps = _steps(spark, path)
    number = steps[-1].number + 1 if steps else 1
    while True:
        fs, claim = _hadoop(spark, f"{path}/_claims/{number}")
        try:
            if fs.createNewFile(claim):
                return number
        except Py4JJavaError as error:  # taken between the look and the making
            if "Exist" not in str(error.java_exception):
                raise
        number += 1


def _broadcast_if_small(keys: DataFrame, size: int) -> DataFrame:
    """Keys, marked for broadcast if their measured size allows it; else the join shuffles."""
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys


def _rows(spark: SparkSession, path: str, steps: list[Step], schema: StructType) -> DataFrame:
    """Rows of steps of one layout as one relation, with ``__number`` and ``__writer`` of their step."""
    parted = schema.add("step", "string") if steps[0].centroids is None else schema.add("step", "string").add("centroid", "integer")
    rows = spark.read.schema(parted).option("basePath", path).parquet(*[f"{path}/{step.folder}" for step in steps])
    name = F.split("step", r"\.")
    return rows.withColumns({"__number": name[0].cast("long"), "__writer": name[1]}).drop("step")


def read_index(
    spark: SparkSession, path: str, version: int | None = None, probes: Callable[[int], list[int]] | None = None
) -> DataFrame:
    """The newest (or a given) version; empty if there is none.  Needs no source files.

    Rows come from the last snapshot and the steps after it, one relation however many there are,
    each row without what a later step supersedes: a table of the latest step of every id that
    later steps hold is made once and joined once, and likewise of files that were pruned.

    ``probes`` names, for a set of centroids, those whose rows are wanted: of steps partitioned by
    them only these partitions are read.  Rows that were superseded from another partition are
    still left out.
    """
    steps = [step for step in _steps(spark, path) if step.finished and (version is None or step.number <= version)]
    if not steps:
        return spark.createDataFrame([], INDEX_SCHEMA)
    steps = steps[max([i for i, step in enumerate(steps) if step.kind == _SNAPSHOT], default=0) :]
    schema = spark.read.parquet(f"{path}/{steps[-1].folder}").schema
    schema = StructType([f for f in schema.fields if f.name != "centroid"])
    layouts: dict[int | None, list[Step]] = {}
    for step in steps:
        layouts.setdefault(step.centroids, []).append(step)
    parts = []
    for centroids, own in layouts.items():
        part = _rows(spark, path, own, StructType(schema.fields))
        if centroids is not None:
            if probes is not None:
                part = part.where(F.col("centroid").isin(probes(centroids)))
            part = part.drop("centroid")
        parts.append(part)
    rows = reduce(DataFrame.unionByName, parts)
    step_of = F.struct("__number", "__writer")

    def without_superseded(rows: DataFrame, key: str, later: list[Step]) -> DataFrame:
        groups = [[step for step in later if step.centroids == c] for c in {step.centroids for step in later}]
        held = [_rows(spark, path, own, StructType([schema[key]])).select(key, "__number", "__writer") for own in groups]
        held = reduce(DataFrame.unionByName, held)
        size = held.agg(F.sum(F.octet_length(key) + 64)).first()[0] or 0
        newest = held.groupBy(F.col(key).alias("__key")).agg(F.max(step_of).alias("__newest"))
        joined = rows.join(_broadcast_if_small(newest, size), F.col(key) == F.col("__key"), "left")
        return joined.where(F.col("__newest").isNull() | (step_of >= F.col("__newest"))).drop("__key", "__newest")

    if len(steps) > 1:
        rows = without_superseded(rows, "external_id", steps[1:])
    pruned = [step for step in steps[1:] if step.kind == _FILES]
    if pruned:
        rows = without_superseded(rows, "file_path", pruned)
    return rows.select(*schema.names)


def _publish(
    spark: SparkSession, rows: DataFrame, path: str, kind: str, centroids: int | None = None, number: int | None = None
) -> int | None:
    """Write one step and mark it finished; readers see it then.  No rows: no step.

    Bloom filters on the id let a lookup of a few hits skip nearly all row groups.
    """
    step = Step(_claimed(spark, path) if number is None else number, uuid.uuid4().hex[:12], kind, centroids)
    folder, seen = f"{path}/{step.folder}", Observation()
    writer = rows.observe(seen, F.count("*").alias("rows")).write if centroids is None else rows.write.partitionBy("centroid")
    writer = writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    writer.option("parquet.bloom.filter.enabled#external_id", "true").parquet(folder)
    if centroids is None and not seen.get["rows"]:
        delete_path(spark, folder)
        return None
    fs, mark = _hadoop(spark, f"{folder}/_SUCCESS")
    fs.create(mark, True).close()
    return step.number


def centroid_sets(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the sets of centroids that steps of the index may be partitioned by."""
    fs, root = _hadoop(spark, f"{path}/_centroids")
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def read_centroids(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema("centroid int, embedding array<double>").parquet(f"{path}/_centroids/{number}")


def _partitioned(spark: SparkSession, rows: DataFrame, path: str, kind: str, train: int | None) -> int | None:
    """Publish a step partitioned by centroid: by the newest set, or by a new one of ``train`` centroids."""
    if rows.isEmpty():
        return None
    number, sets = _claimed(spark, path), centroid_sets(spark, path)
    if train is not None or not sets:
        usable = rows.where(F.col("embedding").isNotNull())
        ivf.ivf_train(usable, train).write.parquet(f"{path}/_centroids/{number}")
        sets = [number]
    assigned = ivf.ivf_assign(rows, read_centroids(spark, path, sets[-1]))
    return _publish(spark, ivf.spread_by_centroid(assigned), path, kind, sets[-1], number)


def upsert_index(
    spark: SparkSession, path: str, new: DataFrame, prune: bool = False, centroids: int | None = None
) -> int | None:
    """Add ``new`` to the index as a step of its own; the version now current.

    The step is written once and is no part of the index until it is marked as finished, so a
    failing model leaves the index as it was.  An empty ``new`` changes nothing.  What is written
    follows the new rows: old rows are left where they are (see ``compact``).

    With ``centroids`` an index without any is partitioned from here on: that many are trained on
    ``new``; every later step goes by the newest set, and its rows are stored once before.
    """
    kind = _FILES if prune else _IDS
    if centroids is None and not centroid_sets(spark, path):
        found = _publish(spark, new, path, kind)
    else:
        new, place = stored_at(new)
        try:
            found = _partitioned(spark, new, path, kind, None if centroid_sets(spark, path) else centroids)
        finally:
            delete_path(spark, place)
    return current_version(spark, path) if found is None else found


def compact(spark: SparkSession, path: str, centroids: int | None = None) -> int | None:
    """Write the current rows as one snapshot, so that readers compare no keys.

    With ``centroids`` it is partitioned by as many newly trained ones; an index that has some
    keeps the newest set otherwise.
    """
    if current_version(spark, path) is None:
        return None
    rows = read_index(spark, path)
    if centroids is not None or centroid_sets(spark, path):
        return _partitioned(spark, rows, path, _SNAPSHOT, centroids)
    return _publish(spark, rows, path, _SNAPSHOT)


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete what is older than the last ``keep`` snapshots; no reader may still use it."""
    steps = _steps(spark, path)
    snapshots = [step for step in steps if step.kind == _SNAPSHOT and step.finished]
    if keep > 0 and len(snapshots) >= keep:
        old = [step for step in steps if step < snapshots[-keep]]
        for step in old:
            delete_path(spark, f"{path}/{step.folder}")
        used = {step.centroids for step in steps if step not in old}
        for number in centroid_sets(spark, path)[:-1]:
            if number not in used:
                delete_path(spark, f"{path}/_centroids/{number}")
