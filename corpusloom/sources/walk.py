"""Reading a directory tree from its file system: every name, no links, and a reason for what cannot be read.

The tree is expanded in rounds: each task lists directories until it has seen ``ENTRIES_EACH``
entries and hands on what is left, so a wide or deep tree spreads over the cluster and a small
one takes one round.  Names are stored, packed into lists of bounded size, and read list by list:
neither names nor contents pass through the driver.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import checkpoint_folder

ENTRIES_EACH = 1 << 14  # entries that a task lists before it hands directories on
LIST_BYTES = 32 << 20  # of files that are read together, unless one alone is larger
LIST_FILES = 4096
BATCH_BYTES = 8 << 20  # of contents that leave a task at a time, unless one alone is larger
MOST_BYTES = (1 << 31) - 64  # of one file: a longer value does not fit a row

FILE, DIRECTORY, PROBLEM = 0, 1, 2
BAD_NAME = "name is not valid UTF-8"
NOT_LISTED = "directory cannot be listed"
NOT_READ = "file cannot be read"
TOO_LARGE = "file is larger than 2 GiB"
FOUND = "kind int, rel string, size long, reason string"


def reachable(uri: str) -> bool:
    """Whether tasks can read this file system themselves (else only Spark's own reader can)."""
    try:
        return _open(uri) is not None
    except (OSError, ValueError, NotImplementedError):
        return False


def _open(uri: str) -> tuple[arrow_fs.FileSystem | None, str]:
    """File system and path of an absolute URI; None stands for local files."""
    scheme, _, path = uri.partition(":")
    if scheme == "file":
        return None, "/" + path.lstrip("/")
    return arrow_fs.FileSystem.from_uri(uri)


def tables(uri: str, columns: list[str]) -> Iterator[pa.Table]:
    """The Parquet files of one folder that hold rows, one at a time."""
    files, path = _open(uri)
    files = files or arrow_fs.LocalFileSystem()
    for info in files.get_file_info(arrow_fs.FileSelector(path)):
        if info.base_name.endswith(".parquet"):
            rows = pq.read_table(info.path, columns=columns, filesystem=files, use_threads=False)
            if rows.num_rows:
                yield rows


def _why(error: Exception) -> str:
    return error.strerror or type(error).__name__ if isinstance(error, OSError) else type(error).__name__


def _entries(files: arrow_fs.FileSystem | None, path: str) -> Iterator[tuple[int, str, int]]:
    """Kind, name and size of what a directory holds; links and devices are neither kind."""
    if files is None:
        with os.scandir(path) as found:
            for entry in found:
                mode = entry.stat(follow_symlinks=False)
                if stat.S_ISDIR(mode.st_mode):
                    yield DIRECTORY, entry.name, 0
                elif stat.S_ISREG(mode.st_mode):
                    yield FILE, entry.name, mode.st_size
    else:
        for info in files.get_file_info(arrow_fs.FileSelector(path)):
            if info.type in (arrow_fs.FileType.Directory, arrow_fs.FileType.File):
                yield (DIRECTORY if info.type == arrow_fs.FileType.Directory else FILE), info.base_name, info.size or 0


def expand(uri: str, directories: list[str]) -> Iterator[tuple[int, str | None, int | None, str | None]]:
    """What lies below ``directories`` (paths below the root): files, problems, and directories
    that were met after ``ENTRIES_EACH`` entries and are not listed yet."""
    files, base = _open(uri)
    todo, seen = list(directories), 0
    while todo:
        rel = todo.pop()
        if seen >= ENTRIES_EACH:
            yield DIRECTORY, rel, None, None
            continue
        try:
            for kind, name, size in _entries(files, f"{base}/{rel}" if rel else base):
                seen += 1
                below = f"{rel}/{name}" if rel else name
                if below.encode(errors="surrogateescape") != below.encode(errors="replace"):
                    yield PROBLEM, below.encode(errors="replace").decode(), None, BAD_NAME
                elif kind == DIRECTORY:
                    todo.append(below)
                else:
                    yield FILE, below, size, None
        except OSError as error:
            yield PROBLEM, rel, None, f"{NOT_LISTED}: {_why(error)}"


def listing(spark: SparkSession, uri: str) -> DataFrame:
    """``kind, rel, size, reason`` of all files and problems below the root, stored."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(expand(uri, batch.column("rel").to_pylist()))
            for at in range(0, len(rows), 1 << 14):
                columns = zip(*rows[at : at + (1 << 14)])
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "rel", "size", "reason"])

    path = checkpoint_folder(spark, "listing")
    todo, count, number = spark.createDataFrame([("",)], "rel string"), 1, 0
    while count:
        todo.repartition(min(count, 4096)).mapInArrow(listed, FOUND).write.parquet(f"{path}/round={number}")
        todo = spark.read.schema(FOUND).parquet(f"{path}/round={number}").where(F.col("kind") == DIRECTORY).select("rel")
        count, number = todo.count(), number + 1
    return spark.read.schema(FOUND).parquet(path).where(F.col("kind") != DIRECTORY)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names packed into lists of at most ``LIST_BYTES`` of contents and ``LIST_FILES`` files."""
    held, total = [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.string()))], names=["files"])

    for batch in batches:
        for rel, size in zip(batch.column("rel").to_pylist(), batch.column("size").to_pylist()):
            if held and (total + size > LIST_BYTES or len(held) >= LIST_FILES):
                yield row()
                held, total = [], 0
            held.append(rel)
            total += size
    if held:
        yield row()


def contents(names: DataFrame, uri: str) -> DataFrame:
    """``rel, content, reason`` of every file of a listing; the content of what cannot be read is
    null and the reason says why.  A file that has gone meanwhile is such a file."""
    spark = names.sparkSession
    path = checkpoint_folder(spark, "file-lists")
    names.select("rel", "size").mapInArrow(_lists, "files array<string>").write.parquet(path)
    lists = spark.read.schema("files array<string>").parquet(path)
    count = lists.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(uri)

        def one(rel: str) -> tuple[bytes | None, str | None]:
            try:
                if files is None:
                    with open(f"{base}/{rel}", "rb") as opened:
                        content = opened.read(MOST_BYTES + 1)
                else:
                    with files.open_input_stream(f"{base}/{rel}") as opened:
                        content = opened.read(MOST_BYTES + 1)
            except OSError as error:
                return None, f"{NOT_READ}: {_why(error)}"
            return (content, None) if len(content) <= MOST_BYTES else (None, TOO_LARGE)

        held, total = [], 0

        def block() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.binary(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["rel", "content", "reason"])

        for batch in batches:
            for rel in (rel for files_ in batch.column("files").to_pylist() for rel in files_):
                content, reason = one(rel)
                size = len(content or b"")
                if held and total + size > BATCH_BYTES:
                    yield block()
                    held, total = [], 0
                held.append((rel, content, reason))
                total += size
        if held:
            yield block()

    return lists.repartition(max(1, min(count, 1 << 16))).mapInArrow(read, "rel string, content binary, reason string")
