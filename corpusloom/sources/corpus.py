"""Where files come from: directories, or any table with a path and a text."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import SourceRoot
from corpusloom.functions.glob import path_filter
from corpusloom.sources import walk

INVALID_UTF8 = "not valid UTF-8"
HIDDEN = "hidden file, not read by Spark"
REASONS = (INVALID_UTF8, HIDDEN, walk.BAD_NAME, walk.NOT_LISTED, walk.NOT_READ, walk.TOO_LARGE)  # kinds of them
ROWS_EACH = 2_048  # rows of a table that a task makes files of, where they are dealt
_READ_ANYWAY = re.compile(r"_[^=]*=.*|_metadata.*|_common_metadata.*")  # by Spark's listing


def root_prefix(path: str) -> str:
    """Last component of the root, or the whole path if it has none."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    return path if last in ("", ".", "..") else last


def _qualified(spark: SparkSession, root: str) -> tuple[str, str]:
    """URI of a root, and its path on its file system without scheme and host."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    return path.toString().rstrip("/"), path.toUri().getPath().rstrip("/")


def _literal(path: str) -> str:
    """The path with the signs that Hadoop would take for a glob escaped."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _relative(root_path: str) -> Column:
    """Path below the root.

    Built from file metadata alone, so that a predicate on it prunes the file listing and
    an excluded file is never opened.
    """
    uri = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    path = F.regexp_replace(F.url_decode(uri), r"\A[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?", "")
    return F.substr(path, F.lit(len(root_path) + 2))


def _hidden(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """Directories and files below the root that Spark's listing drops for their names.

    Level by level, so that only names that are dropped leave the file system's own listing.
    """
    base, conf = _literal(root).rstrip("/"), spark._jsc.hadoopConfiguration()
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = new_path(root).getFileSystem(conf)
    directories, files = [], []
    while fs.globStatus(new_path(f"{base}/*")):
        for status in fs.globStatus(new_path(f"{base}/{{.*,_*,*._COPYING_}}")):
            if not _READ_ANYWAY.fullmatch(status.getPath().getName()):
                (directories if status.isDirectory() else files).append(status.getPath())
        base += "/*"
    return [p.toString() for p in directories], [p.toUri().getPath() for p in files]


def scan_root(spark: SparkSession, root: SourceRoot) -> DataFrame:
    """``file_path, content, reason`` of every file below one root that passes its globs.

    All names are read, also those that begin with a dot or an underscore; links are not followed
    (but for the root itself).  A directory that cannot be listed and a file that cannot be opened
    have a reason and no content, and the run goes on.  Globs are tested on the stored names, so
    an excluded file is never opened.  A root that does not exist is such a directory.

    File systems that only Spark can open are read by its own reader, see ``_read_by_spark``.
    """
    uri, _ = _qualified(spark, root.path)
    wanted = path_filter(F.col("rel"), root.include, root.exclude)
    if not walk.reachable(uri):
        return _read_by_spark(spark, root)
    names = walk.listing(spark, uri)
    rel = F.when(F.col("rel") == "", F.lit(root_prefix(root.path))).otherwise(F.concat(F.lit(root_prefix(root.path) + "/"), F.col("rel")))
    found = walk.contents(names.where((F.col("kind") == walk.FILE) & wanted), uri)
    problems = names.where(F.col("kind") == walk.PROBLEM).select("rel", F.lit(None).cast("binary").alias("content"), "reason")
    return found.unionByName(problems).select(rel.alias("file_path"), "content", "reason")


def _read_by_spark(spark: SparkSession, root: SourceRoot) -> DataFrame:
    """``scan_root`` by Spark's own listing, which opens no hidden file, follows links, and ends the
    run at what it cannot open.

    Hidden directories are read as roots of their own; the content of a hidden file is null, and
    its reason says so.
    """
    _, root_path = _qualified(spark, root.path)
    directories, hidden = _hidden(spark, root.path)
    prefix = F.lit(root_prefix(root.path) + "/")

    def chosen(files: DataFrame, rel: Column, reason: Column) -> DataFrame:
        wanted = path_filter(rel, root.include, root.exclude)
        return files.where(wanted).select(F.concat(prefix, rel).alias("file_path"), "content", reason.alias("reason"))

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load([_literal(p) for p in (root.path, *directories)])
    found = chosen(files, _relative(root_path), F.lit(None).cast("string"))
    if not hidden:
        return found
    unread = [(p[len(root_path) + 1 :], None) for p in hidden]
    return found.unionByName(chosen(spark.createDataFrame(unread, "rel string, content binary"), F.col("rel"), F.lit(HIDDEN)))


def scan_roots(spark: SparkSession, roots: Sequence[SourceRoot]) -> DataFrame:
    """All roots in turn.  Roots with the same last component share paths."""
    if not roots:
        return spark.createDataFrame([], "file_path string, content binary, reason string")
    prefixes = [root_prefix(r.path) for r in roots]
    twice = sorted({p for p in prefixes if prefixes.count(p) > 1})
    if twice:
        warnings.warn(f"roots share the path prefix {', '.join(twice)}", stacklevel=2)
    return reduce(DataFrame.unionByName, [scan_root(spark, r) for r in roots])


def _is_text() -> Column:
    return F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))


def decode(files: DataFrame) -> DataFrame:
    """``file_path, source`` of the files that are valid UTF-8."""
    return files.where(_is_text()).select("file_path", F.col("content").cast("string").alias("source"))


def skip_reason() -> Column:
    """Why ``decode`` leaves a scanned file out; null for the files that it keeps."""
    return F.when(~_is_text(), F.coalesce(F.col("reason"), F.lit(INVALID_UTF8)))


def skipped(files: DataFrame) -> DataFrame:
    """``file_path, reason`` of the files that ``decode`` leaves out."""
    if "reason" not in files.columns:
        files = files.withColumn("reason", F.lit(None).cast("string"))
    return files.where(~_is_text()).select("file_path", skip_reason().alias("reason"))


def scan_corpus(spark: SparkSession, roots: Sequence[SourceRoot]) -> DataFrame:
    return decode(scan_roots(spark, roots))


def spread(table: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """``table`` dealt to tasks of about ``rows_each`` rows: a small file may hold more rows than one task
    should make files of, and chunking, a narrow stage, has as many tasks as its input.

    Select what the files are made of first: that is what is shuffled.
    """
    return table.repartition(max(1, -(-table.count() // rows_each)))


def table_corpus(table: DataFrame, path: Column, text: Column) -> DataFrame:
    """Any table as a corpus: one row is one file."""
    return table.select(path.alias("file_path"), text.alias("source"))


def union_corpora(*corpora: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, corpora)
