"""Paths against a table of glob patterns: an equality join on what a pattern spells out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.glob import glob_to_regex

SALTS = 16  # parts that the paths of one key are dealt to

_BEFORE_SIGNS = re.compile(r"[^*?\[]*")
_AFTER_SIGNS = re.compile(r"[^*?\]]*\Z")


def pattern_key(pattern: str) -> str:
    """What a path must have to match, the most telling first: the whole path (``=``), its last
    component (``/``), first component and extension (``^`` and ``/.``), extension (``.``), first
    component (``^``), or nothing that is spelled out (``*``)."""
    head, tail = _BEFORE_SIGNS.match(pattern)[0], _AFTER_SIGNS.search(pattern)[0]
    if head == pattern:
        return f"={pattern}"
    if "/" in tail:
        return "/" + tail.rsplit("/", 1)[1]
    first = "^" + head.split("/", 1)[0] if "/" in head else ""
    extension = "." + tail.rsplit(".", 1)[1] if "." in tail else ""
    return f"{first}/{extension}" if first and extension else first or extension or "*"


def path_keys(rel: Column) -> Column:
    """Every key that a pattern matching this path can have."""
    name = F.substring_index(rel, "/", -1)
    first = F.when(F.contains(rel, F.lit("/")), F.concat(F.lit("^"), F.substring_index(rel, "/", 1)))
    extension = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    whole = F.concat(F.lit("="), rel), F.concat(F.lit("/"), name)
    return F.array_compact(F.array(*whole, F.concat(first, F.lit("/"), extension), extension, first, F.lit("*")))


def keyed_patterns(patterns: DataFrame, column: str) -> DataFrame:
    """``key, regex`` of every distinct pattern; a malformed one ends the job."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            columns = [pa.array([f(p) for p in own], pa.string()) for f in (pattern_key, glob_to_regex)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "regex"])

    distinct = patterns.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct()
    return distinct.mapInArrow(keyed, "key string, regex string")


def filter_paths_by(
    df: DataFrame,
    rel_col: str,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
    column: str = "pattern",
    salts: int = SALTS,
) -> DataFrame:
    """Rows of ``df`` whose path a pattern of ``include`` matches, if that is given, and none of
    ``exclude`` does.

    Patterns are the rows of ``column``, any number of them, and never pass through the driver.
    Distinct paths meet the patterns of their keys only; the regular expression decides within a
    key.  The paths of a key, also of the one without anything spelled out, are dealt to ``salts``
    parts, to each of which its patterns go.

    Null patterns match nothing, so an empty ``include`` keeps nothing.  Rows with a null path go
    if a table is given.  Repeated rows and patterns, and further columns, are kept as they are.
    """
    tables = [(include, True), (exclude, False)]
    marked = [keyed_patterns(t, column).withColumn("wanted", F.lit(w)) for t, w in tables if t is not None]
    if not marked:
        return df
    patterns = marked[0] if len(marked) == 1 else marked[0].unionByName(marked[1])
    patterns = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    paths = df.select(F.col(rel_col).alias("__rel")).where(F.col("__rel").isNotNull()).distinct()
    salt = F.pmod(F.xxhash64("__rel"), F.lit(salts)).cast("int").alias("salt")
    asked = paths.select("__rel", salt, F.explode(path_keys(F.col("__rel"))).alias("key"))
    # Merged at any size: an estimate from before the patterns were multiplied would broadcast them.
    met = asked.join(patterns.hint("merge"), ["key", "salt"]).where(F.rlike("__rel", F.col("regex")))
    found = met.groupBy("__rel").agg(F.bool_or("wanted").alias("wanted"), F.bool_or(~F.col("wanted")).alias("unwanted"))
    if include is None:
        return df.where(F.col(rel_col).isNotNull()).join(found, df[rel_col] == found["__rel"], "left_anti")
    kept = found.where("wanted and not unwanted")
    return df.join(kept, df[rel_col] == kept["__rel"], "left_semi")
