"""Files to chunks: one narrow, shuffle-free pass over the corpus."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import MAX_CHUNK_BYTES
from corpusloom.functions.declarations import cuttable, declaration_chunks
from corpusloom.functions.markdown import heading_sections
from corpusloom.functions.text import is_blank, let, line_count, split_bytes, truncate_bytes
from corpusloom.schemas import CHUNK_STRUCT

_RAW = "array<struct<start_line:bigint,end_line:bigint,item_name:string,text:string>>"


def language_of(path: Column) -> Column:
    return (
        F.when(F.endswith(path, F.lit(".rs")), "rust")
        .when(F.endswith(path, F.lit(".md")), "markdown")
        .otherwise("text")
    )


def whole_file(path: Column, source: Column) -> Column:
    return F.array(
        F.struct(
            F.lit(1).cast("long").alias("start_line"),
            F.greatest(line_count(source), F.lit(1)).alias("end_line"),
            path.alias("item_name"),
            source.alias("text"),
        )
    )


def raw_chunks(path: Column, source: Column, plain: Column) -> Column:
    """Chunks before the size cap; only the branch of the file's suffix is evaluated.

    ``plain`` is ``cuttable(source)`` of a Rust file.
    """
    return (
        F.when(F.endswith(path, F.lit(".rs")), declaration_chunks(source, plain).cast(_RAW))
        .when(F.endswith(path, F.lit(".md")), heading_sections(path, source).cast(_RAW))
        .otherwise(whole_file(path, source).cast(_RAW))
    )


def chunk_array(path: Column, raw: Column, max_bytes: int | None = MAX_CHUNK_BYTES) -> Column:
    """All chunks of one file: cut to the byte cap (if there is one) first, then without blank ones."""
    cut = (lambda text: text) if max_bytes is None else (lambda text: truncate_bytes(text, max_bytes))
    over = (lambda text: F.lit(False)) if max_bytes is None else (lambda text: F.octet_length(text) > max_bytes)
    capped = F.transform(
        raw,
        lambda c: F.struct(
            c["start_line"].alias("start_line"),
            c["end_line"].alias("end_line"),
            c["item_name"].alias("item_name"),
            cut(c["text"]).alias("text"),
            language_of(path).alias("language"),
            over(c["text"]).alias("was_truncated"),
        ),
    )
    return F.filter(capped, lambda c: ~is_blank(c["text"])).cast(
        f"array<{CHUNK_STRUCT.simpleString()}>"
    )


_SPLIT = f"array<struct<{CHUNK_STRUCT.simpleString()[7:-1]},piece:int>>"


def split_array(path: Column, raw: Column, max_bytes: int) -> Column:
    """All chunks of one file that are not blank; a longer one than ``max_bytes`` as several pieces.

    Pieces stand on the lines they hold, and joined they are the chunk.  The preamble gathers
    lines from everywhere: its pieces keep the whole range.
    """

    def pieces(c: Column) -> Column:
        def row(start: Column, end: Column, text: Column, was: Column, number: Column) -> Column:
            return F.struct(
                start.cast("long").alias("start_line"),
                end.cast("long").alias("end_line"),
                c["item_name"].alias("item_name"),
                text.alias("text"),
                language_of(path).alias("language"),
                was.alias("was_truncated"),
                number.cast("int").alias("piece"),
            )

        in_one_run = line_count(c["text"]) == c["end_line"] - c["start_line"] + 1

        def place(p: Column, i: Column) -> Column:
            start = F.when(in_one_run, c["start_line"] + p["first"]).otherwise(c["start_line"])
            end = F.when(in_one_run, c["start_line"] + p["last"]).otherwise(c["end_line"])
            return row(start, end, p["text"], F.lit(False), i)

        whole = F.array(row(c["start_line"], c["end_line"], c["text"], F.lit(False), F.lit(0)))
        return F.when(F.octet_length(c["text"]) <= max_bytes, whole).otherwise(F.transform(split_bytes(c["text"], max_bytes), place))

    kept = F.filter(raw, lambda c: ~is_blank(c["text"]))
    return F.flatten(F.transform(kept, pieces)).cast(_SPLIT)


def last_per_range(chunks: Column, pieces: bool = False) -> Column:
    """Of a file's chunks with the same lines, the last one: what an upsert by id keeps.

    Items that share both lines lie on one line and are neighbours; only the leading
    preamble can share its lines with an item further on.
    """

    def same(a: Column, b: Column) -> Column:
        lines = (a["start_line"] == b["start_line"]) & (a["end_line"] == b["end_line"])
        return lines & (a["piece"] == b["piece"]) if pieces else lines

    def of_bound(chunks: Column) -> Column:
        def stays(c: Column, i: Column) -> Column:
            if pieces:  # of two long items on one line each piece meets its like further on
                return ~F.exists(F.slice(chunks, i + 2, F.size(chunks)), lambda d: same(c, d))
            before_equal = F.coalesce(same(c, F.get(chunks, i + 1)), F.lit(False))
            later = F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0)))
            return ~before_equal & ~((i == 0) & F.exists(later, lambda d: same(c, d)))

        return F.filter(chunks, stays)

    return let(chunks, of_bound)


@lru_cache(maxsize=16)
def _steps(session: SparkSession, max_bytes: int | None, unique: bool, split: bool) -> list[Column]:
    """The expressions from ``file_path`` and ``source`` to the chunks, each over the one before,
    built once per session; Spark resolves nested lambdas level by level, so they stand apart."""
    path, before = F.col("file_path"), F.col("__step")
    plain = F.when(F.endswith(path, F.lit(".rs")), cuttable(F.col("source")))
    split = split and max_bytes is not None
    steps = [plain, raw_chunks(path, F.col("source"), before), (split_array if split else chunk_array)(path, before, max_bytes)]
    return [*steps, last_per_range(before, split)] if unique else steps


def chunk_files(
    files: DataFrame,
    max_bytes: int | None = MAX_CHUNK_BYTES,
    keep: tuple[str, ...] = (),
    unique: bool = False,
    oversize: str = "truncate",
) -> DataFrame:
    """``(file_path, source)`` rows to chunk rows, ``chunk_ord`` giving the order in a file.

    ``keep`` names further columns of ``files`` to carry along.  With ``unique``, chunks of
    a file that would be stored under the same id are reduced to the last.  Without
    ``max_bytes`` no text is cut.  With ``oversize="split"`` nothing is lost of a longer chunk: it
    comes in pieces, numbered by a further column ``piece`` where ids would else be equal.
    """
    if oversize not in ("truncate", "split"):
        raise ValueError("oversize must be truncate or split")
    if oversize == "split" and max_bytes is not None and max_bytes < 4:
        raise ValueError("max_bytes must be at least 4, the longest character, to split")
    if max_bytes is not None and max_bytes <= 0:
        raise ValueError("max_bytes must be positive")
    kept, steps = files.select(*keep, "file_path", "source"), _steps(files.sparkSession, max_bytes, unique, oversize == "split")
    for step in steps[:-1]:
        kept = kept.select(*keep, "file_path", "source", step.alias("__step"))
    # Exploding a plain column would let Spark filter on it first, and so compute it twice.
    exploded = kept.select(*keep, "file_path", F.posexplode(steps[-1]).alias("chunk_ord", "c"))
    return exploded.select(*keep, "file_path", "chunk_ord", "c.*")
