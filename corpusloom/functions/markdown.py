"""Heading sections of a Markdown text, as one expression per file row.

Every file is a row, so its sections are built inside that row: no explode of lines,
no shuffle, and nothing to be skewed by a path that occurs many times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import gather, let, split_lines, trim_all


def is_heading(line: Column) -> Column:
    """Any indentation, one to three ``#``, then a space."""
    return F.rlike(line, F.lit(r"(?U)\A\s*#{1,3} "))


def heading_title(line: Column) -> Column:
    """Leading ``#`` are stripped from the raw line, so an indented heading keeps them."""
    return trim_all(F.regexp_replace(line, r"\A#+", ""))


def heading_sections(path: Column, source: Column) -> Column:
    """``array<struct<start_line, end_line, item_name, text>>`` in file order."""

    def of_lines(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.when((i == 0) | is_heading(x), i))
        starts = F.filter(numbered, lambda i: i.isNotNull())

        def of_starts(starts: Column) -> Column:
            def section(start: Column, j: Column) -> Column:
                stop = F.coalesce(F.get(starts, j + 1), F.size(lines))
                first = F.get(lines, start)
                title = F.when(is_heading(first), F.nullif(heading_title(first), F.lit("")))
                return F.struct(
                    (start + 1).cast("long").alias("start_line"),
                    stop.cast("long").alias("end_line"),
                    F.coalesce(title, path).alias("item_name"),
                    F.array_join(gather(lines, start, stop - 1), "\n").alias("text"),
                )

            return F.transform(starts, section)

        return let(starts, of_starts)

    return let(split_lines(source), of_lines)
