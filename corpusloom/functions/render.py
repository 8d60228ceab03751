"""Search hits as readable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let, split_lines

# The printed form.
NO_RESULTS = "No results found."
RULE = "  ---"


def with_defaults(hits: DataFrame) -> DataFrame:
    """Attributes a stored vector may lack: path is its id, lines 0, name and text empty."""
    defaults = {
        "file_path": F.col("external_id"),
        "start_line": F.lit(0).cast("long"),
        "end_line": F.lit(0).cast("long"),
        "item_name": F.lit(""),
        "chunk_text": F.lit(""),
    }
    filled = {
        name: F.coalesce(F.col(name), value) if name in hits.columns else value
        for name, value in defaults.items()
    }
    return hits.withColumns(filled)


def hit_text(rank: Column, score: Column, path: Column, start: Column, end: Column, name: Column, text: Column) -> Column:
    """One hit; it ends with an empty line."""
    head = F.format_string("Result %d (score: %.4f)\n  File: %s:%d-%d", rank, score, path, start, end)
    item = F.when(name != "", F.concat(F.lit("  Item: "), name))
    body = let(
        split_lines(text),
        lambda lines: F.when(
            F.size(lines) > 0,
            F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), x)), "\n"),
        ),
    )
    return F.concat(F.concat_ws("\n", head, item, F.lit(RULE), body, F.lit(RULE)), F.lit("\n"))


def render_hits(hits: DataFrame) -> DataFrame:
    """``rank, rendered`` per hit."""
    full = with_defaults(hits)
    columns = ("rank", "score", "file_path", "start_line", "end_line", "item_name", "chunk_text")
    return full.select("rank", hit_text(*[F.col(c) for c in columns]).alias("rendered"))


def render_report(hits: DataFrame) -> str:
    """The hits of one query (at most k) as one text."""
    rows = sorted(render_hits(hits).collect(), key=lambda r: r["rank"])
    return "\n".join(r["rendered"] for r in rows) + "\n" if rows else NO_RESULTS + "\n"
