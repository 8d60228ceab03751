"""Exact line, byte and white-space semantics as column expressions.

Line rules: only ``\\n`` and ``\\r\\n`` end a line, a lone ``\\r`` is data, and one
trailing terminator opens no further line.  Blank means Unicode ``White_Space``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


FOLD_BLOCK = 256  # items whose results a fold collects at a time


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda the optimizer may inline a projected column and then evaluate it
    once per array element.  A one-element ``transform`` binds it for good.
    """
    return F.transform(F.array(value), body)[0]


def gather(items: Column, first: Column, last: Column) -> Column:
    """Elements ``first`` to ``last``, 0-based; ``slice`` would walk the whole array each time."""
    return F.transform(F.sequence(first, last), lambda i: F.get(items, i))


def folded(
    items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]], kind: str
) -> Column:
    """What ``step`` emits along ``items``: it returns the next state, whether it emits, and what.

    A fold copies what it has collected at every step, so items are taken in blocks: the state at
    each block's start comes first, and what is emitted is collected block by block.
    """

    def collect(acc: Column, item: Column) -> Column:
        state, emits, value = step(acc["state"], item)
        found = acc["found"]
        return F.struct(
            state.alias("state"),
            F.when(emits, F.concat(found, F.array(value))).otherwise(found).alias("found"),
        )

    blocks = F.floor((F.size(items) - 1) / FOLD_BLOCK).cast("int")  # number of the last one

    def block(n: Column) -> Column:
        last = F.least((n + 1) * FOLD_BLOCK, F.size(items)) - 1
        return gather(items, n * FOLD_BLOCK, last)

    def next_start(states: Column, n: Column) -> Column:
        reached = F.aggregate(block(n), F.get(states, n), lambda acc, item: step(acc, item)[0])
        return F.concat(states, F.array(reached))

    complete = F.filter(F.sequence(F.lit(0), blocks), lambda n: n < blocks)

    def of_states(states: Column) -> Column:
        def found_in(state: Column, n: Column) -> Column:
            empty = F.array().cast(f"array<{kind}>")
            begin = F.struct(state.alias("state"), empty.alias("found"))
            return F.aggregate(block(n), begin, collect, lambda acc: acc["found"])

        return F.flatten(F.transform(states, found_in))

    return let(F.aggregate(complete, F.array(start), next_start), of_states)


def unix_newlines(s: Column) -> Column:
    return F.replace(s, F.lit("\r\n"), F.lit("\n"))


def split_lines(s: Column) -> Column:
    """The lines of a text, without terminators; the empty text has none."""
    body = F.regexp_replace(unix_newlines(s), r"\n\z", "")
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def count_newlines(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit("\n"), F.lit("")))


def line_count(s: Column) -> Column:
    """``size(split_lines(s))`` without building the array."""
    unterminated = (s != "") & ~F.endswith(s, F.lit("\n"))
    return (count_newlines(s) + unterminated.cast("int")).cast("long")


def is_blank(s: Column) -> Column:
    return ~F.rlike(s, F.lit(r"(?U)\S"))


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\A\s+", "")


def trim_all(s: Column) -> Column:
    return F.regexp_replace(trim_start(s), r"(?U)\s+\z", "")


def truncate_bytes(s: Column, cap: int) -> Column:
    """The longest prefix of whole characters within ``cap`` UTF-8 bytes."""
    head = F.substring(s.cast("binary"), 1, cap)
    # A cut character repairs to exactly one replacement character at the end.
    whole = F.left(s, F.length(F.make_valid_utf8(head.cast("string"))) - 1)
    cut = F.coalesce(F.try_validate_utf8(head.cast("string")), whole)
    return F.when(F.octet_length(s) > cap, cut).otherwise(s)


def split_bytes(s: Column, cap: int) -> Column:
    """``array<struct<first, last, text>>``: pieces of at most ``cap`` UTF-8 bytes, of whole lines as
    long as these fit, with the numbers, from 0, of their first and last line.

    Joined they are the text: a line keeps its terminator.  A longer line is cut between
    characters, into pieces of its own.  ``cap`` is at least 4, the longest character.
    """
    letters = max(1, cap // 4)
    ends = F.regexp_extract_all(s, F.lit(r"[^\n]*+(?:\n|\z)"), F.lit(0))
    lines = F.filter(ends, lambda line: line != "")

    def of_line(line: Column, n: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.length(line) - 1) / letters).cast("int"))
        cut = F.transform(parts, lambda i: F.substr(line, i * letters + 1, F.lit(letters)))
        texts = F.when(F.octet_length(line) <= cap, F.array(line)).otherwise(cut)
        return F.transform(texts, lambda t: F.struct(n.cast("int").alias("line"), t.alias("text"), (F.octet_length(line) > cap).alias("own")))

    def of_segments(segments: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("held"), F.lit(True).alias("own"))

        def step(acc: Column, segment: Column) -> tuple[Column, Column, Column]:
            size = F.octet_length(segment["text"])
            begins = acc["own"] | segment["own"] | (acc["held"] + size > cap)
            held = F.when(begins, size).otherwise(acc["held"] + size)
            return F.struct((acc["i"] + 1).alias("i"), held.alias("held"), segment["own"].alias("own")), begins, acc["i"]

        def piece(starts: Column, k: Column) -> Column:
            first = F.get(starts, k)
            last = F.coalesce(F.get(starts, k + 1), F.size(segments)) - 1
            text = F.array_join(F.transform(gather(segments, first, last), lambda x: x["text"]), "")
            return F.struct(F.get(segments, first)["line"].alias("first"), F.get(segments, last)["line"].alias("last"), text.alias("text"))

        return let(folded(segments, start, step, "int"), lambda starts: F.transform(starts, lambda _, k: piece(starts, k)))

    return let(F.flatten(F.transform(lines, of_line)), of_segments)


def external_id(path: Column, start: Column, end: Column, piece: Column | None = None) -> Column:
    """``path:start-end``; a further piece of a chunk that was split has its number behind."""
    made = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    if piece is None:
        return made
    return F.when(piece > 0, F.concat(made, F.lit("#"), piece.cast("string"))).otherwise(made)


def root_component(path: Column) -> Column:
    return F.substring_index(path, "/", 1)
