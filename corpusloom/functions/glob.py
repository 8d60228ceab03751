"""Glob patterns as predicates on a path relative to its root.

``*`` and ``?`` also match ``/``; ``**`` stands for whole components, so ``**/`` means any
number of directories; ``[a-z]`` and ``[!a-z]`` are classes.  Matching is case-sensitive
and leading dots are ordinary.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERNS_EACH = 500

_PARTS = re.compile(
    r"(?P<stars>\*+)|(?P<any>\?)|\[(?P<negated>!?+)(?P<members>.[^\]]*)\]|(?P<char>.)", re.S
)


def _literal(char: str) -> str:
    plain = char.isalnum() or char in "_/" or ord(char) > 127
    return char if plain else "\\" + char


def _class(negated: str, members: str) -> str:
    ranges = re.sub(
        r"(?s)(.)-(.)|(.)",
        lambda m: _literal(m[3]) if m[3] else f"{_literal(m[1])}-{_literal(m[2])}",
        members,
    )
    return f"[{'^' if negated else ''}{ranges}]"


def glob_to_regex(pattern: str) -> str:
    """An anchored Java regex; raises ``ValueError`` for a malformed pattern."""
    out, skip_to = [], 0
    for m in _PARTS.finditer(pattern):
        if m.start() < skip_to:
            continue
        if m["stars"]:
            stars, before, after = m["stars"], pattern[: m.start()], pattern[m.end() :]
            if stars == "*":
                out.append(".*")
                continue
            alone = (not before or before[-1] == "/") and (not after or after[0] == "/")
            if len(stars) > 2 or not alone:
                raise ValueError(f"invalid glob {pattern!r}: ** must be a whole path component")
            out.append("(?:.*/)?" if after else ".*")
            skip_to = m.end() + 1
        elif m["any"]:
            out.append(".")
        elif m["members"]:
            out.append(_class(m["negated"], m["members"]))
        elif m["char"] == "[":
            raise ValueError(f"invalid glob {pattern!r}: unclosed character class")
        else:
            out.append(_literal(m["char"]))
    return rf"(?s)\A{''.join(out)}\z"


def matches_any(rel: Column, patterns: Sequence[str]) -> Column:
    """One regular expression for every ``PATTERNS_EACH`` patterns; there may be any number."""
    regexes = [f"(?:{glob_to_regex(p)})" for p in patterns]
    starts = range(0, max(len(regexes), 1), PATTERNS_EACH)
    parts = [F.rlike(rel, F.lit("|".join(regexes[i : i + PATTERNS_EACH]) or r"\A\z.")) for i in starts]
    return reduce(Column.__or__, parts)


def path_filter(rel: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Kept if no include is given or one matches, and no exclude matches."""
    wanted = matches_any(rel, include) if include else F.lit(True)
    return wanted & ~matches_any(rel, exclude) if exclude else wanted


def filter_paths(df: DataFrame, rel_col: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    return df.where(path_filter(F.col(rel_col), include, exclude))


def patterns_of(table: DataFrame, column: str) -> list[str]:
    """Patterns kept in a table, for ``filter_paths``: configuration, read by the driver."""
    return sorted(r[0] for r in table.select(column).where(F.col(column).isNotNull()).distinct().collect())
