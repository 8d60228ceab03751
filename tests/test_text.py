from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.glob import filter_paths, glob_to_regex, patterns_of
from corpusloom.operators.lines import line_offsets, lines

TEXTS = ["", "\n", "a", "a\n", "a\n\n", "\r", "a\r\nb\r\r\n\nc\n", "é\nüü\n", "x\r", "\r\n", "a\n\r\nb"]


def lines_of(s: str) -> list[str]:
    if not s:
        return []
    parts = s.split("\n")
    ended, last = parts[:-1], parts[-1]
    found = [p[:-1] if p.endswith("\r") else p for p in ended]
    return found + [last] if last else found


def test_lines(spark):
    df = spark.createDataFrame([(s,) for s in TEXTS], "s string")
    for row in df.select("s", X.split_lines(F.col("s")).alias("l"), X.line_count(F.col("s")).alias("n")).collect():
        assert row["l"] == lines_of(row["s"]), repr(row["s"])
        assert row["n"] == len(row["l"])


def test_lines_and_offsets_as_rows(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab\n\ré") for _ in range(rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").repartition(3)
    got = {(r["id"], r["line_no"]): r["line"] for r in lines(df, "s", "id").collect()}
    assert got == {(i, n + 1): x for i, s in enumerate(texts) for n, x in enumerate(lines_of(s))}
    starts = {(r["id"], r["line_no"]): r["start_byte"] for r in line_offsets(df, "s", "id").collect()}
    expected = {}
    for i, s in enumerate(texts):
        at = 0
        for n, piece in enumerate(s.split("\n")):
            if n < len(lines_of(s)):
                expected[(i, n + 1)] = at
            at += len(piece.encode()) + 1
    assert starts == expected


@pytest.mark.parametrize("cap", [1, 2, 3, 4, 5, 9])
def test_truncate_bytes(spark, cap):
    texts = ["", "abcdefghij", "éééé", "a€€€", "x😀y😀", "�����"]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for row in df.select("s", X.truncate_bytes(F.col("s"), cap).alias("t")).collect():
        want = row["s"].encode()[:cap].decode(errors="ignore")
        assert row["t"] == want


def test_blank_is_unicode_white_space(spark):
    blank = ["", " \t\n\r\x0b\x0c", "\x85", "\xa0", " ", "      ", "　"]
    solid = ["a", "​", "\x1c", "﻿"]
    df = spark.createDataFrame([(s,) for s in blank + solid], "s string")
    found = {r["s"]: r["b"] for r in df.select("s", X.is_blank(F.col("s")).alias("b")).collect()}
    assert found == {s: s in blank for s in blank + solid}


GLOBS = [
    ("**/*.rs", ["a.rs", "x/y/z.rs", ".rs", "x/.a.rs"], ["a.rs.bak", "A.RS", "a.rst"]),
    ("**/target/**", ["target/x", "a/target/b/c"], ["a/mytarget/b", "target"]),
    ("*.md", ["a.md", "x/a.md"], ["a.mdx"]),
    ("a?c", ["abc", "a/c"], ["ac", "abbc"]),
    ("[a-c]x[!0-9]", ["axb", "cx/"], ["dxb", "ax1", "Axb"]),
    ("a/**/b", ["a/b", "a/x/y/b"], ["ab", "a/xb"]),
    ("**", ["a", "a/b"], []),
    ("a+(b).c", ["a+(b).c"], ["aab.c"]),
    ("[]-]x", ["]x", "-x"], ["ax"]),
    ("**/**/x", ["x", "a/x", "a/b/x"], ["xx"]),
]


@pytest.mark.parametrize("pattern,hits,misses", GLOBS)
def test_glob(spark, pattern, hits, misses):
    df = spark.createDataFrame([(p,) for p in hits + misses], "rel string")
    kept = {r["rel"] for r in filter_paths(df, "rel", include=[pattern]).collect()}
    assert kept == set(hits)
    dropped = {r["rel"] for r in filter_paths(df, "rel", exclude=[pattern]).collect()}
    assert dropped == set(misses)


@pytest.mark.parametrize("pattern", ["a**", "**a", "***", "a/***/b", "[a", "[]", "[!]"])
def test_malformed_glob_fails_at_once(pattern):
    with pytest.raises(ValueError):
        glob_to_regex(pattern)


def test_exclude_wins_and_no_include_means_all(spark):
    df = spark.createDataFrame([("a.rs",), ("target/a.rs",), ("b.py",)], "rel string")
    kept = filter_paths(df, "rel", ["**/*.rs"], ["**/target/**"])
    assert [r["rel"] for r in kept.collect()] == ["a.rs"]
    assert filter_paths(df, "rel").count() == 3


def test_patterns_from_a_table(spark):
    table = spark.createDataFrame([("*.rs",), ("*.md",), ("*.rs",)], "pattern string")
    assert patterns_of(table, "pattern") == ["*.md", "*.rs"]
