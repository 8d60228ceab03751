from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.glob import filter_paths, glob_to_regex
from corpusloom.operators.patterns import filter_paths_by, pattern_key

PIECES = ["a", "b", "ab", ".", ".rs", ".md", "/", "/", "*", "?", "[ab]", "[!a]", "]", "**/", "\n", "é", "+"]


def valid(pattern: str) -> bool:
    try:
        glob_to_regex(pattern)
    except ValueError:
        return False
    return True


def patterns(spark, own):
    return spark.createDataFrame([(p,) for p in own], "pattern string")


def paths(spark, own):
    return spark.createDataFrame(list(enumerate(own)), "n long, rel string")


@pytest.mark.parametrize(
    "pattern, key",
    [
        ("src/a.rs", "=src/a.rs"),
        ("**/a.rs", "/a.rs"),
        ("src/**/*.rs", "^src/.rs"),
        ("*.tar.gz", ".gz"),
        ("src/**", "^src"),
        ("*a*", "*"),
        ("[x/]y", "*"),
        ("a/[b.c]", "^a"),
        ("", "="),
    ],
)
def test_keys(pattern, key):
    assert pattern_key(pattern) == key


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_one_regex(spark, seed):
    draw = random.Random(seed)
    globs = {"".join(draw.choices(PIECES, k=draw.randint(0, 5))) for _ in range(400)}
    globs = sorted(g for g in globs if valid(g))
    names = ["".join(draw.choices([p for p in PIECES if p[0] not in "*?["], k=draw.randint(0, 6))) for _ in range(600)]
    table = paths(spark, names)
    found = 0
    for at in range(0, 60, 30):
        include, exclude = globs[at : at + 12], globs[-at - 4 : -at - 1]
        for own in ((include, exclude), (include, ()), ((), exclude)):
            given = [patterns(spark, p) if p else None for p in own]
            kept = sorted(r.n for r in filter_paths_by(table, "rel", *given, salts=3).collect())
            assert kept == sorted(r.n for r in filter_paths(table, "rel", *own).collect())
            found += len(kept)
    assert found > 50


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a.rs", "x"), (1, "a.rs", "x"), (2, None, "y"), (3, "b.md", None)]
    table = spark.createDataFrame(rows, "key long, rel string, __rel string").withColumns({"salt": F.lit(9), "wanted": F.lit(False)})
    some = patterns(spark, ["*.rs", "*.rs", None])
    kept = filter_paths_by(table, "rel", some)
    assert kept.columns == table.columns and [r.key for r in kept.collect()] == [1, 1]
    assert [r.key for r in filter_paths_by(table, "rel", None, some).collect()] == [3]
    assert filter_paths_by(table, "rel", patterns(spark, [None])).count() == 0
    assert filter_paths_by(table, "rel", None, patterns(spark, [])).count() == 3
    assert filter_paths_by(table.limit(0), "rel", some, some).count() == 0
    assert filter_paths_by(table, "rel").count() == 4


def test_malformed_pattern_ends_the_job(spark):
    with pytest.raises(Exception, match="unclosed character class"):
        filter_paths_by(paths(spark, ["a"]), "rel", patterns(spark, ["[a"])).collect()


def test_many_patterns_without_nested_loops(spark):
    table = spark.range(30_000).select("id", F.concat(F.lit("d/f"), "id", F.lit(".rs")).alias("rel"))
    many = spark.range(100_000).select(F.concat(F.lit("**/f"), F.col("id") * 2, F.lit(".rs")).alias("pattern"))
    kept = filter_paths_by(table, "rel", many, patterns(spark, ["d/f1*.rs"]))
    assert kept.count() == sum(not str(i).startswith("1") for i in range(0, 30_000, 2))
    plan = kept._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_patterns_are_merged_whatever_their_estimate(spark):
    # A file's size says nothing of how many rows its patterns become: they must not be broadcast.
    kept = filter_paths_by(paths(spark, ["a.rs", "b.md"]), "rel", patterns(spark, ["**/a.rs", "*.md"]), patterns(spark, ["b*"]))
    assert [r.n for r in kept.collect()] == [0]
    plan = kept._jdf.queryExecution().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "salt#" in line and "key#" in line]
    assert any("SortMergeJoin" in line for line in joins) and not any("Broadcast" in line for line in joins)
