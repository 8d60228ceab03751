"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from compare import differences, duck
from corpusloom.plans.oracles import ORACLES
from corpusloom.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    assert differences(spark, con, query, sql, SF_DIR) is None


def test_heading_sections_are_not_cut(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "en", "\n".join(["a" * 60_000] * 8))], "doc_id long, source string, lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sections = QUERIES["heading_sections"](spark, str(tmp_path)).collect()
    assert max(r["text_bytes"] for r in sections) >= 60_000


def test_entry(spark):
    assert registry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())
