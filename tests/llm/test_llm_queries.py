"""The registered queries, and the pipeline against its parts."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from compare import differences, duck
from corpusloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert differences(spark, duck(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) is None
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.staged(stage(spark, frames[-1], SF_DIR), name))
    start, quality, language, unique, mixed, packed = (f.toPandas() for f in frames)
    assert all(list(f.columns) == docs.columns for f in frames[:-1])
    assert set(language.doc_id) <= set(quality.doc_id) <= set(start.doc_id)
    assert all(any(c.isalpha() for c in t or "") for t in language.text)
    classes = brute.near_duplicates(list(zip(language.doc_id.tolist(), language.text)))
    assert Counter(unique.doc_id) == Counter(d for d, least, _ in classes if d == least)
    assert set(mixed.doc_id) <= set(unique.doc_id) and mixed.doc_id.value_counts().max() <= 2
    whole = packed[packed.piece == 0].groupby("doc_id").size()
    assert whole.to_dict() == mixed.groupby("doc_id").size().to_dict()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_without_rows(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHES = "size copies source_size target taken place rate start name no_source score keep coverage lang_pred text_score class_no".split()


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, a very long text, and columns named as the stages' own."""
    base = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    text = base.text[base.text.str.len().idxmax()]
    near = base.text[3].split(" ")
    rows = [tuple(r) for r in base.itertuples(index=False)]
    rows += [(None, base.text[i], "en", None, None) for i in (3, 3, 5)] + [(None, " ".join(["q", *near[1:]]), None, "s", 1)]
    rows += [(None, None, None, None, None)] * 2 + [(7_000, "", "en", "s", 0), (7_001, None, "de", "s", None), (7_002, " \n", "de", "s", 2)]
    rows += [rows[9]] * 3 + [(8_000, " ".join([text] * 40), "en", "big", 1), (8_001, "x" * 300_000, "en", "big", 1)]
    rows += [(5, "another text under an id that is taken already, of twelve words", "en", "s", 3)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    frames = [corpus_pipeline.staged(docs, "odd")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.staged(stage(spark, frames[-1], SF_DIR), name))
    for frame in frames[:-1]:
        assert frame.columns == docs.columns
        for i, name in enumerate(CLASHES):
            assert frame.where(F.col(name) != F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))).count() == 0
    start, quality, language, unique, mixed, packed = ([tuple(r)[:5] for r in f.collect()] for f in frames)
    for before, after in zip((start, quality, language), (quality, language, unique)):
        assert not Counter(after) - Counter(before)
    assert all(any(c.isalpha() for c in r[1] or "") for r in language)
    classes = {}
    for (doc_id, text, *_), root in zip(language, brute.classes([r[1] for r in language])):
        classes.setdefault(root, []).append((doc_id is None, doc_id))
    assert Counter((r[0] is None, r[0]) for r in unique) == Counter(min(v, key=lambda t: (t[0], t[1] or 0)) for v in classes.values())
    assert set(mixed) <= set(unique) and max(Counter(mixed).values()) <= 2
    assert sum(r[1] == 0 for r in packed) == len(mixed)


def test_no_words_no_links(spark):
    rows = [(None, None), (None, None), (None, ""), (1, ""), (1, ""), (1, None), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, extra string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()
    expected = [(None, None), (None, ""), (1, ""), (1, None), (2, "a b c d e f")]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(expected)
