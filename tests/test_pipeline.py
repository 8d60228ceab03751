from __future__ import annotations

import hashlib
import os
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.config import Settings, SourceRoot
from corpusloom.functions import glob
from corpusloom.functions.render import render_hits, render_report
from corpusloom.operators import stats
from corpusloom.operators.chunk import chunk_files
from corpusloom.operators.embed import (
    HashEmbedder,
    ModelEmbedder,
    embed_documents,
    embed_queries,
    embed_query,
    token_usage,
)
from corpusloom.plans import pipelines
from corpusloom.plans.queries import QUERIES
from corpusloom.sources import corpus, index_table, walk
from corpusloom.sources.corpus import spread
from corpusloom.streaming.incremental import keep_indexed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES = {
    "alpha/src/lib.rs": b"use std::io;\n\nfn hello() {}\n",
    "alpha/src/with space+plus%.rs": b"struct Odd;\n",
    "alpha/docs/guide.md": "# Über\nerste\n## Zwei\nzweite\n".encode(),
    "alpha/target/out.rs": b"fn generated() {}\n",
    "alpha/bad.md": b"# A\n\xff\xfe\n",
    "alpha/notes.txt": b"plain words\n",
    "beta/readme.md": b"# Beta\nsearching vectors with centroids\n",
    "beta/empty.md": b"",
}


@pytest.fixture()
def roots(tmp_path):
    for name, content in FILES.items():
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    base = str(tmp_path / "files")
    globs = {"include": ("**/*.rs", "**/*.md"), "exclude": ("**/target/**",)}
    return (SourceRoot(f"{base}/alpha", **globs), SourceRoot(f"{base}/beta/", **globs))


@pytest.fixture()
def settings(roots):
    return Settings(roots=roots, dimensions=32, k=3)


# Sources


def test_scan_reads_decodes_and_reports(spark, roots):
    files = corpus.scan_roots(spark, roots)
    texts = {r["file_path"]: r["source"] for r in corpus.decode(files).collect()}
    assert texts == {
        name: FILES[name].decode()
        for name in (
            "alpha/src/lib.rs",
            "alpha/src/with space+plus%.rs",
            "alpha/docs/guide.md",
            "beta/readme.md",
            "beta/empty.md",
        )
    }
    bad = corpus.skipped(files)
    assert [tuple(r) for r in bad.collect()] == [("alpha/bad.md", corpus.INVALID_UTF8)]
    assert [tuple(r) for r in stats.skipped_by_reason(bad).collect()] == [(corpus.INVALID_UTF8, 1)]


HIDDEN_NAMES = (".github/ci.md", ".github/_deep/[a]/b.md", "docs/_posts/post.md", "docs/plain.md", "docs/_k=v.md", "docs/_index.md", ".env.md", ".git/.x.md")


def tree(top, names):
    for name in names:
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)


def test_all_names_are_read(spark, tmp_path):
    tree(tmp_path / "top[1]", (*HIDDEN_NAMES, ".env", ".git/no.txt"))
    files = corpus.scan_root(spark, SourceRoot(str(tmp_path / "top[1]"), ("**/*.md",)))
    assert {(r["file_path"], r["source"]) for r in corpus.decode(files).collect()} == {(f"top[1]/{n}", n) for n in HIDDEN_NAMES}
    assert corpus.skipped(files).count() == 0


def test_sparks_reader_reports_hidden_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "reachable", lambda uri: False)
    tree(tmp_path / "top[1]", (*HIDDEN_NAMES, ".env", ".git/no.txt"))
    files = corpus.scan_root(spark, SourceRoot(str(tmp_path / "top[1]"), ("**/*.md",)))
    hidden = {"docs/_index.md", ".env.md", ".git/.x.md"}
    assert {r["source"] for r in corpus.decode(files).collect()} == set(HIDDEN_NAMES) - hidden
    assert {tuple(r) for r in corpus.skipped(files).collect()} == {(f"top[1]/{n}", corpus.HIDDEN) for n in hidden}
    df = corpus.scan_root(spark, SourceRoot(str(tmp_path / "top[1]"), ("docs/plain.md",)))
    assert "metadata" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("entries", [1 << 14, 3])
def test_links_are_not_followed(spark, tmp_path, monkeypatch, entries):
    monkeypatch.setattr(walk, "ENTRIES_EACH", entries)
    top = tmp_path / "top"
    names = [f"d{i % 3}/e{i % 5}/f{i}.md" for i in range(30)] + ["empty/x/y.md"]
    tree(top, names)
    (top / "d0" / "loop").symlink_to(top)
    (top / "linked.md").symlink_to(top / names[0])
    os.mkfifo(top / "pipe.md")
    (tmp_path / "way").symlink_to(top)
    for root in (top, tmp_path / "way"):
        found = corpus.scan_root(spark, SourceRoot(str(root), ("**/*.md",)))
        assert sorted(r["file_path"] for r in found.collect()) == sorted(f"{root.name}/{n}" for n in names)
        assert found.where("reason is not null").count() == 0


def test_what_cannot_be_read_is_reported(spark, tmp_path, monkeypatch):
    top = tmp_path / "top"
    tree(top, ("a/x.md", "b/y.md", "c/z.md", "gone.md"))
    with open(os.fsencode(str(top)) + b"/bad\xff.md", "wb") as odd:
        odd.write(b"x")
    listing, entries = walk.listing, walk._entries

    def closed(files, path):
        if path.endswith("/b"):
            raise PermissionError(13, "Permission denied")
        return entries(files, path)

    def stale(spark, uri):
        found = listing(spark, uri)
        os.remove(top / "gone.md")
        return found

    monkeypatch.setattr(walk, "_entries", closed)
    monkeypatch.setattr(walk, "listing", stale)
    files = corpus.scan_root(spark, SourceRoot(str(top)))
    assert {r["file_path"]: r["source"] for r in corpus.decode(files).collect()} == {"top/a/x.md": "a/x.md", "top/c/z.md": "c/z.md"}
    assert {tuple(r) for r in corpus.skipped(files).collect()} == {
        ("top/b", "directory cannot be listed: Permission denied"),
        ("top/bad?.md", "name is not valid UTF-8"),
        ("top/gone.md", "file cannot be read: No such file or directory"),
    }
    monkeypatch.undo()
    absent = corpus.scan_root(spark, SourceRoot(str(tmp_path / "absent")))
    assert [tuple(r) for r in absent.collect()] == [("absent", None, "directory cannot be listed: No such file or directory")]


def test_files_are_read_in_lists_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "LIST_BYTES", 100)
    monkeypatch.setattr(walk, "BATCH_BYTES", 50)
    tree(tmp_path / "top", [f"{'n' * (i % 40)}{i}.md" for i in range(60)])
    (tmp_path / "top" / "large.md").write_text("x" * 1000)
    found = corpus.scan_root(spark, SourceRoot(str(tmp_path / "top")))
    sizes = [sum(p) for p in found.select(F.octet_length("content").alias("n"), F.spark_partition_id().alias("p")).groupBy("p").agg(F.collect_list("n")).toPandas().iloc[:, 1]]
    assert found.count() == 61 and len(sizes) > 10 and sorted(sizes)[-2] <= 100


def test_excluded_files_are_never_opened(spark, roots, monkeypatch):
    asked, contents = [], walk.contents
    monkeypatch.setattr(walk, "contents", lambda names, uri: asked.extend(r["rel"] for r in names.collect()) or contents(names, uri))
    assert corpus.scan_root(spark, roots[0]).count() == 4
    assert sorted(asked) == ["bad.md", "docs/guide.md", "src/lib.rs", "src/with space+plus%.rs"]


def test_same_prefix_warns(spark, roots):
    with pytest.warns(UserWarning, match="alpha"):
        corpus.scan_roots(spark, [roots[0], roots[0]])


def test_bad_pattern_fails_before_reading(spark, roots):
    with pytest.raises(ValueError):
        corpus.scan_root(spark, SourceRoot(roots[0].path, include=("a**",)))


@pytest.mark.parametrize("path,prefix", [("/a/b", "b"), ("/a/b/", "b"), ("/", "/"), (".", "."), ("s3a://k/x", "x")])
def test_root_prefix(path, prefix):
    assert corpus.root_prefix(path) == prefix


# Embedding


def toy_model(mode: str):
    def predict(texts: np.ndarray):
        sizes = np.array([len(t) for t in texts], dtype=np.float32)
        return np.stack([sizes, np.full(len(texts), float(mode == "query"))], axis=1), sizes

    return predict


def hashed(text: str, dims: int) -> np.ndarray:
    sums = np.zeros(dims)
    for word in re.findall("[a-z0-9]+", text.lower()):
        digest = hashlib.md5(word.encode()).hexdigest()
        sums[int(digest[:8], 16) % dims] += 1 - 2 * (int(digest[8], 16) % 2)
    norm = np.linalg.norm(sums)
    return sums / norm if norm else sums


def test_hash_embedder(spark):
    texts = ["", "a b", "The the THE x9", "...", "über a-b", "word " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    rows = embed_documents(df, "t", HashEmbedder(16)).collect()
    for r in rows:
        assert r["embedding"] == pytest.approx(hashed(r["t"], 16), abs=1e-6)
        assert r["usage_tokens"] == len(re.findall("[a-z0-9]+", r["t"].lower()))
    assert len(rows) == len(texts)
    assert embed_query(spark, "a b", HashEmbedder(16)) == pytest.approx(hashed("a b", 16), abs=1e-6)


def test_model_embedder_keeps_rows_modes_and_usage(spark):
    df = spark.createDataFrame([("x" * i,) for i in range(1, 301)], "t string")
    model = ModelEmbedder(toy_model, dimensions=2, batch_size=7)
    rows = embed_documents(df, "t", model).collect()
    assert all(r["embedding"] == [float(len(r["t"])), 0.0] for r in rows)
    assert token_usage(embed_documents(df, "t", model)).first()[0] == 300 * 301 // 2
    assert embed_queries(df, "t", model).first()["embedding"][1] == 1.0
    assert embed_query(spark, "abc", model) == [3.0, 1.0]


def test_model_without_usage(spark):
    model = ModelEmbedder(lambda mode: lambda t: np.zeros((len(t), 3)), dimensions=3)
    df = spark.createDataFrame([("a",)], "t string")
    assert embed_documents(df, "t", model).first()["usage_tokens"] is None


@pytest.mark.parametrize("shape", [(0, 2), (1, 3)])
def test_wrong_model_output_fails(spark, shape):
    model = ModelEmbedder(lambda mode: lambda t: np.zeros(shape), dimensions=2)
    with pytest.raises(Exception, match="the model returned|dimensions"):
        embed_documents(spark.createDataFrame([("a",)], "t string"), "t", model).collect()


# Reports


def test_dry_run(spark, settings):
    report = pipelines.dry_run_roots(spark, settings)
    chunks = chunk_files(corpus.scan_corpus(spark, settings.roots)).collect()
    size = lambda rows: sum(len(r["text"].encode()) for r in rows)
    assert [tuple(r) for r in report.by_root.collect()] == [
        (root, len(own), size(own) // 4)
        for root in ("alpha", "beta")
        for own in [[c for c in chunks if c["file_path"].startswith(root)]]
    ]
    totals = report.totals.first()
    assert totals["total_chunks"] == len(chunks) == 6
    assert totals["total_characters"] == size(chunks)
    assert totals["estimated_tokens"] == size(chunks) // 4
    assert (totals["embedding_batches"], totals["dimensions"]) == (1, 32)


def test_dry_run_of_nothing(spark):
    files = spark.createDataFrame([], "file_path string, source string")
    report = pipelines.dry_run(files)
    assert tuple(report.totals.first())[:5] == (0, 0, 0, 0, 0)
    assert report.by_root.count() == 0


def test_dry_run_reads_once(spark, tmp_path):
    """Sums of one pass give both reports, null and repeated roots included."""
    rows = [("b/x.txt", "é" * 9), ("b/y.txt", "abc"), ("a", "x" * 50_000), (None, "no path"), ("b/z.md", " "), ("a", "again")]
    spark.createDataFrame(rows, "file_path string, source string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    chunks = chunk_files(files)
    sums = stats.dry_run_sums(chunks)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert [tuple(r) for r in stats.by_root_of(sums).collect()] == [tuple(r) for r in stats.dry_run_by_root(chunks).collect()]
    assert stats.totals_of(sums).first() == stats.dry_run_totals(chunks).first()
    both = pipelines.dry_run(files)
    assert [tuple(r) for r in both.by_root.collect()] == [(None, 1, 1), ("a", 2, 12_001), ("b", 2, 5)]
    assert tuple(both.totals.first())[:5] == (5, 48_033, 12_008, 1, 1)
    report = {(r["root"], r["whole"]): tuple(r)[2:] for r in stats.dry_run_report(chunks, 2).collect()}
    assert report[(None, True)] == (5, 48_033, 12_008, 3, 1)
    assert report[("a", False)] == (2, 48_005, 12_001, 1, 1)
    assert len(report) == 4
    with pytest.raises(ValueError):
        pipelines.dry_run(files, Settings(embed_batch_size=0))


def words_of(text):
    return len(re.findall("[a-z0-9]+", text.lower()))


@pytest.mark.parametrize("centroids", [None, 2])
def test_run_report(spark, settings, tmp_path, centroids):
    path, report = str(tmp_path / "index"), pipelines.RunReport()
    pipelines.index_roots(spark, path, settings, centroids=centroids, report=report)
    rows = index_table.read_index(spark, path).collect()
    scanned = corpus.scan_roots(spark, settings.roots)
    found = report.totals
    assert found.chunks == len(rows) == 6
    assert found.tokens == sum(words_of(r["chunk_text"]) for r in rows)
    assert found.files == scanned.count()
    assert found.skipped == {corpus.INVALID_UTF8: 1}
    assert (found.truncated_chunks, found.embedding_batches) == (0, 1)


def test_run_report_of_shared_paths_and_problems(spark, tmp_path):
    """Two roots with one prefix: an id that both write is counted once, files are counted each."""
    for side, text in (("x", "left side"), ("y", "right side " * 6_000)):
        (tmp_path / side / "r").mkdir(parents=True)
        (tmp_path / side / "r" / "a.txt").write_text(text)
    (tmp_path / "x" / "r" / "bad.txt").write_bytes(b"\xff")
    os.mkdir(os.fsencode(tmp_path / "y" / "r") + b"/\xfe")
    roots = (*(SourceRoot(str(tmp_path / side / "r")) for side in "xy"), SourceRoot(str(tmp_path / "gone")))
    report = pipelines.RunReport()
    with pytest.warns(UserWarning, match="share the path prefix"):
        pipelines.index_roots(spark, str(tmp_path / "index"), Settings(roots=roots, dimensions=4), report=report)
    found = report.totals
    assert (found.chunks, found.files) == (1, 5)
    assert found.skipped == {corpus.INVALID_UTF8: 1, walk.BAD_NAME: 1, walk.NOT_LISTED: 1}


def test_run_report_of_nothing(spark, tmp_path):
    files, report = spark.createDataFrame([], "file_path string, source string"), pipelines.RunReport()
    assert pipelines.index_files(spark, files, str(tmp_path / "index"), report=report) is None
    assert report.totals == pipelines.RunTotals(0, 0, None, 0, None, {})


def test_settings_reach_the_model(spark, tmp_path):
    """The settings' batch size is the model's unless it has its own; other vector lengths are told."""

    def sizes(mode):
        return lambda texts: np.full((len(texts), 2), len(texts), np.float32)

    files = spark.createDataFrame([(f"r/{i}.md", str(i)) for i in range(9)], "file_path string, source string").coalesce(1)
    for own, most, batches in ((None, 4, 3), (3, 3, 3), (9, 9, 1)):
        path, report = str(tmp_path / f"index{own}"), pipelines.RunReport()
        settings = Settings(dimensions=2, embed_batch_size=4)
        pipelines.index_files(spark, files, path, settings, ModelEmbedder(sizes, 2, own), report=report)
        assert max(r["embedding"][0] for r in index_table.read_index(spark, path).collect()) == most
        assert (report.totals.embedding_batches, report.totals.tokens) == (batches, None)
    with pytest.warns(UserWarning, match="2 components, the settings name 3"):
        pipelines.run_embedder(Settings(dimensions=3), ModelEmbedder(sizes, 2))


def test_no_text_is_cut_without_a_cap(spark):
    text = "é" * 40_000
    files = spark.createDataFrame([("r/a.txt", text), ("r/a.md", "# A\n" + text), ("r/b.txt", " \n")], "file_path string, source string")
    whole = {r.file_path: (r.text, r.was_truncated) for r in chunk_files(files, None).collect()}
    assert whole == {"r/a.txt": (text, False), "r/a.md": ("# A\n" + text, False)}
    assert chunk_files(files).where("was_truncated").count() == 2
    rows = pipelines.corpus_index_rows(files, HashEmbedder(4), Settings(max_chunk_bytes=None))
    assert {len(r.chunk_text) for r in rows.collect()} == {40_000, 40_004}


def test_batches(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(257)], "k string").repartition(7)
    got = {r["k"]: r["batch_id"] for r in stats.batch_ids(df, "k", batch_size=100).collect()}
    assert got == {f"k{i:03d}": i // 100 for i in range(257)}
    for call in (lambda: stats.batch_ids(df, "k", batch_size=0), lambda: stats.batch_count(F.lit(1), 0)):
        with pytest.raises(ValueError):
            call()


# Index


def contents(spark, path):
    return {r["external_id"]: r["chunk_text"] for r in index_table.read_index(spark, path).collect()}


def test_index_and_search(spark, settings, tmp_path):
    path = str(tmp_path / "index")
    assert pipelines.search_report(spark, path, "anything", settings) == "No results found.\n"
    assert pipelines.index_roots(spark, path, settings) == 1
    assert set(contents(spark, path)) == {
        "alpha/src/lib.rs:1-1",
        "alpha/src/lib.rs:3-3",
        "alpha/src/with space+plus%.rs:1-1",
        "alpha/docs/guide.md:1-2",
        "alpha/docs/guide.md:3-4",
        "beta/readme.md:1-2",
    }
    before = contents(spark, path)
    assert pipelines.index_roots(spark, path, settings) == 2
    assert contents(spark, path) == before
    hits = pipelines.search_text(spark, path, "vectors and centroids", settings).collect()
    assert hits[0]["external_id"] == "beta/readme.md:1-2" and hits[0]["language"] == "markdown"
    assert [h["rank"] for h in hits] == list(range(1, len(hits) + 1))
    report = pipelines.search_report(spark, path, "vectors and centroids", settings)
    assert report.startswith("Result 1 (score: 0.") and "\n  File: beta/readme.md:1-2\n  Item: Beta\n" in report


@pytest.mark.parametrize("bound", [None, 100, 1])
def test_upsert_keeps_stale_rows_unless_pruned(spark, tmp_path, monkeypatch, bound):
    if bound:  # measured sizes above the bound take the paths without that broadcast
        monkeypatch.setattr(index_table, "BROADCAST_BYTES", bound)
    path = str(tmp_path / "index")
    files = lambda *rows: spark.createDataFrame(rows, "file_path string, source string")
    settings = Settings(dimensions=8)
    pipelines.index_files(spark, files(("r/a.md", "# A\nx"), ("r/b.md", "b"), ("r/d.md", "d")), path, settings)
    second = files(("r/a.md", "# A\ny\nz"), ("r/b.md", "B"))
    pipelines.index_files(spark, second, path, settings)
    assert contents(spark, path) == {
        "r/a.md:1-2": "# A\nx", "r/a.md:1-3": "# A\ny\nz", "r/b.md:1-1": "B", "r/d.md:1-1": "d",
    }
    pipelines.index_files(spark, second, path, settings, prune=True)
    assert contents(spark, path) == {"r/a.md:1-3": "# A\ny\nz", "r/b.md:1-1": "B", "r/d.md:1-1": "d"}


def test_empty_run_leaves_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    none = spark.createDataFrame([("r/a.md", " \n")], "file_path string, source string")
    assert pipelines.index_files(spark, none, path) is None
    assert index_table.current_version(spark, path) is None


def test_failing_model_leaves_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    files = spark.createDataFrame([("r/a.md", "a")], "file_path string, source string")

    def broken(mode):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        pipelines.index_files(spark, files, path, embedder=ModelEmbedder(broken, 2))
    assert index_table.current_version(spark, path) is None


def test_unfinished_version_is_invisible(spark, tmp_path):
    path = tmp_path / "index"
    files = spark.createDataFrame([("r/a.md", "a")], "file_path string, source string")
    pipelines.index_files(spark, files, str(path), Settings(dimensions=4))
    (path / "step=2.ab.s" / "_temporary").mkdir(parents=True)
    assert index_table.current_version(spark, str(path)) == 1
    more = spark.createDataFrame([("r/b.md", "b")], "file_path string, source string")
    assert pipelines.index_files(spark, more, str(path), Settings(dimensions=4)) == 3
    assert contents(spark, str(path)) == {"r/a.md:1-1": "a", "r/b.md:1-1": "b"}


def test_upsert_writes_new_rows_only_until_compacted(spark, tmp_path):
    path = tmp_path / "index"
    files = lambda *rows: spark.createDataFrame(rows, "file_path string, source string")
    settings = Settings(dimensions=4)
    pipelines.index_files(spark, files(*[(f"r/{i}.md", str(i)) for i in range(50)]), str(path), settings)
    for text in ("x", "y"):
        pipelines.index_files(spark, files(("r/7.md", text)), str(path), settings)
    assert [spark.read.parquet(str(f)).count() for f in path.glob("step=3.*")] == [1]
    before = contents(spark, str(path))
    assert len(before) == 50 and before["r/7.md:1-1"] == "y"
    assert index_table.read_index(spark, str(path), 2).where("chunk_text = 'x'").count() == 1
    assert index_table.compact(spark, str(path)) == 4
    index_table.drop_versions(spark, str(path))
    assert [p.name.split(".")[0] for p in path.iterdir() if p.name != "_claims"] == ["step=4"] and contents(spark, str(path)) == before
    assert index_table.compact(spark, str(tmp_path / "none")) is None


def test_many_steps_are_one_relation(spark, tmp_path):
    """Relations, joins and jobs do not grow with the steps."""
    path, settings = str(tmp_path / "index"), Settings(dimensions=4)
    files = lambda *rows: spark.createDataFrame(rows, "file_path string, source string").coalesce(1)
    rows = pipelines.corpus_index_rows(files(("r/0.md", "0"), ("r/a.md", "a")), HashEmbedder(4), settings, True)
    index_table.upsert_index(spark, path, rows)
    for i in range(1, 50):
        folder = tmp_path / "index" / f"step={i + 1}.abc.s"
        rows.where("file_path = 'r/a.md'").withColumn("chunk_text", F.lit(str(i))).write.parquet(str(folder))
    group = str(tmp_path)
    spark.sparkContext.setJobGroup(group, "read")
    index = index_table.read_index(spark, path)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 8
    spark.sparkContext.setJobGroup("", "")
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join ") == 1
    assert {r["external_id"]: r["chunk_text"] for r in index.collect()} == {"r/0.md:1-1": "0", "r/a.md:1-1": "49"}
    found = index_table.read_index(spark, path, 20).collect()
    assert {r["chunk_text"] for r in found} == {"0", "19"}


def test_writers_share_no_step(spark, tmp_path, monkeypatch):
    """Neither where claims are exclusive nor where two writers hold the same number."""
    path, settings = tmp_path / "index", Settings(dimensions=4)
    numbers = [index_table._claimed(spark, str(path)) for _ in range(3)]
    assert numbers == [1, 2, 3]
    monkeypatch.setattr(index_table, "_claimed", lambda spark, path: 7)
    for name in "ab":
        files = spark.createDataFrame([(f"r/{name}.md", name)], "file_path string, source string")
        assert pipelines.index_files(spark, files, str(path), settings) == 7
    assert len(list(path.glob("step=7.*"))) == 2
    assert contents(spark, str(path)) == {"r/a.md:1-1": "a", "r/b.md:1-1": "b"}


def test_index_partitioned_by_centroids(spark, tmp_path):
    path, settings = str(tmp_path / "index"), Settings(dimensions=16, k=5)
    words = "river stone cloud tree lamp glass paper wheel".split()
    texts = [" ".join(words[(i * j) % 8] for j in range(1, 6)) for i in range(60)]
    files = lambda rows: spark.createDataFrame(rows, "file_path string, source string")
    first = [(f"r/{i}.md", t) for i, t in enumerate(texts)] + [("r/none.md", "...")]
    pipelines.index_files(spark, files(first), path, settings, centroids=4)
    # rows that move to another partition, and a new one
    pipelines.index_files(spark, files([(f"r/{i}.md", texts[(i + 1) % 60] + " lamp") for i in range(0, 60, 3)] + [("r/new.md", "glass wheel")]), path, settings)
    assert index_table.centroid_sets(spark, path) == [1] and len(contents(spark, path)) == 62
    for query in ("river glass", "wheel lamp lamp", "paper"):
        hits = lambda nprobe: [(r["rank"], r["external_id"], r["score"], r["chunk_text"]) for r in pipelines.search_text(spark, path, query, settings, nprobe=nprobe).collect()]
        assert hits(None) == hits(4)
        near = pipelines.near_rows(spark, path, embed_query(spark, query, HashEmbedder(16)), 1)
        assert 0 < near.count() < 62 and "PartitionFilters: [centroid" in near._jdf.queryExecution().executedPlan().toString().replace("isnotnull(centroid#", "centroid#")
        stored = {r["external_id"]: r["chunk_text"] for r in near.collect()}
        assert stored.items() <= contents(spark, path).items()
    before = contents(spark, path)
    assert index_table.compact(spark, path, centroids=3) == 3
    index_table.drop_versions(spark, path)
    assert index_table.centroid_sets(spark, path) == [3] and contents(spark, path) == before
    assert pipelines.search_text(spark, path, "paper", settings, nprobe=3).count() == 5


def test_any_number_of_globs(spark, tmp_path):
    table = spark.createDataFrame([(f"f{i}.md",) for i in range(6000)], "rel string")
    patterns = glob.patterns_of(spark.createDataFrame([(f"f{i}.*",) for i in range(5000)], "p string"), "p")
    assert glob.filter_paths(table, "rel", patterns).count() == 5000
    assert glob.filter_paths(table, "rel", (), patterns).count() == 1000


def test_roots_are_taken_literally(spark, tmp_path):
    for name in ("w[1]", "{a,b}", "s*"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.md").write_text("x")
        found = corpus.scan_corpus(spark, (SourceRoot(str(tmp_path / name)),)).collect()
        assert [(r.file_path, r.source) for r in found] == [(f"{name}/x.md", "x")]


def test_paths_that_occur_twice(spark, tmp_path):
    rows = [("r/a.rs", "const A: u8 = 1; const B: u8 = 2;\n"), ("r/a.rs", "const C: u8 = 3;\n"), ("r/b.md", "b")]
    files = spark.createDataFrame(rows, "file_path string, source string")
    assert not pipelines.paths_are_unique(files)
    path = str(tmp_path / "index")
    pipelines.index_files(spark, files, path, Settings(dimensions=4))
    found = contents(spark, path)
    assert set(found) == {"r/a.rs:1-1", "r/b.md:1-1"}
    assert index_table.read_index(spark, path).count() == 2


def test_unique_paths_need_no_shuffle(spark):
    files = spark.createDataFrame([("r/a.rs", "fn a() {}")], "file_path string, source string")
    rows = pipelines.corpus_index_rows(files, HashEmbedder(4), unique_paths=True)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_stream_of_files_is_indexed(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "index")
    schema = "file_path string, source string"
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    for rows in ([("r/a.md", "# A\nx")], [("r/a.md", "# A\ny"), ("r/b.md", "b")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
        query = keep_indexed(spark, stream(), path, str(tmp_path / "cp"), Settings(dimensions=4))
        assert query.awaitTermination(120)
    assert contents(spark, path) == {"r/a.md:1-2": "# A\ny", "r/b.md:1-1": "b"}


# Rendering


def test_render(spark):
    schema = (
        "rank int, score double, external_id string, file_path string, start_line long, "
        "end_line long, item_name string, chunk_text string"
    )
    rows = [
        (1, 0.92341, "x", "p.rs", 3, 5, "Foo::bar", "fn bar() {\n    x\n}\n"),
        (2, 0.5, "id:1-2", None, None, None, None, None),
    ]
    hits = spark.createDataFrame(rows, schema)
    assert render_report(hits) == (
        "Result 1 (score: 0.9234)\n  File: p.rs:3-5\n  Item: Foo::bar\n  ---\n"
        "  fn bar() {\n      x\n  }\n  ---\n\n"
        "Result 2 (score: 0.5000)\n  File: id:1-2:0-0\n  ---\n  ---\n\n"
    )
    bare = render_hits(hits.select("rank", "score", "external_id")).orderBy("rank").collect()
    assert bare[0]["rendered"] == "Result 1 (score: 0.9234)\n  File: x:0-0\n  ---\n  ---\n"
    assert render_report(hits.where("false")) == "No results found.\n"


def test_word_vectors_of_sliced_batches():
    import pyarrow as pa

    from corpusloom.operators.embed import _hash_vectors, _slices

    texts = ["", None, " a  b", "über-straße 9", "x" * 50, "...", "a,b;c\n", "naïve"] * 3
    whole = pa.array(texts)
    expected = [hashed(t or "", 8) for t in texts]
    for part, at in ((whole, 0), (whole.slice(3, 7), 3), (whole.slice(5, 0), 5), (pa.array(texts, pa.large_string()), 0)):
        got = _hash_vectors(part, 8)
        assert got.shape == (len(part), 8)
        assert np.allclose(got, np.array(expected[at : at + len(part)]).reshape(-1, 8), atol=1e-6)
    assert sum(len(p) for p in _slices(whole)) == len(texts)
    assert not _hash_vectors(pa.array(["", "...", None]), 8).any()


def test_files_made_of_a_small_table_are_dealt_to_tasks(spark, tmp_path):
    spark.range(5_000).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = QUERIES["decl_kinds"](spark, str(tmp_path))
    tasks = made.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("file_path").alias("files")).collect()
    assert len(tasks) == 3 and sum(t.files for t in tasks) == 5_000 and max(t.files for t in tasks) < 1_700
    assert spread(spark.range(0)).count() == 0
