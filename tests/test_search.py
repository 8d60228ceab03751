from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.vectors import TopK, cosine, unit
from corpusloom.operators import ivf
from corpusloom.operators.search import SPREAD, grid_top_k, merge_top_k, search, search_batch
from corpusloom.sources import walk


def vectors(n: int, dims: int, seed: int) -> np.ndarray:
    """Random directions; a third of the rows are copies of one vector."""
    rows = np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)
    rows[::3] = rows[0]
    return rows


def as_table(spark, rows, name="external_id", start=0):
    data = [(f"v{i + start:04d}", [float(x) for x in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, f"{name} string, embedding array<float>").repartition(5)


def brute_force(index, queries, k):
    index, queries = index.astype(np.float64), queries.astype(np.float64)
    live = np.flatnonzero(np.linalg.norm(index, axis=1) > 0)
    expected = {}
    for qi, q in enumerate(queries):
        if not np.linalg.norm(q):
            continue
        scores = {i: float((index[i] * q).sum() / np.linalg.norm(index[i]) / np.linalg.norm(q)) for i in live}
        best = sorted(scores, key=lambda i: (-round(scores[i], 12), f"v{i:04d}"))[:k]
        expected[f"q{qi:04d}"] = [f"v{i:04d}" for i in best]
    return expected


def hits_of(df, query_col="query_id"):
    found: dict[str, dict[int, str]] = {}
    for r in df.collect():
        found.setdefault(r[query_col], {})[r["rank"]] = r["external_id"]
    return {q: [ids[i] for i in sorted(ids)] for q, ids in found.items()}


@pytest.fixture(scope="module")
def data(spark):
    index = vectors(301, 12, 1)
    index[7] = 0
    queries = np.vstack([vectors(20, 12, 2), index[:3], np.zeros((1, 12), np.float32)])
    table = as_table(spark, index).cache()
    asked = spark.createDataFrame(
        [(f"q{i:04d}", [float(x) for x in q]) for i, q in enumerate(queries)],
        "query_id string, embedding array<float>",
    ).cache()
    return index, queries, table, asked


@pytest.mark.parametrize("k", [1, 10, 150, 400])
def test_batch_equals_brute_force(data, k):
    index, queries, table, asked = data
    assert hits_of(search_batch(table, asked, k)) == brute_force(index, queries, k)


@pytest.mark.parametrize("in_place", [False, True])
@pytest.mark.parametrize("k", [3, 150])
def test_grid_and_blocks_equal_brute_force(data, k, in_place):
    index, queries, table, asked = data
    got = search_batch(
        table, asked, k, broadcast_bytes=12 * 8 * 5, cell_bytes=12 * 8 * 7, index_bytes=12 * 8 * 11, in_place=in_place
    )
    assert hits_of(got) == brute_force(index, queries, k)


def test_index_rows_stay_where_they_are(spark, tmp_path):
    """Five blocks of queries: index rows are read once and meet no shuffle, only lists do."""
    as_table(spark, vectors(60, 4, 5)).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    asked = as_table(spark, vectors(50, 4, 6), "query_id").coalesce(1)
    hits = search_batch(index, asked, 3, broadcast_bytes=1, cell_bytes=4 * 8 * 10)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    below = below[: below.index("FileScan")]
    assert plan.count("MapInArrow") == 1 and "Exchange" not in below
    assert plan.index("WindowGroupLimit") < plan.index("MapInArrow")
    read = hits.inputFiles()
    assert len([f for f in read if "queries-" in f]) == 5
    assert hits.count() == 150


def test_folder_only_spark_can_open(data, monkeypatch):
    """Without blocks that tasks can read, both sides are dealt into cells: equal hits."""
    index, queries, table, asked = data
    monkeypatch.setattr(walk, "reachable", lambda uri: False)
    hits = search_batch(table, asked, 5, broadcast_bytes=1, cell_bytes=12 * 8 * 40)
    assert "CoGroup" in hits._jdf.queryExecution().executedPlan().toString()
    assert hits_of(hits) == brute_force(index, queries, 5)


def test_single_equals_batch(data):
    index, queries, table, asked = data
    got = search(table, [float(x) for x in queries[3]], 120)
    rows = got.collect()
    assert [r["external_id"] for r in rows] == brute_force(index, queries, 120)["q0003"]
    assert [r["rank"] for r in rows] == list(range(1, 121))
    scores = [r["score"] for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_single_reads_only_what_it_needs(spark, tmp_path):
    table = as_table(spark, vectors(9, 4, 5)).withColumn("chunk_text", F.lit("long"))
    table.write.parquet(str(tmp_path / "i"))
    plan = search(spark.read.parquet(str(tmp_path / "i")), [1.0, 0, 0, 0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "chunk_text" not in plan


def test_zero_query_finds_nothing(data):
    assert search(data[2], [0.0] * 12, 5).count() == 0


def test_no_queries(spark, data):
    assert search_batch(data[2], data[3].where("false"), 5).count() == 0


@pytest.mark.parametrize("run", ["single", "batch", "grid", "blocks"])
def test_length_mismatch_fails(spark, data, run):
    table = data[2].unionByName(spark.createDataFrame([("bad", [1.0, 2.0])], "external_id string, embedding array<float>"))
    with pytest.raises(Exception, match="vector lengths differ"):
        if run == "single":
            search(table, [1.0] * 12, 3).collect()
        elif run == "batch":
            search_batch(table, data[3], 3).collect()
        else:
            search_batch(table, data[3], 3, broadcast_bytes=1, cell_bytes=12 * 8 * 40, in_place=run == "blocks").collect()


def test_bad_k(data):
    with pytest.raises(ValueError):
        search(data[2], [1.0] * 12, 0)
    with pytest.raises(ValueError):
        search_batch(data[2], data[3], 0)


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    values = [r["u"] for r in df.select(unit(F.col("v")).alias("u")).collect()]
    assert values[0] == pytest.approx([0.6, 0.8]) and values[1] is None


def test_cosine_of_columns(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([1.0], [-2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>").coalesce(1)
    values = [r["c"] for r in df.select(cosine("a", "b").alias("c")).collect()]
    assert values[:2] == pytest.approx([0.96, -1.0]) and values[2:] == [None, None]
    uneven = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="vector lengths differ"):
        uneven.select(cosine("a", "b")).collect()


@pytest.fixture(scope="module")
def assigned(spark, data):
    centroids = ivf.ivf_train(data[2], 6, seed=3, max_iter=4).cache()
    return centroids, ivf.ivf_assign(data[2], centroids).cache()


def test_assignment_is_the_nearest_centroid_either_way(data, assigned):
    centroids, placed = assigned
    grid = ivf.ivf_assign(data[2], centroids, broadcast_bytes=1, cell_bytes=12 * 8 * 40)
    as_dict = lambda df: {r["external_id"]: r["centroid"] for r in df.collect()}
    small, large = as_dict(placed), as_dict(grid)
    assert small == large and small["v0007"] is None
    c = np.array([r["embedding"] for r in centroids.orderBy("centroid").collect()])
    scores = data[0].astype(float) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    assert all(small[f"v{i:04d}"] == int(scores[i].argmax()) for i in range(301) if i != 7)


def test_full_probe_is_exact(data, assigned):
    index, queries, _, asked = data
    centroids, placed = assigned
    expected = brute_force(index, queries, 10)
    assert hits_of(ivf.ivf_search_batch(placed, centroids, asked, 10, nprobe=6)) == expected
    one = ivf.ivf_search(placed, centroids, [float(x) for x in queries[3]], 10, nprobe=6)
    assert [r["external_id"] for r in one.collect()] == expected["q0003"]


@pytest.mark.parametrize("nprobe", [1, 2])
def test_partial_probe_agrees_on_all_paths(data, assigned, nprobe):
    _, queries, _, asked = data
    centroids, placed = assigned
    small = hits_of(ivf.ivf_search_batch(placed, centroids, asked, 10, nprobe=nprobe))
    grid = hits_of(
        ivf.ivf_search_batch(placed, centroids, asked, 10, nprobe=nprobe, broadcast_bytes=1, cell_bytes=12 * 8 * 40)
    )
    assert small == grid
    one = ivf.ivf_search(placed, centroids, [float(x) for x in queries[4]], 10, nprobe=nprobe)
    assert [r["external_id"] for r in one.collect()] == small["q0004"]


def test_probes_prune_partitions_and_hot_centroid_gets_several_files(spark, data, assigned, tmp_path):
    centroids, placed = assigned
    path = str(tmp_path / "ivf")
    ivf.write_by_centroid(placed, path, rows_per_file=20)
    stored = spark.read.parquet(path)
    assert stored.count() == 301 and stored.where("centroid is null").count() == 1
    hits = ivf.ivf_search(stored, centroids, [float(x) for x in data[1][3]], 10, nprobe=1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "centroid" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = stored.groupBy("centroid").agg(F.countDistinct("_metadata.file_name").alias("f"), F.count("*").alias("n"))
    assert all(r["f"] > 1 for r in files.collect() if r["n"] > 80)


TINY = {"broadcast_bytes": 8, "cell_bytes": 8 * 2 * 3}  # cells of three vectors


@pytest.mark.parametrize("bounds", [{}, TINY, {**TINY, "in_place": False}])
def test_odd_rows_are_treated_alike_on_every_path(spark, bounds):
    nan, inf = float("nan"), float("inf")
    index = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), (None, [1.0, 0.0]), ("b", [nan, 1.0]), ("c", [inf, 0.0])]
    index += [("d", [0.0, 0.0]), ("e", None), ("f", [None, 1.0]), ("g", [-1.0, 0.0])]
    asked = [("q", [1.0, 0.0]), ("q", [-1.0, 0.0]), (None, [1.0, 0.0]), ("n", [nan, 0.0]), ("z", [0.0, 0.0]), ("y", None)]
    table = spark.createDataFrame(index, "external_id string, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    right = [(1, 1.0, "a"), (2, 1.0, None), (3, 0.0, "a"), (4, -1.0, "g")]
    left = [(1, 1.0, "g"), (2, 0.0, "a"), (3, -1.0, "a"), (4, -1.0, None)]
    found = sorted(
        ((r.query_id or "", r["rank"], r.score, r.external_id or "") for r in search_batch(table, queries, 9, **bounds).collect())
    )
    expected = [("q", *h) for h in right + left] + [("", *h) for h in right]
    assert found == sorted((q, n, s, i or "") for q, n, s, i in expected)
    single = search(table, [1.0, 0.0], 9).collect()
    assert [(r["rank"], r.score, r.external_id) for r in single] == right


@pytest.mark.parametrize("bounds", [{}, TINY])
def test_close_centroids_and_repeated_ids(spark, bounds):
    near = [(0, [1.0, 0.1]), (1, [1.0, 0.1 + 1e-10]), (2, [-1.0, 0.0]), (3, [-1.0, 0.0])]
    centroids = spark.createDataFrame(near, "centroid int, embedding array<double>")
    rows = [("a", [1.0, 0.5]), ("a", [-2.0, 0.0]), (None, [1.0, 0.05]), ("z", [0.0, 0.0])]
    table = spark.createDataFrame(rows, "external_id string, embedding array<double>")
    assigned = ivf.ivf_assign(table, centroids, **bounds)
    assert sorted((r.external_id or "", r.centroid) for r in assigned.where("centroid is not null").collect()) == [
        ("", 0), ("a", 1), ("a", 2),
    ]
    assert assigned.count() == 4
    queries = spark.createDataFrame([("q", [1.0, 0.5]), ("q", [-1.0, 0.0])], "query_id string, embedding array<double>")
    hits = ivf.ivf_search_batch(assigned, centroids, queries, 5, nprobe=1, **bounds).collect()
    assert sorted((r["rank"], r.external_id, round(r.score, 6)) for r in hits) == [(1, "a", 1.0), (1, "a", 1.0)]
    one = ivf.ivf_search(assigned, centroids, [1.0, 0.5], 5, nprobe=1).collect()
    assert [(r.external_id, round(r.score, 6)) for r in one] == [("a", 1.0)]


def test_probes_prune_the_stored_index(spark, tmp_path):
    table = as_table(spark, vectors(60, 4, 3))
    centroids = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(vectors(6, 4, 4)[1:])], "centroid int, embedding array<double>")
    ivf.write_by_centroid(ivf.ivf_assign(table, centroids), str(tmp_path / "index"))
    hits = ivf.ivf_search(spark.read.parquet(str(tmp_path / "index")), centroids, [1.0, 0.0, 0.0, 0.0], 5, nprobe=2)
    assert "PartitionFilters: [centroid" in hits._jdf.queryExecution().executedPlan().toString()


def test_grid_deals_a_row_to_few_groups_however_small_its_cells(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((2_000, 4)).astype(np.float32)
    index = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(vectors)], "cell int, id long, vec array<float>")
    asked = index.select("cell", F.col("id").alias("query"), F.col("id").alias("query_id"), "vec")
    schema = "query long, query_id long, score double, id long"
    found = grid_top_k(index, asked, 3, 4, schema, cell_bytes=16 * 8 * 4)  # 125 cells of 16 a side
    # Every query has three hits of every piece of the index that it met.
    assert found.count() <= SPREAD * 3 * 2_000
    # Pieces that may not grow stay as small as they are asked to be.
    bounded = grid_top_k(index, asked, 3, 4, schema, cell_bytes=16 * 8 * 4, piece_bytes=100 * 8 * 4)
    assert 19 * 3 * 2_000 <= bounded.count() <= 20 * 3 * 2_000
    best = lambda t: sorted(map(tuple, merge_top_k(t, 3, "id", "query_id").collect()))
    assert best(found) == best(bounded)


def test_kernel_memory_does_not_grow_with_queries():
    rng = np.random.default_rng(8)
    queries = rng.standard_normal((60_000, 32)).astype(np.float32)
    rows = rng.standard_normal((300, 32)).astype(np.float32)
    tracemalloc.start()
    top = TopK(queries, 2)
    top.add(pa.array(range(300)), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert top.best.num_rows == 120_000
    assert peak < 24 << 20, peak


def test_kernel_holds_few_pairs_of_equal_vectors():
    rows = np.ones((5_000, 8), np.float32)
    tracemalloc.start()
    top = TopK(np.ones((600, 8), np.float32), 3)
    top.add(pa.array(range(5_000, 0, -1)), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert top.best["id"].to_pylist() == [1, 2, 3] * 600
    assert peak < 40 << 20, peak
