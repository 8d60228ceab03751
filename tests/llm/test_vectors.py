"""Hard negatives, centroid clustering and exact search against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute
from corpusloom.llm import hard_negatives, hilbert_zones, norm_buckets
from corpusloom.llm import integer_vectors as iv

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score long, x int, d string, length int"


def vectors(seed: int, n: int, d: int, spread: float) -> list[tuple]:
    """Rows of very different lengths, with copies, scaled copies, repeated ids and odd rows."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.exp(rng.normal(size=(n, 1)) * spread)
    rows = [(i, v.tolist(), int(rng.integers(10))) for i, v in enumerate(base)]
    rows += [(n + i, rows[3][1], 1) for i in range(n // 3)]  # a vector with very many copies
    rows += [(2 * n + i, (2.0 * base[i]).tolist(), 4) for i in range(5)] + [rows[0], rows[0], (0, rows[5][1], 2)]
    rows += [(None, rows[4][1], 3), (None, rows[4][1], 3), (5 * n, [0.0] * d, 6), (5 * n + 1, [-0.001] * d, 6)]
    odd = [None, [math.nan] * d, [None] + [1.0] * (d - 1), [math.inf] + [0.0] * (d - 1), [1.0] * (d - 1), [], [2.0] * (d - 1)]
    return rows + [(100 * (n + i), v, 7) for i, v in enumerate(odd)] + [(700 * n, rows[7][1], None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash", 3) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(params=[0.0, 1.0, 12.0], ids=["alike", "varied", "huge"])
def rows(request):
    return vectors(7, 240, 8, request.param)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(iv, "BLOCK_BYTES", 1 << 10)
    monkeypatch.setattr(iv, "PIECE_BYTES", 1 << 9)
    monkeypatch.setattr(norm_buckets, "SEED_ROWS", 20)
    monkeypatch.setattr(norm_buckets, "QUERY_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 2)


def test_products_of_any_size():
    rng = np.random.default_rng(1)
    for high in (9, 40, 62):
        a = np.where(rng.random((20, 5)) < 0.5, rng.integers(-(2**high), 2**high, (20, 5)), rng.integers(-9, 9, (20, 5)))
        exact = [[max(iv.LEAST, min(iv.MOST, sum(int(p) * int(q) for p, q in zip(u, v)))) for v in a] for u in a]
        assert iv.products(a, a).tolist() == exact


def test_best_keeps_the_first_of_ties():
    rng = np.random.default_rng(2)
    best, seen = iv.Best(3, 4), []
    for _ in range(30):
        n = int(rng.integers(0, 9))
        offer = [rng.integers(0, 3, n), rng.integers(-2, 2, n), rng.integers(0, 5, n), rng.integers(0, 1 << 40, n)]
        best.offer(*offer)
        seen += list(zip(*(c.tolist() for c in offer)))
    want = [sorted((-s, i, r) for q_, s, i, r in seen if q_ == q)[:4] for q in range(3)]
    assert [list(zip((-best.score[q]).tolist(), best.id[q].tolist(), best.row[q].tolist())) for q in range(3)] == want


# 11: hard negatives


def test_keys_sort_by_anchor_score_kind_and_id():
    rng = np.random.default_rng(3)
    ends = [iv.LEAST, iv.MOST, -1, 0, 1]
    items = [(int(a), int(s), int(k), int(i)) for a in range(2) for s in ends for k in (0, 1) for i in ends]
    keys = {}
    for a, s, k, i in items:
        keys[a, s, k, i] = hard_negatives.packed(np.array([a]), np.array([s]), k, np.array([i]))[0].as_py()
        assert hard_negatives.unpacked(keys[a, s, k, i])[1:] == (s, k, i)
    rng.shuffle(items)
    assert sorted(map(tuple, items), key=lambda t: keys[tuple(t)]) == sorted(map(tuple, items), key=lambda t: (t[0], -t[1], t[2], t[3]))


def test_hard_negatives(spark, rows, small):
    anchor, label = F.col("vec_id") % 20 == 0, F.col("label").cast("long")
    found = hard_negatives.mine(frame(spark, rows), anchor, label, positives=3, negatives=4).collect()
    assert Counter(map(tuple, found)) == brute.hard_negatives(rows, lambda i: i % 20 == 0, 3, 4)
    assert found


def test_no_anchors_no_negatives(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("vec_id") % 2 == 0, F.col("label")).count() == 0
    one_label = spark.createDataFrame([(i, [1.0, 2.0], 3) for i in range(9)], empty.schema)
    assert hard_negatives.mine(one_label, F.col("vec_id") % 2 == 0, F.col("label")).count() == 0
    no_label = spark.createDataFrame([(i, [1.0, 2.0], i) for i in range(9)], empty.schema)
    assert hard_negatives.mine(no_label, F.col("vec_id") % 2 == 0, F.col("label")).count() == 0


# 12: clustering


@pytest.mark.parametrize("n, bits", [(1, 3), (2, 1), (2, 4), (3, 3), (5, 2)])
def test_the_curve_is_hilberts(n, bits):
    """It meets every cell of the grid once, and goes from one to a neighbour."""
    cells = np.indices((1 << bits,) * n).reshape(n, -1).T
    keys = [k.tobytes() for k in hilbert_zones.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[np.argsort(np.array(keys, object), kind="stable")]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_the_nearest_centroid():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, c = rng.integers(-50, 50, (20, 3)) // int(rng.integers(1, 20)), rng.integers(-60, 60, (9, 3))
        cluster, distance = hilbert_zones.assigned(x, x.min(axis=0), x.max(axis=0), c)
        all_ = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (cluster == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()


def test_boxes_rule_centroids_out():
    x = np.arange(20)[:, None] + np.zeros(2, np.int64)
    assert hilbert_zones.candidates(x.min(axis=0), x.max(axis=0), np.array([[0, 0], [900, 0], [19, 19]])).tolist() == [0, 2]


def test_clusters(spark, rows, monkeypatch):
    monkeypatch.setattr(hilbert_zones, "BLOCK_ROWS", 16)
    found = hilbert_zones.cluster(frame(spark, rows), clusters=6, dims=8).collect()
    assert Counter(map(tuple, found)) == brute.clusters(rows, 6, 3, 8, 1, 64)


def test_clusters_of_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert hilbert_zones.cluster(spark.createDataFrame([], kind), dims=2).count() == 0
    rows = [(3, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [5.0, 5.0]), (4, [1.0])]
    found = hilbert_zones.cluster(spark.createDataFrame(rows, kind), dims=2).collect()
    assert Counter(map(tuple, found)) == brute.clusters([(*r, 0) for r in rows], 16, 3, 2, 1, 64)
    first = hashlib.sha256(b"64,128").hexdigest()
    assert {(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in found if r.vec_id == 3} == {(3, 0, 0, first)}


# 13: exact search


@pytest.mark.parametrize("coordinates_from", [0.7, 0.0, 2.0], ids=["either", "coordinates", "lengths"])
def test_exact_search(spark, rows, small, monkeypatch, coordinates_from):
    monkeypatch.setattr(norm_buckets, "COORDINATES_FROM", coordinates_from)
    found = norm_buckets.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, k=4).collect()
    assert Counter(map(tuple, found)) == brute.top_products(rows, lambda i: i % 20 == 0, 4, 256)


def test_pruning_skips_what_cannot_enter():
    """Every way of pruning finds the same, and both leave vectors out."""
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (400, 16)) * rng.integers(1, 9, (400, 1))
    bucket = norm_buckets.Bucket(x, np.arange(400), np.arange(400))
    unit = x[0] / np.linalg.norm(x[0])
    cosines = bucket.x @ unit / bucket.length
    for cosine in (0.5, 0.8, 0.95):
        kept = bucket.feasible(unit, cosine)
        assert set(np.flatnonzero(cosines >= cosine)) <= set(kept.tolist())
    assert len(kept) < 100
    n = bucket.long_enough(float(bucket.length[150]))
    assert 150 < n < 160 and (bucket.length[:n] >= bucket.length[150]).all()


def test_short_vectors_are_not_read(spark):
    table = frame(spark, vectors(9, 60, 8, 1.0)).selectExpr("16L as least", "double(2) as length").limit(1).toArrow()
    assert norm_buckets.shortest(table) == pytest.approx(8, rel=1e-5)


def test_exact_search_of_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert norm_buckets.top_k(spark.createDataFrame([], kind), F.col("vec_id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(2, [1.0]), (3, [1.0, 2.0])], kind)
    assert norm_buckets.top_k(one, F.col("vec_id") % 2 == 0).count() == 0
