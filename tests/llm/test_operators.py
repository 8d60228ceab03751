"""The operators against brute force, and on odd rows: nulls, empty, ties, repeats, clashes."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute
from corpusloom.llm import (
    best_fit,
    common,
    cotraining,
    interpolated_lm,
    language_bitmask,
    lsh_forest,
    mixing,
    order_minhash,
    rp_forest,
    token_orc,
    tokens,
    warc_chunks,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = "the of and der die und le la et el los que tion ment heit ando".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(STEMS, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    near = prose(1, 200).split()
    out = [(i, prose(i, 20 + i), "en", f"src{i % 4}", i) for i in range(2, 40)]
    out += [(40 + i, " ".join([*near[: 20 * i], f"w{i}", *near[20 * i + 1 :]]), "en", "src0", 1) for i in range(8)]
    out += [(60 + i, "one two three four", "fr", "src1", 18) for i in range(5)]
    out += [(70, None, None, None, None), (71, "", "de", None, 0), (72, " \n\t ", "de", "", 4)]
    out += [(None, prose(3, 23), "en", "src3", 1), (None, None, "en", "src3", 1), (None, near[0] * 3, None, "s", 1)]
    out += [(5, prose(5, 25), "en", "src1", 5)] * 3 + [(6, prose(7, 27), "de", "src9", 5)]
    out += [(80, "é ü ß " * 50, "de", "src2", 9), (81, "x" * 70_000, "en", "src2", 9), (82, "a  b  c  d <|endoftext|> it's", "en", "x", 2)]
    out += [(83, prose(99, 30_000), "en", "src5", 9), (84, "12 34 ?! $$$", "en", "src5", 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_file(None))
    return [[*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Helpers


def test_word_hashes_follow_words_across_blocks(rows, monkeypatch):
    import pyarrow as pa

    data, offsets = common.text_bytes(pa.array([r[1] for r in rows]).slice(2))
    whole, at = common.word_hashes(data, offsets, common.Hasher())
    expected = [brute.words(r[1]) for r in rows[2:]]
    assert np.diff(at).tolist() == [len(w) for w in expected]
    names = {}
    assert all(names.setdefault(w, h) == h for w, h in zip([w for x in expected for w in x], whole.tolist()))
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    small, at_small = common.word_hashes(data, offsets, common.Hasher())
    assert (small == whole).all() and (at == at_small).all()


def test_worker_state_is_shared_and_given_up(monkeypatch):
    monkeypatch.setattr(common, "IDLE_SECONDS", 0.2)
    first = common.worker_state("thing", lambda: [1])
    assert common.worker_state("thing", lambda: [2]) is first
    time.sleep(0.6)
    assert common.worker_state("thing", lambda: [3]) == [3]


@pytest.mark.parametrize("shape", ["path", "star", "two"])
def test_components(spark, shape):
    pairs = {"path": [(i, i + 1) for i in range(20)], "star": [(9, i) for i in range(20)], "two": [(1, 5), (7, 5), (3, 4), (4, 4)]}[shape]
    found = {(r.node, r.root) for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    if shape == "two":
        assert found == {(1, 1), (5, 1), (7, 1), (3, 3), (4, 3)}
    else:
        assert found == {(i, 0) for i in range(21 if shape == "path" else 20)}


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 and 8: tokens


def test_token_files(spark, docs, rows, tmp_path):
    token_orc.write_token_ids(docs, str(tmp_path / "ids"))
    found = token_orc.token_digests(spark, str(tmp_path / "ids"))
    ids = encoded(rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found.collect()) == Counter(
        (r[0], len(x), crc(x)) for r, x in zip(rows, ids)
    )
    ordered = found.orderBy("start").collect()
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1]]
    keys = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert keys == sorted(keys)
    stored = token_orc.read_token_ids(spark, str(tmp_path / "ids"))
    assert {tuple(r.ids) for r in stored.where("doc_id = 6").collect()} == {tuple(x) for r, x in zip(rows, ids) if r[0] == 6}
    one = stored.where("doc_id = 6")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)]" in one


def test_token_files_of_no_rows(spark, none, tmp_path):
    token_orc.write_token_ids(none, str(tmp_path / "ids"))
    assert token_orc.token_digests(spark, str(tmp_path / "ids")).count() == 0


def test_segments_encode_like_whole_texts(rows):
    import pyarrow as pa

    data, offsets = common.text_bytes(pa.array([r[1] for r in rows] * 2))
    found = [x.tolist() for _, x in tokens.Encoder().documents(data, offsets)]
    assert found == encoded(rows) * 2


def test_packing(docs, rows):
    pieces = best_fit.token_pieces(docs.withColumn("offset", F.lit("clash")), capacity=64, keep_ids=True)
    packed = best_fit.pack(pieces, capacity=64, group_pieces=300).collect()
    by_doc, by_bin = {}, {}
    for r in packed:
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == crc(r.ids)
        by_doc.setdefault((r.doc_id, r.piece, tuple(r.ids), r.start), []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for held in by_bin.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [0, *np.cumsum([r.length for r in held])[:-1]]
        assert sum(r.length for r in held) <= 64
    expected = Counter()
    for r, ids in zip(rows, encoded(rows)):
        first = len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        expected.update((r[0], k, tuple(ids[a:b]), a) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter({k: len(v) for k, v in by_doc.items()}) == expected
    total = sum(r.length for r in packed)
    assert len(by_bin) <= math.ceil(total / 64) * 1.01 + 2


def test_packed_sequences_hold_the_ids(docs):
    packed = best_fit.pack(best_fit.token_pieces(docs.where("doc_id < 20"), 64, keep_ids=True), 64)
    whole = best_fit.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == packed.agg(F.sum("length")).first()[0]
    assert all(len(r.ids) <= 64 and r.offsets[0] == 0 for r in whole)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_binds(rule):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 500)
    bins, offsets = best_fit.fit(lengths, 100, 3, 4000.0 + 99**2, rule)
    for b in set(bins.tolist()):
        held = lengths[bins == b]
        assert held.sum() <= 100 and len(held) <= 3 and (held.astype(float) ** 2).sum() <= 4000 + 99**2
        assert sorted(offsets[bins == b]) == sorted(np.cumsum(held[np.argsort(offsets[bins == b])]) - held[np.argsort(offsets[bins == b])])


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("full", [(64, 64, 4096), (64, 4, 2048), (64, 8, 2048)])
def test_bins_equal_brute_force(rule, full):
    """Powers of two as capacities and weights: sums are exact in any order, so ties are ties."""
    rng, weights = np.random.default_rng(full[1]), (1.0, 0.25, 0.5)
    for most in (45, 12, 3):
        lengths = rng.integers(1, most + 1, 400)
        bins, offsets = best_fit.fit(lengths, full[0], full[1], float(full[2]), rule, weights)
        assert list(zip(bins.tolist(), offsets.tolist())) == brute.best_fit(lengths.tolist(), full, weights, rule)


def test_packing_no_rows(none):
    assert best_fit.pack(best_fit.token_pieces(none)).count() == 0


# 2: fingerprints


def test_order_minhash(spark, docs, rows):
    found = order_minhash.edited_neighbours(docs.withColumn("signature", F.lit(1))).collect()
    assert len(found) == len(rows)
    same = {}
    by_text = {}
    for r in rows:
        by_text.setdefault((r[0], len(r[1] or "")), set()).add(r[1] or "")
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        texts = by_text[(r.doc_id, r.n_chars)]
        if len(texts) == 1:
            assert same.setdefault(next(iter(texts)), r.fingerprint) == r.fingerprint
    ids = sorted(r[0] for r in rows if r[0] is not None)
    text = {r[0]: r[1] or "" for r in rows}
    for r in found:
        if r.doc_id is not None and ids.count(r.doc_id) == 1 and r.doc_id != ids[-1]:
            after = ids[ids.index(r.doc_id) + 1]
            if ids.count(after) == 1:
                own, n = text[r.doc_id], len(text[r.doc_id])
                edited = own[: n - n // 4] + text[after][: n // 4]
                assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_order_minhash_equals_brute_force(docs, rows):
    found = Counter(tuple(r) for r in order_minhash.edited_neighbours(docs).collect())
    assert found == brute.edited_neighbours([r[:2] for r in rows], order_minhash.K, order_minhash.SKETCHES, order_minhash.PICKED)


@pytest.mark.parametrize("k, sketches, picked", [(1, 5, 3), (3, 64, 2), (4, 33, 1)])
def test_signatures_equal_brute_force(spark, k, sketches, picked):
    texts = ["", None, " \n", "a", "a b", "a b c", "x y " * 40, "ü" * 50, "😀" * 40 + " z", prose(3, 300), "a b c d e f " * 9]
    signed = order_minhash.with_signature(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "s", k, sketches, picked)
    for r in signed.collect():
        assert r.s == brute.order_sketches(r.t, k, sketches, picked)


def test_likeness_follows_edits_and_order(spark):
    text = prose(1, 400).split()
    moved = text[200:] + text[:200]
    shuffled = random.Random(0).sample(text, 400)
    few = [*text[:100], "new", *text[101:]]
    frame = spark.createDataFrame([(0, " ".join(text)), (1, " ".join(few)), (2, " ".join(moved)), (3, " ".join(shuffled))], "i int, t string")
    signed = {r.i: r.s for r in order_minhash.with_signature(frame, "t", "s", sketches=256).collect()}
    near = [sum(a == b for a, b in zip(signed[0], signed[i])) / 256 for i in range(4)]
    assert near[0] == 1 and near[1] > 0.9 and 0.35 < near[2] < 0.75 and near[3] < 0.05


def test_occurrences_are_numbered(spark):
    frame = spark.createDataFrame([("a b c " * 3,), ("a b c " * 30,), ("a b c " * 3,)], "t string")
    a, b, c = (r.s for r in order_minhash.with_signature(frame, "t", "s").collect())
    assert a == c and sum(x == y for x, y in zip(a, b)) < 32


def test_order_minhash_no_rows_and_one(spark, none):
    assert order_minhash.edited_neighbours(none).count() == 0
    one = order_minhash.edited_neighbours(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1


# 3: mixing


def test_mixing(docs, rows):
    found = mixing.mix(docs.withColumns({"size": F.lit("x"), "copies": F.lit(1)})).collect()
    assert len(found) == len(rows) and {r.size for r in found} == {len(brute.words(r[1])) for r in rows}
    sums = {}
    for r in found:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        sums.setdefault(r.source, [r.source_size, r.target, 0, 0])[2] += r.taken
        sums[r.source][3] = max(sums[r.source][3], r.size)
    names = sorted((s for s in sums if s is not None), key=str.encode) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(v[0] for v in sums.values())
    assert math.isclose(sum(v[1] for v in sums.values()), total)
    level = max(v[1] / weight[s] for s, v in sums.items() if v[1] < 2 * v[0])
    for s, (size, target, taken, largest) in sums.items():
        assert math.isclose(target, min(2 * size, weight[s] * level)) and abs(taken - target) <= 2 * largest + 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in found)
    emitted = mixing.emitted(mixing.mix(docs))
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in found)


def test_mixing_no_rows_and_no_words(spark, none):
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


# 4: near duplicates


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(docs, rows, block, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    found = lsh_forest.near_duplicates(docs.withColumns({"node": F.lit("clash"), "root": F.lit(0)})).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == brute.near_duplicates([r[:2] for r in rows])


def test_prefixes_shorten_until_recall_is_reached():
    depth = lsh_forest.prefix_length(0.8, 32, 12, 0.9999)
    assert 1 - (1 - 0.8**depth) ** 32 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 32


def test_tile_counts_only_pairs_between_blocks():
    sets = [np.arange(10, dtype=np.uint64)] * 3
    inner, _ = lsh_forest.tile_links(sets, np.array([1, 2, 3]), np.array([0, 0, 1]), False, Fraction(4, 5))
    cross, _ = lsh_forest.tile_links(sets, np.array([1, 2, 3]), np.array([0, 0, 1]), True, Fraction(4, 5))
    assert inner.tolist() == [5, 4, 3] and cross.tolist() == [3, 3, 3]


def test_near_duplicates_no_rows(none):
    assert lsh_forest.near_duplicates(none).count() == 0


# 5: archives


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    pages = [(i, f"http://h/{i}\r\nX: y", f"<p>{i % 7}</p>" * (1 + i % 3)) for i in range(60)]
    pages += [(100, None, None), (101, "u", ""), (None, "n", "<p>0</p>"), (None, "n", "only"), (None, "m", "only")]
    pages += [(200, "big", "é" * 700_000)] + [(201, "r", "same")] * 2 + [(202, "WARC/1.1", "WARC/1.1\r\n\r\n\r\nHTTP/1.1")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "warc")
    segments = warc_chunks.archive(frame.repartition(3), path)
    chunks = warc_chunks.read_chunks(spark, path, segments).collect()
    last = [r for r in chunks if r.last]
    largest = {}
    for page, _, html in pages:
        largest.setdefault(html or "", []).append(page)
    expected = Counter()
    for page, _, html in pages:
        raw, ids = (html or "").encode(), [x for x in largest[html or ""] if x is not None]
        response = not ids or page == max(ids)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        expected[(page, len(raw), digest, "response" if response else "revisit", None if response else max(ids))] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in last) == expected
    big = sorted((r for r in chunks if r.page_id == 200), key=lambda r: r.chunk_no)
    assert len(big) == 2 and b"".join(r.data for r in big).decode() == "é" * 700_000
    assert {r.url for r in last if r.page_id == 3} == {"http://h/3%0D%0AX: y"}


def test_small_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame([(1, "a", b"xy"), (2, "b", b"xy"), (3, "c", b"long"), (4, "d", b"long")], "page_id long, url string, payload binary")
    found = {(r.page_id, r.record_type) for r in warc_chunks.record_types(pages, least_bytes=3).collect()}
    assert found == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_archive_no_rows(spark, tmp_path):
    segments = warc_chunks.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc_chunks.read_chunks(spark, str(tmp_path / "w"), segments).count() == 0


# 6: language model


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_language_model(docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(interpolated_lm, "CHUNK_TOKENS", chunk)
    found = interpolated_lm.score(docs.withColumn("row", F.lit(1))).collect()
    key = lambda r: (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
    assert Counter(map(key, found)) == brute.base_scores([r[:2] for r in rows])
    assert all(r.score < 0 for r in found)


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_model_scores_equal_brute_force(docs, rows, chunk, monkeypatch):
    """``score`` itself: roles, bigram counts, context buckets and expectation-maximisation in plain Python."""
    monkeypatch.setattr(interpolated_lm, "CHUNK_TOKENS", chunk)
    found = sorted((r.doc_id or -1, r.n_tokens, r.score) for r in interpolated_lm.score(docs).collect())
    scores = brute.model_scores([r[:2] for r in rows], interpolated_lm.ROUNDS, interpolated_lm.ENOUGH)
    expected = sorted((d or -1, n, x) for d, n, x in scores)
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected], rel=1e-9)


def test_chunks_do_not_change_scores(docs, monkeypatch):
    by = lambda: sorted((r.doc_id or -1, r.n_tokens, round(r.score, 4)) for r in interpolated_lm.score(docs).collect())
    whole = by()
    monkeypatch.setattr(interpolated_lm, "CHUNK_TOKENS", 97)
    assert by() == whole


def test_probabilities_sum_to_one():
    """Over all seen words and one unseen, for a seen context."""
    pair, word = np.array([3.0, 1.0, 0.0, 0.0]), np.array([5.0, 3.0, 2.0, 0.0])
    shares = interpolated_lm.parts_of(pair, np.full(4, 4.0), word, 10, 3)
    assert np.allclose(shares.sum(axis=1), 1)


def test_packed_numbers():
    for kind in (np.uint32, np.uint64):
        x = np.array([0, 1, 255, 2**31, 7], kind)
        assert (interpolated_lm.unpacked(interpolated_lm.packed(x), kind) == x).all()


def test_language_model_no_rows(none):
    assert interpolated_lm.score(none).count() == 0


# 7: neighbours


def test_neighbours_are_exact_when_all_leaves_are_searched(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "CELL_ROWS", 7)
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(12)] + [(9, vectors[9][1])]
    odd = [(500, None), (550, [0.0] * 8), (600, [float("nan")] + [1.0] * 7), (650, [None] + [1.0] * 7), (700, [1.0] * 3)]
    odd += [(None, vectors[4][1]), (750, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("row", F.lit("x"))
    found = rp_forest.nearest(frame, F.col("vec_id") % 50 == 0, leaf_sample=8, trees=4, share=4.0).collect()
    kept = vectors + [(None, vectors[4][1])]
    x = np.array([np.float32(v) for _, v in kept]).astype(float)
    for q, (q_id, _) in enumerate(kept):
        if q_id is not None and q_id % 50 == 0:
            score = rp_forest.exact(x[q], x)
            others = [i for i in range(len(kept)) if i != q]
            others.sort(key=lambda i: (-score[i], float("inf") if kept[i][0] is None else kept[i][0]))
            mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q_id)
            assert mine == [(k + 1, kept[i][0], score[i]) for k, i in enumerate(others[:5])]
    assert {r.query_id for r in found} == {0, 50, 100, 150, 200, 250, 300}


def test_recall_of_the_forest(spark):
    found = rp_forest.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 50 == 0, least=0)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    hits = total = 0
    for q, own in found.toPandas().groupby("query_id"):
        at = int(np.flatnonzero(ids == q)[0])
        score = rp_forest.exact(x[at], x)
        score[at] = -2
        hits += len(set(ids[np.lexsort((ids, -score))[:5]]) & set(own.vec_id))
        total += 5
    assert total == 5 * (ids % 50 == 0).sum() and hits / total >= 0.8


def test_neighbours_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rp_forest.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in rp_forest.nearest(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]


# 9: languages


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = language_bitmask.train(language_bitmask.training_rows(docs))
    found = language_bitmask.identify(docs, filters).where(common.fold("doc_id", 5) == 0)
    assert filters.languages == ["de", "en", "es", "fr"]
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()


def test_language_of_odd_rows(docs, rows, none):
    filters = language_bitmask.train(docs)
    found = language_bitmask.identify(docs.withColumn("score", F.lit("clash")), filters)
    assert found.columns == [*docs.columns, "lang_pred", "score", "coverage"] and found.count() == len(rows)
    unknown = {r.text for r in found.where("lang_pred = 'und'").collect()}
    assert unknown == {t for _, t, *_ in rows if not any(c.isalpha() for c in t or "")}
    assert all(0 <= r.score <= 1 and 0 <= r.coverage <= 1 for r in found.collect())
    nothing = language_bitmask.train(none)
    assert {r.lang_pred for r in language_bitmask.identify(docs, nothing).collect()} == {"und"}
    assert language_bitmask.identify(none, filters).count() == 0


def test_languages_equal_brute_force(docs, rows):
    """Filters, popcounts and their correction, on all rows and learned from all."""
    found = language_bitmask.identify(docs, language_bitmask.train(docs)).collect()
    rules = (language_bitmask.SLOT_BITS, language_bitmask.LEAST_SHARE, language_bitmask.LEAST_RATIO)
    expected = brute.languages([(r[1], r[2]) for r in rows], [r[1] for r in rows], *rules)
    one = lambda d, t, lang, score, coverage: (d or -1, len(t or ""), lang, round(score, 9), round(coverage, 9))
    found = sorted(one(r.doc_id, r.text, r.lang_pred, r.score, r.coverage) for r in found)
    assert found == sorted(one(r[0], r[1], *e) for r, e in zip(rows, expected))
    assert len({r[2] for r in found}) > 2


def test_filters_of_more_than_64_languages(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" * 3, f"l{i:02d}") for i in range(70)]
    filters = language_bitmask.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.slots.shape[1] == 2
    found = language_bitmask.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), filters)
    assert found.where("lang = lang_pred").count() >= 66


# 10: quality


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = cotraining.classify(docs, labels).join(labels, "doc_id").where(common.fold("doc_id", 10) == 0).toPandas()
    assert ((found.score >= 0.5) == (found.quality == 1)).mean() >= 0.97
    assert found[found.quality == 1].keep.mean() >= 0.98 and found[found.quality == 0].keep.mean() <= 0.1


def test_quality_of_odd_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    for table, n in ((docs.withColumn("keep", F.lit(3)), len(rows)), (none, 0)):
        found = cotraining.classify(table, labels)
        assert found.columns == [*docs.columns, "score", "text_score", "metadata_score", "keep"]
        assert found.where("keep and score = 1").count() == n
    some = spark.createDataFrame([(r[0], 0 if r[0] % 3 else 1) for r in rows if r[0] is not None], "doc_id long, quality int")
    found = cotraining.classify(docs, some).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)


def test_all_unlabelled_rows_teach(spark):
    """A rare source among 9,400 unlabelled documents, last in order of the hash of the id."""
    rng = random.Random(1)
    words = ["alpha beta gamma delta".split(), "4 7 !! ##".split()]
    good = [i % 2 for i in range(12_400)]
    ids = spark.range(12_400).orderBy(F.xxhash64("id")).toPandas().id.tolist()
    rows = []
    for at, i in enumerate(ids):
        kind = 1 if at >= 12_380 else good[at]
        source = "rare" if at >= 12_380 else "ab"[kind if rng.random() < 0.9 else 1 - kind]
        rows.append((i, " ".join(rng.choices(words[1 - kind], k=30)), "en", source, 100))
    labels = spark.createDataFrame([(r[0], good[at]) for at, r in enumerate(rows[:3_000])], "doc_id long, quality int")
    found = cotraining.classify(spark.createDataFrame(rows, SCHEMA), labels).where("source = 'rare'").collect()
    assert len(found) == 20 and min(r.metadata_score for r in found) >= 0.7


def test_spark_sums_are_the_sums_over_all_rows(spark):
    rng = np.random.default_rng(0)
    views = [rng.normal(size=(5_000, n)).astype(np.float16) for n in (5, 3)]
    model = lambda n: cotraining.Logistic(np.zeros(n), np.ones(n), np.full(n + 1, 2.0))
    teachers = [(model(5), model(1)), (model(3), model(1))]
    table = spark.createDataFrame([tuple(v[i].tobytes() for v in views) for i in range(5_000)], "a binary, b binary")
    weights = [rng.normal(size=6), rng.normal(size=4)]
    local = cotraining.sums_over(views, teachers, weights)
    for one, other in zip(local, cotraining.spark_pool(table.repartition(5))(teachers, weights)):
        assert one.first[0] > 2_000 and np.allclose(one.stack(), other.stack())


def test_a_pass_of_sums_is_one_stage_of_few_tasks(spark):
    """Of a table in many files: no shuffle, and no more tasks than the cores need."""
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    most = max(cotraining.PARTIALS, 2 * sc.defaultParallelism)
    rng = np.random.default_rng(0)
    views = [rng.normal(size=(1_000, n)).astype(np.float16) for n in (5, 3)]
    rows = [tuple(v[i].tobytes() for v in views) for i in range(1_000)]
    files = common.staged(spark.createDataFrame(rows, "a binary, b binary").repartition(most + 40))
    model = lambda n: cotraining.Logistic(np.zeros(n), np.ones(n), np.full(n + 1, 2.0))
    teachers, weights = [(model(5), model(1)), (model(3), model(1))], [rng.normal(size=6), rng.normal(size=4)]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
        assert files.rdd.getNumPartitions() >= most + 40
        sc.setJobGroup("pass of sums", "test")
        found = cotraining.spark_pool(files)(teachers, weights)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup("pass of sums")]
    stages = [tracker.getStageInfo(stage) for job in jobs for stage in job.stageIds]
    assert len(stages) == 1 and stages[0].numTasks <= most
    for one, other in zip(cotraining.sums_over(views, teachers, weights), found):
        assert one.first[0] > 100 and np.allclose(one.stack(), other.stack())


@pytest.mark.parametrize("first", [0.0, 3.0])
def test_refit_reaches_the_plain_fit(first):
    """Gradients summed over pseudo-labelled rows end where Newton's method on all rows ends."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4_000, 12)) * np.exp(rng.normal(size=12)) + 3 * rng.normal(size=12)
    other = x @ rng.normal(size=(12, 2)) / 4
    identity = cotraining.Logistic(np.zeros(1), np.ones(1), np.array([0.0, 1.0]))
    teacher = (cotraining.Logistic(np.zeros(2), np.ones(2), np.array([0.5, 2.0, -1.0])), identity)
    sure = cotraining.chance(teacher[0].logit(other))
    given = (sure >= cotraining.SURE) | (sure <= 1 - cotraining.SURE)
    labelled, y = x[:200] + first, (sure[:200] >= 0.5).astype(float)
    learner = cotraining.Refit(labelled, y, cotraining.fit(labelled, y))
    for passes in range(cotraining.PASSES):
        learner.update(cotraining.sums_over([x, other], [teacher, teacher], [learner.trial, None])[0])
        if learner.done:
            break
    rows, marks = np.concatenate((labelled, x[given])), np.concatenate((y, (sure[given] >= 0.5)))

    def loss(model):
        p = cotraining.chance(model.logit(rows))
        return cotraining.RIDGE * (model.weights[1:] ** 2).sum() / 2 - np.log(np.where(marks > 0, p, 1 - p)).sum()

    assert learner.done and passes < cotraining.PASSES - 1 and 100 < given.sum() < 4_000
    assert loss(learner.model) <= 1.001 * loss(cotraining.fit(rows, marks))


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    view = lambda: (y[:, None] * 3 + rng.normal(size=(3000, 4)))
    a, b = view(), view()
    parts = lambda rows: [a[rows], b[rows]]
    learn, hold, free, test = slice(0, 40), slice(40, 240), slice(240, 1500), slice(1500, 3000)
    model = cotraining.cotrain(parts(learn), y[learn].astype(float), parts(free), parts(hold), y[hold].astype(float))
    assert ((model.scores(parts(test))[0] >= 0.5) == y[test]).mean() >= 0.99


def test_text_features_hold_little_beside_a_block():
    texts = ["a" * (1 << 20), "\n" * (1 << 20), "Ab 12 ,; é\n" * 80_000, "", "one Two one Two"]
    data, offsets = common.text_bytes(pa.array(texts))
    cotraining.text_features(data[: offsets[1]], offsets[:2])  # what is kept for good comes first
    tracemalloc.start()
    found = cotraining.text_features(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    shares = found[:, -cotraining.NUMBERS :]
    assert shares[0, 0] == 1 and shares[1, 5] == 1 and shares[1, 6] == 1 and not shares[3].any()
    kinds = [1, 1, 2, 2, 2, 4, 1]  # bytes of a line: lower, upper, digits, signs, beyond, white, new lines
    assert np.allclose(shares[2, :7], np.array(kinds) / 12, atol=1e-3)
    assert np.allclose(shares[4, 7:11], [np.log1p(4), 0, 0.5, 0.5], atol=1e-3)
    assert peak < 105 << 20, peak
