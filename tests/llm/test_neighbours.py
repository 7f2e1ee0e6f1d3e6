import math

import numpy as np

from inkweave.llm.neighbours import nearest_neighbours, op3_neighbours

VECTORS = "vec_id bigint, embedding array<float>, label int, score string, rank int"


def brute(rows, q, k):
    """The k nearest of rows to q, whose vector is rows[q]."""
    scored = sorted((math.sqrt(float(((rows[i] - rows[q]) ** 2).sum())), i) for i in rows if i != q and len(rows[i]) == len(rows[q]))
    return scored[:k]


def test_recall_order_and_scores(spark, write):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 24))
    vectors = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24)) * 0.4).astype("float32")
    vectors[100:160] = vectors[0]  # ties with a query, and among each other
    rows = [(i, v.tolist(), 0, None, None) for i, v in enumerate(vectors)]
    rows += [(3000, None, 0, None, None), (3100, [0.0] * 24, 0, None, None), (3200, [float("nan")] * 24, 0, None, None), (3300, [None] * 24, 0, None, None), (3400, [1.0, 2.0], 0, None, None), (3401, [1.0, 3.0], 0, None, None), (None, [1.0] * 24, 0, None, None), (3500, [], 0, None, None)]
    folder = write("embeddings", rows, VECTORS)
    good = {i: np.array(v, dtype=float) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    got = {}
    for r in op3_neighbours(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == [q for q in sorted(good) if q % 100 == 0]
    hits = total = 0
    for q, found in got.items():
        expected = brute(good, q, 10)
        assert [r.rank for r in found] == list(range(1, len(expected) + 1))
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        for r in found:
            assert math.isclose(r.score, float(np.sqrt(((good[r.vec_id] - good[q]) ** 2).sum())), rel_tol=1e-12)
        hits += len({i for _, i in expected} & {r.vec_id for r in found})
        total += len(expected)
    assert hits / total >= 0.9
    assert [r.vec_id for r in got[3400]] == [3401]
    assert [r.vec_id for r in got[0]] == list(range(100, 110)) and got[0][0].score == 0


def test_shards_and_blocks_make_no_difference_to_what_is_near(spark):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "vec_id bigint, embedding array<double>")
    rows = {i: np.array(v) for i, v in vectors.collect()}
    found = nearest_neighbours(vectors, vectors.where("vec_id < 30"), 5, shard=90, block=7).collect()
    hits = sum((r.score, r.vec_id) in brute(rows, r.query_id, 5) or any(r.vec_id == i for _, i in brute(rows, r.query_id, 5)) for r in found)
    assert len(found) == 150 and hits >= 0.9 * 150


def test_few_vectors_are_verified(spark):
    rng = np.random.default_rng(6)
    even = rng.normal(size=(2500, 64))
    even /= np.sqrt((even**2).sum(axis=1, keepdims=True))
    near = np.repeat(rng.normal(size=(250, 64)), 10, axis=0) + rng.normal(size=(2500, 64)) * 0.3
    for vectors, most in ((even, 0.1), (near, 0.03)):
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors.astype("float32"))], "vec_id bigint, embedding array<float>")
        rows = {i: v for i, v in enumerate(vectors.astype("float32").astype(float))}
        got, hits = {}, 0
        for r in nearest_neighbours(frame, frame.where("vec_id % 100 = 0"), report=True).collect():
            got.setdefault(r.query_id, []).append(r)
        for q, found in got.items():
            hits += len({i for _, i in brute(rows, q, 10)} & {r.vec_id for r in found})
        share = np.mean([found[0].verified for found in got.values()]) / len(vectors)
        print(f"recall {hits / 250:.3f}, verified {share:.3f}")
        assert len(got) == 25 and hits / 250 >= 0.9 and share <= most


def test_empty(spark, write):
    assert op3_neighbours(spark, write("embeddings", [], VECTORS)).count() == 0
