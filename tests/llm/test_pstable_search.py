import math

import numpy as np
import pytest

from voltrail.llm import pstable_search as S

SCHEMA = "vec_id long, embedding array<float>, label int, row string, cls string, v string, query int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z", 1) for i, v in rows], schema)


def cloud(n, centres, noise, dims, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * noise


def product(a, b):
    """Summed in the order of the axes."""
    total = 0.0
    for x, y in zip(np.float32(a).astype(float).tolist(), np.float32(b).astype(float).tolist()):
        total += x * y
    return total


def valid(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_force(rows, k, step):
    """(query_id, rank, vec_id, score) by all pairs."""
    good = [(i, v) for i, v in rows if valid(v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i is None or i % step:
            continue
        near = sorted((-product(v, w), j is None, j or 0, spot) for spot, (j, w) in enumerate(good) if spot != at and len(w) == len(v))[:k]
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j, _) in enumerate(near, 1)]
    return sorted(out, key=str)


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("dims,centres,noise,scale", [(16, 40, 0.2, False), (64, 300, 1.0, False), (24, 30, 0.3, True)])
def test_recall_and_exact_scores(spark, dims, centres, noise, scale):
    vectors = cloud(3000, centres, noise, dims, dims)
    if scale:  # lengths from 1/16 to 16
        vectors *= 2.0 ** np.random.default_rng(1).uniform(-4, 4, (len(vectors), 1))
    x = vectors.astype(np.float32).astype(float)
    got = S.search(frame(spark, list(enumerate(vectors.tolist()))), 10, 20).toPandas()
    hits, queries = 0, range(0, 3000, 20)
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own.score.is_monotonic_decreasing and q not in own.vec_id.tolist()
        assert own.score.tolist() == [product(vectors[q], vectors[j]) for j in own.vec_id]
        hits += len(set(own.vec_id) & set(np.argsort(-score, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 10 * len(queries)


def test_fewer_functions_than_one_find_everything(spark):
    """Up to 64 vectors there is one bucket, so the answer is the exact one: ties, repeated and odd rows included."""
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.integers(-2, 3, (40, 3)).astype(float).tolist())]  # many ties, equal vectors, zero vectors
    rows += [(20, [1.0, 2.0, 0.0]), (20, [1.0, 2.0, 0.0]), (None, [2.0, 2.0, 2.0]), (None, [2.0, 2.0, 2.0]), (60, None), (80, []), (100, [0.0, 0.0, 0.0]),
             (120, [float("nan"), 1.0, 0.0]), (140, [float("inf"), 1.0, 0.0]), (160, [None, 1.0, 0.0]), (180, [1.0, 2.0]), (200, [3.0, -1.0]), (220, [1.0])]
    for k in (1, 5, 100):
        assert answers(S.search(frame(spark, rows).coalesce(1), k, 20)) == brute_force(rows, k, 20)


def test_a_very_common_vector_and_huge_and_tiny_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 1.0, 0.0, 0.0] if i % 3 == 0 else v) for i, v in enumerate(rng.normal(size=(600, 4)).tolist())]
    rows += [(1001, [1e30, 0.0, 0.0, 0.0]), (1002, [1e-30, 0.0, 0.0, 1e-30]), (1020, [-1e-30, 0.0, 0.0, 0.0])]
    got, want = answers(S.search(frame(spark, rows), 20, 20)), brute_force(rows, 20, 20)
    assert len(got) == len(want)
    common = [r for r in got if r[0] % 60 == 0 and r[0] < 600]
    assert common == [r for r in want if r[0] % 60 == 0 and r[0] < 600]
    assert len(set(map(str, got)) & set(map(str, want))) >= 0.9 * len(want)


def test_groups_in_parts(spark, monkeypatch):
    """Near copies fill one bucket; its group is dealt in parts, all of which are searched."""
    monkeypatch.setattr(S, "GROUP", 50)
    rows = list(enumerate((np.ones(8) + cloud(700, 1, 0.001, 8, 3) * 0.001).tolist()))
    got, want = answers(S.search(frame(spark, rows), 5, 50)), brute_force(rows, 5, 50)
    assert len(got) == len(want)
    assert len({r[:1] + r[2:] for r in got} & {r[:1] + r[2:] for r in want}) >= 0.9 * len(want)


def test_outliers_find_as_many_as_there_are(spark):
    """A query far from all others finds its neighbours in the second round."""
    vectors = cloud(1500, 3, 0.01, 12, 8)
    vectors[0] = -vectors[1] - vectors[2] - vectors[3]
    rows = list(enumerate(vectors.tolist()))
    got = [r for r in answers(S.search(frame(spark, rows), 20, 20)) if r[0] == 0]
    assert len(got) == 20
    assert len({r[2] for r in got} & {r[2] for r in brute_force(rows, 20, 20) if r[0] == 0}) >= 18


def test_probes_come_in_falling_order_and_reach_the_goal():
    rng = np.random.default_rng(2)
    likely = rng.dirichlet(np.ones(5), 4)
    codes = (np.arange(5, dtype=np.uint64)[None, :] * np.array([1, 10, 100, 1000], np.uint64)[:, None])
    got = S.best_products(likely, codes, 0.8).tolist()
    every = sorted(((-likely[0, a] * likely[1, b] * likely[2, c] * likely[3, d], a + 10 * b + 100 * c + 1000 * d)
                    for a in range(5) for b in range(5) for c in range(5) for d in range(5)))
    total, want = 0.0, []
    for p, code in every:
        want.append(code)
        total -= p
        if total >= 0.8:
            break
    assert got == want


def test_empty_table(spark):
    df = S.search(frame(spark, []), 20, 20)
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and df.count() == 0
    assert answers(S.search(frame(spark, [(20, [1.0, 0.0]), (1, None)]), 20, 20)) == []
