import numpy as np
import pytest

from voltrail.llm import near_vectors as V
from voltrail.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, row string, u string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def brute_force(ids, vectors, threshold=0.95):
    x = np.asarray(vectors, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            return {i: (int(near[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}
        label = new


def answers(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def cloud(n, centres, noise, dims, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return middle[rng.integers(0, centres, n) ** 2 % centres] + rng.normal(size=(n, dims)) * noise


@pytest.mark.parametrize("dims,noise", [(64, 0.12), (48, 0.05), (7, 0.05)])
def test_links_equal_all_pairs(spark, dims, noise):
    vectors = cloud(400, 60, noise, dims, 1)
    got, want = answers(V.near_vectors(frame(spark, list(enumerate(vectors.tolist()))))), brute_force(range(400), vectors)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
    assert got == want


def test_a_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(V, "CORE_ROWS", 20)
    monkeypatch.setattr(V, "BLOCK", 16)
    vectors = cloud(500, 3, 0.13, 32, 2)
    vectors[:150] = vectors[0]
    assert answers(V.near_vectors(frame(spark, list(enumerate(vectors.tolist()))))) == brute_force(range(500), vectors)


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine lies just above the threshold: the hardest to meet."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    both = np.concatenate((a, 0.951 * a + np.sqrt(1 - 0.951 ** 2) * b))
    got = answers(V.near_vectors(frame(spark, list(enumerate(both.tolist())))))
    found = sum(got[300 + i][1] == i for i in range(300))
    assert found >= 294 and all(n <= 1 for n, _ in got.values())


def test_invalid_vectors_link_with_nothing(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(1, same), (2, same), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [float("nan")] * 3), (8, [float("inf"), 0.0, 0.0]),
            (9, [1.0, 2.0, 3.0, 0.0]), (10, [1e-30, 2e-30, 3e-30]), (11, [1e30, 2e30, 3e30]), (None, same), (2, same)]
    got = sorted([(r.vec_id or 99, r.n_links, r.component_id, r.kept) for r in V.near_vectors(frame(spark, rows)).collect()])
    assert got == [(1, 5, 1, True), (2, 5, 1, False), (2, 5, 1, False), *[(i, 0, i, True) for i in range(3, 10)], (10, 5, 1, False), (11, 5, 1, False), (99, 5, 1, False)]
    assert V.near_vectors(frame(spark, [])).isEmpty()


def test_vectors_of_one_and_two_components(spark):
    rows = [(1, [2.0]), (2, [0.5]), (3, [-1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.1]), (6, [-1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0])]
    assert answers(V.near_vectors(frame(spark, rows))) == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (1, 7), 8: (1, 7)}


def test_transform_is_a_rotation():
    x = np.random.default_rng(4).normal(size=(5, 16))
    y = V.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(V.hadamard(y), x)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    alone = {n for n in label if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: c for n, c in label.items() if n not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
