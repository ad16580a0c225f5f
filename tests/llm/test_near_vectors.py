import numpy as np
import pytest

from obsweave.llm.near_vectors import group_centres, near_vectors


def brute(ids, labels, vectors, cosine=0.98):
    m = np.array(vectors, dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= cosine) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(near, low[None, :], low.max() + 1).min(1))
        if (new == low).all():
            return dict(zip(ids, zip(near.sum(1).tolist(), low.tolist())))
        low = new


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((700, 24))
    tight = base[0] + 0.02 * rng.standard_normal((150, 24))  # all linked
    loose = base[1] + 0.14 * rng.standard_normal((60, 24))  # some linked
    pairs = base[2:102] + 0.05 * rng.standard_normal((100, 24))
    vectors = np.concatenate([base, tight, loose, pairs, base[5:15]])
    return [(i, v.tolist(), int(i % 700 == 3)) for i, v in enumerate(vectors)]


def test_links_and_components_equal_brute_force(rows, cloud):
    vectors = rows("vec_id long, embedding array<double>, label int", *cloud)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(vectors, window=32).collect()}
    want = brute(*zip(*[(i, g, v) for i, v, g in cloud]))
    found, all_links = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found <= all_links and found >= 0.98 * all_links
    assert all(n <= want[i][0] for i, (n, _) in got.items())
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.99 * len(got)


def test_odd_vectors_link_with_nothing(rows):
    nan, inf = float("nan"), float("inf")
    vectors = rows(
        "vec_id long, embedding array<double>, label int, rep int, n int", (1, [1.0, 0.0], 0, 1, 1), (2, [2.0, 0.0], 0, 1, 1), (3, None, 0, 1, 1), (4, [0.0, 0.0], 0, 1, 1), (5, [nan, 1.0], 0, 1, 1),
        (6, [inf, 1.0], 0, 1, 1), (7, [1.0, None], 0, 1, 1), (8, [1.0, 0.0], None, 1, 1), (9, [1.0, 0.0], 1, 1, 1), (10, [1.0, 0.0, 0.0], 0, 1, 1), (2, [2.0, 0.0], 0, 1, 1), (11, [], 0, 1, 1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(vectors).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False)] + [(i, 0, i, True) for i in range(3, 12)]
    assert near_vectors(vectors.limit(0)).count() == 0


def test_more_vectors_and_narrower_cones_take_more_passes(rows):
    rng = np.random.default_rng(3)

    def passes(n, mean, most=256):
        v = rng.standard_normal((n, 32))
        v = np.sqrt(1 - mean) * v / np.linalg.norm(v, axis=1, keepdims=True)
        v[:, 0] += np.sqrt(mean)
        reps = rows("group int, v array<double>", *[(0, x.tolist()) for x in v])
        return group_centres(reps, 64, 0.98, 0.99, most).first()["passes"]

    assert 2 <= passes(200, 0.0) < passes(3000, 0.0) < passes(3000, 0.9) < 100
    assert passes(3000, 0.97, most=20) == 20


@pytest.mark.parametrize("mean, dims", [(0.8, 64), (0.95, 64), (0.9, 384)])
def test_pairs_within_a_cone_are_found(rows, mean, dims):
    rng = np.random.default_rng(1)
    n, cosine = 1000, 0.983
    base = rng.standard_normal((n, dims))
    base[:, 0] = 0
    base *= np.sqrt(1 - mean) / np.linalg.norm(base, axis=1, keepdims=True)
    base[:, 0] = np.sqrt(mean)
    step = rng.standard_normal((n, dims))
    step -= (step * base).sum(axis=1, keepdims=True) * base
    twin = cosine * base + np.sqrt(1 - cosine ** 2) * step / np.linalg.norm(step, axis=1, keepdims=True)
    vectors = np.concatenate([base, twin])
    got = near_vectors(rows("vec_id long, embedding array<double>, label int", *[(i, v.tolist(), 0) for i, v in enumerate(vectors)])).collect()
    want = brute(list(range(2 * n)), [0] * (2 * n), vectors)
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(k for k, _ in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
