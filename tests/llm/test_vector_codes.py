import hashlib

import numpy as np

from obsweave.llm import vector_codes
from obsweave.llm.vector_codes import codebooks_digest, moved_round, nearest, parts_of, usable_vectors, with_label_error


def brute(rows, rounds=6, positions=8, entries=16):
    """Plain Lloyd rounds over (id, vector, label), in id order."""
    v = np.floor(np.array([x for _, x, _ in rows], dtype=np.float64) * 4096).astype(np.int64)
    parts = v.reshape(len(v), positions, -1)
    books = parts[:entries].transpose(1, 0, 2).copy()
    assign = lambda: np.stack([nearest(parts[:, p], books[p])[0] for p in range(positions)], axis=1)
    for _ in range(rounds):
        code = assign()
        for p in range(positions):
            for e in range(books.shape[1]):
                own = parts[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    code = assign()
    error = np.array([sum(((parts[i, p] - books[p, code[i, p]]) ** 2).sum() for p in range(positions)) for i in range(len(parts))])
    return code, error, books


def table(rows, data):
    return rows("vec_id long, embedding array<float>, label int, position int, entry int, v int", *[(i, [float(y) for y in x], g, 1, 1, 1) for i, x, g in data])


def cloud(n=400, dims=32):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, dims))
    v = (base[rng.integers(0, 40, n)] + 0.2 * rng.standard_normal((n, dims))).astype(np.float32)
    v[100:240] = v[3]  # a third of all rows
    return [(i, v[i].tolist(), None if i % 7 == 0 else i % 5) for i in range(n)]


def test_codes_errors_and_codebooks_equal_plain_rounds(rows, monkeypatch):
    monkeypatch.setattr(vector_codes, "ROWS_PER_OWNER", 50)  # owners of one entry are salted
    data = cloud()
    coded, books = vector_codes.vector_codes(table(rows, data))
    code, error, want = brute(data)
    assert (books == want).all()
    got = {r["id"]: (list(r["code"]), r["error"], r["label_error"]) for r in with_label_error(coded).collect()}
    labels = np.array([-1 if g is None else g for _, _, g in data])
    for i in range(len(data)):
        assert got[i] == (code[i].tolist(), error[i], error[labels == labels[i]].sum())
    assert codebooks_digest(books) == hashlib.sha256(",".join(str(x) for p in want for e in p for x in e).encode()).hexdigest()


def test_only_parts_that_change_their_entry_move(rows):
    data = cloud()
    state = parts_of(usable_vectors(table(rows, data), "vec_id", "embedding", "label"), 8, 4, 4096, 4)
    _, _, books = brute(data, rounds=1)
    state, moved = moved_round(state, books, "t1")
    assert moved.count() == state.count() == 8 * len(data)
    same, moved = moved_round(state, books, "t2")
    assert moved.count() == 0 and sorted(map(str, same.collect())) == sorted(map(str, state.collect()))
    _, _, later = brute(data, rounds=2)
    _, moved = moved_round(state, later, "t3")
    changed = {(r["vec"], r["position"]): r["entry"] for r in moved.collect()}
    before = {(r["vec"], r["position"]): r["entry"] for r in state.collect()}
    assert 0 < len(changed) < len(before) and all(before[k] != e for k, e in changed.items())


def test_ties_go_to_the_lower_index_and_unused_entries_stay(rows):
    same = [(i, [0.5] * 8, 0) for i in range(20)]
    coded, books = vector_codes.vector_codes(table(rows, same))
    assert {tuple(r["code"]) for r in coded.collect()} == {(0,) * 8}
    assert books.shape == (8, 16, 1) and (books == 2048).all()


def test_odd_vectors(rows):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0] * 8, 0), (2, None, 0), (3, [nan] + [1.0] * 7, 0), (4, [inf] * 8, 0), (5, [1.0] * 3, None), (6, [], None), (None, [2.0] * 9, 1), (1, [1.0] * 8, 0), (7, [3e38] * 8, 1)]
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.vector_codes(rows(schema, *data, (8, [1.0, None], 0)))
    got = [(r["id"], len(r["code"]), r["error"]) for r in coded.collect()]
    assert sorted((i or 0, n) for i, n, _ in got) == [(0, 8), (1, 8), (1, 8), (5, 8), (6, 8), (7, 8)]
    assert books.shape == (8, 6, 2) and all(e == 0 for _, _, e in got)  # no more vectors than entries
    for few in (rows(schema, (1, [], 0)), rows(schema, (2, None, 0))):
        coded, books = vector_codes.vector_codes(few)
        assert coded.count() == few.where("embedding is not null").count() and books.size == 0
    long = [(i, list(range(i, i + 20_000)), 0) for i in range(3)]
    coded, books = vector_codes.vector_codes(table(rows, long), rounds=1)
    assert books.shape == (8, 3, 2500) and sorted(r["error"] for r in coded.collect()) == [0, 0, 0]
