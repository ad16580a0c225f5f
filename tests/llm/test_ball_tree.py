import math
import re

import numpy as np
import pytest

from obsweave.llm import ball_tree
from obsweave.llm.ball_tree import Best, Queries, Rows, Tree, ranked_search, search
from tests.llm.conftest import LONG

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(d, terms(t)) for d, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    out = []
    for item in {i for i, _ in items}:
        wanted = {t for i, x in items if i == item for t in terms(x)}
        scored = []
        for d, b in bags:
            score = 0
            for t in wanted & set(b):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for _, x in bags) + 1)))
                m = 10 + 90 * len(b) * n // total
                score += w * (1000000000 * b.count(t) // (1000 * b.count(t) + 8 * m))
            if score > 0:
                scored.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def words(rng, n, vocabulary=120):
    return " ".join(f"W{i}" for i in (rng.zipf(1.3, n) % vocabulary).tolist())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    texts = [words(rng, rng.integers(1, 60)) for _ in range(500)]
    texts[50:90] = [texts[10]] * 40  # a group of copies: ties beyond the ten best
    texts[91:94] = [None, "", " .,; "]
    return list(enumerate(texts)), [(i, words(rng, 12)) for i in range(25)] + [(25, texts[10]), (26, None), (27, "unseen"), (28, "!")]


@pytest.mark.parametrize("rows_of_tree", [40, 8192])
def test_ranks_equal_brute_force(rows, corpus, monkeypatch, rows_of_tree):
    monkeypatch.setattr(ball_tree, "TREE_ROWS", rows_of_tree)
    docs, items = corpus
    found = ranked_search(rows("doc_id long, text string, n long, q int", *[(d, t, 1, 1) for d, t in docs]), rows("item_id long, text string, query int", *[(i, t, 1) for i, t in items]))
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, items)


def test_blocks_of_queries_give_the_same_ranks(rows, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(ball_tree, "BLOCK_TERMS", 60)
    found = ranked_search(rows("doc_id long, text string", *docs[:150]), rows("item_id long, text string", *items), k=3)
    assert sorted(tuple(r) for r in found.collect()) == brute(docs[:150], items, 3)


def test_bounds_hold_and_subtrees_are_pruned():
    rng = np.random.default_rng(5)
    n, t = 2000, 300
    sizes = rng.integers(1, 20, n)
    # two halves that share no term
    ids = [np.unique(rng.integers(0, t // 2, s)) + (t // 2) * (i % 2) for i, s in enumerate(sizes)]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    rows_ = Rows(starts, np.concatenate(ids), rng.integers(1, 10**6, starts[-1]))
    queries = Queries([(q, int(x)) for q in range(20) for x in np.unique(rng.integers(0, t // 2, 6))], rng.integers(0, 12000, t), 20)
    tree = Tree(rows_, t)
    dense = np.zeros((n, t), dtype=np.int64)
    for r, i in enumerate(ids):
        dense[r, i] = rows_.values[starts[r]:starts[r + 1]]
    want = np.zeros((20, t), dtype=np.int64)
    for q in range(20):
        want[q, queries.query(q)] = queries.weights[queries.query(q)]
    scores = dense @ want.T
    below = {}
    for node in sorted(tree.nodes, reverse=True):
        at = tree.nodes[node][4]
        below[node] = list(at) if at is not None else below[2 * node + 1] + below[2 * node + 2]
        assert (tree.bounds(node, queries) >= scores[below[node]].max(axis=0)).all()
    assert sorted(below[0]) == list(range(n))
    best = Best(20, 10)
    opened = search(tree, queries, list(range(n)), best)
    leaves = sum(v[3] is not None for v in tree.nodes.values())
    assert opened < 0.7 * 20 * leaves
    for q in range(20):
        assert [(-s, i) for s, _, i in best.found[q]] == sorted(((s, i) for i, s in enumerate(scores[:, q].tolist()) if s > 0), key=lambda x: (-x[0], x[1]))[:10]


def test_odd_documents(odd_documents, no_documents, rows):
    items = rows("item_id int, text string", (1, "two line"), (2, LONG), (None, "kurzer"), (3, "x" * 100_000))
    got = sorted((r["item_id"] or 0, r["rank"], r["doc_id"], r["score"]) for r in ranked_search(odd_documents, items).collect())
    assert [r[:3] for r in got if r[0] == 0] == [(0, 1, 7)]
    assert [r[2] for r in got if r[0] == 1][-3:] == [6, 6, 10]  # equal texts by id, the repeated row twice
    assert [r[2] for r in got if r[0] == 2] == [5]
    assert not [r for r in got if r[0] == 3]
    assert ranked_search(no_documents, items).count() == 0
    assert ranked_search(odd_documents, items.limit(0)).count() == 0
