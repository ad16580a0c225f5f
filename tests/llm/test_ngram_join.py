import random
from collections import defaultdict

import pytest

from obsweave.llm import ngram_join
from obsweave.llm.ngram_join import ngram_join as join


def brute(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    ids = sorted(sets)
    links = defaultdict(list)
    for x in ids:
        for y in ids:
            same = len(sets[x] & sets[y])
            if x < y and same and 100 * same >= percent * (len(sets[x]) + len(sets[y]) - same):
                links[x].append(y)
                links[y].append(x)
    for x in ids:  # smallest first: what it reaches is its component
        todo = [x] if low[x] == x else []
        while todo:
            v = todo.pop()
            for u in links[v]:
                if low[u] > x:
                    low[u] = x
                    todo.append(u)
    return {i: (len(s), low[i]) for i, s in sets.items()}


def near_copies():
    random.seed(6)
    vocabulary = [f"w{k}" for k in range(60)]
    docs = []
    for _ in range(60):
        words = random.choices(vocabulary, k=random.randint(2, 120))
        for _ in range(random.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(random.randint(0, 5)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            docs.append(" ".join(copy))
    boiler = " ".join(random.choices(vocabulary, k=40))
    docs += [f"{boiler} {random.choice(vocabulary)} x{k % 7}" for k in range(40)]  # many alike, in few words
    random.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("frequent, pairs, orders", [(64, 64, 3), (3, 64, 1), (2, 3, 1)])
def test_components_equal_brute_force(rows, monkeypatch, size, percent, frequent, pairs, orders):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "PAIRS_UP_TO", pairs)
    monkeypatch.setattr(ngram_join, "ORDERS", orders)
    docs = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join(rows("doc_id long, text string", *docs), size, percent).collect()}
    assert got == brute(docs, size, percent)


def test_index_finds_links_without_stars(spark, rows, monkeypatch):
    """With no first comparison everything must come from the prefixes."""
    monkeypatch.setattr(ngram_join, "star_pairs", lambda reps, alone, percent: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    docs = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join(rows("doc_id long, text string", *docs)).collect()}
    assert got == brute(docs, 3, 90)


def test_odd_documents(odd_documents, no_documents):
    got = join(odd_documents).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_documents.where("doc_id is not null").collect()}
    want = brute(texts.items(), 3, 90)
    assert len(got) == odd_documents.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (want[r["doc_id"]] if r["doc_id"] is not None else (1, None))
    assert join(no_documents).count() == 0
