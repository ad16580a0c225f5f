import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from obsweave.llm import maxent


def corpus(n):
    random.seed(8)
    words = {x: [f"{x}{i}" for i in range(300)] for x in "pqr"}
    out = []
    for i in range(n):
        own = words[random.choice("pqr")]
        out.append((i, " ".join(random.choices(own, weights=[1 / (k + 1) for k in range(300)], k=random.randint(5, 60)))))
    return out


def check_base(docs, got):
    tokens = {i: (t or "").encode().lower().split() + [b" "] for i, t in docs}
    counts = Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    for r in got:
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w))
        assert r["score"] < 0


def test_base_is_exact_and_the_model_beats_it_on_held_out_texts(rows, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 1e-3)  # so that rare words are joined
    docs = corpus(1500)
    got = maxent.scores(rows("doc_id long, text string", *docs)).collect()
    check_base(docs, got)
    held = [r for r in got if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / n > sum(r["base_score"] for r in held) / n + 0.1


def test_probabilities_of_all_next_words_sum_to_one():
    words = maxent.Words(np.arange(40), np.arange(40, 0, -1), np.concatenate([np.arange(40), maxent.HEAD + np.arange(maxent.TAILS)]), np.log10(np.ones(maxent.TAILS) * 3), 900, 60)
    tables = maxent.first_weights(words)
    rng = np.random.default_rng(0)
    tables[0][1:] += rng.standard_normal(tables[0][1:].shape) * 0.1
    features = maxent.feature_rows(*(np.array([k]) for k in (3, 5, 7)))
    by_class = maxent.softmax(tables[0], features)[0]
    assert by_class.sum() == pytest.approx(1, abs=1e-4)
    inner = maxent.inner_rows(np.repeat(features, 32, 0), np.arange(32))
    assert maxent.softmax(tables[1], inner).sum(1) == pytest.approx(np.ones(32), abs=1e-4)


def test_odd_documents(odd_documents, no_documents):
    got = maxent.scores(odd_documents).collect()
    assert len(got) == odd_documents.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    empty = [r for r in got if r["doc_id"] in (0, 1, 2)]
    assert {r["n_tokens"] for r in empty} == {1} and len({r["score"] for r in empty}) == 1
    assert maxent.scores(no_documents).count() == 0
