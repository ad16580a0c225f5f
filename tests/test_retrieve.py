import math
import random

import pytest

from obsweave.operators import retrieve


def brute_ranks(corpus, queries):
    """Rankings by the textbook formulas, one list at a time."""
    out = {}
    for source in sorted({c[0] for c in corpus}):
        docs = [c for c in corpus if c[0] == source]
        n, avg = len(docs), sum(len(d[2]) for d in docs) / len(docs)
        df = {}
        for d in docs:
            for t in set(d[2]):
                df[t] = df.get(t, 0) + 1
        idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
        mean = sum(idf.values()) / len(idf)
        idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
        for qid, tokens, vector in queries:
            bm25 = {}
            for _, uri, words, _ in docs:
                bm25[uri] = round(sum(idf.get(t, 0) * words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * len(words) / avg)) for t in tokens), 9)
            lists = {"bm25": sorted(bm25, key=lambda u: (-bm25[u], u))}
            if vector is not None:
                cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
                dist = {u: round(cos(vector, v) - 1, 9) for _, u, _, v in docs if v is not None}
                lists["dense"] = sorted(dist, key=lambda u: (-dist[u], u))
            rank = {m: {u: i + 1 for i, u in enumerate(us)} for m, us in lists.items()}
            rrf = {u: sum(1 / (60 + rank[m][u]) for m in rank if u in rank[m]) for u in lists["bm25"]}
            far = 10 ** 9
            order = sorted(rrf, key=lambda u: (-rrf[u], rank.get("dense", {}).get(u, far), u))
            out[source, qid] = rank, order
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    pick = lambda n: [words[min(29, int(rng.expovariate(0.15)))] for _ in range(n)]
    vec = lambda: [float(rng.randint(-3, 3)) or 1.0 for _ in range(4)]
    corpus = [(s, f"{s}/{i:03d}", pick(rng.randint(0, 12)), None if i % 9 == 0 else vec()) for s, n in (("a", 400), ("b", 25)) for i in range(n)]
    queries = [(f"q{i:02d}", pick(rng.randint(1, 5)) + (["unseen"] if i % 2 else []), None if i % 5 == 0 else vec()) for i in range(12)]
    c = spark.createDataFrame(corpus, "source string, uri string, tokens array<string>, embedding array<float>").repartition(5)
    q = spark.createDataFrame(queries, "query_id string, tokens array<string>, embedding array<float>")
    return c, q, brute_ranks(corpus, queries)


def test_top_lists(data):
    corpus, queries, want = data
    got = retrieve.Ranker(corpus, queries).top(7).collect()
    for r in got:
        assert want[r["source"], r["query_id"]][0][r["mode"]][r["uri"]] == r["rank"]
    assert len(got) == 2 * 7 * (12 + 9)


@pytest.mark.parametrize("block", [256, 4])
def test_fusion_is_exact(data, block):
    corpus, queries, want = data
    got = retrieve.Ranker(corpus, queries, block).fused(10).collect()
    assert len(got) == 2 * 12 * 10
    for r in got:
        ranks, order = want[r["source"], r["query_id"]]
        assert order[r["rank"] - 1] == r["uri"]
        assert (ranks["bm25"][r["uri"]], ranks.get("dense", {}).get(r["uri"])) == (r["bm25_rank"], r["dense_rank"])


def test_rank_of_any_pair(spark, data):
    corpus, queries, want = data
    pairs = spark.createDataFrame([("a", f"q{i:02d}", f"a/{(i * 37) % 400:03d}") for i in range(12)], "source string, query_id string, uri string")
    got = retrieve.Ranker(corpus, queries, 5).ranks(pairs).collect()
    assert {(r["mode"], r["query_id"], r["rank"]) for r in got} == {
        (m, q, ranks[m][u]) for _, q, u in [tuple(p) for p in pairs.collect()] for ranks in [want["a", q][0]] for m in ranks if u in ranks[m]
    }


def test_recall_counts_missing_ranks_as_misses(rows):
    ranks = rows("mode string, rank long", ("m", 1), ("m", 11))
    gold = rows("query_id int", (1,), (2,), (3,), (4,))
    got = {r["k"]: r["recall"] for r in retrieve.recall_at(ranks, gold, ["mode"], [1, 10, 20]).collect()}
    assert got == {1: 0.25, 10: 0.25, 20: 0.5}


def test_top1_baseline(rows):
    menus = rows("query_id int, source string, rank int, uri string, distance double", (1, "x", 1, "u", 0.5), (1, "y", 1, "v", 0.2), (2, "x", 1, "w", 0.1), (2, "x", 2, "u", 0.1))
    gold = rows("query_id int, source string, uri string", (1, "x", "u"), (2, "x", "w"), (3, "x", "u"))
    r = retrieve.top1_baseline(menus, gold).first()
    assert (r["n"], r["top1_any"], r["top1_gold_corpus"]) == (2, 0.5, 1.0)


@pytest.mark.parametrize("block", [10_000, 1])
def test_nearest_class(rows, block):
    classes = rows("uri string, embedding array<float>", ("c", [1.0, 0.0]), ("b", [0.0, 1.0]), ("a", [0.0, 2.0]))
    phrases = rows("phrase_id int, phrase string, embedding array<float>", (1, "x", [3.0, 0.1]), (2, "x", [0.0, 5.0]), (3, " ", [1.0, 0.0]), (4, "x", [-1.0, -1.0]), (5, None, [1.0, 0.0]))
    got = {r["phrase_id"]: r["class_uri"] for r in retrieve.nearest_class(phrases, classes, block=block).collect()}
    assert got == {1: "c", 2: "a", 3: None, 4: None, 5: None}


def test_query_variants(rows):
    cols = rows("query_id int, column string, stem string, phrase string, context string, unit string, description string", (1, "flow_rate", "in-flow", None, None, None, ""), (2, "a", "b", "volume", "ctx", "mm", "probe"))
    got = {(r["query_id"], r["variant"]): r["text"] for r in retrieve.query_variants(cols).collect()}
    assert got[1, "raw+meta+unit+device"] == "flow rate in flow" and got[1, "phrase"] == "flow rate"
    assert got[2, "raw+meta+unit+device"] == "a b ctx mm probe" and got[2, "phrase+meta+unit"] == "volume ctx mm"


@pytest.mark.parametrize("rows_of_window", [0, 1_000_000])
def test_fused_rank_of_any_pair(spark, data, monkeypatch, rows_of_window):
    monkeypatch.setattr(retrieve, "WINDOW_ROWS", rows_of_window)  # 0: every list is numbered by ranges
    corpus, queries, want = data
    gold = spark.createDataFrame([("a", f"q{i:02d}", f"a/{(i * 31) % 400:03d}") for i in range(12)], "source string, query_id string, uri string")
    got = {(r["mode"], r["query_id"]): r["rank"] for r in retrieve.gold_ranks(retrieve.Ranker(corpus, queries), gold).collect()}
    for source, q, u in [tuple(g) for g in gold.collect()]:
        ranks, order = want[source, q]
        assert got["hybrid", q] == order.index(u) + 1 and got["bm25", q] == ranks["bm25"][u] and got.get(("dense", q)) == ranks.get("dense", {}).get(u)


def test_common_tokens_are_salted_where_the_queries_are_many(data, monkeypatch):
    corpus, queries, want = data
    monkeypatch.setattr(retrieve, "TERM_BYTES", 0)
    got = retrieve.Ranker(corpus, queries).top(5, ("bm25",)).collect()
    assert len(got) == 2 * 5 * 12 and all(want[r["source"], r["query_id"]][0]["bm25"][r["uri"]] == r["rank"] for r in got)


def test_bm25_runs_without_python_and_scoring_without_cross_joins(data):
    corpus, queries, _ = data
    ranker = retrieve.Ranker(corpus, queries)
    sizes = retrieve.corpus_statistics(corpus)
    plan = retrieve.bm25_hits(corpus, queries, sizes)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    plan = retrieve.dense_scores(corpus, queries)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in ranker.top(3)._jdf.queryExecution().executedPlan().toString()


def test_tasks_that_sum_scores_follow_the_pairs(spark, rows, monkeypatch):
    corpus = rows("source string, uri long, tokens array<string>", *[("a", i, ["x", "y", f"t{i}"]) for i in range(100)])
    asked = rows("query_id long, tokens array<string>", *[(i, ["x", f"t{i}"]) for i in range(10)])
    sizes = retrieve.corpus_statistics(corpus)
    few = {tuple(r) for r in retrieve.bm25_hits(corpus, asked, sizes).collect()}
    monkeypatch.setattr(retrieve, "TASK_PAIRS", 10)
    hits = retrieve.bm25_hits(corpus, asked, sizes)
    assert hits.rdd.getNumPartitions() == 100
    assert {tuple(r) for r in hits.collect()} == few
