from obsweave.operators import retrieve
from obsweave.plans import retrieving

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_few_pairs_do_not_shuffle_all_ranks(spark, rows):
    corpus = rows("source string, uri long, tokens array<string>, embedding array<float>", *[("a", i, ["x", f"w{i}"], [1.0, float(i)]) for i in range(8)])
    queries = rows("query_id long, tokens array<string>, embedding array<float>", (1, ["w3", "w5"], [1.0, 2.0]), (2, ["w1"], [1.0, 0.0]))
    ranker = retrieve.Ranker(corpus, queries)
    pairs = rows("source string, query_id long, uri long", ("a", 1, 5), ("a", 1, 0), ("a", 2, 7))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ranker.ranks(pairs)
        dense = _plan(found.where("mode = 'dense'"))
        got = {(r["mode"], r["query_id"], r["uri"]): r["rank"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in dense and "SortMergeJoin" not in dense
    assert {k: v for k, v in got.items() if k[0] == "bm25"} == {("bm25", 1, 5): 2, ("bm25", 1, 0): 3, ("bm25", 2, 7): 8}


def test_gold_documents_and_menus_are_found_once(spark):
    # the passages used to be looked for anew in every branch of the plan
    assert "Generate" not in _plan(retrieving.gold_rank(spark, SMALL))
    assert _plan(retrieving.top1_baseline(spark, SMALL)).count("Window") == 0
