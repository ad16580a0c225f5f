import zlib

import numpy as np
import pytest

from obsweave.llm import pooled_quality as pq
from obsweave.llm.queries import op13_pooled_quality
from obsweave.session import staged

FOLDER = "/root/testdata/sf0.01"


def test_context_sums_equal_a_plain_walk(rows):
    texts = ["a b c d", "b b, A", None, "", "x"]
    got = {r["bucket"]: r["v"] for r in pq.context_sums(rows("text string", *[(t,) for t in texts]), 64, 16, 1).collect()}
    places, signs = pq.index_vectors(64, 16, 1)
    want = {}
    for t in texts:
        w = [zlib.crc32(x.encode()) % 64 for x in pq.WORD.findall(t or "")]
        for i, x in enumerate(w):
            v = want.setdefault(x, np.zeros(16))
            for j in range(max(0, i - pq.WINDOW), min(len(w), i + pq.WINDOW + 1)):
                if j != i:
                    np.add.at(v, places[w[j]], signs[w[j]])
    assert got.keys() == want.keys() and all(list(want[b]) == got[b] for b in want)


def test_context_sums_do_not_depend_on_tasks(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text")
    tables = [pq.word_table(pq.context_sums(docs.repartition(n), 1024, 16, 1), 1024, 16, 1) for n in (1, 7)]
    assert np.allclose(*tables, atol=1e-6)


def test_pooling_equals_mean_and_spread(rows):
    table = np.random.default_rng(1).standard_normal((64, 8)).astype(np.float32)
    docs = rows("id long, text string", (1, "a b b c"), (2, ""), (3, None), (4, "w" * 100_000))
    got = {r["id"]: np.array(r["x"]) for r in pq.pooled(docs, table).collect()}
    v = table[[zlib.crc32(x) % 64 for x in (b"a", b"b", b"b", b"c")]].astype(float)
    assert np.allclose(got[1], [*v.mean(axis=0), *v.std(axis=0), np.log1p(4) / 4], atol=1e-5)
    assert not got[2].any() and not got[3].any() and got[4].any()


def test_network_learns_what_no_line_parts_and_temperature_mends_confidence():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    p = np.where(x[:, 0] * x[:, 1] > 0, 0.9, 0.1)
    y = (rng.random(3000) < p).astype(float)
    net = pq.Network(4, 16, 1)
    net.fit(x[:2000], y[:2000], 40, 1)
    net.weights[2] *= 5  # overconfident
    net.weights[3] *= 5
    loss = lambda: -np.mean(y * np.log(net.score(x)) + (1 - y) * np.log(1 - net.score(x)))
    before = loss()
    net.calibrate(x[2000:2500], y[2000:2500])
    assert net.temperature > 2 and loss() < before
    held = slice(2500, 3000)
    assert ((net.score(x[held]) >= 0.5) == (p[held] > 0.5)).mean() > 0.9


@pytest.fixture(scope="module")
def judged(spark):
    return staged(op13_pooled_quality(spark, FOLDER), "quality-test")


def test_held_out_accuracy(spark, judged):
    assert judged.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = judged.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    base = sum(r["quality"] for r in got) / len(got)
    right = sum(r["predicted"] == r["quality"] for r in got) / len(got)
    loss = -np.mean([np.log(max(r["score"] if r["quality"] else 1 - r["score"], 1e-9)) for r in got])
    assert right > base and right > 0.93 and loss < 0.7 * -(base * np.log(base) + (1 - base) * np.log(1 - base))
    ranks = [(a["score"] > b["score"]) for a in got if a["quality"] for b in got if not b["quality"]]
    assert sum(ranks) / len(ranks) > 0.93


def test_labels_of_held_out_rows_and_other_columns_say_nothing(spark, judged):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "1 - toxic AS toxic")
    again = pq.quality_scores(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source", "1 AS x"), turned)
    assert judged.exceptAll(again).count() == 0


def test_odd_documents(odd_documents, no_documents, rows):
    labels = rows("doc_id long, quality int", (3, 1), (4, 0), (4, None), (5, 0), (5, 1), (None, 1), (99, 0))
    small = {"buckets": 256, "dims": 8, "epochs": 2}
    got = pq.quality_scores(odd_documents, labels, **small).collect()
    assert len(got) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (0, 1, 2)}) == 1
    assert {(r["score"], r["predicted"]) for r in pq.quality_scores(odd_documents, labels.limit(0), **small).collect()} == {(0.5, 1)}
    assert pq.quality_scores(no_documents, labels, **small).count() == 0
