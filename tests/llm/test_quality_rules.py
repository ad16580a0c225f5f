import random
import re
from collections import Counter

from pyspark.sql import functions as F

from obsweave.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_statistics_equal_a_plain_count(rows, odd_documents, no_documents):
    random.seed(4)
    texts = ["".join(random.choice(["a ", "b ", "c", "\n", "\t", "é", "# ", "\xa0", " "]) for _ in range(random.randint(0, 80))) for _ in range(400)]
    docs = rows("doc_id long, text string", *enumerate(texts)).unionByName(odd_documents.select("doc_id", "text"))
    pairs = docs.collect()
    want = Counter((r["doc_id"], *brute(r["text"])) for r in pairs)
    got = Counter(tuple(r) for r in q.statistics(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == want
    assert q.statistics(no_documents).count() == 0


def test_rules_find_the_planted_conditions(spark):
    rows = spark.range(4000).select(
        (F.rand(1) * 100).alias("words"), F.rand(2).alias("symbols"), F.rand(3).alias("upper"), (F.col("id") % 3 == 0).alias("held"))
    rows = rows.withColumn("bad", (F.col("symbols") > 0.8) | ((F.col("words") <= 20) & (F.col("upper") > 0.5)))
    rules = q.learn(rows, quantiles=40, precision=0.9)
    assert {c.feature for c in rules[0]} == {"symbols"} and rules[0][0].above and 0.75 < rules[0][0].threshold < 0.85
    judged = rows.withColumn("kept", q.verdict(rules))
    wrong = judged.where("kept = bad").count()
    assert wrong < 0.03 * 4000, rules
    assert q.learn(rows.where("bad")) == [] and q.learn(rows.limit(0)) == []


def test_verdict_follows_rules_and_base(odd_documents, no_documents, rows):
    words = " ".join(f"w{i}" for i in range(60))
    good = [(100 + i, f"{words} {i}") for i in range(30)]
    bad = [(200 + i, " ".join(f"# w{k}{i} $" for k in range(60))) for i in range(30)]
    docs = odd_documents.select("doc_id", "text").union(rows("doc_id long, text string", *good, *bad, *good[:2]))
    labels = rows("doc_id long, quality int", *[(i, 1) for i, _ in good[:20]], *[(i, 0) for i, _ in bad[:20]], (1, None), (None, 0), (100, 1))
    got = q.judged(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        n, _, _, _, repeated = brute(next(t for i, t in docs.collect() if i == r["doc_id"])) if r["doc_id"] is None or r["doc_id"] < 100 else (60, 0, 0, 0, 0)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert r["kept"] == (r["doc_id"] is not None and 100 <= r["doc_id"] < 200)
    assert q.judged(no_documents, labels).count() == 0
    assert {r["kept"] for r in q.judged(docs, labels.limit(0)).where("not base_failed").collect()} == {True}
