import random

import pytest
from pyspark.sql import functions as F

from obsweave.llm import language_id as li

SYLLABLES = {"en": ["the", "ing", "wh", "ou", "er"], "de": ["sch", "ung", "ei", "ü", "ver"], "fr": ["eau", "é", "que", "oi", "ç"]}


def text(language, n):
    return " ".join("".join(random.choices(SYLLABLES[language], k=random.randint(1, 4))) for _ in range(n))


@pytest.fixture
def pages(rows):
    random.seed(1)
    data = []
    for i in range(300):
        own = ("en", "de", "fr")[i % 3]
        declared = own if i % 10 else "en"  # one in ten is declared English
        data.append((i, text(own, 40 if i % 4 else 3), declared, f"www.{own}{i % 2}.org" if i % 7 else None, own))
    data += [(1000, "", None, "www.de1.org", "de"), (1001, None, "fr", None, "fr"), (1002, "123 ###", None, "new.de1.org", "de")]
    return rows("page_id long, text string, lang string, host string, own string", *data)


def test_evidence_is_fused(pages):
    got = li.identify(pages, host=F.col("host"), suffix=F.lit("org")).collect()
    assert len(got) == 303
    assert sum(r["language"] != r["own"] for r in got if r["page_id"] < 1000) <= 3
    odd = {r["page_id"]: r for r in got if r["page_id"] >= 1000}
    # without text the host decides, or its domain, or the declaration
    assert odd[1000]["language"] == odd[1002]["language"] == "de" and odd[1001]["language"] == "fr"
    assert all(r["text_language"] is None and 0.3 < r["probability"] <= 1 for r in odd.values())


def test_every_declared_language_and_value_counts(rows, monkeypatch):
    random.seed(4)
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(70)]
    words = {x: ["".join(random.choices("abcdefghijklmnop", k=7)) for _ in range(30)] for x in names}
    data = [(i, " ".join(random.choices(words[x], k=30)), x, f"s{i}") for i, x in enumerate(names * 4)]
    pages = rows("page_id long, text string, lang string, tld string", *data)
    got = li.identify(pages, suffix=F.col("tld")).collect()
    assert [r["page_id"] for r in got if not r["language"] == r["text_language"] == r["lang"]] == []  # 70 languages, two models
    monkeypatch.setattr(li, "LANGUAGES", 100)
    once = {r["page_id"]: tuple(r) for r in li.identify(pages, suffix=F.col("tld")).collect()}
    assert {r["page_id"]: tuple(r) for r in got} == once
    # values of evidence are tables: each has its row, however many there are
    counts = rows("best int, declared string, c long", *[(i % 2, f"v{i}", 5) for i in range(5000)])
    assert li.likelihoods_of(counts, "declared", 2, [0.5, 0.5], 20.0).count() == 5000


def test_priors_are_smoothed_by_domain(spark):
    counts = spark.createDataFrame([("a.x.org", 0, 1000), ("b.x.org", 1, 1), ("c.y.org", 1, 1)], "host string, best int, c long")
    prior = {r["host"]: r["prior"] for r in li.host_priors(counts, 2, [0.5, 0.5], 20.0).collect()}
    assert prior["a.x.org"][0] > prior["a.x.org"][1]
    assert prior["b.x.org"][0] > prior["b.x.org"][1]  # one row says less than the domain's thousand
    assert prior["c.y.org"][1] > prior["c.y.org"][0]


def test_addresses_and_markup(rows):
    r = rows("url string, html string", ("https://u@M.Site.de:80/x?y", "<!DOCTYPE html><HTML class='a' lang=\"de-AT\"><script>var x='<p>'</script><p>Hal&auml;lo<b>!</b></p>"), (None, None))
    got = r.select(li.host_of(F.col("url")), li.suffix_of(F.col("url")), li.declared_in(F.col("html")), li.visible(F.col("html"))).collect()
    assert got[0][:3] == ("m.site.de", "de", "de") and got[0][3].split() == ["Hal", "lo", "!"] and got[1] == (None,) * 4


def test_odd_documents(odd_documents, no_documents):
    got = li.identify(odd_documents)
    assert got.count() == odd_documents.count() and got.columns.count("language") == 1
    assert {r["language"] for r in got.collect()} == {"en"}
    nothing = li.identify(odd_documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r["language"] for r in nothing.collect()} == {None}
    assert li.identify(no_documents).count() == 0
