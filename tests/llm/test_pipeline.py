import random

import corpus_pipeline as pipeline
from obsweave.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, rows, tmp_path):
    random.seed(0)
    letters = ["the", "ing", "wh", "ou", "er", "sch", "ung"]
    word = lambda: "".join(random.choices(letters, k=4))
    body = [" ".join(word() for _ in range(12)) for _ in range(6)]
    near = body[:3] + [body[3].replace(body[3].split()[5], "changed")] + body[4:]
    docs = rows(
        "doc_id long, text string, lang string, source string, n_chars long, n int", (1, "\n".join(body), "en", "a", 0, 1), (2, "\n".join(body), "en", "a", 0, 1),
        (3, "\n".join(near), "en", "b", 0, 1), (4, " ".join(word() for _ in range(80)) + " mail a.b@example.com 4041894974608795", "en", "b", 0, 1), (5, None, "en", "a", 0, 1),
        (6, "123 456", None, None, 0, 1), (None, " ".join(word() for _ in range(80)), "en", "a", 0, 1))
    kept = {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, SMALL).write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "PII":
            texts = {r["doc_id"]: r for r in docs.collect()}
            assert "example.com" not in texts[4]["text"] and "4041894974608795" not in texts[4]["text"]
            assert texts[4]["n_chars"] == len(texts[4]["text"])
    assert kept["language ID"] == {1, 2, 3, 4, None}
    assert kept["line dedup"] == {1, 3, 4, None}  # the copy has no line left, the near copy one
    assert kept["packing"] == {1, 3, 4, None}


def test_documents_pass_where_no_language_is_declared(spark, rows):
    docs = rows("doc_id long, text string, lang string, source string", (1, "some words", None, "a"), (2, "123", None, "a"), (3, None, None, None))
    assert [tuple(r) for r in pipeline.identify_language(spark, docs, SMALL).collect()] == [(1, "some words", None, "a")]


def test_copies_leave_no_stub_of_short_lines(spark, rows):
    text = "A title\n---\nthe same line of a text that is long enough\nAll rights reserved."
    docs = rows("doc_id long, text string, n_chars long", (1, text, len(text)), (2, text, len(text)), (3, f"{text}\nmore", len(text) + 5))
    got = {r["doc_id"]: r["text"] for r in pipeline.dedup_lines(spark, docs, SMALL).collect()}
    assert got == {1: text, 3: "---\nmore"}


def test_near_duplicates_of_other_lines_go(spark, rows):
    random.seed(1)
    words = [f"w{random.randrange(500)}" for _ in range(200)]
    other = list(words)
    other[100] = "x"
    docs = rows("doc_id long, text string, lang string", (7, " ".join(other), "en"), (5, " ".join(words), "en"), (9, "alone", "en"), (None, " ".join(words), "en"))
    got = pipeline.join_near_duplicates(spark, docs, SMALL)
    assert {r["doc_id"] for r in got.collect()} == {5, 9, None}


def test_no_documents(spark, odd_documents, no_documents):
    for _, stage in pipeline.STAGES:
        assert stage(spark, no_documents, SMALL).count() == 0
    for _, stage in pipeline.STAGES:
        stage(spark, odd_documents, SMALL).count()


def test_run_and_registered_queries(spark):
    pieces = pipeline.run(spark, SMALL)
    ids = {r["doc_id"] for r in pieces.select("doc_id").collect()}
    assert 100 < len(ids) <= 200
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_archive_query_equals_sql(spark):
    import duckdb

    from check import compare

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SMALL}/pages.parquet')")
    line = compare(spark, con, SMALL, "op6_warc", queries.QUERIES["op6_warc"], queries.ORACLES["op6_warc"])
    assert " ok " in line, line
