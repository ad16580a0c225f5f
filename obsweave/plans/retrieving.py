"""Queries on retrieval: documents as four vocabularies (one per language), benchmark passages as queries.

A document with an embedding of its id takes part in dense ranking; so does a passage. The gold document
of a passage is the first one that holds it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.functions import fixed, text
from obsweave.functions.values import cosine
from obsweave.operators import retrieve, vocab
from obsweave.plans.registry import query
from obsweave.session import join_small, spread, staged
from obsweave.sources.tables import table

K = 10

_TOK = "list_filter(regexp_split_to_array(replace(lower({}), '_', ' '), '[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}]+'), lambda x: x <> '')"

CORPUS_SQL = f"""
corpus AS MATERIALIZED (SELECT lang AS source, doc_id AS uri, {_TOK.format('text')} AS tokens, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
asked AS MATERIALIZED (SELECT item_id AS query_id, {_TOK.format('text')} AS tokens, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
sizes AS (SELECT source, count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM corpus GROUP BY source),
tf AS MATERIALIZED (SELECT source, uri, token, count(*) AS tf FROM (SELECT source, uri, unnest(tokens) AS token FROM corpus) GROUP BY ALL),
raw AS (SELECT source, token, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf JOIN sizes USING (source) GROUP BY ALL),
idf AS MATERIALIZED (SELECT source, token, df, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY source) ELSE r END AS idf FROM raw),
asked_tokens AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(tokens) AS token FROM asked) GROUP BY ALL),
hits AS (SELECT a.query_id, tf.source, tf.uri, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avg_length))) AS s
  FROM asked_tokens a JOIN tf USING (token) JOIN idf USING (source, token) JOIN sizes USING (source) JOIN corpus USING (source, uri) GROUP BY ALL),
bm25 AS MATERIALIZED (SELECT query_id, source, uri, round(coalesce(s, 0), 9) AS score, row_number() OVER (PARTITION BY query_id, source ORDER BY round(coalesce(s, 0), 9) DESC, uri) AS rank
  FROM (SELECT query_id, source, uri FROM asked, corpus) LEFT JOIN hits USING (query_id, source, uri)),
dense AS MATERIALIZED (SELECT query_id, source, uri, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, uri) AS rank
  FROM (SELECT query_id, source, uri, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) - 1, 9) AS score FROM asked a, corpus c WHERE a.embedding IS NOT NULL AND c.embedding IS NOT NULL)),
fused AS MATERIALIZED (SELECT query_id, source, uri, b.rank AS bm25_rank, d.rank AS dense_rank, d.score AS d, coalesce(1 / (60 + d.rank), 0) + 1 / (60 + b.rank) AS rrf,
  row_number() OVER (PARTITION BY query_id, source ORDER BY coalesce(1 / (60 + d.rank), 0) + 1 / (60 + b.rank) DESC, d.rank NULLS LAST, uri) AS rank FROM bm25 b LEFT JOIN dense d USING (query_id, source, uri)),
gold AS MATERIALIZED (SELECT item_id AS query_id, arg_min(lang, doc_id) AS source, min(doc_id) AS uri FROM documents d, benchmark b WHERE contains(d.text, b.text) GROUP BY item_id)"""
_WITH = f"WITH {CORPUS_SQL}"


def corpus(spark, folder):
    docs, vectors = spread(table(spark, folder, "documents"), "doc_id"), table(spark, folder, "embeddings")
    joined = join_small(docs, vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return joined.select(F.col("lang").alias("source"), F.col("doc_id").alias("uri"), text.tokens(F.col("text")).alias("tokens"), "embedding")


def asked(spark, folder):
    items, vectors = table(spark, folder, "benchmark"), table(spark, folder, "embeddings")
    joined = items.join(vectors, F.col("vec_id") == F.col("item_id"), "left")
    return joined.select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("tokens"), "embedding")


def gold(spark, folder):
    """First document that holds each passage.

    All words of a passage but the first and the last lie between spaces in every document that holds it, so up to four
    of them are an exact join key; passages of one or two words have their first eight characters. The full text is
    then compared.
    """
    words = lambda c: F.split(c, " ")
    inner = F.array_join(F.slice(words(F.col("text")), F.lit(2), F.least(F.lit(4), F.size(words(F.col("text"))) - 2)), " ")
    n = F.size(words(F.col("text")))
    items = table(spark, folder, "benchmark").where(F.col("text").isNotNull()).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("passage"), F.when(n >= 3, F.least(F.lit(4), n - 2)).otherwise(0).alias("run"),
        F.when(n >= 3, inner).otherwise(F.left("text", F.lit(8))).alias("key"))
    docs = spread(table(spark, folder, "documents"), "doc_id").withColumn("_w", words(F.col("text")))
    some = items.select("run", F.when(F.col("run") == 0, F.length("key")).otherwise(0).alias("chars")).distinct().collect()  # at most 4 + 9 kinds of keys
    pieces = {
        True: lambda n: (F.size("_w"), lambda i: F.array_join(F.slice("_w", i, n), " ")),
        False: lambda n: (F.length("text"), lambda i: F.substring("text", i, F.lit(n))),
    }
    keyed = []
    for run, chars in some:
        n = run or chars
        size, piece = pieces[run > 0](n)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), piece)
        keys = docs.select("doc_id", F.explode(F.array_distinct(runs)).alias("key"))
        own = items.where((F.col("run") == run) & ((F.col("run") > 0) | (F.length("key") == chars)))
        keyed.append(join_small(keys, own.select("query_id", "key"), "key", "inner").select("query_id", "doc_id"))
    near = reduce(DataFrame.unionByName, keyed) if keyed else items.select("query_id", F.lit(0).cast("long").alias("doc_id"))
    full = near.join(items.select("query_id", "passage"), "query_id").join(docs.select("doc_id", "lang", "text"), "doc_id")
    return full.where(F.contains("text", F.col("passage"))).groupBy("query_id").agg(F.min_by("lang", "doc_id").alias("source"), F.min("doc_id").alias("uri"))


def _ranker(spark, folder):
    return retrieve.Ranker(corpus(spark, folder), asked(spark, folder))


@query(f"{_WITH} SELECT source, token, df, round(idf, 6) AS idf FROM idf")
def token_statistics(spark, folder):
    return retrieve.token_statistics(corpus(spark, folder)).withColumn("idf", F.round("idf", 6))


@query(f"{_WITH} SELECT source, n_docs, round(avg_length, 6) AS avg_length FROM sizes")
def corpus_statistics(spark, folder):
    return retrieve.corpus_statistics(corpus(spark, folder)).withColumn("avg_length", F.round("avg_length", 6))


@query(f"{_WITH} SELECT query_id, source, uri, rank, round(score, 6) AS score FROM bm25 WHERE rank <= {K}")
def bm25_topk(spark, folder):
    top = _ranker(spark, folder).top(K, ("bm25",))
    return top.select("query_id", "source", "uri", "rank", F.round("score", 6).alias("score"))


@query(f"{_WITH} SELECT query_id, source, uri, rank, round(0 - score, 6) AS distance FROM dense WHERE rank <= {K}")
def dense_topk(spark, folder):
    top = _ranker(spark, folder).top(K, ("dense",))
    return top.select("query_id", "source", "uri", "rank", F.round(0.0 - F.col("score"), 6).alias("distance"))


@query(f"{_WITH} SELECT query_id, source, uri, rank, round(rrf, 9) AS rrf, bm25_rank, dense_rank, round(coalesce(0 - d, 1), 3) AS distance FROM fused WHERE rank <= {K}")
def rrf_topk(spark, folder):
    return _ranker(spark, folder).fused(K).withColumn("rrf", F.round("rrf", 9))


@query(f"{_WITH} SELECT f.query_id, f.source, f.rank, f.uri, left(text, 40) AS label, round(coalesce(0 - d, 1), 3) AS distance FROM fused f JOIN documents ON doc_id = f.uri WHERE rank <= {K}")
def candidate_menu(spark, folder):
    labels = table(spark, folder, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("uri"), F.left("text", F.lit(40)).alias("label"))
    return retrieve.menu(_ranker(spark, folder).fused(K), labels).select("query_id", "source", "rank", "uri", "label", "distance")


_GOLD_RANKS = """gr AS (SELECT query_id, source, uri, 'bm25' AS mode, rank FROM gold JOIN bm25 USING (query_id, source, uri) UNION ALL SELECT query_id, source, uri, 'dense', rank FROM gold JOIN dense USING (query_id, source, uri)
  UNION ALL SELECT query_id, source, uri, 'hybrid', rank FROM gold JOIN fused USING (query_id, source, uri))"""


@query(f"{_WITH} SELECT * FROM gold")
def gold_documents(spark, folder):
    return gold(spark, folder)


@query(f"{_WITH}, {_GOLD_RANKS} SELECT query_id, source, uri, mode, rank FROM gr")
def gold_rank(spark, folder):
    return retrieve.gold_ranks(_ranker(spark, folder), staged(gold(spark, folder), "gold"))


@query(f"{_WITH}, {_GOLD_RANKS}, ks(k) AS (VALUES {', '.join(f'({k})' for k in fixed.RECALL_DEPTHS)}) SELECT m.mode, k, count_if(rank <= k)::BIGINT AS hits, (SELECT count(*) FROM gold) AS n, round(count_if(rank <= k) / (SELECT count(*) FROM gold), 6) AS recall FROM (VALUES ('bm25'), ('dense'), ('hybrid')) m(mode), ks LEFT JOIN gr ON gr.mode = m.mode GROUP BY m.mode, k")
def recall_at_k(spark, folder):
    wanted = staged(gold(spark, folder), "gold")
    ranks = retrieve.gold_ranks(_ranker(spark, folder), wanted)
    return retrieve.recall_at(ranks, wanted, ["mode"], modes=["bm25", "dense", "hybrid"]).withColumn("recall", F.round("recall", 6))


@query(f"""{_WITH}, menu AS (SELECT query_id, source, uri, rank, round(coalesce(0 - d, 1), 3) AS distance FROM fused WHERE rank <= {K}),
  near AS (SELECT query_id, arg_min({{'s': source, 'u': uri}}, (distance, source, rank)) AS a FROM menu GROUP BY query_id), own AS (SELECT query_id, source, uri AS own FROM menu WHERE rank = 1)
  SELECT count(*) AS n, round(avg((a.u = g.uri AND a.s = g.source)::INT), 6) AS top1_any, round(avg(coalesce(own = g.uri, FALSE)::INT), 6) AS top1_gold_corpus FROM gold g JOIN near USING (query_id) LEFT JOIN own USING (query_id, source)""")
def top1_baseline(spark, folder):
    found = retrieve.top1_baseline(staged(_ranker(spark, folder).fused(K), "menus"), gold(spark, folder))
    return found.select("n", F.round("top1_any", 6).alias("top1_any"), F.round("top1_gold_corpus", 6).alias("top1_gold_corpus"))


@query("""WITH c AS (SELECT 'http://example.org/class/' || label AS uri, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label),
  p AS (SELECT vec_id AS phrase_id, uri, round(list_cosine_similarity(embedding::DOUBLE[], e), 9) AS s FROM embeddings, c WHERE label <> 3)
  SELECT vec_id AS phrase_id, CASE WHEN max(s) >= 0.42 THEN arg_min(uri, (-s, uri)) END AS class_uri, round(max(s), 3) AS score FROM embeddings LEFT JOIN p ON vec_id = phrase_id GROUP BY vec_id""")
def class_by_threshold(spark, folder):
    vectors = table(spark, folder, "embeddings")
    classes = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.concat(F.lit("http://example.org/class/"), F.col("label").cast("string")).alias("uri"), "embedding")
    phrases = vectors.select(F.col("vec_id").alias("phrase_id"), F.when(F.col("label") == 3, "  ").otherwise(F.concat(F.lit("phrase "), F.col("label").cast("string"))).alias("phrase"), "embedding")
    return retrieve.nearest_class(phrases, classes)


_NAMES = "SELECT p_partkey, unnest([p_name || '_' || p_size, p_name, 'TempSensor' || p_size || '-' || p_partkey, 'COD' || p_size || '/' || p_type, 'lvl' || p_brand || ' ' || p_size]) AS name FROM part"
_ABBREV = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.ABBREVIATIONS.items()) + "}"


@query(f"""WITH n AS ({_NAMES}), a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(name), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_\\-/]+', ' ', 'g'), '([A-Za-z])\\s*\\d+\\b', '\\1', 'g') AS s FROM n)
  SELECT p_partkey, name, array_to_string(list_transform(list_filter(regexp_split_to_array(s, '\\s+'), lambda t: t <> '' AND NOT regexp_full_match(t, '\\d+')), lambda t: coalesce({_ABBREV}[lower(t)], t)), ' ') AS term FROM a""")
def clean_term(spark, folder):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    names = F.array(
        F.concat_ws("_", "p_name", size), F.col("p_name"), F.concat(F.lit("TempSensor"), size, F.lit("-"), key), F.concat(F.lit("COD"), size, F.lit("/"), "p_type"),
        F.concat(F.lit("lvl"), "p_brand", F.lit(" "), size),
    )
    part = table(spark, folder, "part").select("p_partkey", F.explode(names).alias("name"))
    return part.select("p_partkey", "name", text.clean_term(F.col("name")).alias("term"))


@query("""WITH v AS (SELECT p_partkey AS query_id, unnest([
    {'variant': 'raw', 't': replace(p_name, '_', ' ') || ' ' || translate(stem, '_-', '  ')}, {'variant': 'raw+meta', 't': replace(p_name, '_', ' ') || ' ' || translate(stem, '_-', '  ') || ' ' || context},
    {'variant': 'phrase', 't': coalesce(phrase, p_name)}, {'variant': 'phrase+meta', 't': coalesce(phrase, p_name) || ' ' || context},
    {'variant': 'raw+meta+unit', 't': replace(p_name, '_', ' ') || ' ' || translate(stem, '_-', '  ') || ' ' || context || coalesce(' ' || unit, '')},
    {'variant': 'raw+meta+unit+device', 't': replace(p_name, '_', ' ') || ' ' || translate(stem, '_-', '  ') || ' ' || context || coalesce(' ' || unit, '') || ' ' || p_brand},
    {'variant': 'phrase+meta+unit', 't': coalesce(phrase, p_name) || ' ' || context || coalesce(' ' || unit, '')}]) AS v
  FROM (SELECT *, 'data_' || lower(p_type) || '-' || p_size AS stem, CASE WHEN p_size > 10 THEN p_type || ' ' || p_name END AS phrase, 'sold at ' || p_retailprice AS context, CASE WHEN p_size > 20 THEN 'mm' END AS unit FROM part))
  SELECT query_id, v.variant AS variant, v.t AS text, 'Represent this sentence for searching relevant passages: ' || v.t AS dense_text FROM v""")
def query_variants(spark, folder):
    big = F.col("p_size")
    columns = table(spark, folder, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_name").alias("column"), F.concat(F.lit("data_"), F.lower("p_type"), F.lit("-"), F.col("p_size").cast("string")).alias("stem"),
        F.when(big > 10, F.concat_ws(" ", "p_type", "p_name")).alias("phrase"), F.concat(F.lit("sold at "), F.col("p_retailprice").cast("string")).alias("context"),
        F.when(big > 20, "mm").alias("unit"), F.col("p_brand").alias("description"),
    )
    return retrieve.query_variants(columns).withColumn("dense_text", text.dense_text(F.col("text")))


def _place_triples(spark, folder):
    """Nations and regions as concepts, part types as quantity kinds."""
    nation, region, part = (table(spark, folder, n) for n in ("nation", "region", "part"))
    uri = lambda kind, key: F.concat(F.lit(f"http://example.org/{kind}/"), F.col(key).cast("string"))
    no = F.lit(None).cast("string")

    def rows(df, s, p, o, lang=no):
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), no.alias("o_datatype"), lang.alias("o_lang"))

    kind = F.concat(F.lit(fixed.QUANTITY_KIND), F.concat_ws("-", "p_type", "p_brand"))
    small = F.col("p_size") < 5
    return (
        rows(nation, uri("nation", "n_nationkey"), fixed.SKOS_PREF_LABEL, F.col("n_name"))
        .unionByName(rows(nation, uri("nation", "n_nationkey"), fixed.SKOS_BROADER, uri("region", "n_regionkey")))
        .unionByName(rows(nation.where("n_nationkey < 12"), uri("nation", "n_nationkey"), fixed.SKOS_DEFINITION, F.concat(F.lit("nation number "), F.col("n_nationkey").cast("string"))))
        .unionByName(rows(nation.where("n_nationkey > 8"), uri("nation", "n_nationkey"), fixed.SKOS_BROADER, uri("region", "n_regionkey")))
        .unionByName(rows(nation.where("n_nationkey > 8"), uri("nation", "n_nationkey"), fixed.SKOS_BROADER, F.lit("http://example.org/region/0")))
        .unionByName(rows(region, uri("region", "r_regionkey"), fixed.SKOS_PREF_LABEL, F.col("r_name")))
        .unionByName(rows(part.where(~small), kind, fixed.RDFS_LABEL, F.concat_ws(" ", "p_type", "p_name"), F.when(F.col("p_size") < 30, "de").otherwise("en")))
        .unionByName(rows(part.where(small), kind, fixed.DCTERMS_DESCRIPTION, F.concat(F.lit("described as "), "p_name")))
        .unionByName(rows(part.where("p_size = 9"), kind, fixed.RDFS_COMMENT, F.concat(F.lit("comment on "), "p_name")))
        .unionByName(rows(part.where("p_size = 1"), kind, vocab.DESCRIPTIONS[0], F.concat(F.lit("plainly "), "p_name")))
    )


_BROADER_SQL = """broader AS (SELECT DISTINCT n_nationkey, r FROM (SELECT n_nationkey, n_regionkey AS r FROM nation UNION ALL SELECT n_nationkey, 0 FROM nation WHERE n_nationkey > 8)),
  parents AS (SELECT n_nationkey, string_agg(r_name, ' ' ORDER BY r_name) AS parents FROM broader JOIN region ON r = r_regionkey GROUP BY n_nationkey)"""


@query(f"""WITH {_BROADER_SQL} SELECT 'http://example.org/nation/' || n_nationkey AS uri, n_name AS label, n_name || CASE WHEN n_nationkey < 12 THEN '. nation number ' || n_nationkey ELSE '' END || '. ' || parents AS doc FROM nation JOIN parents USING (n_nationkey)
  UNION ALL SELECT 'http://example.org/region/' || r_regionkey, r_name, r_name FROM region""")
def concept_docs(spark, folder):
    return vocab.concept_docs(_place_triples(spark, folder))


@query(f"WITH {_BROADER_SQL} SELECT 'http://example.org/nation/' || n_nationkey AS uri, parents FROM parents")
def broader_labels(spark, folder):
    triples = _place_triples(spark, folder)
    labels = triples.where(F.col("p") == fixed.SKOS_PREF_LABEL).select(F.col("s").alias("uri"), F.col("o").alias("label"))
    return vocab.parent_labels(triples, labels)


@query("""WITH x AS (SELECT 'http://qudt.org/vocab/quantitykind/' || p_type || '-' || p_brand AS uri, p_type || ' ' || p_name AS l, p_name, p_size FROM part),
  a AS (SELECT uri, coalesce(min(l) FILTER (p_size >= 30), min(l) FILTER (p_size >= 5)) AS label, coalesce(min('plainly ' || p_name) FILTER (p_size = 1), min('described as ' || p_name) FILTER (p_size < 5), min('comment on ' || p_name) FILTER (p_size = 9), '') AS about FROM x GROUP BY uri)
  SELECT uri, label, trim(label || '. ' || about) AS doc FROM a WHERE label <> ''""")
def quantity_kind_docs(spark, folder):
    return vocab.quantity_kind_docs(_place_triples(spark, folder))


@query("""SELECT p_partkey, trim(coalesce(nullif(e, ''), p_type) || '. ' || coalesce(d, '') || ' (' || p_type || ')') AS doc FROM (SELECT *, CASE WHEN p_size < 10 THEN NULL WHEN p_size < 20 THEN '' ELSE p_name END AS e, CASE WHEN p_size > 15 THEN p_brand END AS d FROM part)""")
def feature_class_docs(spark, folder):
    return feature_classes(spark, folder).select("p_partkey", vocab.feature_class_doc().alias("doc"))


def feature_classes(spark, folder):
    size = F.col("p_size")
    return table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("label_nl"), F.when(size >= 20, F.col("p_name")).when(size >= 10, "").alias("label_en"), F.when(size > 15, F.col("p_brand")).alias("def_en"))


@query("""WITH p AS (SELECT 2 * p_partkey AS column_key, CASE WHEN p_size % 4 = 0 THEN '   ' WHEN p_size % 4 = 1 THEN NULL ELSE ' ' || p_name || ' ' END AS phrase FROM part)
  SELECT column_key, trim(phrase) AS phrase FROM p WHERE trim(phrase) <> '' AND column_key IN (SELECT l_partkey FROM lineitem)""")
def phrase_cleaning(spark, folder):
    from obsweave.operators.decide import clean_phrases
    size = F.col("p_size")
    phrases = table(spark, folder, "part").select((2 * F.col("p_partkey")).alias("column_key"), F.when(size % 4 == 0, "   ").when(size % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("phrase"))
    return clean_phrases(phrases, table(spark, folder, "lineitem").select(F.col("l_partkey").alias("column_key")))


@query("""WITH c AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label)
  SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], e), 6) + 0 AS distance FROM embeddings JOIN c USING (label)""")
def cosine_distance(spark, folder):
    vectors = table(spark, folder, "embeddings")
    centre = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centre"))
    return join_small(vectors, centre, "label", "inner").select("vec_id", "label", (F.round(1 - cosine(F.col("embedding"), F.col("centre")), 6) + 0.0).alias("distance"))
