"""Queries on scoring: documents with labels as gold, embeddings as predictions of four runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.operators import score
from obsweave.plans.registry import query
from obsweave.sources.tables import table

CONCEPT = "http://example.org/concept/"
RUNS = [1, 2, 3, 4]

_TOKEN = """CASE WHEN {0} IS NULL OR {0} = '' THEN NULL WHEN contains({0}, '/vocab/unit/') THEN 'unit:' || regexp_extract({0}, '([^/]*)$', 1) WHEN contains({0}, '/concept/') THEN 'gemet:' || regexp_extract({0}, '([^/]*)$', 1)
  WHEN contains({0}, 'gwsw.nl') THEN 'gwsw:' || regexp_extract({0}, '([^/]*)$', 1) WHEN contains({0}, 'example.org/property/') OR starts_with({0}, 'ex:property/') THEN 'mint:' || regexp_extract({0}, '([^/]*)$', 1) ELSE {0} END"""
_UNIT = "replace(" + _TOKEN + ", 'unit:MicroS-PER-CentiM', 'unit:MicroS-PER-CM')"

SQL = f"""raw_gold AS (SELECT doc_id AS key, CASE WHEN toxic = 1 THEN 'ex:property/' || lang ELSE '{CONCEPT}' || lang END AS observedProperty, CASE WHEN toxic = 1 THEN 'mint' ELSE 'reuse' END AS decision,
    CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'unit:MicroS-PER-CentiM' ELSE 'unit:' || source END AS unit, CASE WHEN doc_id % 4 > 0 THEN 'gwsw:' || source END AS feature_gwsw, source AS sensor,
    CASE WHEN n_chars > 2000 THEN ['gemet:en', 'mint:*'] WHEN n_chars > 1000 THEN ['{CONCEPT}fr'] ELSE [] END AS accept, CASE n_chars % 5 WHEN 0 THEN 'Expert: yes' WHEN 1 THEN 'an APPROXIMATE match' END AS note, lang, source AS src
  FROM documents LEFT JOIN labels USING (doc_id)),
gold AS (SELECT key, {_TOKEN.format('observedProperty')} AS property, decision AS source, {_UNIT.format('unit')} AS unit, coalesce({_TOKEN.format('feature_gwsw')}, 'untyped') AS feature, sensor,
    list_transform(accept, lambda a: CASE WHEN a = 'mint:*' THEN a WHEN contains(a, '/concept/') THEN 'gemet:' || regexp_extract(a, '([^/]*)$', 1) ELSE a END) AS accept, coalesce(contains(lower(note), 'approximate') OR contains(lower(note), 'expert'), FALSE) AS soft, src FROM raw_gold),
pred AS (SELECT run, vec_id * 2 AS key, CASE WHEN (label + run) % 5 = 0 THEN 'mint:' || lang ELSE 'gemet:' || lang END AS property, CASE WHEN (label + run) % 5 = 0 THEN 'mint' ELSE 'reuse' END AS source,
    CASE WHEN label = 3 THEN 'unit:MicroS-PER-CM' WHEN label = 4 THEN NULL ELSE 'unit:src' || (vec_id * 2 % 20) END AS unit, CASE WHEN label > 6 THEN 'untyped' ELSE 'gwsw:src' || (vec_id * 2 % 20) END AS feature, 'sensor ' || label AS sensor
  FROM embeddings JOIN documents ON doc_id = vec_id, (VALUES (1), (2), (3), (4)) r(run) WHERE (vec_id + run) % 11 > 0),
menus AS (SELECT DISTINCT key, 'gemet:' || l AS token FROM (SELECT doc_id + n_chars % 2 AS key, unnest([lang, 'en']) AS l FROM documents)),
cmp AS (SELECT coalesce(g.key, p.key) AS key, coalesce(g.run, p.run) AS run, CASE WHEN g.key IS NOT NULL AND p.key IS NOT NULL THEN 'matched' WHEN g.key IS NOT NULL THEN 'missed' ELSE 'spurious' END AS status, g.* EXCLUDE (key, run), p.property AS p_property, p.source AS p_source, p.unit AS p_unit, p.feature AS p_feature, p.sensor AS p_sensor
  FROM (SELECT gold.*, run FROM gold, (VALUES (1), (2), (3), (4)) r(run)) g FULL JOIN pred p ON g.key = p.key AND g.run = p.run),
m0 AS (SELECT *, CASE WHEN source = 'mint' THEN p_source = 'mint' ELSE property = p_property END AS prop_ok FROM cmp WHERE status = 'matched'),
marked AS (SELECT m0.*, prop_ok OR list_contains(accept, p_property) OR (list_contains(accept, 'mint:*') AND p_source = 'mint') AS len_ok, source = p_source AS rm_ok, unit IS NOT DISTINCT FROM p_unit AS unit_ok, feature = p_feature AS feature_ok,
    CASE WHEN source = 'reuse' THEN (m0.key, property) IN (SELECT (key, token) FROM menus) END AS in_menu FROM m0)"""

_LAYERS = f"""sides AS (SELECT run, count_if(status <> 'spurious') AS n_gold, count_if(status <> 'missed') AS n_pred, count_if(status = 'matched') AS n_matched, count_if(status = 'spurious') AS n_spurious FROM cmp GROUP BY run),
hits AS (SELECT run, count(in_menu) AS menu_total, count_if(in_menu) AS menu_hits, count_if(NOT soft) AS strict_total, count_if(NOT soft AND prop_ok) AS strict_hits, count_if(prop_ok) AS property_hits, count_if(len_ok) AS property_lenient_hits, count_if(rm_ok) AS reuse_mint_hits, count_if(unit_ok) AS unit_hits, count_if(feature_ok) AS feature_hits FROM marked GROUP BY run),
layers AS (SELECT run, n_gold::BIGINT AS n_gold, n_pred::BIGINT AS n_pred, n_matched::BIGINT AS n_matched, n_spurious::BIGINT AS n_spurious, menu_total, menu_hits::BIGINT AS menu_hits, strict_total::BIGINT AS strict_total, strict_hits::BIGINT AS strict_hits, property_hits::BIGINT AS property_hits, property_lenient_hits::BIGINT AS property_lenient_hits,
  reuse_mint_hits::BIGINT AS reuse_mint_hits, unit_hits::BIGINT AS unit_hits, feature_hits::BIGINT AS feature_hits, n_matched / n_gold AS coverage, n_spurious / n_pred AS spurious_rate, menu_hits / menu_total AS menu_recall, strict_hits / strict_total AS property_strict,
  property_hits / n_matched AS property_acc, property_lenient_hits / n_matched AS property_lenient_acc, reuse_mint_hits / n_matched AS reuse_mint_acc, unit_hits / n_matched AS unit_acc, feature_hits / n_matched AS feature_acc FROM sides JOIN hits USING (run))"""

_RATES = ["coverage", "spurious_rate", "menu_recall", "property_strict", "property_acc", "property_lenient_acc", "reuse_mint_acc", "unit_acc", "feature_acc"]


def raw_gold(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    toxic, key, n = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("doc_id"), F.col("n_chars")
    none = F.array().cast("array<string>")
    return docs.select(
        key.alias("key"), F.when(toxic, F.concat(F.lit("ex:property/"), "lang")).otherwise(F.concat(F.lit(CONCEPT), "lang")).alias("observedProperty"), F.when(toxic, "mint").otherwise("reuse").alias("decision"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 7 == 1, "unit:MicroS-PER-CentiM").otherwise(F.concat(F.lit("unit:"), "source")).alias("unit"), F.when(key % 4 > 0, F.concat(F.lit("gwsw:"), "source")).alias("feature_gwsw"),
        F.col("source").alias("sensor"), F.when(n > 2000, F.array(F.lit("gemet:en"), F.lit("mint:*"))).when(n > 1000, F.array(F.lit(CONCEPT + "fr"))).otherwise(none).alias("accept"),
        F.when(n % 5 == 0, "Expert: yes").when(n % 5 == 1, "an APPROXIMATE match").alias("note"), F.col("source").alias("src"),
    )


def gold(spark, folder):
    return score.gold_rows(raw_gold(spark, folder))


def pred(spark, folder):
    rows = table(spark, folder, "embeddings").join(table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")
    rows = score.for_runs(rows, RUNS).where((F.col("vec_id") + F.col("run")) % 11 > 0)
    mint, label, key = (F.col("label") + F.col("run")) % 5 == 0, F.col("label"), F.col("vec_id") * 2
    place = (key % 20).cast("string")
    return rows.select(
        "run", key.alias("key"), F.concat(F.when(mint, "mint:").otherwise("gemet:"), "lang").alias("property"), F.when(mint, "mint").otherwise("reuse").alias("source"),
        F.when(label == 3, "unit:MicroS-PER-CM").when(label == 4, F.lit(None)).otherwise(F.concat(F.lit("unit:src"), place)).alias("unit"),
        F.when(label > 6, "untyped").otherwise(F.concat(F.lit("gwsw:src"), place)).alias("feature"), F.concat(F.lit("sensor "), label.cast("string")).alias("sensor"),
    )


def menus(spark, folder):
    # every second menu is that of the next document, so some columns lack their concept
    docs, key = table(spark, folder, "documents"), F.col("doc_id") + F.col("n_chars") % 2
    langs = docs.select(key.alias("key"), F.explode(F.array("lang", F.lit("en"))).alias("l"))
    return langs.select("key", F.concat(F.lit(CONCEPT), "l").alias("uri"))


def compared(spark, folder):
    return score.compare(score.for_runs(gold(spark, folder), RUNS), pred(spark, folder), ["run"])


def marked(spark, folder):
    return score.mark(compared(spark, folder), menus(spark, folder))


def layers(spark, folder):
    return score.layers(compared(spark, folder), marked(spark, folder), ["run"])


@query(f"WITH {SQL} SELECT key, property, source, unit, feature, sensor, array_to_string(accept, ',') AS accept, soft FROM gold")
def gold_rows(spark, folder):
    return gold(spark, folder).drop("src").withColumn("accept", F.array_join("accept", ","))


@query(f"WITH {SQL} SELECT run, status, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM cmp GROUP BY ALL")
def decision_comparison(spark, folder):
    return compared(spark, folder).groupBy("run", "status").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query(f"WITH {SQL} SELECT run, key, prop_ok, len_ok AS prop_ok_lenient, rm_ok, unit_ok, feature_ok, in_menu FROM marked")
def scored_rows(spark, folder):
    return marked(spark, folder).select("run", "key", "prop_ok", "prop_ok_lenient", "rm_ok", "unit_ok", "feature_ok", "in_menu")


@query(f"WITH {SQL}, {_LAYERS} SELECT * EXCLUDE ({', '.join(_RATES)}), {', '.join(f'round({r}, 6) AS {r}' for r in _RATES)} FROM layers")
def decision_layers(spark, folder):
    return layers(spark, folder).withColumns({r: F.round(r, 6) for r in _RATES})


_AGREE = """c AS (SELECT grp, coalesce(a, 'None') AS a, coalesce(b, 'None') AS b, count(*) AS n FROM pairs GROUP BY ALL), t AS (SELECT grp, sum(n) AS n, sum(n * (n - 1) / 2) AS idx FROM c GROUP BY grp),
sa AS (SELECT grp, sum(n * (n - 1) / 2) AS sa FROM (SELECT grp, a, sum(n) AS n FROM c GROUP BY ALL) GROUP BY grp), sb AS (SELECT grp, sum(n * (n - 1) / 2) AS sb FROM (SELECT grp, b, sum(n) AS n FROM c GROUP BY ALL) GROUP BY grp),
pr AS (SELECT grp, n::BIGINT AS n, CASE WHEN sb > 0 THEN idx / sb ELSE 1 END AS p, CASE WHEN sa > 0 THEN idx / sa ELSE 1 END AS r, idx, sa, sb, sa * sb / (n * (n - 1) / 2) AS e, (sa + sb) / 2 AS mx FROM t JOIN sa USING (grp) JOIN sb USING (grp))
SELECT {grp}, n, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, round(CASE WHEN n < 2 OR mx = e THEN 1 ELSE (idx - e) / (mx - e) END, 9) AS ari FROM pr"""


def _rounded(df, names=("precision", "recall", "f1", "ari")):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"WITH {SQL}, pairs AS (SELECT run AS grp, sensor AS a, p_sensor AS b FROM cmp WHERE status = 'matched'), " + _AGREE.format(grp="grp AS run"))
def sensor_agreement(spark, folder):
    return _rounded(score.sensor_agreement(compared(spark, folder), ["run"]))


@query("WITH pairs AS (SELECT lang AS grp, source AS a, CASE WHEN n_chars > 100 THEN (n_chars % 9)::VARCHAR END AS b FROM documents), " + _AGREE.format(grp="grp AS lang"))
def partition_agreement(spark, folder):
    pairs = table(spark, folder, "documents").select("lang", F.col("source").alias("a"), F.when(F.col("n_chars") > 100, (F.col("n_chars") % 9).cast("string")).alias("b"))
    return _rounded(score.partition_agreement(pairs, ["lang"]))


@query("""WITH m AS (SELECT l_shipdate::DATE::VARCHAR AS a, l_partkey::VARCHAR AS b FROM lineitem), pairs AS (SELECT 0 AS grp, a, b FROM m), """ + _AGREE.format(grp="'lineitem' AS name"))
def partition_agreement_of_rows(spark, folder):
    pairs = table(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("a"), F.col("l_partkey").alias("b"))
    return _rounded(score.partition_agreement(pairs)).withColumn("name", F.lit("lineitem"))


@query(f"WITH {SQL} SELECT run, property AS concept, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_property)), ',') AS answers, count(DISTINCT p_property) = 1 AS converged FROM marked GROUP BY run, property HAVING count(*) >= 2")
def harmonization(spark, folder):
    groups = score.harmonization(marked(spark, folder), ["run"])
    return groups.withColumn("answers", F.array_join("answers", ","))


@query(f"WITH {SQL}, g AS (SELECT unit AS property, count(*) AS n, count(DISTINCT p_feature) = 1 AS converged FROM marked WHERE unit IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) SELECT count(*) AS groups, count_if(converged)::BIGINT AS converged, round(count_if(converged) / count(*), 6) AS rate FROM g")
def harmonization_rate(spark, folder):
    rows = marked(spark, folder).where("g_unit is not null").select(F.col("g_unit").alias("g_property"), F.col("p_feature").alias("p_property"))
    return score.harmonization_rate(score.harmonization(rows)).withColumn("rate", F.round("rate", 6))


_CONV = """r AS (SELECT run, g.src AS family, property AS concept, p.chosen FROM (SELECT * FROM gold, (VALUES (1), (2), (3), (4)) r(run)) g
    LEFT JOIN (SELECT run, key, property AS chosen FROM pred) p USING (run, key)),
  c AS (SELECT run, concept, family, chosen, count(*) AS n FROM r GROUP BY ALL),
  w AS (SELECT run, concept, count(DISTINCT family) AS families, sum(n)::BIGINT AS columns FROM c GROUP BY run, concept HAVING count(DISTINCT family) >= 2)"""


def _families(spark, folder):
    rows = gold(spark, folder).withColumn("family", F.col("src"))
    found = pred(spark, folder).join(rows.select("key", "family"), "key")
    return score.convergence(score.for_runs(rows, RUNS), found, ["run"])


@query(f"""WITH {SQL}, {_CONV}, a AS (SELECT run, concept, chosen, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
  x AS (SELECT run, concept, chosen, n, row_number() OVER (PARTITION BY run, concept ORDER BY n DESC, chosen NULLS LAST) AS k FROM a)
  SELECT w.*, chosen AS most_common, n AS on_most_common FROM w JOIN x USING (run, concept) WHERE k = 1""")
def convergence(spark, folder):
    return _families(spark, folder)[0]


@query(f"WITH {SQL}, {_CONV} SELECT c.* FROM c JOIN w USING (run, concept)")
def convergence_counts(spark, folder):
    return _families(spark, folder)[1]


_METRICS = ", ".join("{'m': '" + r + "', 'v': " + r + "}" for r in _RATES)


@query(f"WITH {SQL}, {_LAYERS}, v AS (SELECT unnest([{_METRICS}]) AS x FROM layers) SELECT x.m AS metric, round(avg(x.v), 6) AS mean, round(stddev_pop(x.v), 6) AS std, count(x.v) AS runs FROM v GROUP BY 1")
def run_variance(spark, folder):
    return score.run_variance(layers(spark, folder), _RATES).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"WITH {SQL} SELECT key, count(*) AS runs, count_if(prop_ok)::BIGINT AS correct_runs, array_to_string(list_sort(list(DISTINCT p_property)), ',') AS answers FROM marked GROUP BY key")
def stability(spark, folder):
    return score.stability(marked(spark, folder)).withColumn("answers", F.array_join("answers", ","))


@query(f"WITH {SQL} SELECT run, source, count(*) AS n FROM (SELECT DISTINCT run, property, source FROM pred) GROUP BY ALL")
def property_sources(spark, folder):
    return score.property_sources(pred(spark, folder).select("run", "property", "source").distinct(), ["run"])


@query("""WITH k AS (SELECT vec_id AS key, CASE label WHEN 1 THEN 'derived' WHEN 2 THEN 'quality' WHEN 3 THEN 'diagnostic' WHEN 4 THEN 'measurement' END AS column_class FROM embeddings WHERE label <> 6)
  SELECT column_class, count(*) AS demoted, count(l.doc_id) AS wrong_demotions FROM k LEFT JOIN labels l ON l.doc_id = key WHERE column_class <> 'measurement' GROUP BY column_class""")
def demotions(spark, folder):
    label = F.col("label")
    cls = F.when(label == 1, "derived").when(label == 2, "quality").when(label == 3, "diagnostic").when(label == 4, "measurement")
    resolved = table(spark, folder, "embeddings").select(F.col("vec_id").alias("column_key"), cls.alias("column_class"), F.when(label == 6, "quality_flag").otherwise("unknown").alias("role"))
    return score.demotions(resolved, table(spark, folder, "labels").select(F.col("doc_id").alias("key")))


_PHRASES = "SELECT doc_id AS key, split_part(text, ' ', 1) AS a, CASE WHEN n_chars % 3 > 0 THEN split_part(text, ' ', CASE WHEN n_chars % 7 = 0 THEN 2 ELSE 1 END) END AS b, CASE WHEN n_chars % 3 > 0 THEN split_part(text, ' ', 1) END AS c, lower(split_part(text, ' ', 1)) AS d FROM documents"


@query(f"WITH p AS ({_PHRASES}) SELECT count(*) AS keys, count_if(a IS NOT DISTINCT FROM b AND a IS NOT DISTINCT FROM c)::BIGINT AS identical_runs, count_if(a IS NOT DISTINCT FROM d)::BIGINT AS identical_other FROM p")
def phrase_agreement(spark, folder):
    n = F.col("n_chars")
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    forms = {"meta_1": word(1), "meta_2": F.when(n % 3 > 0, F.when(n % 7 == 0, word(2)).otherwise(word(1))), "meta_3": F.when(n % 3 > 0, word(1)), "nometa": F.lower(word(1))}
    rows = F.array(*[F.struct(F.lit(r).alias("run"), p.alias("phrase")) for r, p in forms.items()])
    phrases = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), F.inline(rows)).where("phrase is not null")
    return score.phrase_agreement(phrases, ["meta_1", "meta_2", "meta_3"], ("meta_1", "nometa"))


@query("""WITH f AS (SELECT DISTINCT 2 * l_partkey AS k FROM lineitem), e AS (SELECT 3 * p_partkey AS k FROM part)
  SELECT count(*) FILTER (f.k IS NOT NULL AND e.k IS NOT NULL) AS true_positive, count(*) FILTER (e.k IS NULL) AS false_positive, count(*) FILTER (f.k IS NULL) AS false_negative FROM f FULL JOIN e ON f.k = e.k""")
def detection_confusion(spark, folder):
    found = table(spark, folder, "lineitem").select((2 * F.col("l_partkey")).alias("key"))
    return score.detection_confusion(found, table(spark, folder, "part").select((3 * F.col("p_partkey")).alias("key")), ["key"])


@query("""WITH f AS (SELECT DISTINCT 2 * l_partkey AS k FROM lineitem), e AS (SELECT 3 * p_partkey AS k FROM part)
  SELECT count(*) AS in_any, count(*) FILTER (f.k IS NOT NULL AND e.k IS NOT NULL) AS in_both, count(*) FILTER (e.k IS NULL) AS only_a, count(*) FILTER (f.k IS NULL) AS only_b FROM f FULL JOIN e ON f.k = e.k""")
def key_sets(spark, folder):
    found = table(spark, folder, "lineitem").select((2 * F.col("l_partkey")).alias("key"))
    return score.key_sets(found, table(spark, folder, "part").select((3 * F.col("p_partkey")).alias("key")))


_VOCAB = "vocabulary AS (SELECT DISTINCT 'gemet:' || lang AS token FROM documents WHERE lang <> 'es' UNION SELECT DISTINCT 'unit:' || source FROM documents WHERE doc_id % 3 > 0 AND source < 'src5' UNION SELECT DISTINCT 'gwsw:' || source FROM documents)"


def _vocabulary(spark, folder):
    docs = table(spark, folder, "documents")
    name = lambda df, prefix, c: df.select(F.concat(F.lit(prefix), c).alias("token"))
    return name(docs.where("lang <> 'es'"), "gemet:", "lang").union(name(docs.where("doc_id % 3 > 0 and source < 'src5'"), "unit:", "source")).union(name(docs, "gwsw:", "source")).distinct()


@query(f"WITH {SQL}, {_VOCAB}, n AS (SELECT DISTINCT unnest(list_concat([{_TOKEN.format('observedProperty')}, unit, feature_gwsw], accept)) AS token FROM raw_gold) SELECT token FROM n WHERE token IS NOT NULL AND NOT regexp_matches(token, '^(mint|ex):') AND token NOT IN (SELECT token FROM vocabulary)")
def unknown_identifiers(spark, folder):
    from obsweave.functions.naming import token
    rows = raw_gold(spark, folder).withColumn("observedProperty", token(F.col("observedProperty")))
    return score.unknown_identifiers(rows, _vocabulary(spark, folder))


@query(f"""WITH {SQL}, {_VOCAB}, a AS (SELECT vec_id * 2 AS key, CASE WHEN label = 0 THEN 'MINT' WHEN label = 1 THEN '{CONCEPT}' || 'xx' || vec_id ELSE '{CONCEPT}' || lang END AS uri FROM embeddings JOIN documents ON doc_id = vec_id),
  b AS (SELECT key, uri = 'MINT' AS minted, CASE WHEN uri <> 'MINT' THEN 'gemet:' || regexp_extract(uri, '([^/]*)$', 1) END AS token FROM a), c AS (SELECT *, NOT minted AND token NOT IN (SELECT token FROM vocabulary) AS missing FROM b), o AS (SELECT c.*, property, source FROM c JOIN gold USING (key))
  SELECT count(*) AS n, count_if(token = property)::BIGINT AS correct, count_if((source = 'mint') = minted)::BIGINT AS reuse_mint, count_if(minted)::BIGINT AS minted, count_if(missing)::BIGINT AS missing_gold,
    (SELECT count_if(NOT minted)::BIGINT FROM c) AS uris_total, (SELECT count_if(missing)::BIGINT FROM c) AS uris_missing, round(count_if(token = property) / count(*), 6) AS property_acc, round(count_if((source = 'mint') = minted) / count(*), 6) AS reuse_mint_acc FROM o""")
def nonexistent_answers(spark, folder):
    rows = table(spark, folder, "embeddings").join(table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")
    label, key = F.col("label"), F.col("vec_id")
    uri = F.when(label == 0, "MINT").when(label == 1, F.concat(F.lit(CONCEPT + "xx"), key.cast("string"))).otherwise(F.concat(F.lit(CONCEPT), "lang"))
    answers = rows.select((key * 2).alias("key"), uri.alias("property_uri"))
    out = score.nonexistent_answers(gold(spark, folder), answers, _vocabulary(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("property_acc", "reuse_mint_acc")})


@query(f"""WITH {SQL} SELECT run, 'property' AS kind, key, property AS gold, p_property AS pred FROM marked WHERE NOT prop_ok UNION ALL SELECT run, 'unit', key, unit, p_unit FROM marked WHERE NOT unit_ok
  UNION ALL SELECT run, 'missed', key, property, NULL FROM cmp WHERE status = 'missed' UNION ALL SELECT run, 'spurious', key, NULL, p_property FROM cmp WHERE status = 'spurious'""")
def error_listing(spark, folder):
    return score.error_listing(compared(spark, folder), marked(spark, folder), ["run"])


@query("""SELECT event_type AS config, user_id % 3 AS tool, count(*) AS calls, round(sum(value), 4) AS seconds, round(avg(value), 6) AS mean_seconds, max(value) AS max_seconds, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS input_tokens, sum(length(props))::BIGINT AS output_tokens FROM events GROUP BY ALL""")
def call_log_summary(spark, folder):
    log = table(spark, folder, "events").select(
        F.col("event_type").alias("config"), (F.col("user_id") % 3).alias("tool"), F.col("value").alias("seconds"),
        F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), F.length("props").alias("output_tokens"),
    )
    return score.call_log_summary(log, ["config", "tool"]).withColumns({"seconds": F.round("seconds", 4), "mean_seconds": F.round("mean_seconds", 6)})


@query("""WITH d AS (SELECT vec_id AS key, 'http://example.org/' || CASE WHEN label % 2 = 0 THEN 'concept/' ELSE 'property/' END || label AS uri, CASE WHEN label % 2 = 0 THEN 'reuse' ELSE 'mint' END AS source, label FROM embeddings WHERE label <> 7)
  SELECT key, CASE WHEN label % 2 = 0 THEN 'gemet:' ELSE 'mint:' END || label AS property, source, CASE WHEN label = 5 THEN 'unit:MicroS-PER-CM' WHEN label = 6 THEN NULL ELSE 'unit:U' || label END AS unit, CASE WHEN label < 4 THEN 'gwsw:C' || label ELSE 'untyped' END AS feature, 'probe ' || label AS sensor FROM d""")
def predictions(spark, folder):
    label = F.col("label")
    text = label.cast("string")
    vectors = table(spark, folder, "embeddings")
    unit = F.when(label == 5, "MicroS-PER-CentiM").otherwise(F.concat(F.lit("U"), text))
    resolved = vectors.select(
        F.col("vec_id").alias("column_key"), F.lit("f.csv").alias("file"), F.lit("c").alias("column"), F.when(label == 7, "quality_flag").otherwise("unknown").alias("role"),
        F.concat(F.lit("http://example.org/"), F.when(label % 2 == 0, "concept/").otherwise("property/"), text).alias("property_uri"),
        F.when(label != 6, F.concat(F.lit("http://qudt.org/vocab/unit/"), unit)).alias("unit_uri"), text.alias("feature_id"), F.concat(F.lit("probe "), text).alias("sensor_id"),
    )
    registry = resolved.select("property_uri").distinct().withColumn("source", F.when(F.contains("property_uri", F.lit("/property/")), "minted").otherwise("gemet"))
    features = vectors.where("label < 4").select(text.alias("id"), F.concat(F.lit("http://data.gwsw.nl/C"), text).alias("class_uri")).distinct()
    return score.predictions(resolved, registry, features).drop("file", "column")
