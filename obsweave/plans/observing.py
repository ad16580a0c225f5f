"""Queries on observations, graphs, their integrity, and questions across datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.functions import naming
from obsweave.operators import compete, graph, integrity, reshape
from obsweave.plans import given
from obsweave.plans.registry import query
from obsweave.sources import sinks
from obsweave.sources.tables import table

_OBS = f"WITH {given.LONG_SQL}"
_GRAPH = given.GRAPH_SQL


@query(f"""{_OBS} SELECT property_uri, dataset_id AS dataset, unit_uri, count(value_num) AS n,
    least(min(value_num) * multiplier, max(value_num) * multiplier) AS min_value,
    greatest(min(value_num) * multiplier, max(value_num) * multiplier) AS max_value
  FROM obs JOIN units USING (unit_uri) GROUP BY property_uri, dataset_id, unit_uri, multiplier HAVING count(value_num) > 0""")
def converted_range(spark, folder):
    return compete.converted_range_of_observations(given.observations(spark, folder), given.units(spark))


@query(f"""{_OBS} SELECT property_uri, count(DISTINCT dataset_id) AS datasets, count(*) AS observations,
    string_agg(DISTINCT dataset_id, ', ' ORDER BY dataset_id) AS which
  FROM obs GROUP BY property_uri HAVING count(DISTINCT dataset_id) > 1""")
def shared_properties(spark, folder):
    return compete.shared_properties_of_observations(given.observations(spark, folder))


@query(f"""{_OBS}, {given.DECLARATIONS_SQL} SELECT dataset_id AS dataset, sensor_uri, max(nullif(label, '')) AS label, count(*) AS n
  FROM obs LEFT JOIN entities ON uri = sensor_uri WHERE property_uri = '{given.PROPERTY}price' GROUP BY ALL""")
def sensors_of_property(spark, folder):
    labels = given.entities(spark, folder).where("kind = 'Sensor'").select(F.col("uri").alias("sensor_uri"), F.nullif("label", F.lit("")).alias("label"))
    return compete.sensors_of_observations(given.observations(spark, folder), labels, given.PROPERTY + "price")


@query(f"""{_GRAPH}, o AS (SELECT a.s, b.o AS property_uri, regexp_extract(a.s, '/obs/([^/]+)/', 1) AS dataset FROM triples a JOIN triples b ON a.s = b.s
    WHERE a.p = {given._T} AND a.o = '{given._S}Observation' AND b.p = '{given._S}observedProperty')
  SELECT property_uri, count(DISTINCT dataset) AS datasets, count(*) AS observations, string_agg(DISTINCT dataset, ', ' ORDER BY dataset) AS which
  FROM o GROUP BY 1 HAVING count(DISTINCT dataset) > 1""")
def shared_properties_in_graph(spark, folder):
    return compete.shared_properties(given.whole_graph(spark, folder, compete.NEEDED["shared_properties"]))


@query(f"""{_GRAPH}, o AS (SELECT b.o AS property_uri, regexp_extract(a.s, '/obs/([^/]+)/', 1) AS dataset, r.o AS result
    FROM triples a JOIN triples b ON a.s = b.s JOIN triples r ON a.s = r.s
    WHERE a.p = {given._T} AND a.o = '{given._S}Observation' AND b.p = '{given._S}observedProperty' AND r.p = '{given._S}hasResult'),
  v AS (SELECT n.s, n.o::DOUBLE AS value_num, u.o AS unit_uri, m.o::DOUBLE AS f FROM triples n JOIN triples u ON n.s = u.s JOIN triples m ON u.o = m.s
    WHERE n.p = '{given._Q}numericValue' AND u.p = '{given._Q}unit' AND m.p = '{given._Q}conversionMultiplier')
  SELECT property_uri, dataset, unit_uri, count(*) AS n, min(value_num * f) AS min_value, max(value_num * f) AS max_value
  FROM o JOIN v ON o.result = v.s GROUP BY ALL""")
def converted_range_in_graph(spark, folder):
    return compete.converted_range(given.whole_graph(spark, folder, compete.NEEDED["converted_range"]))


@query(f"""{_GRAPH}, o AS (SELECT c.o AS sensor_uri, regexp_extract(a.s, '/obs/([^/]+)/', 1) AS dataset
    FROM triples a JOIN triples b ON a.s = b.s JOIN triples c ON a.s = c.s
    WHERE a.p = {given._T} AND a.o = '{given._S}Observation' AND b.p = '{given._S}observedProperty' AND b.o = '{given.PROPERTY}rate' AND c.p = '{given._S}madeBySensor')
  SELECT dataset, sensor_uri, l.o AS label, count(*) AS n
  FROM o LEFT JOIN (SELECT s, o FROM triples WHERE p = 'http://www.w3.org/2000/01/rdf-schema#label') l ON l.s = o.sensor_uri GROUP BY ALL""")
def sensors_in_graph(spark, folder):
    return compete.sensors(given.whole_graph(spark, folder, compete.NEEDED["sensors"]), given.PROPERTY + "rate")


@query(f"{_GRAPH} SELECT unit_uri, multiplier::DOUBLE AS multiplier FROM units WHERE unit_uri IN (SELECT o FROM triples WHERE p = '{given._Q}unit')")
def units_in_use(spark, folder):
    return compete.units_in_use(graph.observation_triples(given.observations(spark, folder)), given.units(spark))


@query(f"{_OBS}, {given.OBSERVATION_TRIPLES_SQL} SELECT * FROM observation_triples WHERE s LIKE 'http://example.org/%/orders/%'")
def observation_triples_of_orders(spark, folder):
    return graph.observation_triples(given.observations(spark, folder, "orders"))


@query(f"{_OBS}, {given.OBSERVATION_TRIPLES_SQL} SELECT * FROM observation_triples WHERE s LIKE 'http://example.org/%/part/%'")
def observation_triples_without_time(spark, folder):
    return graph.observation_triples(given.observations(spark, folder, "part"))


@query(f"{_OBS}, {given.OBSERVATION_TRIPLES_SQL} {given.DIGEST_SQL.format(source='observation_triples')}")
def observation_triples(spark, folder):
    return given.digest(graph.observation_triples(given.observations(spark, folder)))


@query(f"WITH {given.SAMPLE_TRIPLES_SQL} SELECT * FROM sample_triples")
def sample_triples(spark, folder):
    return graph.sample_triples(given.sample_rows(spark, folder))


@query(f"WITH {given.DECLARATIONS_SQL} SELECT * FROM declaration_triples")
def declarations(spark, folder):
    return graph.declarations(given.entities(spark, folder))


@query(f"{_GRAPH} {given.DIGEST_SQL.format(source='triples')}")
def merged_graph(spark, folder):
    return given.digest(given.whole_graph(spark, folder))


@query(f"""{_GRAPH}, lines AS (SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>'
    ELSE '"' || replace(replace(replace(replace(o, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') || '"'
      || CASE WHEN o_lang IS NOT NULL THEN '@' || o_lang WHEN o_datatype IS NOT NULL THEN '^^<' || o_datatype || '>' ELSE '' END END || ' .' AS line, p FROM triples)
  SELECT p, count(*) AS n, sum(length(line))::BIGINT AS chars,
    sum(('0x' || substr(md5(line), 1, 8))::BIGINT)::BIGINT AS code FROM lines GROUP BY p""")
def ntriples_lines(spark, folder):
    return digest_lines(given.whole_graph(spark, folder))


def digest_lines(triples):
    """Lines of the triples, counted and hashed by predicate."""
    lines = triples.select("p", sinks.nt_line().alias("line"))
    return lines.groupBy("p").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"),
        F.sum(F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("long")).alias("code"),
    )


@query("""SELECT doc_id, '"' || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') || '"@' || lang AS literal FROM documents""")
def escaped_literals(spark, folder):
    from obsweave.functions.text import escape
    return table(spark, folder, "documents").select("doc_id", F.concat(F.lit('"'), escape(F.col("text")), F.lit('"@'), F.col("lang")).alias("literal"))


@query(f"""{_GRAPH} SELECT CASE WHEN p = {given._T} AND o = '{given._S}Observation' THEN 'Observation' WHEN p = {given._T} THEN 'other type'
    ELSE regexp_extract(p, '([^/]*)$', 1) END AS kind, count(*) AS n FROM triples GROUP BY 1""")
def triple_census(spark, folder):
    return integrity.census(given.whole_graph(spark, folder))


@query(f"""{_OBS}, c AS (SELECT file_id, value_col, count(*) AS n, count(value) AS n_value FROM obs GROUP BY ALL)
  SELECT file_id, max(n) AS n_rows, count(*) AS n_columns, sum(n)::BIGINT AS n_observations, sum(n_value)::BIGINT AS n_values FROM c GROUP BY file_id""")
def expected_counts(spark, folder):
    return integrity.expected_counts(given.observations(spark, folder))


@query(f"""{_GRAPH} SELECT (SELECT count(*) FROM triples) AS triples, (SELECT count(*) FROM triples WHERE p = {given._T} AND o = '{given._S}Observation') AS observations,
    (SELECT count(*) FROM triples WHERE p IN ('{given._Q}numericValue', '{given._S}hasSimpleResult')) AS result_values,
    (SELECT count(*) FROM obs) AS observations_expected, (SELECT count(value) FROM obs) AS values_expected, TRUE AS observations_match, TRUE AS values_match""")
def reconcile_counts(spark, folder):
    expected = integrity.expected_counts(given.observations(spark, folder))
    return integrity.reconcile(expected, integrity.census(given.whole_graph(spark, folder)))


@query(f"""{_GRAPH}, need(class, required) AS (VALUES ('Observation', 'resultTime'), ('Observation', 'madeBySensor'), ('Observation', 'observedProperty'),
    ('Observation', 'hasFeatureOfInterest'), ('Observation', 'hasResult|hasSimpleResult'), ('Sample', 'isSampleOf'), ('Sample', 'isResultOf'),
    ('Sampling', 'madeBySampler'), ('Sampling', 'hasFeatureOfInterest'), ('Sampling', 'resultTime'), ('Sampling', 'hasResult')),
  c AS (SELECT s, class, required, (SELECT count(*) FROM triples x WHERE x.s = t.s AND list_contains(string_split(required, '|'), replace(x.p, '{given._S}', ''))) AS n
    FROM triples t JOIN need ON t.p = {given._T} AND t.o = '{given._S}' || class)
  SELECT class, required, count(*) AS subjects, count_if(n <> 1)::BIGINT AS violations FROM c GROUP BY ALL""")
def integrity_cardinality(spark, folder):
    return integrity.cardinality(given.whole_graph(spark, folder, integrity.NEEDED["cardinality"]))


_LINKS = ", ".join(f"'{p}'" for p in integrity.LINKS)


@query(f"""{_GRAPH} SELECT regexp_extract(p, '([^/]*)$', 1) AS predicate, count(*) AS n
  FROM (SELECT DISTINCT p, o FROM triples WHERE p IN ({_LINKS}) AND o_kind = 'iri')
  WHERE o NOT IN (SELECT s FROM triples WHERE p = {given._T}) GROUP BY 1""")
def integrity_dangling(spark, folder):
    return integrity.dangling(given.whole_graph(spark, folder, integrity.NEEDED["dangling"]))


@query(f"""{_GRAPH}, want(class, link) AS (VALUES ('Sensor', 'madeBySensor'), ('ObservableProperty', 'observedProperty'), ('FeatureOfInterest', 'hasFeatureOfInterest'), ('Sampler', 'madeBySampler'))
  SELECT class, count(*) AS n FROM triples t JOIN want ON t.p = {given._T} AND t.o = '{given._S}' || class
  WHERE NOT EXISTS (SELECT 1 FROM triples x WHERE x.p = '{given._S}' || link AND x.o = t.s) GROUP BY class""")
def integrity_unused(spark, folder):
    return integrity.unused(given.whole_graph(spark, folder, integrity.NEEDED["unused"]))


@query(f"""{_GRAPH}, q AS (SELECT s FROM triples WHERE p = {given._T} AND o = '{given._Q}QuantityValue')
  SELECT (SELECT count(*) FROM q) AS quantity_values,
    (SELECT count(*) FROM q WHERE s NOT IN (SELECT s FROM triples WHERE p = '{given._Q}numericValue')) AS without_value,
    (SELECT count(*) FROM q WHERE s NOT IN (SELECT s FROM triples WHERE p = '{given._Q}unit')) AS without_unit,
    (SELECT count(*) FROM triples WHERE p = '{given._S}resultTime' AND o_datatype IS DISTINCT FROM '{given._X}dateTime') AS times_not_datetime""")
def integrity_completeness(spark, folder):
    return integrity.completeness(given.whole_graph(spark, folder, integrity.NEEDED["completeness"]))


@query(f"""{_GRAPH} SELECT (SELECT count(*) FROM triples WHERE o = '{given._S}Sample') AS samples, (SELECT count(*) FROM triples WHERE o = '{given._S}Sampling') AS samplings,
    (SELECT count(*) FROM triples WHERE p = '{given._S}isSampleOf') AS samples_with_feature, (SELECT count(*) FROM triples WHERE p = '{given._S}madeBySampler') AS samplings_with_sampler,
    (SELECT count(*) FROM triples WHERE p = '{given._S}hasFeatureOfInterest' AND o IN (SELECT s FROM triples WHERE o = '{given._S}Sample')) AS observations_about_a_sample""")
def sample_shape(spark, folder):
    return integrity.sample_shape(given.whole_graph(spark, folder, integrity.NEEDED["sample_shape"]))


@query(f"""{_GRAPH}, sampled_file(file_id) AS (VALUES ('orders'), ('events'))
  SELECT file_id, count(*) AS n FROM (SELECT s, regexp_extract(s, '/obs/[^/]+/([^/]+)/', 1) AS file_id FROM triples WHERE o = '{given._S}Observation')
  JOIN sampled_file USING (file_id) WHERE s NOT IN (SELECT s FROM triples WHERE p = '{given._S}hasFeatureOfInterest' AND o IN (SELECT s FROM triples WHERE o = '{given._S}Sample')) GROUP BY file_id""")
def observations_not_about_samples(spark, folder):
    files = spark.createDataFrame([("orders",), ("events",)], "file_id string")
    return integrity.not_about_samples(given.whole_graph(spark, folder, integrity.NEEDED["not_about_samples"]), files)


@query("""SELECT slug, count(*) AS n FROM (SELECT DISTINCT p_name || ' ' || p_type AS value_col, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part
    UNION SELECT DISTINCT p_type || '/' || p_name, trim(regexp_replace(lower(p_type || '/' || p_name), '[^a-z0-9]+', '-', 'g'), '-') FROM part
    UNION SELECT DISTINCT p_name || '-' || p_type, trim(regexp_replace(lower(p_name || '-' || p_type), '[^a-z0-9]+', '-', 'g'), '-') FROM part) GROUP BY slug HAVING count(*) > 1""")
def slug_collisions(spark, folder):
    part = table(spark, folder, "part")
    names = F.array(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws("/", "p_type", "p_name"), F.concat_ws("-", "p_name", "p_type"))
    rows = part.select(F.lit("part").alias("dataset_id"), F.lit("part").alias("file_id"), F.explode(names).alias("value_col")).distinct()
    return reshape.slug_collisions(rows).select("slug", "n")


@query("""SELECT regexp_extract(url, '([^/]*)$', 1) AS last_segment, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
    trim(regexp_replace(lower(regexp_replace(url, '\\.[^./]+$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS file_id,
    CASE WHEN contains(url, 'quantitykind/') THEN 'qudt:' || regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) WHEN contains(url, '/vocab/unit/') THEN 'unit:' || regexp_extract(rtrim(url, '/'), '([^/]*)$', 1)
      WHEN contains(url, '/concept/') THEN 'gemet:' || regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) WHEN contains(url, 'gwsw.nl') THEN 'gwsw:' || regexp_extract(rtrim(url, '/'), '([^/]*)$', 1)
      ELSE url END AS token, count(*) AS n FROM (SELECT unnest([url, replace(url, '/en/', '/concept/'), replace(url, 'example.com', 'gwsw.nl'), replace(url, '/fr/', '/vocab/unit/')]) AS url FROM pages) GROUP BY ALL""")
def identifiers(spark, folder):
    u = F.col("url")
    forms = F.array(u, F.replace(u, F.lit("/en/"), F.lit("/concept/")), F.replace(u, F.lit("example.com"), F.lit("gwsw.nl")), F.replace(u, F.lit("/fr/"), F.lit("/vocab/unit/")))
    urls = table(spark, folder, "pages").select(F.explode(forms).alias("url"))
    return urls.groupBy(naming.last_segment(u).alias("last_segment"), naming.slug(u).alias("slug"), naming.file_id(u).alias("file_id"), naming.token(u).alias("token")).agg(F.count(F.lit(1)).alias("n"))
