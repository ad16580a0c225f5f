"""The given tables seen as sensor datasets, and the same views in SQL.

lineitem: one file, four value columns, a time, one sensor per supplier.
orders: a sampled file, every row one sample taken by the customer's sampler.
part: a file without a time.
events: two value columns (the value and k of the properties), one sensor per user.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.functions import naming, values
from obsweave.operators import graph, reshape
from obsweave.session import spread
from obsweave.sources.tables import table

PROPERTY = "http://example.org/property/"
UNIT = "http://qudt.org/vocab/unit/"

_P, _U, _F = PROPERTY, UNIT, "http://example.org/feature/"
MAPPING = [
    ("lineitem", "lineitem", "l_quantity", "xsd:double", None, _P + "quantity", None, _F + "lineitem/store", False, None, None),
    ("lineitem", "lineitem", "l_extendedprice", "xsd:double", None, _P + "price", _U + "CCY_CENT", _F + "lineitem/store", False, None, None),
    ("lineitem", "lineitem", "l_discount", "xsd:double", None, _P + "rate", _U + "PERCENT", _F + "lineitem/store", False, None, None),
    ("lineitem", "lineitem", "l_tax", "xsd:double", None, _P + "rate", _U + "UNITLESS", None, False, None, None),
    ("orders", "orders", "o_totalprice", "xsd:double", "http://example.org/sensor/orders/till", _P + "price", _U + "CCY", None, True, None, _F + "orders/desk"),
    ("part", "part", "p_retailprice", "xsd:double", None, _P + "price", _U + "CCY", _F + "part/shelf", False, None, None),
    ("part", "part", "p_size", "xsd:double", None, _P + "size", _U + "MilliM", _F + "part/shelf", False, None, None),
    ("events", "events", "value", "xsd:double", None, _P + "price", _U + "CCY_CENT", _F + "events/site", False, None, None),
    ("events", "events", "k", "xsd:double", None, _P + "quantity", None, _F + "events/site", False, None, None),
]
MULTIPLIERS = [
    (UNIT + "CCY_CENT", 0.01), (UNIT + "CCY", 1.0), (UNIT + "PERCENT", 0.01), (UNIT + "UNITLESS", 1.0), (UNIT + "MilliM", 0.001),
]
TABLES = ["lineitem", "orders", "part", "events"]


def mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPING, reshape.MAPPING)


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MULTIPLIERS, "unit_uri string, multiplier double")


def file_row(name: str):
    """Position of a parquet row in its file; rows of further part files carry the name of their file."""
    index = F.col("_metadata.row_index").cast("string")
    return F.when(F.col("_metadata.file_name") == f"{name}.parquet", index).otherwise(F.concat(F.col("_metadata.file_name"), F.lit("-"), index))


def _sensor(dataset: str, column: str):
    return naming.scoped_uri("sensor", F.lit(dataset), F.col(column).cast("string")).alias("row_sensor_uri")


def long(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Long rows of one table."""
    df = table(spark, folder, name)
    no = F.lit(None).cast("string")
    if name == "lineitem":
        # its row numbers come from the scan; a file of one row group is then spread over the cores
        cols = ["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        df = spread(df.select(*cols, file_row(name).alias("_row")), "_row")
        return reshape.unpivot(df, name, F.col("_row"), values.iso(F.col("l_shipdate")), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], _sensor(name, "l_suppkey"), no.alias("row_sampler_uri"))
    if name == "orders":
        return reshape.unpivot(df, name, F.col("o_orderkey"), values.iso(F.col("o_orderdate")), ["o_totalprice"], no.alias("row_sensor_uri"), naming.scoped_uri("sampler", F.lit(name), F.col("o_custkey").cast("string")).alias("row_sampler_uri"))
    if name == "part":
        return reshape.unpivot(df, name, F.col("p_partkey"), no, ["p_retailprice", "p_size"], _sensor(name, "p_brand"), no.alias("row_sampler_uri"))
    df = df.withColumn("k", F.get_json_object("props", "$.k"))
    return reshape.unpivot(df, name, F.col("event_id"), values.iso(F.col("ts")), ["value", "k"], _sensor(name, "user_id"), no.alias("row_sampler_uri"))


def observations(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """Observations of the named tables (all by default)."""
    kept = mapping(spark)
    parts = [reshape.observations(long(spark, folder, n), kept) for n in names or TABLES]
    return graph.add(*parts)


def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sample of the sampled file; with one file its URI prefixes are constants."""
    name = F.lit("orders")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("row"), values.iso(F.col("o_orderdate")).alias("result_time"),
        naming.row_prefix("sample", name, name).alias("sample_prefix"), naming.row_prefix("sampling", name, name).alias("sampling_prefix"),
        naming.scoped_uri("sampler", name, F.col("o_custkey").cast("string")).alias("sampler_uri"), F.lit(_F + "orders/desk").alias("sample_feature_uri"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations: (kind, uri, label, class_uri)."""
    no = F.lit(None).cast("string").alias("class_uri")

    def rows(name, dataset, key, label, kind):
        uri = naming.scoped_uri(kind.lower(), F.lit(dataset), F.col(key).cast("string"))
        return table(spark, folder, name).select(F.lit(kind).alias("kind"), uri.alias("uri"), label.alias("label"), no)

    fixed_rows = [("Sensor", "http://example.org/sensor/orders/till", "Till", None)]
    fixed_rows += [("ObservableProperty", PROPERTY + p, p.title(), None) for p in ("price", "quantity", "rate", "size")]
    fixed_rows += [
        ("FeatureOfInterest", _F + "lineitem/store", "Store", "http://example.org/class/Building"),
        ("FeatureOfInterest", _F + "orders/desk", "Desk", None), ("FeatureOfInterest", _F + "part/shelf", "Shelf", None),
        ("FeatureOfInterest", _F + "part/unused", "Unused", None),
    ]
    users = table(spark, folder, "events").select("user_id").distinct()
    user_uri = naming.scoped_uri("sensor", F.lit("events"), F.col("user_id").cast("string"))
    brands = table(spark, folder, "part").select("p_brand").distinct()
    return graph.add(
        spark.createDataFrame(fixed_rows, "kind string, uri string, label string, class_uri string"),
        rows("supplier", "lineitem", "s_suppkey", F.col("s_name"), "Sensor"),
        rows("customer", "orders", "c_custkey", F.col("c_name"), "Sampler"),
        users.select(F.lit("Sensor").alias("kind"), user_uri.alias("uri"), F.concat(F.lit('User "'), F.col("user_id"), F.lit('"')).alias("label"), no),
        brands.select(F.lit("Sensor").alias("kind"), naming.scoped_uri("sensor", F.lit("part"), F.col("p_brand")).alias("uri"), F.lit("").alias("label"), no),
    )


def data_graphs(spark: SparkSession, folder: str, only: Collection[str] | None = None) -> list[DataFrame]:
    return [graph.observation_triples(observations(spark, folder), only), graph.sample_triples(sample_rows(spark, folder), only)]


def whole_graph(spark: SparkSession, folder: str, only: Collection[str] | None = None) -> DataFrame:
    """Merged graph of all tables with declarations and multipliers.

    A question that looks at few predicates names them, and the classes of types, in `only`: other triples of the data are not built.
    """
    declared = graph.declarations(entities(spark, folder))
    return graph.merge_scoped(data_graphs(spark, folder, only), [declared, graph.multipliers(units(spark))])


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v)
    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


def _iso(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({ts}) % 1000000 = 0 THEN ''"
        f" ELSE '.' || lpad((microsecond({ts}) % 1000000)::VARCHAR, 6, '0') END"
    )


def _slug(v: str) -> str:
    return f"trim(regexp_replace(lower({v}), '[^a-z0-9]+', '-', 'g'), '-')"


LONG_SQL = f"""
mapping(dataset_id, file_id, value_col, value_dtype, sensor_uri, property_uri, unit_uri, foi_uri, sampled, sampler_uri, sample_feature_uri)
  AS (VALUES {_values(MAPPING)}),
units(unit_uri, multiplier) AS (VALUES {_values(MULTIPLIERS)}),
wide AS (
  SELECT 'lineitem' AS file_id, (row_number() OVER () - 1)::VARCHAR AS row, {_iso('l_shipdate')} AS result_time,
    'http://example.org/sensor/lineitem/' || l_suppkey AS row_sensor_uri,
    [{{'c': 'l_quantity', 'v': l_quantity}}, {{'c': 'l_extendedprice', 'v': l_extendedprice}}, {{'c': 'l_discount', 'v': l_discount}}, {{'c': 'l_tax', 'v': l_tax}}] AS cells
  FROM lineitem
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, {_iso('o_orderdate')}, NULL, [{{'c': 'o_totalprice', 'v': o_totalprice}}] FROM orders
  UNION ALL SELECT 'part', p_partkey::VARCHAR, NULL, 'http://example.org/sensor/part/' || {_slug('p_brand')},
    [{{'c': 'p_retailprice', 'v': p_retailprice}}, {{'c': 'p_size', 'v': p_size::DOUBLE}}] FROM part
  UNION ALL SELECT 'events', event_id::VARCHAR, {_iso('ts')}, 'http://example.org/sensor/events/' || user_id,
    [{{'c': 'value', 'v': value}}, {{'c': 'k', 'v': json_extract_string(props, '$.k')::DOUBLE}}] FROM events
),
long AS (SELECT * EXCLUDE (c), c.c AS value_col, c.v AS value_num, c.v::VARCHAR AS value FROM (SELECT * EXCLUDE (cells), unnest(cells) AS c FROM wide)),
obs AS (
  SELECT dataset_id, file_id, row, value_col, result_time, value_num, value, property_uri, unit_uri, foi_uri, sampled,
    coalesce(sensor_uri, row_sensor_uri) AS sensor_uri,
    'http://example.org/obs/' || dataset_id || '/' || file_id || '/' || {_slug('value_col')} || '/' || row AS obs_uri,
    'http://example.org/result/' || dataset_id || '/' || file_id || '/' || {_slug('value_col')} || '/' || row AS result_uri,
    'http://example.org/sample/' || dataset_id || '/' || file_id || '/' || row AS sample_uri
  FROM long JOIN mapping USING (file_id, value_col)
)"""

_T = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"
_S = "http://www.w3.org/ns/sosa/"
_Q = "http://qudt.org/schema/qudt/"
_X = "http://www.w3.org/2001/XMLSchema#"
_IRI = "'iri', NULL::VARCHAR, NULL::VARCHAR"
_DBL, _DT = f"'literal', '{_X}double', NULL::VARCHAR", f"'literal', '{_X}dateTime', NULL::VARCHAR"

OBSERVATION_TRIPLES_SQL = f"""
observation_triples(s, p, o, o_kind, o_datatype, o_lang) AS (
  SELECT obs_uri, {_T}, '{_S}Observation', {_IRI} FROM obs
  UNION ALL SELECT obs_uri, '{_S}resultTime', result_time, {_DT} FROM obs WHERE result_time IS NOT NULL
  UNION ALL SELECT obs_uri, '{_S}madeBySensor', sensor_uri, {_IRI} FROM obs WHERE sensor_uri IS NOT NULL
  UNION ALL SELECT obs_uri, '{_S}observedProperty', property_uri, {_IRI} FROM obs
  UNION ALL SELECT obs_uri, '{_S}hasFeatureOfInterest', CASE WHEN sampled THEN sample_uri ELSE foi_uri END, {_IRI} FROM obs WHERE sampled OR foi_uri IS NOT NULL
  UNION ALL SELECT obs_uri, '{_S}hasResult', result_uri, {_IRI} FROM obs WHERE unit_uri IS NOT NULL
  UNION ALL SELECT obs_uri, '{_S}hasSimpleResult', value, {_DBL} FROM obs WHERE unit_uri IS NULL AND value IS NOT NULL
  UNION ALL SELECT result_uri, {_T}, '{_Q}QuantityValue', {_IRI} FROM obs WHERE unit_uri IS NOT NULL
  UNION ALL SELECT result_uri, '{_Q}numericValue', value, {_DBL} FROM obs WHERE unit_uri IS NOT NULL AND value IS NOT NULL
  UNION ALL SELECT result_uri, '{_Q}unit', unit_uri, {_IRI} FROM obs WHERE unit_uri IS NOT NULL
)"""

SAMPLE_TRIPLES_SQL = f"""
sampled_rows AS (
  SELECT 'http://example.org/sample/orders/orders/' || o_orderkey AS sample, 'http://example.org/sampling/orders/orders/' || o_orderkey AS sampling,
    'http://example.org/sampler/orders/' || o_custkey AS sampler, {_iso('o_orderdate')} AS t FROM orders
),
sample_triples(s, p, o, o_kind, o_datatype, o_lang) AS (
  SELECT sample, {_T}, '{_S}Sample', {_IRI} FROM sampled_rows
  UNION ALL SELECT sample, '{_S}isSampleOf', '{_F}orders/desk', {_IRI} FROM sampled_rows
  UNION ALL SELECT sample, '{_S}isResultOf', sampling, {_IRI} FROM sampled_rows
  UNION ALL SELECT sampling, {_T}, '{_S}Sampling', {_IRI} FROM sampled_rows
  UNION ALL SELECT sampling, '{_S}resultTime', t, {_DT} FROM sampled_rows
  UNION ALL SELECT sampling, '{_S}hasResult', sample, {_IRI} FROM sampled_rows
  UNION ALL SELECT sampling, '{_S}madeBySampler', sampler, {_IRI} FROM sampled_rows
  UNION ALL SELECT sampling, '{_S}hasFeatureOfInterest', '{_F}orders/desk', {_IRI} FROM sampled_rows
)"""

DECLARATIONS_SQL = f"""
entities(kind, uri, label, class_uri) AS (
  VALUES ('Sensor', 'http://example.org/sensor/orders/till', 'Till', NULL),
    ('ObservableProperty', '{_P}price', 'Price', NULL), ('ObservableProperty', '{_P}quantity', 'Quantity', NULL),
    ('ObservableProperty', '{_P}rate', 'Rate', NULL), ('ObservableProperty', '{_P}size', 'Size', NULL),
    ('FeatureOfInterest', '{_F}lineitem/store', 'Store', 'http://example.org/class/Building'),
    ('FeatureOfInterest', '{_F}orders/desk', 'Desk', NULL), ('FeatureOfInterest', '{_F}part/shelf', 'Shelf', NULL),
    ('FeatureOfInterest', '{_F}part/unused', 'Unused', NULL)
  UNION ALL SELECT 'Sensor', 'http://example.org/sensor/lineitem/' || s_suppkey, s_name, NULL FROM supplier
  UNION ALL SELECT 'Sampler', 'http://example.org/sampler/orders/' || c_custkey, c_name, NULL FROM customer
  UNION ALL SELECT DISTINCT 'Sensor', 'http://example.org/sensor/events/' || user_id, 'User "' || user_id || '"', NULL FROM events
  UNION ALL SELECT DISTINCT 'Sensor', 'http://example.org/sensor/part/' || {_slug('p_brand')}, '', NULL FROM part
),
declaration_triples(s, p, o, o_kind, o_datatype, o_lang) AS (
  SELECT uri, {_T}, '{_S}' || kind, {_IRI} FROM entities
  UNION ALL SELECT uri, {_T}, class_uri, {_IRI} FROM entities WHERE class_uri IS NOT NULL
  UNION ALL SELECT uri, 'http://www.w3.org/2000/01/rdf-schema#label', label, 'literal', NULL::VARCHAR, CASE WHEN kind = 'ObservableProperty' THEN 'en' END FROM entities WHERE label <> ''
)"""

GRAPH_SQL = f"""WITH {LONG_SQL}, {OBSERVATION_TRIPLES_SQL}, {SAMPLE_TRIPLES_SQL}, {DECLARATIONS_SQL},
multiplier_triples(s, p, o, o_kind, o_datatype, o_lang) AS (SELECT unit_uri, '{_Q}conversionMultiplier', multiplier::DOUBLE::VARCHAR, {_DBL} FROM units),
triples AS (
  SELECT * FROM observation_triples UNION SELECT * FROM sample_triples UNION SELECT * FROM declaration_triples UNION SELECT * FROM multiplier_triples
)"""


def digest(triples: DataFrame) -> DataFrame:
    """Comparable summary of every triple of a large graph, by predicate and kind of object.

    All aggregates are numbers, which Spark keeps in a hash aggregation; text minima would sort.
    """
    coded = triples.select("p", "o_kind", "o_datatype", "o_lang", "s", "o", F.conv(F.substring(F.md5(F.concat("s", F.lit("|"), "o")), 1, 8), 16, 10).cast("long").alias("code"))
    return coded.groupBy("p", "o_kind", "o_datatype", "o_lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("s_chars"), F.sum(F.length("o")).alias("o_chars"),
        F.sum("code").alias("code"), F.min("code").alias("min_code"), F.max("code").alias("max_code"),
    )


DIGEST_SQL = """SELECT p, o_kind, o_datatype, o_lang, count(*) AS n, sum(length(s))::BIGINT AS s_chars, sum(length(o))::BIGINT AS o_chars,
  sum(code)::BIGINT AS code, min(code) AS min_code, max(code) AS max_code FROM (SELECT *, ('0x' || substr(md5(s || '|' || o), 1, 8))::BIGINT AS code FROM {source}) GROUP BY ALL"""
