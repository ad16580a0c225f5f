"""Queries on decisions: parts as columns, their suppliers (from lineitem) as candidate menus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from obsweave.functions import fixed, naming
from obsweave.operators import decide, vocab
from obsweave.plans.registry import query
from obsweave.session import staged
from obsweave.sources.tables import table

CONCEPT = "http://example.org/concept/"
UNIT = "http://qudt.org/vocab/unit/"
UNITS = [
    (UNIT + "MilliM", ["mm"], ["mm"]), (UNIT + "MicroM", ["um"], ["µm"]), (UNIT + "DEG_C", ["Cel"], ["°C"]), (UNIT + "L-PER-SEC", ["L/s", "L.s-1"], ["L/s"]),
    (UNIT + "PERCENT", ["%"], ["%"]), (UNIT + "A-FIRST", ["first"], ["Cel", "m³/s"]), (UNIT + "M3-PER-SEC", ["m3/s"], ["m³/s"]),
]
UNIT_TEXTS = ["mm", " m m ", "μm", "degC", "lps", "PCT", "bogus", "m³/s", "M^3/S"]


def _texts(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_FOLD = "regexp_replace(translate(trim({}), 'µμ²³·', 'uu23.'), '\\s+', '', 'g')"
_ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.UNIT_ALIASES.items()) + "}"

SQL = f"""cols AS (SELECT p_partkey AS ord, 'files/' || p_brand || '.csv' AS file, p_name || ' ' || p_partkey AS "column", 'files/' || p_brand || '.csv::' || p_name || ' ' || p_partkey AS column_key,
    CASE WHEN p_size % 10 = 0 THEN 'quality_flag' WHEN p_size % 3 = 0 THEN 'unknown' ELSE 'observable_property' END AS role, CASE WHEN p_size % 3 = 0 THEN 'object' ELSE 'float64' END AS dtype, p_partkey, p_size, p_type, p_brand, p_name FROM part),
sup AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
menus AS (SELECT column_key, source, row_number() OVER (PARTITION BY column_key, source ORDER BY l_suppkey) AS rank, '{CONCEPT}' || l_suppkey AS uri, label FROM (
    SELECT column_key, CASE WHEN l_suppkey % 2 = 0 THEN 'gemet' ELSE 'qudt' END AS source, l_suppkey, 'Supplier ' || l_suppkey % 7 AS label FROM sup JOIN cols ON l_partkey = p_partkey)),
firsts AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey),
dec AS (SELECT column_key, CASE WHEN p_size % 8 <> 3 THEN 'probe ' || p_brand END AS sensor_id,
    CASE p_size % 5 WHEN 0 THEN '{CONCEPT}' || s WHEN 1 THEN 'MINT' WHEN 2 THEN CASE WHEN s % 2 = 0 THEN 'gemet:' ELSE 'qudt:' END || s WHEN 3 THEN NULL ELSE '{CONCEPT}' || p_size END AS property_uri,
    CASE WHEN p_size % 4 = 0 THEN ' SUPPLIER ' || p_size % 9 WHEN p_size % 4 = 1 THEN '' WHEN p_size % 4 = 2 THEN p_name END AS property_label,
    {_texts(UNIT_TEXTS)}[p_size % 10 + 1] AS unit, p_type AS feature_id,
    CASE p_brand WHEN 'Brand#1' THEN 'derived' WHEN 'Brand#2' THEN 'quality' WHEN 'Brand#3' THEN 'nonsense' WHEN 'Brand#4' THEN 'measurement' END AS column_class FROM cols JOIN firsts ON l_partkey = p_partkey WHERE p_size <> 17 AND role IN ('observable_property', 'unknown')),
a AS (SELECT cols.*, sensor_id AS sensor0, property_uri AS uri0, property_label AS label0, unit AS unit0, feature_id AS feature0, d.column_key IS NOT NULL AS res0, CASE WHEN column_class IN ('measurement', 'derived', 'diagnostic', 'quality') THEN column_class END AS column_class FROM cols LEFT JOIN dec d USING (column_key)),
b AS (SELECT *, coalesce(column_class <> 'measurement', FALSE) AS demoted FROM a),
c AS (SELECT b.*, res0 AND NOT demoted AS resolved, coalesce(m.uri, uri0, 'MINT') AS choice FROM b LEFT JOIN menus m ON m.column_key = b.column_key AND m.source || ':' || regexp_extract(m.uri, '([^/]*)$', 1) = uri0),
g AS (SELECT c.*, m.uri IS NOT NULL AS hit, CASE WHEN m.uri IS NOT NULL THEN m.label ELSE coalesce(nullif(label0, ''), "column") END AS label1, coalesce(m.source, 'minted') AS source1 FROM c LEFT JOIN menus m ON m.column_key = c.column_key AND m.uri = c.choice),
g2 AS (SELECT *, CASE WHEN hit THEN choice ELSE 'http://example.org/property/' || {_SLUG.format('label1')} END AS uri1 FROM g),
u AS (SELECT lower(trim(label1)) AS k, arg_min({{'u': uri1, 'l': label1, 's': source1}}, ord) AS f FROM g2 WHERE resolved AND source1 <> 'minted' GROUP BY 1),
h AS (SELECT g2.*, CASE WHEN resolved THEN CASE WHEN source1 = 'minted' AND f IS NOT NULL THEN f.u ELSE uri1 END END AS property_uri, CASE WHEN resolved THEN CASE WHEN source1 = 'minted' AND f IS NOT NULL THEN f.l ELSE label1 END END AS property_label,
    CASE WHEN resolved THEN CASE WHEN source1 = 'minted' AND f IS NOT NULL THEN f.s ELSE source1 END END AS property_source, CASE WHEN resolved THEN sensor0 END AS sensor_id, CASE WHEN NOT demoted THEN unit0 END AS unit FROM g2 LEFT JOIN u ON lower(trim(label1)) = k),
units(uri, codes, symbols) AS (VALUES {', '.join(f"('{u}', {_texts(c)}, {_texts(s)})" for u, c, s in UNITS)}),
spell AS (SELECT uri, unnest(list_concat(codes, symbols)) AS k FROM units), idx AS (SELECT k, min(uri) AS unit_uri FROM (SELECT uri, k FROM spell UNION ALL SELECT uri, {_FOLD.format('k')} FROM spell) GROUP BY k),
cand AS (SELECT unit, unnest([{{'p': 0, 'k': trim(unit)}}, {{'p': 1, 'k': {_FOLD.format('unit')}}}, {{'p': 2, 'k': {_ALIAS}[lower({_FOLD.format('unit')})]}}, {{'p': 3, 'k': {_FOLD.format(_ALIAS + '[lower(' + _FOLD.format('unit') + ')]')}}}]) AS x FROM (SELECT DISTINCT unit FROM h WHERE unit <> '')),
un AS (SELECT unit, arg_min(unit_uri, x.p) AS unit_uri FROM cand JOIN idx ON x.k = idx.k GROUP BY unit),
feats AS (SELECT DISTINCT p_type AS id FROM part WHERE p_type <> 'PROMO'), samplers AS (SELECT 'grab ' || r_name AS id, r_name AS label FROM region),
i AS (SELECT h.*, unit_uri, CASE WHEN NOT demoted AND feature0 IN (SELECT id FROM feats) THEN feature0 END AS feature1 FROM h LEFT JOIN un USING (unit)),
kept AS (SELECT * FROM i WHERE role IN ('observable_property', 'unknown') AND property_uri IS NOT NULL),
marks AS (SELECT DISTINCT 'files/' || p_brand || '.csv' AS file, CASE WHEN length(p_brand) = 8 THEN 'grab ASIA' ELSE 'grab MARS' END AS sampler, CASE WHEN p_brand IN ('Brand#11', 'Brand#5') THEN 'SMALL' ELSE 'nothing' END AS feature FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%5'),
bound AS (SELECT file, min(feature1) AS lo, max(feature1) AS hi FROM kept GROUP BY file),
sf AS (SELECT file, CASE WHEN sampler IN (SELECT id FROM samplers) THEN sampler END AS sampler_id, CASE WHEN feature IN (SELECT id FROM feats) THEN feature WHEN lo = hi THEN lo END AS sample_feature_id FROM marks JOIN bound USING (file)),
r AS (SELECT i.*, sf.file IS NOT NULL AS sampled, sampler_id, sample_feature_id, CASE WHEN sf.file IS NOT NULL AND role IN ('observable_property', 'unknown') AND property_uri IS NOT NULL THEN sample_feature_id ELSE feature1 END AS feature_id FROM i LEFT JOIN sf USING (file))"""


def columns(spark, folder):
    size, file = F.col("p_size"), F.concat(F.lit("files/"), "p_brand", F.lit(".csv"))
    column = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("ord"), file.alias("file"), column.alias("column"), naming.column_key(file, column).alias("column_key"),
        F.when(size % 10 == 0, "quality_flag").when(size % 3 == 0, "unknown").otherwise("observable_property").alias("role"),
        F.when(size % 3 == 0, "object").otherwise("float64").alias("dtype"), "p_partkey", "p_size", "p_type", "p_brand", "p_name",
    )


_EXTRA = ["p_partkey", "p_size", "p_type", "p_brand", "p_name"]


def menus(spark, folder):
    pairs = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    keyed = pairs.join(columns(spark, folder).select("column_key", F.col("p_partkey").alias("l_partkey")), "l_partkey")
    rows = keyed.select(
        "column_key", F.when(F.col("l_suppkey") % 2 == 0, "gemet").otherwise("qudt").alias("source"), "l_suppkey",
        F.concat(F.lit("Supplier "), (F.col("l_suppkey") % 7).cast("string")).alias("label"),
    )
    rank = F.row_number().over(Window.partitionBy("column_key", "source").orderBy("l_suppkey"))
    return rows.select("column_key", "source", rank.alias("rank"), F.concat(F.lit(CONCEPT), F.col("l_suppkey").cast("string")).alias("uri"), "label")


def decisions(spark, folder):
    firsts = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s"))
    size, s, brand = F.col("p_size"), F.col("s").cast("string"), F.col("p_brand")
    choice = (
        F.when(size % 5 == 0, F.concat(F.lit(CONCEPT), s)).when(size % 5 == 1, decide.MINT)
        .when(size % 5 == 2, F.concat(F.when(F.col("s") % 2 == 0, "gemet:").otherwise("qudt:"), s))
        .when(size % 5 == 4, F.concat(F.lit(CONCEPT), size.cast("string")))
    )
    label = F.when(size % 4 == 0, F.concat(F.lit(" SUPPLIER "), (size % 9).cast("string"))).when(size % 4 == 1, "").when(size % 4 == 2, F.col("p_name"))
    classes = {"Brand#1": "derived", "Brand#2": "quality", "Brand#3": "nonsense", "Brand#4": "measurement"}
    cls = F.lit(None).cast("string")
    for b, c in classes.items():
        cls = F.when(brand == b, c).otherwise(cls)
    return columns(spark, folder).join(firsts, "p_partkey").where(size != 17).select(
        "column_key", F.when(size % 8 != 3, F.concat(F.lit("probe "), brand)).alias("sensor_id"), choice.alias("property_uri"), label.alias("property_label"),
        F.get(F.array(*[F.lit(t) for t in UNIT_TEXTS]), size % 10).alias("unit"), F.col("p_type").alias("feature_id"), cls.alias("column_class"),
    )


def index(spark):
    return vocab.units_index(spark.createDataFrame(UNITS, "uri string, ucum_codes array<string>, symbols array<string>"))


def features(spark, folder):
    return table(spark, folder, "part").where("p_type <> 'PROMO'").select(F.col("p_type").alias("id"), F.col("p_type").alias("label")).distinct()


def samplers(spark, folder):
    return table(spark, folder, "region").select(F.concat(F.lit("grab "), "r_name").alias("id"), F.col("r_name").alias("label"))


def sampled_files(spark, folder):
    brand = F.col("p_brand")
    marked = table(spark, folder, "part").where(brand.endswith("1") | brand.endswith("5"))
    return marked.select(
        F.concat(F.lit(" files/"), brand, F.lit(".csv::any")).alias("file"), F.when(F.length(brand) == 8, "grab ASIA").otherwise("grab MARS").alias("sampler_id"),
        F.when(brand.isin("Brand#11", "Brand#5"), "SMALL").otherwise("nothing").alias("feature_id"),
    ).distinct()


def resolved(spark, folder):
    cols = columns(spark, folder).drop(*_EXTRA)
    return decide.resolve(cols, decisions(spark, folder), staged(menus(spark, folder), "menus"), index(spark), features(spark, folder), samplers(spark, folder), sampled_files(spark, folder))


def _guarded(spark, folder):
    df = decide.demote(decide.decided(columns(spark, folder).drop(*_EXTRA), decisions(spark, folder)))
    listed = staged(menus(spark, folder), "menus")  # two steps look something up in them
    return decide.guard_membership(decide.expand_curies(df, listed), listed)


@query(f"WITH {SQL} SELECT column_key, resolved, CASE WHEN resolved THEN uri1 END AS property_uri, CASE WHEN resolved THEN label1 END AS property_label, CASE WHEN resolved THEN source1 END AS property_source FROM g2")
def membership_guard(spark, folder):
    return _guarded(spark, folder).select("column_key", "resolved", "property_uri", "property_label", "property_source")


@query(f"WITH {SQL} SELECT column_key, coalesce(m.uri, uri0) AS property_uri FROM b LEFT JOIN menus m USING (column_key) WHERE NOT demoted AND m.source || ':' || regexp_extract(m.uri, '([^/]*)$', 1) = uri0")
def curie_expansion(spark, folder):
    chosen = decide.decided(columns(spark, folder).drop(*_EXTRA), decisions(spark, folder))
    short = decide.demote(chosen).where(F.col("property_uri").rlike("^(gemet|qudt):"))
    return decide.expand_curies(short, menus(spark, folder)).where(F.startswith("property_uri", F.lit(CONCEPT))).select("column_key", "property_uri")


@query(f"WITH {SQL} SELECT column_key, property_uri, property_label, property_source FROM h")
def label_unify(spark, folder):
    return decide.unify_labels(staged(_guarded(spark, folder), "guarded")).select("column_key", "property_uri", "property_label", "property_source")


@query(f"WITH {SQL} SELECT property_uri, arg_min(property_label, ord) AS label, arg_min(property_source, ord) AS source FROM r WHERE property_uri IS NOT NULL GROUP BY property_uri")
def property_registry(spark, folder):
    return decide.property_registry(resolved(spark, folder))


@query(f"WITH {SQL} SELECT column_key, unit, unit_uri FROM r")
def unit_resolve(spark, folder):
    return decide.resolve_units(decide.demote(decide.decided(columns(spark, folder).drop(*_EXTRA), decisions(spark, folder))), index(spark)).select("column_key", "unit", "unit_uri")


@query(f"""WITH k AS (SELECT '{UNIT}' || p_partkey AS uri, unnest([p_brand || ' ' || p_size, 'µ' || p_name, p_size || ' m²']) AS k FROM part)
  SELECT k AS key, min(uri) AS unit_uri FROM (SELECT uri, k FROM k UNION ALL SELECT uri, {_FOLD.format('k')} FROM k) GROUP BY k""")
def unit_index(spark, folder):
    size = F.col("p_size").cast("string")
    units = table(spark, folder, "part").select(
        F.concat(F.lit(UNIT), F.col("p_partkey").cast("string")).alias("uri"), F.array(F.concat_ws(" ", "p_brand", size)).alias("ucum_codes"),
        F.array(F.concat(F.lit("µ"), "p_name"), F.concat(size, F.lit(" m²"))).alias("symbols"),
    )
    return vocab.units_index(units)


@query(f"WITH {SQL} SELECT column_key, feature_id, sampled, sampler_id, CASE WHEN sampled THEN sample_feature_id END AS sample_feature_id FROM r")
def sampling_attach(spark, folder):
    return resolved(spark, folder).select("column_key", "feature_id", "sampled", "sampler_id", F.when(F.col("sampled"), F.col("sample_feature_id")).alias("sample_feature_id"))


@query(f"""WITH {SQL} SELECT 'sensor' AS kind, id FROM (SELECT DISTINCT 'probe ' || p_brand AS id FROM part) WHERE id IN (SELECT sensor_id FROM r WHERE property_uri IS NOT NULL)
  UNION ALL SELECT 'feature', id FROM feats WHERE id IN (SELECT feature_id FROM r WHERE property_uri IS NOT NULL) UNION ALL SELECT 'sampler', id FROM samplers WHERE id IN (SELECT sampler_id FROM r WHERE sampled)""")
def demote_prune(spark, folder):
    df = resolved(spark, folder)
    sensors = table(spark, folder, "part").select(F.concat(F.lit("probe "), "p_brand").alias("id")).distinct()
    named = lambda kind, t: t.select(F.lit(kind).alias("kind"), "id")
    return (
        named("sensor", decide.prune(sensors, df, "sensor_id")).unionByName(named("feature", decide.prune(features(spark, folder), df, "feature_id")))
        .unionByName(named("sampler", decide.used_samplers(samplers(spark, folder), df)))
    )


@query(f"WITH {SQL} SELECT column_class, demoted, count(*) AS n, count(sensor_id) AS with_sensor, count(property_uri) AS with_property FROM r GROUP BY ALL")
def demotion(spark, folder):
    return resolved(spark, folder).groupBy("column_class", "demoted").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("resolved"), F.col("sensor_id"))).alias("with_sensor"), F.count("property_uri").alias("with_property"))


_URI = lambda kind, c: f"'http://example.org/{kind}/parts/' || " + _SLUG.format(c)


@query(f"""WITH {SQL} SELECT 'parts' AS dataset_id, {_SLUG.format("regexp_replace(file, '[.][^./]+$', '')")} AS file_id, "column" AS value_col, CASE dtype WHEN 'float64' THEN 'xsd:double' ELSE 'xsd:string' END AS value_dtype,
    {_URI('sensor', 'sensor_id')} AS sensor_uri, property_uri, unit_uri, CASE WHEN NOT sampled THEN {_URI('feature', 'feature_id')} END AS foi_uri, sampled,
    CASE WHEN sampled THEN {_URI('sampler', 'sampler_id')} END AS sampler_uri, CASE WHEN sampled THEN {_URI('feature', 'sample_feature_id')} END AS sample_feature_uri
  FROM r WHERE role IN ('observable_property', 'unknown') AND property_uri IS NOT NULL AND sensor_id IS NOT NULL""")
def mapping_assembly(spark, folder):
    return decide.mapping(resolved(spark, folder), "parts")


@query(f"""WITH {SQL}, l AS (SELECT column_key, string_agg(source || ':' || regexp_extract(uri, '([^/]*)$', 1), ',' ORDER BY source DESC, rank) AS curies FROM menus GROUP BY column_key),
  f AS (SELECT curies, row_number() OVER (ORDER BY min(ord)) AS no FROM l JOIN cols USING (column_key) GROUP BY curies) SELECT column_key, 'L' || no AS list_name, curies FROM l JOIN f USING (curies)""")
def shared_menu(spark, folder):
    return decide.shared_lists(menus(spark, folder), columns(spark, folder)).withColumn("curies", F.array_join("curies", ","))


@query(f"WITH {SQL} SELECT source || ':' || regexp_extract(uri, '([^/]*)$', 1) AS curie, arg_min(label, (ord, source <> 'qudt', rank)) AS label FROM menus JOIN cols USING (column_key) GROUP BY 1")
def shared_concepts(spark, folder):
    return decide.shared_concepts(menus(spark, folder), columns(spark, folder))


@query("""SELECT s_suppkey::VARCHAR AS id, coalesce(nullif(l, ''), s_suppkey::VARCHAR) AS label, trim(coalesce(nullif(k, ''), nullif(l, ''), '')) AS kind
  FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN '' ELSE s_name END AS l, CASE WHEN s_nationkey < 8 THEN ' shop ' END AS k FROM supplier)""")
def entity_defaults(spark, folder):
    key = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(
        key.cast("string").alias("id"), F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, "").otherwise(F.col("s_name")).alias("label"), F.when(F.col("s_nationkey") < 8, " shop ").alias("kind")
    )
    return decide.with_defaults(rows)


@query("""SELECT o_orderkey, trim(unnest(string_split(o_orderstatus || ' / ' || o_orderpriority || ' /  ' || o_custkey, ' / '))) AS "column" FROM orders""")
def split_columns(spark, folder):
    spec = F.concat(F.col("o_orderstatus"), F.lit(" / "), "o_orderpriority", F.lit(" /  "), F.col("o_custkey").cast("string"))
    return decide.split_columns(table(spark, folder, "orders").select("o_orderkey", spec.alias("column")))
