"""Queries on long fact tables with dimensions.

events with customer and nation: facts of devices (customers) at sites (nations), one variable per kind
of event. lineitem with part, supplier and nation: devices are suppliers, one variable per part name and brand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.operators import relational
from obsweave.plans.registry import query
from obsweave.session import join_small
from obsweave.sources.tables import table, time_window

KINDS = ["click", "error", "purchase", "signup", "view"]

FACTS_SQL = """facts AS (SELECT event_id, ts, date_trunc('day', ts)::TIMESTAMP AS timestamp, event_type AS variable, n_name AS site, c_name AS device,
    c_mktsegment AS device_type, value FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey),
special AS (SELECT DISTINCT device_type, value, 'reading ' || value AS meaning FROM facts WHERE variable = 'error' AND value < 1.0),
cleaned AS (SELECT f.* EXCLUDE (value), CASE WHEN s.value IS NULL THEN f.value END AS value FROM facts f LEFT JOIN special s ON f.device_type = s.device_type AND f.value = s.value)"""

PARTS_SQL = """facts AS (SELECT l_shipdate AS timestamp, p_name || ' ' || p_brand AS variable, n_name AS site, s_name AS device, l_quantity AS value
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
per_variable AS (SELECT site, device, variable, count(*) AS n FROM facts WHERE value IS NOT NULL GROUP BY ALL),
gold AS (SELECT DISTINCT p_name || ' ' || p_brand AS variable, 'http://example.org/property/' || split_part(p_name, ' ', 2) AS property FROM part WHERE split_part(p_name, ' ', 1) IN ('red', 'blue', 'hot', 'cold')),
excluded AS (SELECT DISTINCT p_name || ' ' || p_brand AS variable FROM part WHERE split_part(p_name, ' ', 1) = 'old')"""


def _facts(spark, folder):
    who = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"), F.col("n_name").alias("site"), F.col("c_name").alias("device"), F.col("c_mktsegment").alias("device_type")
    )
    return join_small(table(spark, folder, "events"), who, "user_id", "inner").select(
        "event_id", "ts", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("timestamp"), F.col("event_type").alias("variable"), "site", "device", "device_type", "value"
    )


def _special(facts):
    return facts.where("variable = 'error' and value < 1.0").select("device_type", "value", F.concat(F.lit("reading "), F.col("value")).alias("meaning")).distinct()


def cleaned(spark, folder):
    facts = _facts(spark, folder)
    return relational.null_special_values(facts, _special(facts))


def _part_facts(spark, folder):
    where = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("site"), F.col("s_name").alias("device")
    )
    what = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("variable"))
    out = join_small(table(spark, folder, "lineitem"), what, "l_partkey", "inner")
    return join_small(out, where, "l_suppkey", "inner").select(F.col("l_shipdate").alias("timestamp"), "variable", "site", "device", F.col("l_quantity").alias("value"))


def _gold(spark, folder):
    part = table(spark, folder, "part")
    first, noun = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.concat_ws(" ", "p_name", "p_brand").alias("variable")
    gold = part.where(first.isin("red", "blue", "hot", "cold")).select(name, F.concat(F.lit("http://example.org/property/"), noun).alias("property")).distinct()
    return gold, part.where(first == "old").select(name).distinct()


@query("""SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND event_type <> 'error'""")
def time_window_scan(spark, folder):
    rows = time_window(table(spark, folder, "events"), "2024-01-10 00:00:00", "2024-01-12 00:00:00", F.col("event_type") != "error", "ts")
    return rows.select("event_id", "event_type", "value")


@query("""SELECT p_name AS variable, p_type AS unit, n_name AS source_type, r_name AS site, count(*) AS n, sum(l_quantity) AS total, min(s_name) AS first_source
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def dimension_joins(spark, folder):
    source = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("source_type_id"), F.col("s_name").alias("name"))
    nation = table(spark, folder, "nation")
    kind = nation.select(F.col("n_nationkey").alias("source_type_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("manufacturer"))
    site = table(spark, folder, "region").select(F.col("r_regionkey").alias("site_id"), F.col("r_name").alias("name"))
    variable = table(spark, folder, "part").select(F.col("p_partkey").alias("variable_id"), F.col("p_name").alias("name"), F.col("p_type").alias("unit"))
    at = source.join(nation, F.col("source_type_id") == F.col("n_nationkey")).select("source_id", F.col("n_regionkey").alias("site_id"))
    signal = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("variable_id"), F.col("l_quantity").alias("value"))
    facts = relational.with_dimensions(join_small(signal, at, "source_id", "inner"), source, kind, site, variable)
    return facts.groupBy("variable", "unit", "source_type", "site").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("source").alias("first_source"))


@query(f"WITH {FACTS_SQL} SELECT event_id, device_type, value FROM cleaned")
def special_values(spark, folder):
    return cleaned(spark, folder).select("event_id", "device_type", "value")


@query(f"""WITH {FACTS_SQL} SELECT site, device, timestamp, {', '.join(f"arg_min(value, (ts, event_id)) FILTER (variable = '{k}' AND value IS NOT NULL) AS {k}" for k in KINDS)}
  FROM cleaned WHERE value IS NOT NULL GROUP BY ALL""")
def long_to_wide(spark, folder):
    return relational.to_wide(cleaned(spark, folder), ["site", "device", "timestamp"], KINDS, ["ts", "event_id"])


@query(f"""WITH {FACTS_SQL}, f AS (SELECT site, device, array_to_string(list_sort(list(DISTINCT variable)), ',') AS variables, count(DISTINCT timestamp) AS n_rows FROM cleaned WHERE value IS NOT NULL GROUP BY ALL) SELECT * FROM f""")
def device_files(spark, folder):
    return relational.device_files(cleaned(spark, folder)).withColumn("variables", F.array_join("variables", ","))


@query(f"""WITH {FACTS_SQL}, used AS (SELECT DISTINCT site, device, device_type, variable FROM cleaned WHERE value IS NOT NULL),
  docs AS (SELECT device_type, list_sort(list({{'value': value, 'meaning': meaning}})) AS sv FROM special GROUP BY device_type),
  d AS (SELECT site, list_sort(list({{'device': device, 'file': device || '.csv', 'serial': c_custkey::VARCHAR, 'description': NULL::VARCHAR, 'device_type': x.device_type, 'type_description': 'kind ' || x.device_type, 'manufacturer': left(c_name, 2), 'special_values': coalesce(sv, [])}})) AS devices
    FROM (SELECT DISTINCT site, device, device_type FROM used) x JOIN customer ON c_name = device LEFT JOIN docs ON docs.device_type = x.device_type GROUP BY site),
  v AS (SELECT site, list_sort(list({{'variable': variable, 'unit': NULL::VARCHAR, 'description': 'events of kind ' || variable}})) AS variables FROM (SELECT DISTINCT site, variable FROM used) GROUP BY site)
  SELECT site, to_json({{'site': {{'site': site, 'description': r_name}}, 'devices': devices, 'variables': variables}})::VARCHAR AS metadata
  FROM d JOIN v USING (site) JOIN nation ON n_name = site JOIN region ON r_regionkey = n_regionkey""")
def site_metadata(spark, folder):
    facts = cleaned(spark, folder)
    no = F.lit(None).cast("string")
    devices = table(spark, folder, "customer").select(
        F.col("c_name").alias("device"), F.col("c_mktsegment").alias("device_type"), F.col("c_custkey").cast("string").alias("serial"), no.alias("description"),
        F.concat(F.lit("kind "), "c_mktsegment").alias("type_description"), F.left("c_name", F.lit(2)).alias("manufacturer"),
    )
    variables = spark.createDataFrame([(k, f"events of kind {k}") for k in KINDS], "variable string, description string").withColumn("unit", no)
    sites = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("site"), F.col("r_name").alias("description"))
    return relational.site_metadata(relational.device_files(facts), devices, variables, sites, _special(_facts(spark, folder)))


@query(f"WITH {PARTS_SQL} SELECT site, device, variable, property FROM per_variable JOIN gold USING (variable)")
def site_gold(spark, folder):
    return relational.site_gold(relational.device_files(_part_facts(spark, folder)), _gold(spark, folder)[0])


@query(f"WITH {PARTS_SQL} SELECT DISTINCT variable FROM per_variable WHERE variable NOT IN (SELECT variable FROM gold) AND variable NOT IN (SELECT variable FROM excluded)")
def unknown_variables(spark, folder):
    gold, excluded = _gold(spark, folder)
    return relational.unknown_variables(relational.device_files(_part_facts(spark, folder)), gold, excluded)


@query(f"""WITH {PARTS_SQL}, declared AS (SELECT variable, property FROM gold UNION SELECT p_name || ' ' || p_type, 'http://example.org/property/' || p_brand FROM part)
  SELECT variable, property FROM declared WHERE variable NOT IN (SELECT variable FROM facts)""")
def declared_without_data(spark, folder):
    """Names with a type instead of a brand have no facts."""
    part = table(spark, folder, "part")
    other = part.select(F.concat_ws(" ", "p_name", "p_type").alias("variable"), F.concat(F.lit("http://example.org/property/"), "p_brand").alias("property"))
    declared = _gold(spark, folder)[0].union(other).distinct()
    return relational.without_data(declared, _part_facts(spark, folder))


@query(f"WITH {FACTS_SQL} SELECT variable, rank, event_id, ts, site, device, device_type, value FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY ts, event_id) AS rank FROM facts) WHERE rank <= 3")
def samples_per_variable(spark, folder):
    return relational.samples_per_variable(_facts(spark, folder), ["ts", "event_id"], 3).drop("timestamp")


@query(f"""WITH {PARTS_SQL}, have AS (SELECT site, count(DISTINCT device) AS files, count(*) AS columns FROM per_variable GROUP BY site),
  g AS (SELECT site, count(*) AS gold_columns, array_to_string(list_sort(list(DISTINCT variable)), ',') AS gold_variables FROM per_variable JOIN gold USING (variable) GROUP BY site)
  SELECT site, files, columns, coalesce(gold_columns, 0) AS gold_columns, coalesce(gold_variables, '') AS gold_variables FROM have LEFT JOIN g USING (site)""")
def site_manifest(spark, folder):
    files = relational.device_files(_part_facts(spark, folder))
    manifest = relational.site_manifest(files, relational.site_gold(files, _gold(spark, folder)[0]))
    return manifest.withColumn("gold_variables", F.array_join("gold_variables", ","))


@query(f"""WITH RECURSIVE {PARTS_SQL}, have AS (SELECT site, count(*) AS cost FROM per_variable GROUP BY site),
  s AS (SELECT site, list(DISTINCT variable) AS vars, max(cost) AS cost FROM per_variable JOIN gold USING (variable) JOIN have USING (site) GROUP BY site),
  r(step, site, gain, remaining) AS (
    SELECT 0, NULL::VARCHAR, 0::BIGINT, (SELECT list(DISTINCT variable) FROM per_variable JOIN gold USING (variable))
    UNION ALL
    SELECT any_value(step) + 1, arg_min(site, k), arg_min(gain, k), arg_min(rest, k) FROM (
      SELECT step, s.site, len(list_intersect(vars, remaining)) AS gain, (-len(list_intersect(vars, remaining)), cost, s.site) AS k,
        list_filter(remaining, lambda v: NOT list_contains(vars, v)) AS rest FROM r, s WHERE len(remaining) > 0
    ) HAVING count(*) > 0
  ) SELECT step, site, gain FROM r WHERE step > 0""")
def greedy_cover(spark, folder):
    files = relational.device_files(_part_facts(spark, folder))
    columns = relational.site_gold(files, _gold(spark, folder)[0])
    return relational.greedy_cover(columns, relational.site_manifest(files, columns))
