"""Queries on files: given tables are written as files of many forms to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from obsweave.operators import relational
from obsweave.plans import given, observing, profiling, relating, retrieving
from obsweave.plans.registry import ORACLES, query
from obsweave.session import shared_dir, staged
from obsweave.sources import folder as folders
from obsweave.sources import sinks, tables
from obsweave.sources.tables import table


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Priorities of orders as files: separator, header lines, and how a row is written.
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _order_files(spark, folder):
    """Orders as one text file per priority, each in a dialect of its own; the files end in .txt, as Spark writes texts."""
    orders = table(spark, folder, "orders")
    key, price, who = (F.col(c).cast("string") for c in ("o_orderkey", "o_totalprice", "o_custkey"))
    status = F.col("o_orderstatus")
    note = F.concat(F.lit('"first line of '), who, F.lit(', ""'), status, F.lit('""\n\nlast line"'))
    priority = F.col("o_orderpriority")
    row = (
        F.when(priority == _PRIORITIES[0], F.concat_ws("\t", key, price, F.concat(status, F.lit(" µ"))))  # tabs, Latin-1
        .when(priority == _PRIORITIES[1], F.concat_ws(";", key, F.replace(price, F.lit("."), F.lit(",")), F.concat(status, F.lit(" µ"))))  # decimal commas
        .when(priority == _PRIORITIES[2], F.concat_ws(",", key, price, status))  # two header rows
        .when(priority == _PRIORITIES[3], F.concat_ws(",", key, price, note))  # cells with line breaks
        .otherwise(F.concat_ws(",", key, price, F.concat(status, F.lit(' 5" pipe'))))
    )
    heads = ["key\tprice\tstate [µ]", "key;price;state", ",in,in\nkey,price,state", 'key,price,"the note"', "key,price,state"]
    head = spark.createDataFrame([(p, -1, h) for p, h in zip(_PRIORITIES, heads)], "priority string, o_orderkey long, text string")
    rows = head.unionByName(orders.select(priority.alias("priority"), F.col("o_orderkey").cast("long").alias("o_orderkey"), row.alias("text")))
    text = F.when(F.col("priority") == _PRIORITIES[0], F.encode("text", "ISO-8859-1").cast("string")).otherwise(F.col("text"))
    path = _path(spark, "orders")
    lines = rows.withColumn("text", text).repartition("priority").sortWithinPartitions("priority", "o_orderkey")
    lines.select("priority", "text").write.partitionBy("priority").text(path)
    return path


@query("""SELECT o_orderpriority AS priority, 'table' AS kind, CASE o_orderpriority WHEN '1-URGENT' THEN 'latin-1' ELSE 'utf-8' END AS encoding,
    CASE o_orderpriority WHEN '1-URGENT' THEN chr(9) WHEN '2-HIGH' THEN ';' ELSE ',' END AS sep, CASE o_orderpriority WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS header_rows,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'key|price|state [µ]' WHEN '3-MEDIUM' THEN 'key|in price|in state' WHEN '4-NOT SPECIFIED' THEN 'key|price|the note' ELSE 'key|price|state' END AS names
  FROM orders GROUP BY o_orderpriority""")
def file_dialects(spark, folder):
    """Kind, encoding, separator and flattened header of every file."""
    found = folders.discover(spark, _order_files(spark, folder), ["txt"])
    dialects = folders.dialects(folders.heads(found.where("kind = 'table'"))).join(found.select("file", "kind"), "file")
    priority = F.url_decode(F.regexp_extract("file", "priority=([^/]*)/", 1))
    return dialects.select(
        priority.alias("priority"), "kind", "encoding", "sep", F.col("header_rows").cast("int").alias("header_rows"), F.array_join("names", "|").alias("names"))


@query("""SELECT o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS row, o_orderkey::VARCHAR AS key,
    CASE o_orderpriority WHEN '2-HIGH' THEN replace(o_totalprice::VARCHAR, '.', ',') ELSE o_totalprice::VARCHAR END AS price,
    CASE o_orderpriority WHEN '1-URGENT' THEN o_orderstatus || ' µ' WHEN '2-HIGH' THEN o_orderstatus || ' µ' WHEN '3-MEDIUM' THEN o_orderstatus
      WHEN '4-NOT SPECIFIED' THEN 'first line of ' || o_custkey || ', "' || o_orderstatus || '"' || chr(10) || chr(10) || 'last line' ELSE o_orderstatus || ' 5" pipe' END AS note FROM orders""")
def file_rows(spark, folder):
    """All cells of all files, with their place in the file; records with line breaks included."""
    root = _order_files(spark, folder)
    found = folders.dialects(folders.heads(folders.discover(spark, root, ["txt"]).where("kind = 'table'")))
    rows = folders.rows_of(*folders.table_lines(spark, root, found, ["txt"]), found)
    priority = F.url_decode(F.regexp_extract("file", "priority=([^/]*)/", 1))
    return rows.select(priority.alias("priority"), "row", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("key", "price", "note"))])


@query("""SELECT doc_id, 'triple' AS kind, lang, md5(text) AS code FROM documents UNION ALL SELECT doc_id, 'rejected', NULL, md5('not a triple ' || doc_id) FROM documents WHERE doc_id % 10 = 3""")
def ntriples_scan(spark, folder):
    """Documents as literals: every second one with all letters beyond ASCII escaped, comments, and lines that are no triples."""
    from obsweave.functions.text import escape

    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", r"\\u$1")
    letters = F.transform(F.regexp_extract_all(escape(F.col("text")), F.lit("(?s)."), 0), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), code(c)).otherwise(c))
    even = F.col("doc_id") % 2 == 0
    literal = F.when(even, F.array_join(letters, "")).otherwise(F.replace(escape(F.col("text")), F.lit("\t"), F.lit("\\t")))
    subject = F.concat(F.lit("<http://example.org/doc/"), F.col("doc_id").cast("string"), F.lit("> <http://example.org/text> \""))
    line = F.concat(subject, literal, F.lit('"@'), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, ' . # a "comment" .').otherwise(" ."))
    tenth = F.col("doc_id") % 10
    other = F.when(tenth == 3, F.concat(F.lit("not a triple "), F.col("doc_id").cast("string"))).when(tenth == 4, "").otherwise("# only a comment")
    path = _path(spark, "triples")
    docs.select(F.explode(F.array(line, other)).alias("value")).write.text(path)
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long").alias("doc_id")
    read = tables.ntriples(spark, path).select(number("s"), F.lit("triple").alias("kind"), F.col("o_lang").alias("lang"), F.md5("o").alias("code"))
    rejected = tables.ntriples_rejected(spark, path).select(
        number("line"), F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("lang"), F.md5("line").alias("code"))
    return read.unionByName(rejected)


@query(ORACLES["ntriples_lines"])
def graph_files(spark, folder):
    """The whole graph through its files: every line that is read back, counted and hashed by predicate."""
    path = _path(spark, "graph")
    sinks.write_ntriples(given.whole_graph(spark, folder), path)
    return observing.digest_lines(tables.ntriples(spark, path))


@query("""WITH f AS (SELECT lang, trim(string_agg(text, chr(10) ORDER BY doc_id), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM documents GROUP BY lang)
  SELECT lang, length(t) AS chars, md5(t) AS code FROM f WHERE t <> ''""")
def companion_files(spark, folder):
    """Companion texts as files, one per language."""
    path = _path(spark, "companions")
    docs = table(spark, folder, "documents").where("text IS NOT NULL").repartition("lang").sortWithinPartitions("lang", "doc_id")
    docs.select("lang", "text").write.partitionBy("lang").text(path)
    return folders.companion_digests(spark, path).select(F.regexp_extract("file", "lang=([^/]*)/", 1).alias("lang"), "chars", "code")


@query(ORACLES["normalize_rows"])
def normalized_files(spark, folder):
    """Normalized rows through their files."""
    path = _path(spark, "normalized")
    sinks.write_normalized(profiling.normalize_rows(spark, folder), path)
    read = spark.read.schema("row long, result_time string, value_num double, file_id string").parquet(path)
    return read.select("file_id", "row", "result_time", "value_num")


_UNPIVOT = ", ".join(f"{{'variable': '{k}', 'value': {k}}}" for k in relating.KINDS)


@query(f"""WITH wide AS ({ORACLES['long_to_wide']}), own AS (SELECT site, device, {', '.join(f'count({k}) > 0 AS has_{k}' for k in relating.KINDS)} FROM wide GROUP BY ALL),
  long AS (SELECT site, device, timestamp, unnest([{_UNPIVOT}]) AS v FROM wide)
  SELECT long.site, long.device, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, v.variable AS variable, v.value AS value FROM long JOIN own USING (site, device)
  WHERE {' OR '.join(f"(v.variable = '{k}' AND has_{k})" for k in relating.KINDS)}""")
def site_files(spark, folder):
    """The wide export through its files: every cell of every column that a device has, empty ones included."""
    path = _path(spark, "sites")
    sinks.write_sites(relating.long_to_wide(spark, folder), path)
    # the heads of the files are read once; two joins look at them
    found = staged(folders.dialects(folders.heads(folders.discover(spark, path).where("kind = 'table'"))), "dialects")
    rows = folders.raw_rows(spark, path, found)
    part = lambda name: F.url_decode(F.regexp_extract("file", f"{name}=([^/]*)/", 1)).alias(name)
    cells = rows.select(
        part("site"), part("device"), F.get("cells", F.lit(0)).alias("timestamp"), F.posexplode(F.arrays_zip("names", "cells")).alias("pos", "c")).where("pos > 0")
    return cells.select("site", "device", "timestamp", F.col("c.names").alias("variable"), F.col("c.cells").cast("double").alias("value"))


@query(ORACLES["feature_class_docs"])
def feature_class_lines(spark, folder):
    """Feature classes through JSON lines."""
    from obsweave.operators import vocab

    path = _path(spark, "classes")
    classes = retrieving.feature_classes(spark, folder).withColumn("uri", F.concat(F.lit("http://example.org/class/"), F.col("p_partkey").cast("string")))
    classes.drop("p_partkey").write.json(path)
    read = tables.feature_classes(spark, path)
    return read.select(F.regexp_extract("uri", r"(\d+)$", 1).cast("long").alias("p_partkey"), vocab.feature_class_doc().alias("doc"))


@query("""SELECT p_type AS dataset, p_partkey::VARCHAR AS variable, p_name AS "column", CASE WHEN p_size % 2 = 0 THEN 'reuse' ELSE 'mint' END AS decision, p_brand AS accepted FROM part""")
def gold_files(spark, folder):
    """Gold rows through nested JSON files, by kind of part."""
    part = table(spark, folder, "part")
    decision = F.when(F.col("p_size") % 2 == 0, "reuse").otherwise("mint").alias("decision")
    row = F.struct(F.col("p_partkey").cast("string").alias("variable"), F.col("p_name").alias("column"), decision, F.array("p_brand").alias("accept"))
    # a gold file is one document by its form, so a file holds at most 10,000 parts
    block = F.floor(F.col("p_partkey") / 10_000).alias("block")
    document = F.to_json(F.struct(F.first("p_type").alias("dataset"), F.collect_list(row).alias("observations")))
    files = part.groupBy(F.col("p_type").alias("kind"), block).agg(document.alias("value"))
    path = _path(spark, "gold")
    files.repartition("kind", "block").write.partitionBy("kind", "block").text(path)
    read = tables.gold(spark, path)
    return read.select("dataset", "variable", "column", "decision", F.get("accept", F.lit(0)).alias("accepted"))


@query(ORACLES["device_files"])
def report_files(spark, folder):
    """A report through its JSON files."""
    path = _path(spark, "report")
    facts = relating.cleaned(spark, folder)
    sinks.write_report(relational.device_files(facts), path)
    read = spark.read.schema("site string, device string, variables array<string>, n_rows long").json(path)
    return read.withColumn("variables", F.array_join("variables", ","))
