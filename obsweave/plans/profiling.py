"""Queries on profiling, normalization and evidence: given tables as files of text cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.functions import fixed, values
from obsweave.operators import evidence, profile
from obsweave.plans import build
from obsweave.plans.given import _iso
from obsweave.plans.registry import query
from obsweave.sources import folder as folders
from obsweave.sources.tables import table

FILES = {
    "events": ("event_id", ["ts", "user_id", "event_type", "value", "props"]),
    "orders": ("o_orderkey", ["o_orderdate", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]),
    "part": ("p_partkey", ["p_name", "p_brand", "p_size", "p_retailprice"]),
    "customer": ("c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
}
_TIMES = {"ts", "o_orderdate"}


def _text_sql(c):
    return _iso(c) if c in _TIMES else f"{c}::VARCHAR"


CELLS_SQL = "cells(file, row, pos, \"column\", value) AS (" + " UNION ALL ".join(
    f"SELECT '{f}', {row}, {i}, '{c}', {_text_sql(c)} FROM {f}" for f, (row, cols) in FILES.items() for i, c in enumerate(cols)
) + ")"


def _rows(spark, folder, names=None):
    parts = [profile.as_rows(table(spark, folder, f), f, F.col(row), cols) for f, (row, cols) in FILES.items() if names is None or f in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_NUM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_ISO8601 = fixed.ISO_8601
_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, pos ORDER BY row) AS rank FROM cells WHERE value IS NOT NULL) WHERE rank <= 500)"
_FORMATS = ["%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d.%m.%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d/%m/%Y %H:%M", "%Y-%m-%d"]
_VOTE = "CASE " + " ".join(f"WHEN bool_and(try_strptime(value, '{f}') IS NOT NULL) FILTER (rank <= 20) THEN '{f}'" for f in _FORMATS) + \
    " WHEN bool_and(coalesce(try_strptime(value, '%Y-%m-%dT%H:%M:%S.%f'), try_strptime(value, '%d-%m-%Y %H:%M')) IS NOT NULL) FILTER (rank <= 20) THEN 'AMBIGUOUS' END"

PROFILE_SQL = f"""{CELLS_SQL}, {_FIRST},
c AS (SELECT file, pos, "column", count(*) AS n, count(value) AS n_value, count_if(regexp_matches(value, '{_NUM}')) AS n_number, count_if(regexp_matches(value, '^[+-]?\\d+$')) AS n_integer FROM cells GROUP BY ALL),
v AS (SELECT file, pos, avg(regexp_matches(value, '{fixed.VOTE_DOT}')::INT) AS vote, bool_and(regexp_matches(value, '{_ISO8601}')) FILTER (rank <= 5) AS iso_first, {_VOTE} AS format FROM first GROUP BY ALL),
t AS (SELECT c.*, v.* EXCLUDE (file, pos), CASE WHEN n_value = 0 THEN 'float64' WHEN n_integer = n THEN 'int64' WHEN n_number = n_value THEN 'float64' WHEN vote >= 0.9 THEN 'float64' ELSE 'object' END AS dtype,
  (regexp_matches("column", '\\b(time|datetime|timestamp|date|dato|tid)\\b', 'i') OR coalesce(iso_first, FALSE)) AND format IS NOT NULL AS is_dt FROM c LEFT JOIN v USING (file, pos)),
r AS (SELECT *, coalesce(min(pos) FILTER (is_dt) OVER (PARTITION BY file) = pos, FALSE) AS is_ts FROM t),
m AS (SELECT file, pos, min(CASE WHEN regexp_matches(value, '{_NUM}') THEN value::DOUBLE END) AS lo, max(CASE WHEN regexp_matches(value, '{_NUM}') THEN value::DOUBLE END) AS hi FROM cells GROUP BY ALL),
s AS (SELECT file, pos, list(value ORDER BY row) AS samples FROM cells WHERE row < 5 AND value IS NOT NULL GROUP BY ALL),
p AS (SELECT r.*, CASE WHEN dtype IN ('int64', 'float64') AND NOT is_dt THEN lo END AS "min", CASE WHEN dtype IN ('int64', 'float64') AND NOT is_dt THEN hi END AS "max", array_to_string(samples, '|') AS samples,
  CASE WHEN is_ts THEN 'timestamp' WHEN starts_with("column", 'Unnamed') THEN 'row_index' WHEN len(list_filter(samples, lambda x: NOT regexp_matches(x, '{_ISO8601}'))) = 0 THEN 'auxiliary'
    WHEN regexp_matches("column", '\\b(flag|flags|quality|qc|valid|invalid|status|error)\\b', 'i') THEN 'quality_flag' WHEN dtype IN ('int64', 'float64') THEN 'observable_property' ELSE 'unknown' END AS role
  FROM r JOIN m USING (file, pos) LEFT JOIN s USING (file, pos))"""


@query(f"""WITH {PROFILE_SQL} SELECT file, pos, "column", dtype, round(1 - CASE WHEN dtype = 'object' THEN n_value ELSE n_number END / n, 4) AS null_pct, "min", "max", samples, role, CASE WHEN is_ts THEN format END AS format FROM p""")
def profile_columns(spark, folder):
    out = profile.profile_columns(_rows(spark, folder))
    return out.select("file", "pos", "column", "dtype", "null_pct", "min", "max", F.array_join("sample_values", "|").alias("samples"), "role", "format")


@query(f"""WITH {PROFILE_SQL}, g AS (SELECT file, epoch_us(coalesce(try_strptime(value, '%Y-%m-%dT%H:%M:%S'), try_strptime(value, '%Y-%m-%dT%H:%M:%S.%f'))) AS t, first.rank FROM first JOIN p USING (file, pos) WHERE is_ts AND first.rank <= 100),
  d AS (SELECT file, t - lag(t) OVER (PARTITION BY file ORDER BY rank) AS gap FROM g), q AS (SELECT file, gap, count(*) AS c FROM d WHERE gap IS NOT NULL GROUP BY ALL),
  best AS (SELECT file, arg_min(gap, (-c, gap)) AS gap FROM q GROUP BY file)
  SELECT file, max(p.n)::BIGINT AS row_count, '.' AS decimal, count(*) AS n_columns, max("column") FILTER (is_ts) AS datetime_column, max(format) FILTER (is_ts) AS datetime_format,
    max(floor(gap / 86400000000)::BIGINT || ' days ' || CASE WHEN gap < 0 THEN '+' ELSE '' END || strftime(make_timestamp(((gap % 86400000000) + 86400000000) % 86400000000), '%H:%M:%S') || CASE WHEN gap % 1000000 = 0 THEN '' ELSE '.' || lpad((((gap % 1000000) + 1000000) % 1000000)::VARCHAR, 6, '0') END) AS frequency,
    FALSE AS row_count_sampled
  FROM p LEFT JOIN best USING (file) GROUP BY file""")
def profile_files(spark, folder):
    rows = _rows(spark, folder)
    _, out = profile.profile(rows)
    return out.select("file", "row_count", "decimal", "n_columns", "datetime_column", "datetime_format", "frequency", "row_count_sampled")


@query(f"""WITH {PROFILE_SQL} SELECT file || '::' || "column" AS column_key, role FROM p WHERE role IN ('observable_property', 'unknown')""")
def observable_columns(spark, folder):
    cols = profile.profile_columns(_rows(spark, folder))
    return cols.where(profile.observable(F.col("role"))).select(F.concat_ws("::", "file", "column").alias("column_key"), "role")


# events once per kind, every kind writing its times its own way
_KIND_FORMATS = {"click": "%Y-%m-%dT%H:%M:%S%z", "error": "%d.%m.%Y %H:%M:%S", "purchase": "%d/%m/%Y %H:%M", "signup": "%Y-%m-%d", "view": "%d-%m-%Y %H:%M"}
_KIND_PATTERNS = {"click": "yyyy-MM-dd'T'HH:mm:ss'+01:00'", "error": "dd.MM.yyyy HH:mm:ss", "purchase": "dd/MM/yyyy HH:mm", "signup": "yyyy-MM-dd", "view": "dd-MM-yyyy HH:mm"}
TIMES_SQL = "cells AS (SELECT event_type AS file, event_id AS row, 0 AS pos, 'when' AS \"column\", CASE event_type " + " ".join(
    f"WHEN '{k}' THEN strftime(ts, '{f.replace('%z', '+01:00')}')" for k, f in _KIND_FORMATS.items()
) + " END AS value FROM events), " + _FIRST


def _times(spark, folder):
    text = F.lit(None).cast("string")
    for kind, pattern in _KIND_PATTERNS.items():
        text = F.when(F.col("event_type") == kind, F.date_format("ts", pattern)).otherwise(text)
    return table(spark, folder, "events").select(
        F.col("event_type").alias("file"), F.col("event_id").alias("row"), F.array(F.lit("when"), F.lit("value")).alias("names"),
        F.array(text, F.col("value").cast("string")).alias("cells"),
    )


def _time_cells(spark, folder):
    return profile.cells(_times(spark, folder)).where("pos = 0")


@query(f"""WITH {TIMES_SQL} SELECT file, "column", {_VOTE} AS format FROM first GROUP BY ALL""")
def datetime_format(spark, folder):
    return profile.date_formats(profile.first_values(_time_cells(spark, folder), 20)).select("file", "column", "format")


@query(f"""WITH {TIMES_SQL} SELECT file, "column", arg_min(z, rank) AS timezone FROM (SELECT *, nullif(regexp_extract(value, '[+-]\\d{{2}}:?\\d{{2}}$'), '') AS z FROM first WHERE rank <= 20) GROUP BY ALL""")
def timezone(spark, folder):
    return profile.time_zones(profile.first_values(_time_cells(spark, folder), 20)).select("file", "column", "timezone")


@query("""WITH h AS (SELECT 'user ' || user_id AS file, event_id AS rank, epoch_us(date_trunc('hour', ts)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  d AS (SELECT file, t - lag(t) OVER (PARTITION BY file ORDER BY rank) AS gap FROM h WHERE k <= 100), q AS (SELECT file, gap, count(*) AS c FROM d WHERE gap IS NOT NULL GROUP BY ALL), b AS (SELECT file, arg_min(gap, (-c, gap)) AS gap FROM q GROUP BY file)
  SELECT file, floor(gap / 86400000000)::BIGINT || ' days ' || CASE WHEN gap < 0 THEN '+' ELSE '' END || strftime(make_timestamp(((gap % 86400000000) + 86400000000) % 86400000000), '%H:%M:%S') AS frequency FROM b""")
def frequency(spark, folder):
    rows = table(spark, folder, "events").select(
        F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("row"), F.array(F.lit("time")).alias("names"),
        F.array(values.iso(F.date_trunc("hour", "ts"))).alias("cells"),
    )
    first = profile.first_values(profile.cells(rows), 100)
    return profile.frequencies(first, profile.date_formats(first)).select("file", "frequency")


_ROLE_NAME = "CASE p_type WHEN 'PROMO' THEN p_name || ' status' WHEN 'SMALL' THEN 'Unnamed: ' || p_size WHEN 'LARGE' THEN 'quality_' || p_name WHEN 'MEDIUM' THEN p_name || 'flag' ELSE p_name END"
_ROLE_SAMPLE = "CASE WHEN p_size < 10 THEN '2020-01-0' || p_size % 10 || 'T10:00:00Z' WHEN p_size < 15 THEN p_size || ' days 12:31:00' ELSE p_retailprice::VARCHAR END"


@query(f"""WITH x AS (SELECT p_partkey, {_ROLE_NAME} AS name, CASE WHEN p_size % 3 = 0 THEN 'object' WHEN p_size % 7 = 0 THEN 'bool' ELSE 'float64' END AS dtype, {_ROLE_SAMPLE} AS sample FROM part)
  SELECT p_partkey, name, dtype, CASE WHEN starts_with(name, 'Unnamed') THEN 'row_index' WHEN regexp_matches(sample, '{_ISO8601}') OR regexp_matches(sample, '^-?\\d+\\s+days?\\b') THEN 'auxiliary'
    WHEN dtype = 'bool' OR regexp_matches(name, '\\b(flag|flags|quality|qc|valid|invalid|status|error)\\b', 'i') THEN 'quality_flag' WHEN dtype = 'float64' THEN 'observable_property' ELSE 'unknown' END AS role FROM x""")
def column_roles(spark, folder):
    size = F.col("p_size")
    name = F.expr(_ROLE_NAME)
    sample = F.when(size < 10, F.concat(F.lit("2020-01-0"), (size % 10).cast("string"), F.lit("T10:00:00Z"))).when(size < 15, F.concat(size.cast("string"), F.lit(" days 12:31:00"))).otherwise(F.col("p_retailprice").cast("string"))
    dtype = F.when(size % 3 == 0, "object").when(size % 7 == 0, "bool").otherwise("float64")
    part = table(spark, folder, "part").select("p_partkey", name.alias("name"), dtype.alias("dtype"), F.array(sample).alias("s"))
    return part.select("p_partkey", "name", "dtype", profile.role(F.col("name"), F.lit(False), F.col("s"), F.col("dtype")).alias("role"))


# values with a sentinel, per kind of event; two kinds write a decimal comma
_MESSY_SQL = """cells AS (SELECT event_type AS file, event_id AS row, CASE WHEN event_type = 'error' AND value < 20 THEN 'OL' WHEN value < 1 THEN 'OL'
    WHEN event_type IN ('view', 'click') THEN replace(value::VARCHAR, '.', ',') ELSE value::VARCHAR END AS value FROM events),
  f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row) AS rank FROM cells),
  d AS (SELECT file, CASE WHEN avg(regexp_matches(value, '^-?\\d+(,\\d+)?$')::INT) FILTER (rank <= 50) >= 0.9 AND bool_or(contains(value, ',')) FILTER (rank <= 50) THEN ',' ELSE '.' END AS decimal,
    avg(regexp_matches(value, '^-?\\d+(,\\d+)?$')::INT) FILTER (rank <= 500) AS vc, avg(regexp_matches(value, '^-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?$')::INT) FILTER (rank <= 500) AS vd FROM f GROUP BY file)"""


def _messy(spark, folder):
    v, text = F.col("value"), F.col("value").cast("string")
    cell = F.when((F.col("event_type") == "error") & (v < 20), "OL").when(v < 1, "OL").when(F.col("event_type").isin("view", "click"), F.replace(text, F.lit("."), F.lit(","))).otherwise(text)
    return table(spark, folder, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("row"), F.array(F.lit("level")).alias("names"), F.array(cell).alias("cells"))


@query(f"""WITH {_MESSY_SQL} SELECT file, decimal, CASE WHEN CASE WHEN decimal = ',' THEN vc ELSE vd END >= 0.9 THEN 'float64' ELSE 'object' END AS dtype,
  CASE WHEN CASE WHEN decimal = ',' THEN vc ELSE vd END >= 0.9 THEN count(try_cast(replace(value, ',', '.') AS DOUBLE)) ELSE count(value) END AS present,
  CASE WHEN CASE WHEN decimal = ',' THEN vc ELSE vd END >= 0.9 THEN max(try_cast(replace(value, ',', '.') AS DOUBLE)) END AS "max" FROM cells JOIN d USING (file) GROUP BY file, decimal, vc, vd""")
def numeric_coercion(spark, folder):
    rows = _messy(spark, folder)
    cell = profile.cells(rows)
    cols = profile.typed(profile.column_counts(cell), profile.column_votes(profile.first_values(cell, profile.VOTE_ROWS)))
    kept = cell.join(F.broadcast(cols.select("file", "pos", "dtype", "decimal")), ["file", "pos"])  # one row per kind of event
    shown = profile.shown(F.col("value"), F.col("dtype"), F.col("decimal"))
    present = kept.groupBy("file").agg(F.count(shown).alias("present"))
    return cols.join(present, "file").select("file", "decimal", "dtype", "present", "max")


@query(f"""WITH {_MESSY_SQL} SELECT file AS file_id, row, 'level' AS "column", CASE WHEN CASE WHEN decimal = ',' THEN vc ELSE vd END >= 0.9 THEN try_cast(replace(value, ',', '.') AS DOUBLE) END AS value_num,
  CASE WHEN CASE WHEN decimal = ',' THEN vc ELSE vd END >= 0.9 THEN try_cast(replace(value, ',', '.') AS DOUBLE)::VARCHAR ELSE value END AS value FROM cells JOIN d USING (file)""")
def normalize_values(spark, folder):
    rows = _messy(spark, folder)
    out = profile.normalize(rows, *profile.profile(rows))
    return out.select("file_id", "row", "column", "value_num", "value")


@query(f"""WITH {_MESSY_SQL}, k AS (SELECT file, CASE WHEN CASE WHEN decimal = ',' THEN vc ELSE vd END >= 0.9 THEN try_cast(replace(value, ',', '.') AS DOUBLE)::VARCHAR ELSE value END AS kept FROM cells JOIN d USING (file))
  SELECT file AS file_id, 'level' AS "column", count(*) AS present, count(*) FILTER (kept IS NULL) AS lost FROM k GROUP BY file""")
def values_lost(spark, folder):
    rows = _messy(spark, folder)
    return profile.values_lost(rows, *profile.profile(rows))


@query("""SELECT event_type AS file_id, event_id AS row, CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+01:00' WHEN 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
    WHEN 'signup' THEN strftime(ts, '%Y-%m-%dT00:00:00') ELSE strftime(ts, '%Y-%m-%dT%H:%M:00') END AS result_time, value AS value_num FROM events""")
def normalize_rows(spark, folder):
    rows = _times(spark, folder).withColumn("names", F.array(F.lit("time"), F.lit("value")))
    out = profile.normalize(rows, *profile.profile(rows))
    return out.where("column = 'value'").select("file_id", "row", "result_time", "value_num")


@query("""SELECT user_id, count(*) AS n, max(k) AS last_row FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) WHERE k < 40 GROUP BY ALL""")
def row_cap(spark, folder):
    """The cap is the feature: the first 40 rows of each user's file reach the normal form."""
    from pyspark.sql import Window
    by_file = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("file"), (F.row_number().over(by_file) - 1).alias("row"), F.array(F.lit("value")).alias("names"),
        F.array(F.col("value").cast("string")).alias("cells"))
    long = profile.normalize(rows, *profile.profile(rows), max_rows=40)
    return long.groupBy(F.col("file_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("last_row"))


@query("""WITH c AS (SELECT 'user ' || user_id AS file, event_id AS row, unnest([{'c': 'level', 'v': CASE WHEN value >= 25 THEN value::VARCHAR END}, {'c': 'kind', 'v': CASE WHEN event_type <> 'view' THEN event_type END}]) AS x, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time FROM events)
  SELECT file, x.c AS "column", arg_min(x.v, row) FILTER (x.v IS NOT NULL) AS value, arg_min(time, row) FILTER (x.v IS NOT NULL) AS time FROM c GROUP BY ALL""")
def first_value(spark, folder):
    events = table(spark, folder, "events")
    file = F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string")).alias("file")
    rows = events.select(file, F.col("event_id").alias("row"), F.array(F.lit("level"), F.lit("kind")).alias("names"), F.array(
        F.when(F.col("value") >= 25, F.col("value").cast("string")), F.when(F.col("event_type") != "view", F.col("event_type"))
    ).alias("cells"))
    times = events.select(file, F.col("event_id").alias("row"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"))
    return profile.first_value(profile.cells(rows), times)


_LINES = "l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), b AS (SELECT doc_id, lines, list_filter(lines, lambda x: x <> '')[1:5] AS body FROM l)"
_COUNTS = "SELECT *, list_transform(body, lambda x: length(x) - length(replace(x, chr(9), ''))) AS t, list_transform(body, lambda x: length(x) - length(replace(x, ';', ''))) AS s, list_transform(body, lambda x: length(x) - length(replace(x, ',', ''))) AS c FROM b"


@query(f"""WITH {_LINES}, k AS ({_COUNTS}) SELECT doc_id, CASE WHEN len(body) = 0 THEN ',' WHEN list_min(t) = list_max(t) AND list_min(t) >= 1 THEN chr(9) WHEN list_min(s) = list_max(s) AND list_min(s) >= 1 THEN ';'
    WHEN list_min(c) = list_max(c) AND list_min(c) >= 1 THEN ',' WHEN greatest(list_min(t), list_min(s), list_min(c)) < 1 THEN ',' WHEN list_min(t) = greatest(list_min(t), list_min(s), list_min(c)) THEN chr(9)
    WHEN list_min(s) = greatest(list_min(t), list_min(s), list_min(c)) THEN ';' ELSE ',' END AS sep, list_min(c) AS fewest_commas FROM k""")
def delimiter_detection(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    body = F.slice(F.filter("lines", lambda x: x != ""), 1, 5)
    commas = F.array_min(F.transform(body, lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))))
    return lines.select("doc_id", folders.delimiter(F.col("lines")).alias("sep"), commas.alias("fewest_commas"))


@query("""WITH l AS (SELECT doc_id, string_split(',' || replace(text, '. ', chr(10)), chr(10)) AS lines FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'x,' || text END AS text FROM documents)),
  m AS (SELECT doc_id, lines[1] AS a, lines[2] AS b, CASE WHEN doc_id % 3 = 0 THEN '7' || lines[3] ELSE lines[3] END AS c FROM l)
  SELECT doc_id, CASE WHEN a <> '' AND b <> '' AND c <> '' AND trim(split_part(a, ',', 1)) = '' AND NOT regexp_matches(trim(split_part(b, ',', 1)), '^\\d') AND regexp_matches(trim(split_part(c, ',', 1)), '^\\d') THEN 2 ELSE 1 END AS header_rows FROM m""")
def header_detection(spark, folder):
    docs = table(spark, folder, "documents").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("x,"), "text")))
    lines = F.split(F.concat(F.lit(","), F.replace("text", F.lit(". "), F.lit("\n"))), "\n")
    lines = docs.select("doc_id", F.transform(lines, lambda x, i: F.when((i == 2) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("7"), x)).otherwise(x)).alias("lines"))
    return lines.select("doc_id", folders.header_rows(F.col("lines"), F.lit(",")).alias("header_rows"))


@query("""SELECT source || '/' || doc_id AS source, CASE WHEN length(t) > 20000 THEN left(t, 20000) || chr(10) || '…[truncated]' ELSE t END AS text
  FROM (SELECT *, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM documents) WHERE t <> ''""")
def companion_chunks(spark, folder):
    docs = table(spark, folder, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), "text")
    return evidence.companion_chunks(docs)


@query(f"""WITH {PROFILE_SQL} SELECT 'structure:' || file AS source, 'file: ' || file || chr(10) || 'folder: .' || chr(10) || string_agg('  - column_key: ' || file || '::' || "column" || chr(10) || '    name=' || "column"
    || '  observation=?  unit=?  samples=[' || coalesce(array_to_string(string_split(samples, '|')[1:3], ', '), '?') || ']', chr(10) ORDER BY pos) AS text FROM p WHERE role IN ('observable_property', 'unknown') GROUP BY file""")
def structure_chunks(spark, folder):
    return evidence.structure_chunks(profile.profile_columns(_rows(spark, folder)))


@query(f"""WITH {PROFILE_SQL}, s1 AS (SELECT 'structure:' || file AS source FROM p WHERE role IN ('observable_property', 'unknown') GROUP BY file) SELECT source FROM s1""")
def structure_only(spark, folder):
    chunks = evidence.structure_chunks(profile.profile_columns(_rows(spark, folder))).select("source", "text")
    docs = table(spark, folder, "documents").select("source", "text")
    return evidence.structure_only(chunks.unionByName(evidence.companion_chunks(docs))).select("source")


@query("""WITH RECURSIVE d AS (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations),
  names AS (SELECT DISTINCT conv_id, w AS "column" FROM (SELECT conv_id, regexp_extract(unnest(lines), '^\\p{L}+') AS w FROM d) WHERE length(w) >= 3),
  n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS no, line FROM (SELECT conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)),
  hits AS (SELECT n.conv_id, no, "column" FROM n JOIN names USING (conv_id) WHERE length(line) <= 160 AND NOT contains(lower(line), 'http') AND regexp_matches(lower(line), '(^|[^\\p{L}\\p{N}_])' || lower("column") || '($|[^\\p{L}\\p{N}_])')),
  near AS (SELECT h.conv_id, h."column", h.no AS m, n.no, trim(n.line, ' ' || chr(9) || chr(13)) AS t FROM hits h JOIN n ON n.conv_id = h.conv_id AND n.no BETWEEN h.no AND h.no + 2),
  f AS (SELECT conv_id, "column", t, min((m, no)) AS seen FROM near WHERE t <> '' AND length(t) <= 160 AND NOT contains(lower(t), 'http') GROUP BY ALL),
  g AS (SELECT *, seen[1] AS m, coalesce(sum(length(t)) OVER (PARTITION BY conv_id, "column" ORDER BY seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
  k AS (SELECT *, min(before) OVER (PARTITION BY conv_id, "column", m) AS start FROM g)
  SELECT conv_id::VARCHAR AS dataset_id, "column", string_agg(t, ' ' ORDER BY seen) AS context FROM k WHERE start <= 200 GROUP BY ALL""")
def metadata_context(spark, folder):
    turns = table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("dataset_id"), F.col("turn").cast("int").alias("ord"), "text")
    lines = turns.select("dataset_id", F.explode(F.split("text", "\n")).alias("line"))
    names = lines.select("dataset_id", F.regexp_extract("line", r"^\p{L}+", 0).alias("column")).where(F.length("column") >= 3).distinct()
    return evidence.metadata_context(turns, names)


@query("""SELECT p_partkey, p_name AS "column" FROM part WHERE contains(lower(p_name), 'ring')""")
def columns_named_like(spark, folder):
    names = table(spark, folder, "part").select("p_partkey", F.initcap("p_name").alias("column"))
    return build.columns_named_like(names, "RING").withColumn("column", F.lower("column"))
