"""Tables with a known shape: parquet, N-Triples, JSON lines, gold files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.functions.text import not_blank, unescape


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def time_window(signal: DataFrame, start: str, end: str, source: Column | None = None, time: str = "timestamp") -> DataFrame:
    """Facts of a half-open time window, optionally of one source; both filters reach the scan."""
    kind = signal.schema[time].dataType
    out = signal.where((F.col(time) >= F.lit(start).cast(kind)) & (F.col(time) < F.lit(end).cast(kind)))
    return out if source is None else out.where(source)


# A whole line: subject, predicate, object, the quote and body of a literal, its type and language. Repetitions never give back.
_LINE = (
    r'^\s*+(?:<([^>]*+)>|(_:\S++))\s++<([^>]*+)>\s++'
    r'(?:<([^>]*+)>|(_:\S+?)|(")([^"\\]*+(?:(?s:\\.)[^"\\]*+)*+)"(?:\^\^<([^>]*+)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)'
    r'\s*\.\s*(?:#.*)?[\u0085\u2028\u2029]?\z'
)
_PARTS = "$1$2\n$3\n$4$5\n$6\n$7\n$8\n$9"


def _plain_parts(cut: Column) -> Column:
    """The parts of a line that is cut at its `>`, where this alone shows what they are; null for all other lines.

    Plain lines are `<s> <p> <o> .`, `<s> <p> "o" .` and `<s> <p> "o"^^<type> .` with one space between terms and neither quotes nor
    escapes in the literal. The pattern finds the same in them, at several times the cost.
    """
    at = lambda i: F.get(cut, F.lit(i))
    rest = lambda c, n: F.substring(c, n, 1_000_000_000)
    none = F.lit("")
    o = at(2)
    begun = F.startswith(at(0), F.lit("<")) & F.startswith(at(1), F.lit(" <"))
    ended = begun & (F.size(cut) == 4) & (at(3) == " .")
    quoted = F.startswith(o, F.lit(' "')) & ~F.contains(o, F.lit("\\")) & (F.length(o) - F.length(F.replace(o, F.lit('"'), F.lit(""))) == 2)
    after = F.substring_index(o, '"', -1)
    body = F.substring_index(rest(o, 3), '"', 1)
    s, p = rest(at(0), 2), rest(at(1), 3)
    return (
        F.when(ended & F.startswith(o, F.lit(" <")), F.array(s, p, rest(o, 3), none, none, none, none))
        .when(ended & quoted & F.startswith(after, F.lit("^^<")), F.array(s, p, none, F.lit('"'), body, rest(after, 4), none))
        .when(begun & (F.size(cut) == 3) & quoted & (after == " ."), F.array(s, p, none, F.lit('"'), body, none, none))
    )


def ntriples_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of N-Triples files as (value, ok, s, p, o, o_kind, o_datatype, o_lang); `ok` is null for blank and comment lines.

    The body of a literal ends at its first quote that is not escaped, and may have any length. Plain lines are only cut at
    their `>`; any other meets its pattern once: what the pattern finds is put between line breaks, which no line holds. The
    generators keep the cuts and filters on the parts from being computed on their own.
    """
    cut = spark.read.text(path).select("value", F.explode(F.array(F.split("value", ">", -1))).alias("_cut"))
    parts = F.coalesce(_plain_parts(F.col("_cut")), F.split(F.regexp_replace("value", _LINE, _PARTS), "\n", -1))
    rows = cut.select("value", F.explode(F.array(parts)).alias("_part"))
    part = lambda i: F.get("_part", F.lit(i))
    literal = part(3) == '"'
    return rows.select(
        "value", F.when(F.size("_part") == 7, True).when(~F.col("value").rlike(r"^\s*(?:#.*)?$"), False).alias("ok"),
        unescape(part(0)).alias("s"), unescape(part(1)).alias("p"),
        F.when(literal, unescape(part(4))).otherwise(unescape(not_blank(part(2)))).alias("o"),
        F.when(literal, "literal").otherwise("iri").alias("o_kind"),
        F.when(literal, unescape(not_blank(part(5)))).alias("o_datatype"), F.when(literal, not_blank(part(6))).alias("o_lang"),
    )


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples as (s, p, o, o_kind, o_datatype, o_lang)."""
    return ntriples_lines(spark, path).where("ok").drop("value", "ok")


def ntriples_rejected(spark: SparkSession, path: str) -> DataFrame:
    """(line, n) of lines that are neither triples nor blank nor comments, and how often each occurs."""
    return ntriples_lines(spark, path).where("NOT ok").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def feature_classes(spark: SparkSession, path: str) -> DataFrame:
    """Feature-class vocabulary from JSON lines."""
    return spark.read.schema("uri string, label_en string, label_nl string, def_en string").json(path)


GOLD_ROW = (
    "type string, variable string, file string, `column` string, value string, resultTime string, sensor string,"
    " sensor_type string, observedProperty string, property_source string, decision string, unit string,"
    " feature string, feature_gwsw string, accept array<string>, note string"
)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows of one or more gold files (nested JSON)."""
    read = spark.read.schema(f"dataset string, observations array<struct<{_fields(GOLD_ROW)}>>")
    return read.json(path, multiLine=True).select("dataset", F.inline("observations"))


def _fields(ddl: str) -> str:
    return ", ".join(f"{p.strip().split(' ')[0]}: {p.strip().split(' ')[1]}" for p in ddl.split(","))
