"""Writers: normalized tables, N-Triples, site exports, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.functions.text import escape
from obsweave.session import join_small, staged
from obsweave.sources import files

# Rows that one file of a folder holds about; larger folders get several files.
FILE_ROWS = 5_000_000
# Files that one task writes about; a small file costs its making, which no count of bytes tells.
TASK_FILES = 100
# Lines of an N-Triples file; compressed files are read by one task each, so large graphs get many.
GRAPH_LINES = 2_000_000


def _by_folder(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out so that a folder gets one file for every FILE_ROWS rows, and not one from every task."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"))
    salted = join_small(rows, sizes, list(keys), "inner").withColumn("_salt", F.floor(F.rand(17) * F.col("_files")))
    return salted.repartition(*keys, "_salt").drop("_files", "_salt")


def write_normalized(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Normalized long rows, one folder per file."""
    _by_folder(rows, "file_id").write.mode("overwrite").partitionBy("file_id").format(form).save(path)


def nt_line() -> Column:
    """One N-Triples line of a triple; also valid Turtle."""
    literal = F.concat(
        F.lit('"'), escape(F.col("o")), F.lit('"'),
        F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang")))
        .when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">")))
        .otherwise(F.lit("")),
    )
    o = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(literal)
    return F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), o, F.lit(" ."))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """N-Triples as gzip files: addresses repeat from line to line, so the text of a graph is many times as large as its tables."""
    out = triples.select(nt_line().alias("value")).write.mode("overwrite")
    out.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).option("maxRecordsPerFile", GRAPH_LINES).text(path)


def csv_line(cells: Column) -> Column:
    """One line of comma-separated cells, quoted where they must be; null cells are empty."""
    def cell(c):
        text = F.coalesce(c, F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.array_join(F.transform(cells, cell), ",")


def write_sites(wide: DataFrame, path: str, keys: tuple[str, str] = ("site", "device"), order: str = "timestamp") -> None:
    """Wide rows, one folder per site and device; every file has a header of its own with the columns its device has values in.

    Columns a device never fills are not in its files. Rows come by `order`. A device of more than FILE_ROWS rows gets
    several files, each with the header.
    """
    fields = [c for c in wide.columns if c not in keys]
    own = wide.groupBy(*keys).agg(
        F.filter(F.array(*[F.when(F.max(F.col(c).isNotNull()), F.lit(c)) for c in fields]), lambda c: c.isNotNull()).alias("_own"),
        F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("_files"))
    own = staged(own, "device-columns")
    cells = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(c).cast("string") for c in fields]))
    rows = join_small(wide, own, list(keys), "inner").withColumn("_salt", F.floor(F.rand(17) * F.col("_files")).cast("int"))
    body = rows.select(*keys, "_salt", F.lit(1).alias("_part"), F.col(order).alias("_order"), csv_line(F.transform("_own", lambda c: F.element_at(cells, c))).alias("value"))
    heads = own.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_files") - 1)).alias("_salt"), F.lit(0).alias("_part"), F.lit(None).alias("_order"), csv_line(F.col("_own")).alias("value"))
    n = own.agg(F.sum("_files")).first()[0] or 0
    parts = max(wide.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_FILES))
    lines = heads.unionByName(body).repartition(parts, *keys, "_salt").sortWithinPartitions(*keys, "_salt", "_part", "_order")
    # a cell with line breaks takes several lines
    lines = lines.select(*keys, "_salt", F.explode(F.split("value", "\r\n|\r|\n")).alias("value"))
    files.write_lines(lines, path, keys, "_salt")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
