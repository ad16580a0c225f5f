"""Dataset folders: discovery, dialects, raw rows, companion texts."""

from __future__ import annotations

import codecs
import contextlib
import csv
import hashlib
import io

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from obsweave.functions import fixed
from obsweave.functions.values import known
from obsweave.session import join_small, ship, staged
from obsweave.sources import files, records
from obsweave.sources.files import LISTING_TASKS, opened

HEAD_LINES = 5
ENCODING_CHARS = 4096
ENCODING_READ = 8192
PIECE = 1 << 20
# Beyond this many tables, files of at most SMALL_FILE bytes are read whole by the tasks that annotate their lines: what Spark
# knows about each file of a scan is held by the driver.
MANY_FILES = 10_000
SMALL_FILE = 8 << 20
SMALL_TASK = 1_000
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _root_uri(spark: SparkSession, root: str) -> str:
    """Root folder spelled the way file paths in query results are."""
    return files.qualified(spark, root)[1].toString().rstrip("/")


def _relative(path: Column, root_uri: str) -> Column:
    return F.substring(path, len(root_uri) + 2, 100_000)


@contextlib.contextmanager
def _few_listing_tasks(spark: SparkSession):
    """Folders are listed by a few tasks a core; otherwise Spark takes one task for every folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), LISTING_TASKS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discover(spark: SparkSession, root: str, tables: list[str] = fixed.TABLE_EXTENSIONS) -> DataFrame:
    """Files below `root` as (path, file, length, kind): table, readable or skipped, by extension.

    Folders are listed by tasks, so the driver holds none of their files, and no content is read.
    """
    root_uri = _root_uri(spark, root)
    listed = files.listed(spark, root_uri)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = (
        F.when(ext.isin(tables), "table")
        .when(ext.isin(fixed.TEXT_EXTENSIONS), "readable")
        .otherwise("skipped")
    )
    return listed.select("path", _relative(F.col("path"), root_uri).alias("file"), "length", kind.alias("kind"))


def _any_case(extensions: list[str]) -> str:
    """Glob of names with one of the extensions, whatever the case of each letter."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in extensions) + "}"


def _encoding(raw) -> str:
    """utf-8 when the reads that give the first characters decode, else latin-1."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    chars = 0
    try:
        while chars < ENCODING_CHARS:
            data = raw.read(ENCODING_READ)
            chars += len(decoder.decode(data, final=not data))
            if not data:
                break
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8"


def _head_lines(raw, encoding: str) -> list[str]:
    """First lines: at least three, and on until five are not empty."""
    lines: list[str] = []
    for line in io.TextIOWrapper(raw, encoding=encoding, errors="replace"):
        lines.append(line.rstrip("\r\n").removeprefix("﻿" if not lines else ""))
        if len(lines) >= 3 and sum(1 for x in lines if x) >= HEAD_LINES:
            break
    return lines


def _read_heads(batches):
    """The one thing built-in readers cannot do: read the start of a file without reading all of it."""
    for batch in batches:
        found = []
        for path in batch["path"]:
            with opened(path) as raw:
                encoding = _encoding(raw)
            with opened(path) as raw:
                found.append((encoding, _head_lines(raw, encoding)))
        yield batch[["path", "file"]].assign(
            encoding=[e for e, _ in found], lines=[lines for _, lines in found]
        )


def heads(tables: DataFrame) -> DataFrame:
    """(path, file, encoding, lines) of every table, read on the executors."""
    ship(tables.sparkSession)
    return tables.select("path", "file").mapInPandas(
        _read_heads, "path string, file string, encoding string, lines array<string>"
    )


def _counter(sep: str):
    return lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit("")))


def delimiter(lines: Column) -> Column:
    """Separator of a file from its first five lines that are not empty.

    The first separator found equally often (at least once) in each line; else the one with the
    largest smallest count, if above 0; else the comma.
    """
    body = F.slice(F.filter(lines, lambda x: x != ""), 1, HEAD_LINES)
    low, high = {}, {}
    for sep in fixed.SEPARATORS:
        counts = F.transform(body, _counter(sep))
        low[sep], high[sep] = F.array_min(counts), F.array_max(counts)
    tab, semi, comma = fixed.SEPARATORS
    out = F.when(F.size(body) == 0, comma)
    for sep in fixed.SEPARATORS:
        out = out.when((low[sep] == high[sep]) & (low[sep] >= 1), sep)
    best = F.greatest(*low.values())
    return out.when(best < 1, comma).when(low[tab] == best, tab).when(low[semi] == best, semi).otherwise(comma)


def header_rows(lines: Column, sep: Column) -> Column:
    """2 when line 1 starts with an empty cell, line 2 with text and line 3 with a digit; else 1."""
    first = F.transform(F.slice(lines, 1, 3), lambda x: F.trim(F.split_part(x, sep, F.lit(1))))
    full = F.size(F.filter(F.slice(lines, 1, 3), lambda x: x != "")) == 3
    two = full & (first[0] == "") & ~first[1].rlike(r"^\d") & first[2].rlike(r"^\d")
    return F.when(two, 2).otherwise(1)


@F.pandas_udf(ArrayType(StringType()))
def column_names(lines: pd.Series, sep: pd.Series, rows: pd.Series) -> pd.Series:
    """Column names from the header lines, which may quote separators; runs once per file.

    One header row: empty names become 'Unnamed: <position>', repeated ones get '.1', '.2'.
    Two rows: the levels that are not blank, joined by a space.
    """
    def names(head, sep, rows):
        cells = [next(csv.reader([line], delimiter=sep), []) for line in list(head)[:rows]]
        if rows == 2:
            width = max(len(c) for c in cells)
            levels = [[*c, *[""] * (width - len(c))] for c in cells]
            return [" ".join(p for p in parts if p.strip() and not p.startswith("Unnamed")) for parts in zip(*levels)]
        taken: dict[str, int] = {}
        out = []
        for i, name in enumerate(cells[0] if cells else []):
            name = name or f"Unnamed: {i}"
            n = taken.get(name, 0)
            taken[name] = n + 1
            out.append(f"{name}.{n}" if n else name)
        return out

    return pd.Series([names(*args) for args in zip(lines, sep, rows)])


def dialects(head: DataFrame) -> DataFrame:
    """(path, file, encoding, sep, header_rows, names) of every table."""
    found = head.withColumn("sep", delimiter(F.col("lines")))
    found = found.withColumn("header_rows", header_rows(F.col("lines"), F.col("sep")))
    return found.select(
        "path", "file", "encoding", "sep", "header_rows",
        # blank lines are no header, as they are no rows
        column_names(F.filter("lines", lambda x: F.trim(x) != ""), "sep", "header_rows").alias("names"),
    )


def _cells(line: Column, sep: str) -> Column:
    """Cells of one line; only lines with quotes take the slower pattern."""
    plain = F.split(line, "[" + sep + "]")
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{sep}(?:"[^"]*(?:""[^"]*)*"|[^{sep}]*)'), 0)
    quoted = F.transform(quoted, lambda c: F.substring(c, 2, 1_000_000_000))
    quoted = F.transform(quoted, lambda c: F.when(
        F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))
    ).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def _splits_are_stable(spark: SparkSession, scan: DataFrame) -> bool:
    """Whether the input is so large that its split size is the largest one, whatever the number of cores.

    The scan has listed its files, so their bytes are known without listing them again.
    """
    total = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return total >= records.STABLE_SPLITS * size * spark.sparkContext.defaultParallelism


def _scanned(scan: DataFrame, root_uri: str) -> DataFrame:
    """(file, block, line) of a scan of texts."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(path, "^file:/+", "file:/")
    return scan.select(
        _relative(path, root_uri).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )


def _with_length(batches):
    for batch in batches:
        yield batch.append_column("length", pa.array([files.length(p) for p in batch["path"].to_pylist()], pa.int64()))


def _lines_of_many(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """Annotated lines of many files, written once. Only files above SMALL_FILE are scanned, and these are few for their bytes."""
    ship(spark)
    sized = staged(found.select("path", "file", "sep").mapInArrow(_with_length, "path string, file string, sep string, length long"), "sizes")
    small, large = sized.where(F.col("length") <= SMALL_FILE), sized.where(F.col("length") > SMALL_FILE)
    tasks = max(spark.sparkContext.defaultParallelism, -(-small.count() // SMALL_TASK))
    lines = staged(records.annotated_files(small.drop("length").repartition(tasks)), "lines")
    paths = [r["path"] for r in large.select("path").collect()]
    if not paths:
        return lines
    # the paths are names, not patterns
    scan = spark.read.option("globPaths", "false").text(paths)
    return lines.unionByName(records.annotated(_scanned(scan, _root_uri(spark, root)), large, keep=True))


def table_lines(spark: SparkSession, root: str, found: DataFrame, tables: list[str] = fixed.TABLE_EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(lines, blocks) of all tables below a folder, in one scan whatever their dialects; see `records`."""
    if found.select("file").limit(MANY_FILES + 1).count() > MANY_FILES:
        lines = _lines_of_many(spark, root, found)
        return lines, staged(records.block_states(lines), "block-states")
    with _few_listing_tasks(spark):
        scan = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _any_case(tables)).text(root)
    lines = _scanned(scan, _root_uri(spark, root))
    lines = records.annotated(lines, found, keep=not _splits_are_stable(spark, scan))
    return lines, staged(records.block_states(lines), "block-states")


def rows_of(lines: DataFrame, blocks: DataFrame, found: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Rows of the tables as (file, row, names, cells); cells that are missing or stand for nothing are null."""
    rows = join_small(records.records(lines, blocks), found.select("file", "encoding", "sep", "header_rows", "names"), "file", "inner")
    # a record that is no UTF-8 keeps its characters, though the head of its file said otherwise
    text = F.col("text").cast("string")
    rows = rows.withColumn("_text", F.when((F.col("encoding") == "latin-1") | ~F.is_valid_utf8(text), F.decode("text", "ISO-8859-1")).otherwise(text))
    tab, semi, comma = fixed.SEPARATORS
    cells = (
        F.when(F.col("sep") == tab, _cells(F.col("_text"), tab))
        .when(F.col("sep") == semi, _cells(F.col("_text"), semi))
        .otherwise(_cells(F.col("_text"), comma))
    )
    rows = rows.where(F.col("record") >= F.col("header_rows")).withColumn("cells", cells)
    padded = F.transform("names", lambda n, i: F.get(F.col("cells"), i))
    rows = rows.select(
        "file", (F.col("record") - F.col("header_rows")).alias("row"), "names",
        F.transform(padded, known).alias("cells"),
    )
    return rows if max_rows is None else rows.where(F.col("row") < max_rows)


def raw_rows(spark: SparkSession, root: str, found: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Rows of all tables below a folder as (file, row, names, cells); `row` counts the records of a file from 0."""
    return rows_of(*table_lines(spark, root, found), found, max_rows)


def unclosed_quotes(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(file, row) of each file with a quote that is never closed: from this row on its lines were taken as rows."""
    opened = join_small(records.unclosed(blocks), found.select("file", "header_rows"), "file", "inner")
    return opened.select("file", (F.col("record") - F.col("header_rows")).alias("row"))


def _pieces(path: str, size: int = PIECE):
    """The text of a file without white space around it, in pieces that end with a line break, the last one excepted.

    A piece has at least `size` characters. Lines of several pieces are cut too, each part longer than lines that count as evidence.
    """
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    text = ""  # what is read and not given yet
    begun = False
    with opened(path) as raw:
        while data := raw.read(size):
            text += decoder.decode(data)
            if not begun:
                text = text.lstrip(_WHITE)
                begun = text != ""
            body = len(text.rstrip(_WHITE))
            cut = text.rfind("\n", size - 1, body) + 1 or (3 * size if body >= 4 * size else 0)
            if cut:
                yield text[:cut]
                text = text[cut:]
    text = (text + decoder.decode(b"", final=True)).rstrip(_WHITE)
    text = text if begun else text.lstrip(_WHITE)
    if text:
        yield text


def _readable(spark: SparkSession, root: str) -> DataFrame:
    """(path, file, source) of the companion files, whose content the listing does not read."""
    ship(spark)
    listed = discover(spark, root).where("kind = 'readable'")
    return listed.select("path", "file", F.regexp_extract("path", "([^/]+)$", 1).alias("source"))


def companions(spark: SparkSession, root: str) -> DataFrame:
    """(file, source, piece, text) of the readable companion files that are not empty.

    Files come in pieces, cut between lines and numbered from 0, so that no task holds a large file; a small one is one piece.
    """
    def read(batches):
        for batch in batches:
            for path, file, source in zip(batch["path"], batch["file"], batch["source"]):
                for i, text in enumerate(_pieces(path)):
                    yield pd.DataFrame({"file": [file], "source": [source], "piece": [i], "text": [text.removesuffix("\n").removesuffix("\r")]})

    return _readable(spark, root).mapInPandas(read, "file string, source string, piece long, text string")


def companion_digests(spark: SparkSession, root: str) -> DataFrame:
    """(file, source, chars, code) of the same files: the length of the whole text and its MD5, in memory of a few pieces."""
    def read(batches):
        for batch in batches:
            for path, file, source in zip(batch["path"], batch["file"], batch["source"]):
                chars, code = 0, hashlib.md5()
                for text in _pieces(path):
                    chars += len(text)
                    code.update(text.encode())
                if chars:
                    yield pd.DataFrame({"file": [file], "source": [source], "chars": [chars], "code": [code.hexdigest()]})

    return _readable(spark, root).mapInPandas(read, "file string, source string, chars long, code string")
