"""Evidence texts: file structure, companion documents, metadata lines that name a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsweave.functions import fixed, naming
from obsweave.functions.text import truncate
from obsweave.operators.profile import observable
from obsweave.session import join_small

# Every column adds more than 60 characters, so later ones lie beyond the limit of a chunk.
_CHUNK_COLUMNS = fixed.EVIDENCE_CHARS // 60 + 1
# Every kept line adds at least one character, and one match adds up to three lines.
_CONTEXT_LINES = fixed.METADATA_CHARS + 4


def structure_chunks(columns: DataFrame) -> DataFrame:
    """(source, text): per file its observable columns with up to three sample values.

    `columns` is (file, pos, column, role, sample_values). Only columns that can still fall inside the
    limit of a chunk are collected; the cut text is the same.
    """
    kept = columns.where(observable(F.col("role"))).withColumn(
        "_n", F.row_number().over(Window.partitionBy("file").orderBy("pos"))
    ).where(F.col("_n") <= _CHUNK_COLUMNS)
    samples = F.when(F.size("sample_values") > 0, F.array_join(F.slice("sample_values", 1, 3), ", ")).otherwise("?")
    entry = F.concat(
        F.lit("  - column_key: "), naming.column_key(F.col("file"), F.col("column")), F.lit("\n    name="), F.col("column"),
        F.lit("  observation=?  unit=?  samples=["), samples, F.lit("]"),
    )
    entries = F.transform(F.array_sort(F.collect_list(F.struct("_n", entry.alias("e")))), lambda x: x["e"])
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    head = F.concat(F.lit("file: "), F.col("file"), F.lit("\nfolder: "), F.when(folder == "", ".").otherwise(folder), F.lit("\n"))
    return kept.groupBy("file").agg(entries.alias("_e")).select(
        F.concat(F.lit("structure:"), F.col("file")).alias("source"), truncate(F.concat(head, F.array_join("_e", "\n"))).alias("text")
    )


def companion_chunks(texts: DataFrame) -> DataFrame:
    """(source, text) of companion documents, trimmed, cut, empty ones left out."""
    trimmed = F.regexp_replace(F.regexp_replace("text", r"^(?U)\s+", ""), r"(?U)\s+$", "")
    return texts.select("source", truncate(trimmed).alias("text")).where(F.col("text") != "")


def structure_only(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.startswith("source", F.lit("structure:")))


def metadata_context(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(dataset_id, column, context): metadata lines that name a column, each with the next two lines.

    `documents` is (dataset_id, ord, text) with ord counting 0, 1, 2.. in a dataset: their texts joined
    make one companion text. `names` is (dataset_id, column). Lines longer than the limit or with a link
    are skipped; equal lines count once; matching stops once more than 200 characters are collected.
    """
    lines = F.split("text", "\r\n|\r|\n")
    docs = documents.select("dataset_id", "ord", lines.alias("lines"))
    heads = docs.select("dataset_id", "ord", F.slice("lines", 1, 2).alias("head"))
    for step, name in ((1, "next1"), (2, "next2")):
        docs = docs.join(heads.select("dataset_id", (F.col("ord") - step).alias("ord"), F.col("head").alias(name)), ["dataset_id", "ord"], "left")
    none = F.array().cast("array<string>")
    after = F.slice(F.concat(F.coalesce("next1", none), F.coalesce("next2", none)), 1, 2)
    fits = lambda line: (F.length(line) <= fixed.METADATA_LINE_CHARS) & ~F.contains(F.lower(line), F.lit("http"))
    trimmed = lambda line: F.regexp_replace(line, r"^(?U)\s+|(?U)\s+$", "")
    lines = docs.select("dataset_id", "ord", F.concat("lines", after).alias("_all"), F.posexplode("lines").alias("no", "line")).where(fits(F.col("line")))
    near = F.transform(F.slice("_all", F.col("no") + 1, F.lit(3)), lambda x: F.when((trimmed(x) != "") & fits(trimmed(x)), trimmed(x)))
    keyed = lines.select("dataset_id", "ord", "no", "line", near.alias("near"), F.explode(_keys(F.col("line"))).alias("_key"))
    named = names.select("dataset_id", "column", _key(F.col("column")).alias("_key")).distinct()
    hits = join_small(keyed, named, ["dataset_id", "_key"], "inner").where(_names(F.col("line"), F.col("column")))
    near = hits.select("dataset_id", "column", "ord", "no", F.posexplode("near").alias("step", "text")).where(F.col("text").isNotNull())
    # a line counts where it is first seen; partial aggregation keeps repeated lines from piling up
    at = F.struct("ord", "no", "step")
    first = near.groupBy("dataset_id", "column", "text").agg(F.min(at).alias("at"))
    by_column = Window.partitionBy("dataset_id", "column").orderBy("at")
    ranked = first.withColumn("_rank", F.row_number().over(by_column)).where(F.col("_rank") <= _CONTEXT_LINES)
    match = F.struct(F.col("at.ord"), F.col("at.no"))
    by_match = Window.partitionBy("dataset_id", "column").orderBy("_rank")
    chars = F.sum(F.length("text")).over(by_match.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")
    # characters collected before the first line of this match
    summed = ranked.withColumn("_match", match).withColumn("_chars", chars)
    before = F.min("_chars").over(Window.partitionBy("dataset_id", "column", "_match"))
    kept = summed.withColumn("_before", before).where(F.col("_before") <= fixed.METADATA_CHARS)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "text"))), lambda x: x["text"])  # at most _CONTEXT_LINES
    return kept.groupBy("dataset_id", "column").agg(F.array_join(texts, " ").alias("context"))


def _keys(line):
    """Words of a line and what lies between them, lower-cased, each once."""
    text = F.lower(line)
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), 0), F.regexp_extract_all(text, F.lit(r"(?U)\W+"), 0)))


def _key(column):
    """What a line that names the column has among its keys: the name's first word, or the whole name if it has none.

    Between word borders the first word of a name is a whole word of the line, and a name without words is all that
    lies between two words. So lines meet only names that begin with one of their words.
    """
    text = F.lower(column)
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?U)\w+", 0), F.lit("")), text)


def _names(line, column):
    """Does the line hold the column name between word boundaries, whatever its case?

    The plain search comes first; the pattern is only built for lines that hold the name.
    """
    pattern = F.concat(F.lit(r"(?iU)\b\Q"), column, F.lit(r"\E\b"))
    return F.contains(F.lower(line), F.lower(column)) & F.regexp_like(line, pattern)
