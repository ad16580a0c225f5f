"""Column and file profiles of raw rows, and the normalized rows that follow from them.

Raw rows are (file, row, names ARRAY<STRING>, cells ARRAY<STRING>); nulls are missing values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.functions import fixed, naming, values
from obsweave.session import join_small, staged

VOTE_ROWS = 500


def as_rows(df: DataFrame, file: str, row: Column, columns: list[str]) -> DataFrame:
    """Raw rows of a DataFrame: its columns as text."""
    text = [
        values.iso(F.col(c)) if df.schema[c].dataType.typeName().startswith("timestamp") else F.col(c).cast("string")
        for c in columns
    ]
    return df.select(
        F.lit(file).alias("file"), row.cast("long").alias("row"),
        F.array(*[F.lit(c) for c in columns]).alias("names"), F.array(*text).alias("cells"),
    )


def cells(rows: DataFrame) -> DataFrame:
    """One row per cell: (file, row, pos, column, value)."""
    return rows.select(
        "file", "row", F.posexplode(F.arrays_zip("names", "cells")).alias("pos", "_c")
    ).select("file", "row", "pos", F.col("_c.names").alias("column"), F.col("_c.cells").alias("value"))


def first_values(cell: DataFrame, n: int) -> DataFrame:
    """First n values that are not null of every column, with their rank.

    Spark keeps n rows per column on each task before the shuffle, so a long file does not flood one task.
    """
    order = Window.partitionBy("file", "pos", "column").orderBy("row")
    return cell.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _among(n: int, test: Column) -> Column:
    return F.when(F.col("rank") <= n, test)


def date_format_vote(rank: Column, value: Column, n: int = 20) -> Column:
    """Aggregate: name of the first format that parses all of the first n values, AMBIGUOUS, or null."""
    first = lambda test: F.bool_and(F.when(rank <= n, test))
    out = None
    for name, patterns in fixed.DATE_FORMATS:
        every = first(values.parse_with(value, patterns).isNotNull())
        out = F.when(every, name) if out is None else out.when(every, name)
    return out.when(first(values.ambiguous_local(value).isNotNull()), fixed.AMBIGUOUS)


def date_formats(first: DataFrame) -> DataFrame:
    return first.groupBy("file", "pos", "column").agg(date_format_vote(F.col("rank"), F.col("value")).alias("format"))


def time_zones(first: DataFrame) -> DataFrame:
    """First UTC offset at the end of one of the first 20 values of every column."""
    found = F.nullif(F.regexp_extract("value", fixed.OFFSET_SUFFIX, 0), F.lit(""))
    return first.groupBy("file", "pos", "column").agg(F.min_by(found, F.when((F.col("rank") <= 20) & found.isNotNull(), F.col("rank"))).alias("timezone"))


def frequencies(first: DataFrame, formats: DataFrame) -> DataFrame:
    """Most common gap between consecutive values among the first 100, the smallest of equals."""
    known = first.where(F.col("rank") <= 100).join(formats, ["file", "pos", "column"])
    instant = F.unix_micros(values.parse_time(F.col("value"), F.col("format")).cast("timestamp"))
    order = Window.partitionBy("file", "pos", "column").orderBy("rank")
    gap = known.withColumn("_t", instant).withColumn("_gap", F.col("_t") - F.lag("_t").over(order))
    return gap.groupBy("file", "pos", "column").agg(values.duration_text(F.mode("_gap", True)).alias("frequency"))


def column_counts(cell: DataFrame) -> DataFrame:
    """Counts per column that decide its type, in one aggregation with partial sums."""
    v = F.col("value")
    hit = lambda pattern: F.count_if(F.trim(v).rlike(pattern))
    comma_number = F.replace(v, F.lit(","), F.lit("."))
    return cell.groupBy("file", "pos", "column").agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("n_value"), hit(fixed.NUMBER).alias("n_number"),
        F.count_if(F.trim(comma_number).rlike(fixed.NUMBER) & ~F.contains(v, F.lit("."))).alias("n_comma_number"),
        hit(fixed.INTEGER).alias("n_integer"), hit(fixed.BOOLEAN).alias("n_boolean"),
        F.min(values.number(v)).alias("min_dot"), F.max(values.number(v)).alias("max_dot"), F.count(values.number(v)).alias("n_dot"),
        F.min(values.number(comma_number)).alias("min_comma"), F.max(values.number(comma_number)).alias("max_comma"),
        F.count(values.number(comma_number)).alias("n_comma"),
    )


def column_votes(first: DataFrame) -> DataFrame:
    """What the first values of a column say: number votes, decimal comma, dates, durations."""
    v = F.col("value")
    rate = lambda n, pattern: F.avg(_among(n, v.rlike(pattern).cast("double")))
    zone = F.nullif(F.regexp_extract("value", fixed.OFFSET_SUFFIX, 0), F.lit(""))
    return first.groupBy("file", "pos", "column").agg(
        rate(VOTE_ROWS, fixed.VOTE_DOT).alias("vote_dot"), rate(VOTE_ROWS, fixed.VOTE_COMMA).alias("vote_comma"),
        (rate(50, fixed.VOTE_COMMA) >= 0.9).alias("comma_like"),
        F.bool_or(_among(50, F.contains(v, F.lit(",")))).alias("comma_any"),
        F.bool_and(_among(5, v.rlike(fixed.ISO_8601))).alias("iso_first"),
        date_format_vote(F.col("rank"), v).alias("format"),
        F.min_by(zone, F.when((F.col("rank") <= 20) & zone.isNotNull(), F.col("rank"))).alias("timezone"),
    )


def typed(counts: DataFrame, votes: DataFrame) -> DataFrame:
    """Type of every column: integers, numbers, booleans, or text that is mostly numbers.

    A decimal comma found in one text column holds for its whole file.
    """
    joined = counts.join(votes, ["file", "pos", "column"], "left")
    comma_file = F.bool_or(
        (F.col("n_value") > F.col("n_number")) & F.coalesce("comma_like", F.lit(False)) & F.coalesce("comma_any", F.lit(False))
    )
    decimals = joined.groupBy("file").agg(F.when(comma_file, ",").otherwise(".").alias("decimal"))
    both = joined.join(decimals, "file")
    comma = F.col("decimal") == ","
    numbers = F.when(comma, F.col("n_comma_number")).otherwise(F.col("n_number"))
    full = F.col("n_value") == F.col("n")
    vote = F.when(comma, F.col("vote_comma")).otherwise(F.col("vote_dot"))
    dtype = (
        F.when(F.col("n_value") == 0, "float64")
        .when((F.col("n_integer") == F.col("n")), "int64")
        .when(numbers == F.col("n_value"), "float64")
        .when(full & (F.col("n_boolean") == F.col("n")), "bool")
        .when(vote >= 0.9, "float64")
        .otherwise("object")
    )
    numeric = dtype.isin(fixed.NUMERIC_DTYPES)
    kept = F.when(comma, F.col("n_comma")).otherwise(F.col("n_dot"))
    present = F.when(numeric, kept).otherwise(F.col("n_value"))
    return both.select(
        "file", "pos", "column", "decimal", "n", dtype.alias("dtype"),
        F.round(1 - present / F.col("n"), 4).alias("null_pct"),
        F.when(numeric, F.when(comma, F.col("min_comma")).otherwise(F.col("min_dot"))).alias("min"),
        F.when(numeric, F.when(comma, F.col("max_comma")).otherwise(F.col("max_dot"))).alias("max"),
        "iso_first", "format", "timezone",
    )


def shown(value: Column, dtype: Column, decimal: Column) -> Column:
    """Text of a cell as its column type prints it."""
    num = values.number(values.dot(value, decimal))
    return (
        F.when(dtype == "int64", num.try_cast("long").cast("string"))
        .when(dtype.isin(fixed.NUMERIC_DTYPES), num.cast("string"))
        .when(dtype == "bool", F.initcap(value))
        .otherwise(value)
    )


def sample_values(first: DataFrame, columns: DataFrame, n: int = 5) -> DataFrame:
    """Values of the first n rows of every column, nulls left out, in row order; they are among the first n values."""
    head = first.where(F.col("row") < n)
    text = head.join(columns.select("file", "pos", "dtype", "decimal"), ["file", "pos"]).withColumn(
        "_t", shown(F.col("value"), F.col("dtype"), F.col("decimal"))
    ).where(F.col("_t").isNotNull())
    pairs = F.array_sort(F.collect_list(F.struct("row", "_t")))  # at most n per column
    return text.groupBy("file", "pos").agg(F.transform(pairs, lambda p: p["_t"]).alias("sample_values"))


def datetime_test(name: Column, iso_first: Column, fmt: Column) -> Column:
    """Named like a date, or holding ISO dates first, and parsed by a known format."""
    return (name.rlike(fixed.DATETIME_NAMES) | F.coalesce(iso_first, F.lit(False))) & fmt.isNotNull()


def role(name: Column, is_timestamp: Column, samples: Column, dtype: Column) -> Column:
    """Role of a column; the first rule that holds."""
    some = F.coalesce(F.size(samples), F.lit(0)) > 0
    every = lambda pattern: some & F.forall(samples, lambda v: v.rlike(pattern))
    return (
        F.when(is_timestamp, "timestamp")
        .when(F.startswith(name, F.lit("Unnamed")), "row_index")
        .when(every(fixed.ISO_8601) | every(fixed.DURATION), "auxiliary")
        .when((dtype == "bool") | name.rlike(fixed.QUALITY_NAMES), "quality_flag")
        .when(dtype.isin(fixed.NUMERIC_DTYPES), "observable_property")
        .otherwise("unknown")
    )


def _head(rows: DataFrame, max_rows: int | None) -> DataFrame:
    return rows if max_rows is None else rows.where(F.col("row") < max_rows)


def profile(rows: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(columns, files): both profiles from two scans, one for counts and one for the first values of every column."""
    first = _first(rows, max_rows)
    columns = staged(profile_columns(rows, max_rows, first), "columns")
    return columns, staged(profile_files(rows, columns, max_rows, first), "files")


def _first(rows: DataFrame, max_rows: int | None) -> DataFrame:
    """The first values of every column, at most VOTE_ROWS each, written once: votes, samples, formats and gaps come from them."""
    return staged(first_values(cells(_head(rows, max_rows)), VOTE_ROWS), "first-values")


def profile_columns(rows: DataFrame, max_rows: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """Profile of every column over all rows, or over the first `max_rows` rows of each file.

    Number and date forms are votes of the first values of a column; `values_lost` counts what they cost.
    """
    cell = cells(_head(rows, max_rows))
    first = _first(rows, max_rows) if first is None else first
    columns = typed(column_counts(cell), column_votes(first))
    is_date = datetime_test(F.col("column"), F.col("iso_first"), F.col("format"))
    columns = columns.withColumn("is_datetime", F.coalesce(is_date, F.lit(False)))
    by_file = Window.partitionBy("file")  # the columns of one file
    first_date = F.min(F.when(F.col("is_datetime"), F.col("pos"))).over(by_file)
    columns = columns.withColumn("is_timestamp", F.coalesce(first_date == F.col("pos"), F.lit(False)))
    columns = columns.join(sample_values(first, columns), ["file", "pos"], "left")
    no_range = F.col("is_datetime")
    return columns.select(
        "file", "pos", "column", "dtype", "null_pct",
        F.when(~no_range, F.col("min")).alias("min"), F.when(~no_range, F.col("max")).alias("max"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        role(F.col("column"), F.col("is_timestamp"), F.col("sample_values"), F.col("dtype")).alias("role"),
        "n", "decimal", F.when(F.col("is_timestamp"), F.col("format")).alias("format"),
        F.when(F.col("is_timestamp"), F.col("timezone")).alias("timezone"),
    )


def profile_files(rows: DataFrame, columns: DataFrame, max_rows: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """Profile of every file: rows, decimal mark, timestamp column with its format, offset and frequency."""
    stamp = F.when(F.col("role") == "timestamp", F.col("pos"))
    files = columns.groupBy("file").agg(
        F.max("n").alias("row_count"), F.first("decimal").alias("decimal"), F.count(F.lit(1)).alias("n_columns"),
        F.min_by("column", stamp).alias("datetime_column"), F.min(stamp).cast("int").alias("datetime_pos"),
        F.min_by("format", stamp).alias("datetime_format"), F.min_by("timezone", stamp).alias("timezone"),
    )
    stamps = columns.where(F.col("role") == "timestamp").select("file", "pos", "column", "format")
    if first is None:
        first = first_values(cells(_head(rows, max_rows)).join(stamps.select("file", "pos"), ["file", "pos"], "left_semi"), 100)
    freq = frequencies(first, stamps).select("file", "frequency")
    sampled = F.lit(False) if max_rows is None else F.col("row_count") == max_rows
    return files.join(freq, "file", "left").withColumn("row_count_sampled", sampled)


def observable(role_col: Column) -> Column:
    return role_col.isin(fixed.OBSERVABLE_ROLES)


def normalize(rows: DataFrame, columns: DataFrame, files: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Normalized long rows: (file_id, row, result_time, pos, column, dtype, value, value_num).

    The decisions of the profile travel as one small row per file; the data is read once and not shuffled.
    Missing values stay as rows. A time that does not parse becomes null.
    """
    return _decided(rows, columns, files, max_rows).drop("cell", "is_stamp")


def values_lost(rows: DataFrame, columns: DataFrame, files: DataFrame, max_rows: int | None = None) -> DataFrame:
    """(file_id, column, present, lost): cells with a value, and those that the decided type or time format turns into null."""
    long = _decided(rows, columns, files, max_rows).where(F.col("cell").isNotNull())
    gone = F.when(F.col("is_stamp"), F.col("result_time").isNull()).otherwise(F.col("value").isNull())
    return long.groupBy("file_id", "column").agg(F.count(F.lit(1)).alias("present"), F.count_if(gone).alias("lost"))


def _decided(rows: DataFrame, columns: DataFrame, files: DataFrame, max_rows: int | None) -> DataFrame:
    """Normalized rows with the raw cell, and whether it is the one that gives the time."""
    kinds = columns.groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "dtype"))), lambda c: c["dtype"]).alias("dtypes")
    )  # one entry per column of the file
    plan = files.select("file", "decimal", "datetime_pos", "datetime_format").join(kinds, "file")
    joined = join_small(_head(rows, max_rows), plan, "file", "inner")
    stamp = F.get(F.col("cells"), F.col("datetime_pos"))
    timed = joined.withColumn("_stamp", stamp)
    timed = timed.withColumn("_local", values.local_time(F.col("_stamp"), F.col("datetime_format")))
    timed = timed.withColumn("result_time", values.with_offset(F.col("_local"), F.col("_stamp"), F.col("datetime_format")))
    long = timed.select(
        naming.file_id(F.col("file")).alias("file_id"), "row", "result_time", "decimal", "datetime_pos",
        F.posexplode(F.arrays_zip("names", "dtypes", "cells")).alias("pos", "_c"),
    )
    numeric = F.col("_c.dtypes").isin(fixed.NUMERIC_DTYPES)
    num = F.when(numeric, values.number(values.dot(F.col("_c.cells"), F.col("decimal"))))
    return long.select(
        "file_id", "row", "result_time", "pos", F.col("_c.names").alias("column"), F.col("_c.dtypes").alias("dtype"),
        shown(F.col("_c.cells"), F.col("_c.dtypes"), F.col("decimal")).alias("value"), num.alias("value_num"),
        F.col("_c.cells").alias("cell"), F.coalesce(F.col("pos") == F.col("datetime_pos"), F.lit(False)).alias("is_stamp"),
    )


def first_value(cell: DataFrame, times: DataFrame) -> DataFrame:
    """First value that is not null of every column, with the time of its row."""
    has = F.when(F.col("value").isNotNull(), F.col("row"))
    found = cell.groupBy("file", "pos", "column").agg(F.min(has).alias("row"), F.min_by("value", has).alias("value"))
    return found.join(times, ["file", "row"], "left").select("file", "column", "value", "time")
