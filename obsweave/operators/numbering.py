"""Row numbers without one task seeing every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.session import join_small, staged


def number_by(df: DataFrame, order: str, name: str, bucket: int = 100_000) -> DataFrame:
    """1-based position of each row by a distinct integer column.

    Rows are numbered inside buckets of the order value; only the bucket counts pass one window.
    """
    keyed = df.withColumn("_bucket", F.floor(F.col(order) / bucket))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    numbered = keyed.withColumn("_in", inside)
    return (
        join_small(numbered, offsets, "_bucket", "inner")
        .withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_bucket", "_in", "_before")
    )


def number_in_order(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """1-based position of each row among the rows of equal `keys`, by `order`, which should end in something unique.

    Rows are dealt to tasks by range of keys and order and sorted there; the counts of the (task, key) runs are summed up
    to what lies before each run. A group of any size spreads over many tasks, and with no keys the whole table is one.
    Rows are written once, so that the counts and the rows see the same ranges.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by = [*keys, *order]
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("*", F.shiftright(at, 33).alias("_part"), at.alias("_at"))
    rows = staged(rows, "ordered")
    runs = rows.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_run"), *[F.col(k).alias(f"_of_{k}") for k in keys], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_add"))
    same = F.col("_part") == F.col("_run")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return join_small(rows, runs, same, "inner").withColumn(name, F.col("_at") + F.col("_add")).select(*df.columns, name)
