"""What the operators of this folder share: tables, row batches, and components of links."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.session import ship, staged

# Rows that a Python task turns into one Arrow batch at a time.
SLICE = 512

_LIBC = ctypes.CDLL(None)
_FORGETTING: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Names what an operator keeps in a Python worker between its tasks."""
    _FORGETTING[owner] = forget


def alone(owner: str) -> None:
    """Called by a task of `owner`: a worker serves one operator after another, and drops what the others keep in it."""
    others = [forget for name, forget in _FORGETTING.items() if name != owner]
    for forget in others:
        forget()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # what earlier tasks freed goes back to the system
        _LIBC.malloc_trim(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that memory follows a few texts and not a whole Arrow batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`each` on short Arrow batches inside the tasks; batches for which it gives None are left out."""
    ship(df.sparkSession)

    def run(batches):
        for batch in slices(batches):
            out = each(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links -> (id, component): the smallest id that each linked id reaches.

    Every round gives each id the smallest neighbour as parent, follows parents of parents, and replaces the
    links by the distinct links between parents, so links shrink until none is left. Rounds are written to the
    shared folder. Ids without links have no row. Null ends are ignored.
    """
    links = links.select("a", "b").where("a <> b").distinct()
    links, labels = staged(links, f"{name}-links"), None
    while not links.isEmpty():
        ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("p"))
        parent = staged(parent, f"{name}-parents")
        for _ in range(2):
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("id", F.coalesce("pp", "p").alias("p"))
        parent = staged(parent, f"{name}-jumped")
        if labels is None:
            labels = parent.withColumnRenamed("p", "component")
        else:
            up = parent.withColumnRenamed("id", "component")
            labels = labels.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        labels = staged(labels, f"{name}-labels")
        left, right = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        links = links.join(left, "a").join(right, "b").where("pa <> pb")
        links = staged(links.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-links")
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
