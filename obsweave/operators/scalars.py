"""One-row results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Columns of several one-row results in one row; a union, since joining them would be a cross join."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])
