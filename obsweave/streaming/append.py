"""Observation triples of a growing folder of parquet tables.

Unpivoting, mapping and triple generation work row by row, so the batch operators run unchanged on a
stream: no state, no watermark. Offsets and the list of written files live in the shared folder, which
makes a restarted stream go on where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from obsweave.operators import graph, reshape
from obsweave.session import shared_dir


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_triples(long: DataFrame, mapping: DataFrame) -> DataFrame:
    """Triples of a stream of long rows; `mapping` is a table."""
    return graph.observation_triples(reshape.observations(long, mapping))


def write_stream(triples: DataFrame, path: str, name: str) -> StreamingQuery:
    """Append triples to parquet files, each exactly once; stops when the present files are done."""
    checkpoint = os.path.join(shared_dir(triples.sparkSession), f"stream-{name}")
    return (
        triples.writeStream.format("parquet").outputMode("append").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
