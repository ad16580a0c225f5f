"""Wide rows to long observations, driven by a mapping table.

Mapping rows: dataset_id, file_id, value_col, value_dtype, sensor_uri, property_uri, unit_uri, foi_uri,
sampled, sampler_uri, sample_feature_uri (see `decide.mapping`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.functions import naming
from obsweave.session import join_small

MAPPING = (
    "dataset_id string, file_id string, value_col string, value_dtype string, sensor_uri string,"
    " property_uri string, unit_uri string, foi_uri string, sampled boolean, sampler_uri string,"
    " sample_feature_uri string"
)


def unpivot(df: DataFrame, file_id: str, row: Column, time: Column, columns: list[str], *extra: Column) -> DataFrame:
    """Long rows (file_id, row, result_time, value_col, value_num, value) of a wide table, nulls included.

    One scan and one generator for all columns, no shuffle.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("value_col"), F.col(c).cast("double").alias("value_num")) for c in columns
    ])
    # what belongs to the row is computed below the generator, once per row
    wide = df.select(F.lit(file_id).alias("file_id"), row.cast("string").alias("row"), time.alias("result_time"), *extra, cells.alias("_cells"))
    long = wide.select("*", F.inline("_cells")).drop("_cells")
    return long.withColumn("value", F.col("value_num").cast("string"))


def with_prefixes(mapping: DataFrame) -> DataFrame:
    """Mapping with the row-free part of every URI, built once per column rather than once per cell."""
    ds, file, col = F.col("dataset_id"), F.col("file_id"), F.col("value_col")
    return mapping.withColumns({
        "dataset": naming.slug(ds), "obs_prefix": naming.row_prefix("obs", ds, file, col),
        "result_prefix": naming.row_prefix("result", ds, file, col),
        "sample_prefix": naming.row_prefix("sample", ds, file),
        "sampling_prefix": naming.row_prefix("sampling", ds, file),
    })


def observations(long: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per observation: a cell of a mapped column, with or without a value.

    Rows that name their own sensor (`row_sensor_uri`) keep it where the mapping has none.
    """
    obs = join_small(long, with_prefixes(mapping), ["file_id", "value_col"], "inner")
    if "row_sensor_uri" in long.columns:
        obs = obs.withColumn("sensor_uri", F.coalesce("sensor_uri", "row_sensor_uri")).drop("row_sensor_uri")
    return obs


def slug_collisions(mapping: DataFrame) -> DataFrame:
    """Columns of one file id whose slugs are equal: their observations would share URIs."""
    return (
        mapping.groupBy("dataset_id", "file_id", naming.slug(F.col("value_col")).alias("slug"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value_col").alias("n_columns")).where("n > 1")
    )
