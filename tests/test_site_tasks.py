import os

from pyspark.sql import functions as F

from obsweave.sources import folder as folders
from obsweave.sources import sinks


def test_many_small_site_files_are_written_by_several_tasks_and_listed_by_few(spark, tmp_path):
    n = spark.sparkContext.defaultParallelism
    wide = spark.range(40).select(
        F.concat(F.lit("site"), (F.col("id") % 4).cast("string")).alias("site"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("device"),
        F.col("id").alias("timestamp"), F.col("id").cast("double").alias("temp"))
    sinks.write_sites(wide, str(tmp_path / "sites"))
    names = [f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".csv")]
    assert len(names) == 40
    # small files used to fall to one task, as its bytes are few
    assert len({f.split("-")[1] for f in names}) > 1 or n == 1
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with folders._few_listing_tasks(spark):
        assert int(spark.conf.get(name)) <= folders.LISTING_TASKS * n
    assert spark.conf.get(name) == before
    assert folders.discover(spark, str(tmp_path / "sites")).where("kind = 'table'").count() == 40
