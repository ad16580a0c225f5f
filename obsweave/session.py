"""Session set-up, the shared folder, and joins against sides of a checked size."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 100_000

_SHIPPED: set[str] = set()


def local_session(cores: str | int = "*", memory: str = "16g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("obsweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: spark.checkpoint.dir. Only a session on one machine may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-obsweave-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts `small` when it has at most `limit` rows.

    Beyond it the join shuffles, and adaptive execution splits the hot keys of `big`.
    """
    bounded = bounded_side(small, limit)
    return big.join(small, on, how) if bounded is None else big.join(F.broadcast(bounded), on, how)


def bounded_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """The same rows when there are at most `limit`, else None.

    The bound is taken from the plan where the plan proves one (literal rows, limits). Otherwise at most
    limit + 1 rows are computed, once, and kept as literal rows.
    """
    proven = df._jdf.queryExecution().optimizedPlan().maxRows()
    if proven.isDefined() and proven.get() <= limit:
        return df
    rows = df.limit(limit + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= limit else None


def fits_broadcast(small: DataFrame, text: str, limit: int = 64 << 20) -> bool:
    """Whether the rows of a written table, with the text of one column, take at most `limit` bytes."""
    n, chars = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return 64 * n + chars <= limit


def broadcast_within(small: DataFrame, text: str, limit: int = 64 << 20) -> DataFrame:
    """`small`, written once, marked for broadcast where it fits."""
    small = staged(small, "side")
    return F.broadcast(small) if fits_broadcast(small, text, limit) else small


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when the input comes in fewer parts than there are; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for the few Python tasks; once per application.

    The archive lies in the shared folder where that is a plain path, else in the folder Spark keeps for
    files it hands out.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    shared = shared_dir(spark)
    if shared.startswith("file:"):
        shared = "/" + shared.removeprefix("file:").lstrip("/")
    target = SparkFiles.getRootDirectory() if "://" in shared else shared
    os.makedirs(target, exist_ok=True)
    archive = shutil.make_archive(os.path.join(target, f"obsweave-{app}"), "zip", os.path.dirname(package), "obsweave")
    spark.sparkContext.addPyFile(archive)
