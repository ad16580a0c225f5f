"""Files in tasks: opening, listing and writing, so that the driver holds no list of them."""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.session import ship, staged

LISTING_TASKS = 4
# Entries after which a task leaves the folders it has found to others.
LISTED = 10_000
# What Spark escapes in the name of a folder that stands for a value.
_ESCAPED = re.compile(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]")


def qualified(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(found)


def system(path: str):
    """File system of a path and the path in it."""
    from pyarrow import fs

    if urlsplit(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + path.split(":", 1)[-1].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def opened(path: str):
    found, inner = system(path)
    return found.open_input_stream(inner)


def length(path: str) -> int:
    found, inner = system(path)
    return found.get_file_info(inner).size


def _hidden(name: str) -> bool:
    """As Spark hides names."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _rows(paths: list[str], lengths: list[int | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length) of the files below each folder; folders that are left to others have no length."""
    from pyarrow import fs

    paths: list[str] = []
    lengths: list[int | None] = []
    for batch in batches:
        for top in batch["path"].to_pylist():
            left, n = deque([top]), 0
            while left and n < LISTED:
                folder = left.popleft()
                found, inner = system(folder)
                entries = [e for e in found.get_file_info(fs.FileSelector(inner)) if not _hidden(e.base_name)]
                n += len(entries)
                left.extend(f"{folder}/{e.base_name}" for e in entries if e.type == fs.FileType.Directory)
                files = [e for e in entries if e.type == fs.FileType.File]
                paths, lengths = paths + [f"{folder}/{e.base_name}" for e in files], lengths + [e.size for e in files]
            paths, lengths = paths + [*left], lengths + [None] * len(left)
            if len(paths) >= LISTED:
                yield _rows(paths, lengths)
                paths, lengths = [], []
    yield _rows(paths, lengths)


def listed(spark: SparkSession, root_uri: str) -> DataFrame:
    """(path, length) of the files below a folder that are not empty, found by tasks in rounds and written once."""
    ship(spark)
    tasks = LISTING_TASKS * spark.sparkContext.defaultParallelism
    folders, found = spark.createDataFrame([(root_uri,)], "path string").coalesce(1), None
    while True:
        entries = staged(folders.mapInArrow(_walk, "path string, length long"), "listing")
        files, left = entries.where("length > 0"), entries.where("length IS NULL").select("path")
        found = files if found is None else found.unionByName(files)
        if left.isEmpty():
            return found
        folders = left.repartition(tasks)


def escaped(value: str | None) -> str:
    """A value as a part of a folder's name, as Spark writes it."""
    return _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


class _File:
    """A file that gets its name when it is whole; a repeated attempt replaces it by the same."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.system, inner = system(folder)
        self.system.create_dir(inner, recursive=True)
        self.name, self.hidden = f"{inner}/{name}", f"{inner}/.{name}.{attempt}"
        self.out = self.system.open_output_stream(self.hidden)

    def close(self):
        self.out.close()
        try:
            self.system.move(self.hidden, self.name)
        except OSError:  # not every system replaces files
            self.system.delete_file(self.name)
            self.system.move(self.hidden, self.name)


def write_lines(lines: DataFrame, path: str, keys: tuple[str, ...], number: str) -> None:
    """Texts (value) as the lines of .csv files, one folder per value of the keys, one file per `number` in it.

    Rows of a file come together in one task, and are written in the order in which they come. What was below the path goes.
    Tasks write the files and give them their names; neither folders nor files reach the driver.
    """
    spark = lines.sparkSession
    ship(spark)
    jvm_system, jvm_path = qualified(spark, path)
    jvm_system.delete(jvm_path, True)
    jvm_system.mkdirs(jvm_path)
    root, run = jvm_path.toString().rstrip("/"), uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        now, file, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in batch.columns[:-1]]
            new = np.any([c[1:] != c[:-1] for c in codes], axis=0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                *values, place = (c[start].as_py() for c in batch.columns[:-1])
                if (*values, place) != now:
                    if file:
                        file.close()
                    now, n = (*values, place), n + 1
                    folder = "/".join([root, *(f"{k}={escaped(v)}" for k, v in zip(keys, values))])
                    file = _File(folder, f"part-{task.partitionId():05d}-{run}.c{place:03d}.csv", task.taskAttemptId())
                file.out.write("".join(f"{v}\n" for v in batch.columns[-1].slice(start, end - start).to_pylist()).encode())
        if file:
            file.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    rows = lines.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(number).cast("int").alias(number), "value")
    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
