"""Vector codes: one codebook per part position, learned by Lloyd rounds in exact integers with resident members.

1. Every part of every usable vector is a row (part_row, position, entry, salt). Rows live with the owner of their
   (position, entry, salt); owners hold at most about ROWS_PER_OWNER rows, however many rows an entry has.
2. A round assigns every resident row to its nearest entry, inside the owner's task and without a shuffle. Rows that keep
   their entry are written where they are; only rows that change it are shuffled to their new owner.
3. Owners sum their residents; the sums of all owners meet per (position, entry, component), and the codebook of
   `entries` vectors, all that ever reaches the driver, is replaced by floor(sum / count). Entries without rows stay.

Each round is written to the shared folder, so a lost executor repeats part of one round.

Defined cases: vectors that are null or hold null or non-finite components have no code and no row in the result. Vectors of
different lengths are coded together, shorter ones extended with zeros, and the length rounded up to a multiple of the
number of parts. The first codebook takes the smallest ids, nulls last and equal ids by vector; repeated rows count each
time, in sums and in results. Ties between entries go to the lower index. Scaled components are held within the largest
power of two whose squared distances fit 64 bits (131,072 at 64 dimensions). Labels that are null are one label. Tables
without usable rows give no rows. Only the three named columns are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import slices
from obsweave.session import join_small, shared_dir, ship, staged

ROWS_PER_OWNER = 65_536


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec, id, label, v): rows whose vector has only finite components, with a number of their own."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("vec"), "id", "label", "v")


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part; ties go to the lower index."""
    away = np.stack([((parts - e) ** 2).sum(axis=1) for e in entries], axis=1)
    best = away.argmin(axis=1)
    return best.astype(np.int32), away[np.arange(len(parts)), best]


def parts_of(rows: DataFrame, positions: int, size: int, scale: int, salts: int) -> DataFrame:
    """(vec, position, entry, salt, part): the scaled parts of all vectors; entry is -1 before the first assignment."""
    limit = 2 ** int((61 - math.log2(max(size, 1))) / 2)
    whole = F.transform("v", lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit - 1), F.floor(x * scale))).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), F.lit(positions * size) - F.size("v")))
    cut = F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), lambda p: F.slice(F.col("whole"), p * size + 1, size))
    salt = F.pmod(F.xxhash64("vec"), F.lit(salts)).cast("int").alias("salt")
    return rows.select("vec", salt, padded.alias("whole")).select(
        "vec", F.posexplode(cut).alias("position", "part"), F.lit(-1).alias("entry"), "salt",
    ).select("vec", "position", "entry", "salt", "part")


def part_matrix(batch: pa.RecordBatch) -> np.ndarray:
    parts = batch["part"]
    return parts.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(parts), -1)


def assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows of all owners with the nearest entry, the one before, and the squared distance."""
    def run(batches):
        for batch in slices(batches, 4096):
            parts, position = part_matrix(batch), batch["position"].to_numpy()
            entry, away = np.zeros(len(parts), dtype=np.int32), np.zeros(len(parts), dtype=np.int64)
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                entry[at], away[at] = nearest(parts[at], books[p])
            yield pa.RecordBatch.from_arrays(
                [batch["vec"], batch["position"], pa.array(entry), batch["salt"], batch["part"], batch["entry"], pa.array(away)],
                names=["vec", "position", "entry", "salt", "part", "old", "away"])

    ship(state.sparkSession)
    return state.select("vec", "position", "entry", "salt", "part").mapInArrow(
        run, "vec long, position int, entry int, salt int, part array<int>, old int, away long")


def owner_sums(state: DataFrame, positions: int, entries: int) -> DataFrame:
    """(position, entry, n, sums) of the rows that each task holds; a task has at most positions x entries rows."""
    def run(batches):
        sums, counts = None, np.zeros(positions * entries, dtype=np.int64)
        for batch in slices(batches, 4096):
            parts = part_matrix(batch)
            key = batch["position"].to_numpy().astype(np.int64) * entries + batch["entry"].to_numpy()
            if sums is None:
                sums = np.zeros((positions * entries, parts.shape[1]), dtype=np.int64)
            np.add.at(sums, key, parts)
            counts += np.bincount(key, minlength=len(counts))
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([
                pa.array((some // entries).astype(np.int32)), pa.array((some % entries).astype(np.int32)), pa.array(counts[some]),
                pa.array(list(sums[some]), pa.list_(pa.int64())),
            ], names=["position", "entry", "n", "sums"])

    return state.select("position", "entry", "part").mapInArrow(run, "position int, entry int, n long, sums array<long>")


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one replacement. positions x entries x size numbers reach the driver."""
    positions, entries, _ = books.shape
    sums = owner_sums(state, positions, entries).select("position", "entry", "n", F.posexplode("sums").alias("i", "x"))
    out = books.copy()
    for r in sums.groupBy("position", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        out[r["position"], r["entry"], r["i"]] = r["x"] // r["n"]
    return out


def moved_round(state: DataFrame, books: np.ndarray, name: str) -> tuple[DataFrame, DataFrame]:
    """The state after one assignment, and the rows of it that changed their entry: these alone are shuffled."""
    spark = state.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows = assigned(state, books).withColumn("moved", F.col("entry") != F.col("old")).drop("old", "away")
    rows.write.partitionBy("moved").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    columns = ["vec", "position", "entry", "salt", "part"]
    movers = rows.where("moved").select(*columns)
    movers = staged(movers.repartition("position", "entry", "salt"), f"{name}-moved")
    return rows.where("not moved").select(*columns).unionByName(movers), movers


def first_codebooks(rows: DataFrame, positions: int, size: int, scale: int, entries: int) -> np.ndarray:
    """Parts of the vectors with the smallest ids as (position, entry, component)."""
    lowest = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries)
    found = {}
    for at, r in enumerate(parts_of(lowest, positions, size, scale, 1).collect()):
        found.setdefault(r["vec"], []).append((r["position"], r["part"]))
    order = [r["vec"] for r in lowest.select("vec").collect()]
    books = np.zeros((positions, len(order), size), dtype=np.int64)
    for e, vec in enumerate(order):
        for p, part in found[vec]:
            books[p, e] = part
    return books


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) of every usable vector, codebooks as an array of position, entry, component).

    `code` is one entry index per position, `error` the squared distance of the scaled vector from its entries.
    """
    rows = staged(usable_vectors(vectors, id_col, vector_col, label_col), "codes-vectors")
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    size = -(-(longest or 0) // positions)
    books = first_codebooks(rows, positions, size, scale, entries)
    state = parts_of(rows, positions, size, scale, max(1, -(-n // ROWS_PER_OWNER)))
    ids = dict(rows.select("id", "label").dtypes)
    empty = state.sparkSession.createDataFrame([], f"id {ids['id']}, label {ids['label']}, code array<int>, error long")
    if not n or not size:
        zero = rows.select("id", "label", F.array_repeat(F.lit(0), positions).alias("code"), F.lit(0).cast("long").alias("error"))
        return (zero if n else empty), books
    for r in range(rounds):
        state, _ = moved_round(state, books, f"codes-{r}")
        books = updated(state, books)
    last = assigned(state, books).groupBy("vec").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"]).alias("code"),
        F.sum("away").alias("error"))
    return rows.select("vec", "id", "label").join(last, "vec").select("id", "label", "code", "error"), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by position, entry and place, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """The error of all rows of the label beside each row; rows without a label are one label."""
    coded = staged(coded, "codes-found")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return join_small(coded, totals, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
