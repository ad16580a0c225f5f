"""Near-duplicate vectors: sorted passes over random-hyperplane hashes, compared within windows.

1. Equal vectors of a group are one row with a count. Vectors of one label often lie in a cone, where hyperplanes through
   the origin part little; so each group's mean direction is taken off before hashing, and its number of passes follows
   from its size and from how far its vectors are spread around that mean.
2. Each pass draws its own hyperplanes. A vector's signs, read as one number, are its sort key; vectors are ordered by
   group, key and id, and each is compared with the `window` next ones. The order is cut into blocks that also hold
   the first `window` rows of the next block, so no neighbours are lost at block borders, and equal keys may be split
   among tasks. All passes are sorted in one job.
3. Verified links of all passes are united into components.
4. Within a component all pairs are counted in blocks of vectors as matrix products, so that windows do not limit what
   is linked. Vectors within half the angle of a component's pivot link with each other by the triangle
   inequality and are counted without comparison.

Cosines are computed in double precision. Vectors that are null, zero, or hold null or non-finite components, and rows
without a group, link with nothing and stay as they are. A repeated row counts once; rows with one id and different
vectors count as different vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsweave.llm.common import components
from obsweave.session import join_small, ship, staged

BITS = 48
BLOCK = 1024
CENTRES = 10_000  # groups whose centres are broadcast


def hyperplanes(dims: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + dims).standard_normal((passes, BITS, dims))


def unit(lists) -> np.ndarray:
    m = np.array(lists, dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def group_centres(reps: DataFrame, window: int, cosine: float, recall: float, most: int) -> DataFrame:
    """(group, dims, centre, passes) of every group and length of vectors.

    Two unit vectors at the threshold, seen from a mean of squared length m, are on average at the cosine
    1 - (1 - cosine) / (1 - m) to each other; passes are counted for that angle.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = reps.select("group", F.size("v").alias("dims"), F.posexplode("v").alias("i", "x"), norm.alias("norm"))
    means = rows.groupBy("group", "dims", "i").agg(F.avg(F.col("x") / F.col("norm")).alias("x"), F.count(F.lit(1)).alias("n"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])  # one entry per dimension
    groups = means.groupBy("group", "dims").agg(centre.alias("centre"), F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("m"))
    seen = F.greatest(F.lit(-0.5), 1 - (1 - F.lit(cosine)) / F.greatest(1 - F.col("m"), F.lit(1e-9)))
    bits = F.greatest(F.lit(1.0), F.log2(F.greatest(F.col("n"), F.lit(2)) / window))
    hit = F.least(F.lit(0.999), F.pow(1 - F.acos(seen) / math.pi, bits))
    passes = F.ceil(F.lit(math.log(1 - recall)) / F.log(1 - hit))
    return groups.select("group", "dims", "centre", F.least(F.lit(most), F.greatest(F.lit(2), passes)).cast("int").alias("passes"))


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, group_col: str) -> DataFrame:
    """(rep, id, group, v, copies): usable vectors, equal ones of a group once, with their smallest id and a number of their own."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("group").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.distinct().groupBy("group", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id())


def window_links(reps: DataFrame, centres: DataFrame, window: int, cosine: float, seed: int) -> DataFrame:
    """(a, b) links between neighbours of any pass."""
    ship(reps.sparkSession)
    kind = reps.schema["rep"].dataType.simpleString()
    group = reps.schema["group"].dataType.simpleString()

    def keyed(batches):
        planes = {}
        for batch in batches:
            lists, passes = batch.column(2).to_pylist(), batch.column(4).to_numpy()
            centres, most = batch.column(3).to_pylist(), int(passes.max(initial=0))
            by_dims = {}
            for i, x in enumerate(lists):
                by_dims.setdefault(len(x), []).append(i)
            keys = np.zeros((most, len(lists)), dtype=np.int64)
            for dims, at in by_dims.items():
                own = int(passes[at].max())
                if dims not in planes or len(planes[dims]) < own:
                    planes[dims] = hyperplanes(dims, own, seed)
                seen = unit([lists[i] for i in at]) - np.array([centres[i] for i in at])
                for p in range(own):
                    keys[p, at] = (seen @ planes[dims][p].T > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            for p in range(most):
                some = np.flatnonzero(passes > p)
                rows = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * len(some), pa.int32()), rows.column(0), pa.array(keys[p, some]), rows.column(1), rows.column(2)],
                    names=["pass", "group", "key", "rep", "v"])

    # one row per group: centres are broadcast within a bound, else joined by shuffle
    own = (F.col("group") == F.col("of")) & (F.size("v") == F.col("dims"))
    centred = join_small(reps.select("group", "rep", "v"), centres.withColumnRenamed("group", "of"), own, "inner", CENTRES)
    rows = centred.select("group", "rep", "v", "centre", "passes").mapInArrow(keyed, f"pass int, group {group}, key long, rep {kind}, v array<double>")
    parts = max(1, reps.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(max(parts, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "pass", "group", "key", "rep")
    rows = rows.sortWithinPartitions("pass", "group", "key", "rep").withColumn("at", F.monotonically_increasing_id())
    rows = staged(rows.select((F.col("at") / (1 << 33)).cast("long").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("i"), "pass", "group", "rep", "v"), "vectors-sorted")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per task, not per vector
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part")
    at = F.col("before") + F.col("i")
    block = F.floor(at / BLOCK)
    homes = F.when(at % BLOCK < window, F.array(block, block - 1)).otherwise(F.array(block))
    rows = rows.select(at.alias("at"), "pass", "group", "rep", "v", F.explode(homes).alias("block")).where("block >= 0")

    def compare(batch):
        order = np.argsort(batch["at"].to_numpy())
        table = batch.take(pa.array(order))
        at, block = table["at"].to_numpy(), table["block"][0].as_py()
        codes = {}
        run = np.array([codes.setdefault(x, len(codes)) for x in zip(table["pass"].to_pylist(), table["group"].to_pylist())])
        lists = table["v"].to_pylist()
        dims = np.array([len(x) for x in lists])
        left, right = [], []
        for d in np.unique(dims):
            rows_d = np.flatnonzero(dims == d)
            m, place, own = unit([lists[i] for i in rows_d]), at[rows_d], run[rows_d]
            for s in range(0, len(rows_d), 256):
                e = min(s + 256 + window, len(rows_d))
                near = m[s:s + 256] @ m[s:e].T >= cosine
                gap = place[s:e][None, :] - place[s:s + 256, None]
                near &= (gap > 0) & (gap <= window) & (own[s:e][None, :] == own[s:s + 256, None]) & (place[s:s + 256, None] // BLOCK == block)
                x, y = np.nonzero(near)
                left.append(rows_d[s + x])
                right.append(rows_d[s + y])
        left, right = np.concatenate(left), np.concatenate(right)
        reps = table["rep"].combine_chunks()
        return pa.table({"a": reps.take(pa.array(left)), "b": reps.take(pa.array(right))})

    return rows.groupBy("block").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def counted_links(members: DataFrame, cosine: float) -> DataFrame:
    """(rep, linked): other vectors, copies counted, that each member of a component is linked with.

    `members`: rep, v, copies, component. Blocks of a component meet in pairs; the inner members, which are all linked
    with each other, meet only the outer ones.
    """
    ship(members.sparkSession)
    kind = members.schema["rep"].dataType.simpleString()
    half = math.acos(cosine) / 2 - 1e-7
    pivots = members.where("rep = component").select("component", F.col("v").alias("pivot"))
    dot = F.aggregate(F.zip_with("v", "pivot", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    angle = F.acos(F.least(F.lit(1.0), dot / (norm("v") * norm("pivot"))))
    rows = members.join(pivots, "component").withColumn("inner", F.coalesce((F.size("v") == F.size("pivot")) & (angle <= half), F.lit(False)))
    rows = staged(rows.drop("pivot"), "vectors-members")
    sizes = rows.groupBy("component", "inner").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("total"))
    inner = rows.where("inner").join(sizes.where("inner"), ["component", "inner"]).select("rep", (F.col("total") - F.col("copies")).alias("linked"))
    # blocks by hash: about BLOCK members each
    blocks = sizes.groupBy("component").pivot("inner", [True, False]).agg(F.first("n")).toDF("component", "n_in", "n_out").where("n_out > 0")
    many = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / BLOCK)).cast("int")
    blocks = blocks.select("component", many(F.col("n_in")).alias("b_in"), many(F.col("n_out")).alias("b_out"))
    rows = rows.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("inner"), F.col("b_in")).otherwise(F.col("b_out"))).cast("int"))
    # a task is (component, outer block x, kind of y, block y); outer pairs are seen once, x <= y
    outer = F.flatten(F.array(
        F.transform(F.sequence(F.lit(0), F.col("b_in") - 1), lambda y: F.struct(F.col("own").alias("x"), F.lit(True).alias("in"), y.cast("int").alias("y"))),
        F.transform(F.sequence(F.lit(0), F.col("b_out") - 1), lambda y: F.struct(F.least(F.col("own"), y.cast("int")).alias("x"), F.lit(False).alias("in"), F.greatest(F.col("own"), y.cast("int")).alias("y"))),
    ))
    met = F.transform(F.sequence(F.lit(0), F.col("b_out") - 1), lambda x: F.struct(x.cast("int").alias("x"), F.lit(True).alias("in"), F.col("own").alias("y")))
    tasks = rows.select("component", "rep", "v", "copies", "inner", "own", F.explode(F.when(F.col("inner"), met).otherwise(outer)).alias("t"))
    tasks = tasks.select("component", "t.*", "rep", "v", "copies", "inner", "own")

    def count(key, table):
        _, x, with_inner, y = (k.as_py() for k in key)
        lists, inner_, own = table["v"].to_pylist(), np.array(table["inner"].to_pylist()), table["own"].to_numpy()
        copies, dims = table["copies"].to_numpy(), np.array([len(v) for v in lists])
        linked = np.zeros(len(lists), dtype=np.int64)
        for d in np.unique(dims):
            left = np.flatnonzero((dims == d) & ~inner_ & (own == x))
            right = np.flatnonzero((dims == d) & (inner_ if with_inner else ~inner_ & (own == y)))
            if not len(left) or not len(right):
                continue
            n = unit([lists[i] for i in right])
            for s in range(0, len(left), 256):
                part = left[s:s + 256]
                near = unit([lists[i] for i in part]) @ n.T >= cosine
                near &= part[:, None] != right[None, :]
                linked[part] += near @ copies[right]
                if with_inner or x != y:
                    linked[right] += copies[part] @ near
        some = np.flatnonzero(linked)
        return pa.table({"rep": table["rep"].combine_chunks().take(pa.array(some)), "linked": pa.array(linked[some])})

    outer = tasks.groupBy("component", "x", "in", "y").applyInArrow(count, f"rep {kind}, linked long")
    return inner.unionByName(outer).groupBy("rep").agg(F.sum("linked").alias("linked"))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label",
    cosine: float = 0.98, window: int = 64, recall: float = 0.995, seed: int = 7, most_passes: int = 256,
) -> DataFrame:
    """`most_passes` bounds the passes of groups so narrow that single links hardly show in any order.

    Per row: id, n_links (vectors linked directly), component_id (smallest id reachable, itself included), kept (id = component_id)."""
    reps = staged(distinct_vectors(vectors, id_col, vector_col, group_col), "vectors-distinct")
    centres = staged(group_centres(reps, window, cosine, recall, most_passes), "vectors-centres")
    links = staged(window_links(reps, centres, window, cosine, seed), "vectors-links")
    labels = components(links, "vectors").withColumnRenamed("id", "rep")
    members = staged(reps.join(labels, "rep").select("rep", "id", "v", "copies", "component"), "vectors-grouped")
    linked = counted_links(members, cosine)
    smallest = members.groupBy("component").agg(F.min("id").alias("low"))
    members = members.select("rep", "component").join(smallest, "component").join(linked, "rep", "left").select("rep", "low", "linked")
    found = reps.join(members, "rep", "left").select(
        "group", "v", F.coalesce("low", "id").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.col(vector_col).cast("array<double>").alias("v"))
    found = rows.join(found, ["group", "v"], "left")
    return found.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
