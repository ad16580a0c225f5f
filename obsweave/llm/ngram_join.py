"""Self-join of texts by the Jaccard similarity of their word shingles: token-combination prefixes.

Shingles ordered by how many texts hold them, rarest first, give each text a prefix: two texts above the threshold
miss at most a known number of each other's shingles, so their prefixes share one. A frequent shingle says
little, so of frequent ones the prefix takes more and indexes pairs of them: if n2 frequent and n1 rare shingles
lie in the prefix and n1 + n2 - 1 exceeds what may be missing, two texts share a rare one or two frequent ones. Candidates
are verified on whole sets.

Before the index is built, texts leave it that cannot have a partner or have one already:
1. A text is out if too many of its shingles occur nowhere else. A fixed part of all shingles, chosen by hash, tells; the
   same number may be missing in that part. Tasks first settle what they see twice themselves, so a shingle sends one
   entry per task.
2. Equal sets are one class under their smallest id.
3. Each class is compared with the most typical one that shares its least shingle, for a few orders of shingles. Groups of
   near copies fall together so, with one comparison per member and order.
4. Only links between components of 3. are still wanted: shingles of a single component count as missing, and the test
   of 1. is made again. What remains is indexed, and pairs of different components are verified.

The result is whole: no list is cut. Ids are the nodes, so rows with one id link as one; a null id links with nothing. Null
texts and texts without words have an empty set. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import alone as release
from obsweave.llm.common import components, slices
from obsweave.session import ship, staged

SHARE = 4  # one shingle of so many takes part in the tests of 1. and 4.
DOCS_PER_BUCKET = 8_000
SENT = 1 << 20  # entries that a task gathers before it sends them
BROADCAST_IDS = 2_000_000
FREQUENT = 64
# With more shingles than may be missing than this, pairs would outnumber what they save; texts near the border are indexed both ways.
PAIRS_UP_TO = 64
REMEMBERED = 200_000
ORDERS = 3

_HASHES: dict[bytes, int] = {}


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; shorter texts are one shingle of all their words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    h = []
    for w in words:
        x = _HASHES.get(w)
        if x is None:
            x = _HASHES[w] = xxhash.xxh64_intdigest(w)
        h.append(x)
    h, size = np.array(h, dtype=np.uint64), min(size, len(words))
    mixed = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k:len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def shingled(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set): set holds sorted hashes, 8 bytes each."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_hashes(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "set"])
        _HASHES.clear()  # workers outlive their tasks

    return rows.mapInArrow(run, f"id {kind}, n long, set binary")


def some(hashes: np.ndarray) -> np.ndarray:
    """The part of shingles that stands for all: by other bits than those that order them."""
    return hashes[(hashes >> np.uint64(17)) % np.uint64(SHARE) == 0]


def shared_counts(sets: DataFrame, buckets: int, whole: bool = False, words: int | None = None) -> DataFrame:
    """(id, n, part, shared): for each row of `sets`, how many of its `part` tested (or all) shingles other rows hold too.

    `sets`: (id, n, set), or (id, text) whose sets are made of so many `words` in the same task: of two Python functions
    in a row, each would have a worker of its own.
    """
    ship(sets.sparkSession)
    kind = sets.schema["id"].dataType.simpleString()

    def send(batches):
        release("ngram join")
        task, number = TaskContext.get().partitionId() << 33, 0
        rows: list[tuple] = []
        tested: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(t) for t in tested], dtype=np.int64)
            every = np.concatenate(tested) if tested else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(tested), dtype=np.uint32), lengths)
            distinct, place, times = np.unique(every, return_inverse=True, return_counts=True)
            lone = times[place] == 1
            here = np.bincount(owner[~lone], minlength=len(tested))
            yield pa.RecordBatch.from_arrays([
                pa.array([-1 - i % buckets for i in range(len(rows))], pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows]).cast(id_type), pa.array([r[2] for r in rows], pa.int64()), pa.array(lengths),
                pa.array(here), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary()),
            ], names=names)
            known = distinct[times > 1]
            lone_hash, lone_owner = every[lone], owner[lone]
            to, to_known = lone_hash % np.uint64(buckets), known % np.uint64(buckets)
            order, order_known = np.argsort(to, kind="stable"), np.argsort(to_known, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
            cuts_known = np.searchsorted(to_known[order_known], np.arange(buckets + 1, dtype=np.uint64))
            blobs = []
            for b in range(buckets):
                at, at_known = order[cuts[b]:cuts[b + 1]], order_known[cuts_known[b]:cuts_known[b + 1]]
                if len(at) or len(at_known):
                    blobs.append((b, lone_hash[at].tobytes(), lone_owner[at].tobytes(), known[at_known].tobytes()))
            m = len(blobs)
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in blobs], pa.int64()), pa.array([rows[0][0]] * m, pa.int64()), pa.nulls(m, id_type), pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *(pa.array([x[k] for x in blobs], pa.binary()) for k in (1, 2, 3)),
            ], names=names)

        id_type, size = None, 0
        names = ["bucket", "row", "id", "n", "part", "here", "lone", "owner", "known"]
        for batch in slices(batches):
            id_type = batch.column(0).type
            if words is None:
                found = (np.frombuffer(s, np.uint64) for s in batch.column(2).to_pylist())
            else:
                found = (shingle_hashes(t, words) for t in batch.column(1).to_pylist())
            for i, hashes in zip(batch.column(0).to_pylist(), found):
                rows.append((task + number, i, len(hashes)))
                tested.append(hashes if whole else some(hashes))
                size, number = size + len(tested[-1]), number + 1
            if size > SENT:
                yield from out()
                rows, tested, size = [], [], 0
        _HASHES.clear()  # workers outlive their tasks
        if rows:
            yield from out()

    def settle(group):
        if group["n"][0].as_py() is not None:
            return group.select(["row", "id", "n", "part"]).append_column("shared", group["here"])
        lone = [np.frombuffer(x, np.uint64) for x in group["lone"].to_pylist()]
        owner = [np.frombuffer(x, np.uint32) + np.int64(first) for x, first in zip(group["owner"].to_pylist(), group["row"].to_pylist())]
        known = [np.frombuffer(x, np.uint64) for x in group["known"].to_pylist()]
        lone, owner, known = np.concatenate(lone), np.concatenate(owner), np.unique(np.concatenate(known))
        _, place, times = np.unique(lone, return_inverse=True, return_counts=True)
        met = times[place] > 1
        if len(known):
            met |= known[np.minimum(np.searchsorted(known, lone), len(known) - 1)] == lone
        rows, shared = np.unique(owner[met], return_counts=True)
        none = [pa.nulls(len(rows), t) for t in (group.schema.field("id").type, pa.int64(), pa.int64())]
        return pa.table([pa.array(rows), *none, pa.array(shared)], names=["row", "id", "n", "part", "shared"])

    sent = sets.mapInArrow(send, f"bucket long, row long, id {kind}, n long, part long, here long, lone binary, owner binary, known binary")
    found = sent.groupBy("bucket").applyInArrow(settle, f"row long, id {kind}, n long, part long, shared long")
    return found.groupBy("row").agg(F.max("id").alias("id"), F.max("n").alias("n"), F.max("part").alias("part"), F.sum("shared").alias("shared")).drop("row")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of `pairs` whose sets, found in `sets` (id, set), are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("set").alias("right")), "b").select("a", "b", "left", "right")

    def run(batches):
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = np.count_nonzero(np.diff(np.sort(np.concatenate([x, y]))) == 0)
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def close_in_size(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def least_shingles(reps: DataFrame) -> DataFrame:
    """(order, h, id, n): the least shingle of each set by several orders."""
    kind = reps.schema["id"].dataType.simpleString()
    factors = [np.uint64(2 * x + 1) for x in range(0x51ED270B, 0x51ED270B + ORDERS)]

    def run(batches):
        for batch in slices(batches):
            ids, n = batch.column(0), batch.column(1)
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            for k, f in enumerate(factors):
                least = []
                for s in sets:
                    mixed = s * f
                    mixed ^= mixed >> np.uint64(31)
                    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
                    least.append(s[np.argmin(mixed)].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(sets), pa.int32()), pa.array(least, pa.int64()), ids, n], names=["order", "h", "id", "n"])

    return reps.select("id", "n", "set").mapInArrow(run, f"order int, h long, id {kind}, n long")


def star_pairs(reps: DataFrame, alone: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the most typical one among those that share a least shingle: least alone, then smallest id.

    `alone`: (id, alone), the number of a set's shingles that no other set has.
    """
    heads = staged(least_shingles(reps).join(alone, "id"), "ngram-least")
    centres = heads.groupBy("order", "h").agg(F.min(F.struct("alone", "id", "n")).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    pairs = heads.join(centres, ["order", "h"]).where("id <> c.id").where(close_in_size("n", "c.n", percent))
    return pairs.select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()


def tokens_of(reps: DataFrame, whole: bool) -> DataFrame:
    """(id, n, component, h): a row per shingle, or per tested shingle."""
    kind, comp = (reps.schema[c].dataType.simpleString() for c in ("id", "component"))

    def run(batches):
        for batch in slices(batches, 64):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            sets = sets if whole else [some(s) for s in sets]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(np.concatenate(sets).astype(np.int64))], names=["id", "n", "component", "h"])

    return reps.select("id", "n", "component", "set").mapInArrow(run, f"id {kind}, n long, component {comp}, h long")


def in_several(tokens: DataFrame) -> DataFrame:
    """(h, df): shingles of more than one component, with the number of sets that hold them."""
    seen = tokens.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("df"))
    return seen.where("lo <> hi").select("h", "df")


def signatures(tokens: DataFrame, percent: int) -> DataFrame:
    """(id, n, m, component, larger, reach, mode, s1, s2): single rare and pairs of frequent shingles of each prefix.

    `tokens`: (id, n, component, h, df), shingles of several components only; the others, n - m, count as missing.
    A set may miss more of a smaller partner's shingles than of one that is not smaller. So it has a full prefix to be
    the larger of two (`larger`), and a shorter one to be the smaller; with too much missing it can only be the larger.
    The prefix for a given partner ends where nothing more may be missing: `reach` is the largest partner that needs a signature.
    """
    kind, comp = (tokens.schema[c].dataType.simpleString() for c in ("id", "component"))
    lists = tokens.groupBy("id", "n", "component").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t"))
    lists = lists.select("id", "n", F.size("t").cast("long").alias("m"), "component", F.col("t.df").alias("df"), F.col("t.h").alias("h"))

    def run(batches):
        for batch in slices(batches, 64):
            owner, larger, reach, mode, one, two = [], [], [], [], [], []
            for i, (n, df, h) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 4, 5)))):
                may = n - -(-percent * n // 100)
                rare = sum(x <= FREQUENT for x in df)
                for role, bound in ((True, may), (False, n - -(-2 * percent * n // (100 + percent)))):
                    lost = bound - (n - len(h))
                    if lost < 0:
                        continue
                    rows = []
                    if may * percent <= PAIRS_UP_TO * 100:
                        frequent = [] if rare > lost else h[rare:lost + 2]
                        rows += [(0, x, 0, k) for k, x in enumerate(h[:min(rare, lost + 1)])]
                        rows += [(1, x, y, rare + k + j) for k, x in enumerate(frequent) for j, y in enumerate(frequent[k + 1:])]
                    if may * 100 >= PAIRS_UP_TO * percent:
                        rows += [(2, x, 0, k) for k, x in enumerate(h[:lost + 1])]
                    owner += [i] * len(rows)
                    larger += [role] * len(rows)
                    reach += [(100 + percent) * (len(h) - x[3]) // percent - n for x in rows]
                    mode += [x[0] for x in rows]
                    one += [x[1] for x in rows]
                    two += [x[2] for x in rows]
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(4)), pa.array(larger, pa.bool_()), pa.array(reach, pa.int64()), pa.array(mode, pa.int32()),
                 pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                names=["id", "n", "m", "component", "larger", "reach", "mode", "s1", "s2"])

    return lists.mapInArrow(run, f"id {kind}, n long, m long, component {comp}, larger boolean, reach long, mode int, s1 long, s2 long")


def index_pairs(found: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets of different components that share a signature, and whose sizes and shared shingles allow a link."""
    mine = [F.col(c).alias(c) for c in ("mode", "s1", "s2")]
    left = found.where("not larger").select(*mine, *(F.col(c).alias(f"a_{c}") for c in ("id", "n", "m", "component", "reach")))
    right = found.where("larger").select(*mine, *(F.col(c).alias(f"b_{c}") for c in ("id", "n", "m", "component", "reach")))
    enough = F.expr(f"b_n <= a_reach and a_n <= b_reach and {percent} * (a_n + b_n) <= {100 + percent} * least(a_m, b_m)")
    pairs = left.join(right, ["mode", "s1", "s2"]).where("a_component <> b_component and (a_n < b_n or a_n = b_n and a_id < b_id)").where(enough)
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def may_link(percent: int):
    """Whether enough of the tested shingles are shared."""
    return F.expr(f"n > 0 and shared >= part - (n - ceil({percent} * n / 100))")


def ngram_join(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links of Jaccard similarity >= percent / 100)."""
    buckets = max(16, -(-docs.count() // DOCS_PER_BUCKET))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = staged(shared_counts(rows, buckets, words=size), "ngram-counted")
    ids = counted.where(may_link(percent)).where("id is not null").select("id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    left = rows.join(ids, "id", "left_semi")
    sets = staged(shingled(left, size, "id", "text").where("n > 0").withColumn("sig", F.sha2("set", 256)), "ngram-sets")
    classes = staged(sets.groupBy("sig").agg(F.min("id").alias("rep")), "ngram-classes")
    reps = sets.join(classes.select("sig", F.col("rep").alias("id")), ["sig", "id"], "left_semi").dropDuplicates(["sig"])
    reps = staged(reps.select("id", "n", "sig", "set"), "ngram-reps")
    # ids of one class are one node; an id with several sets joins their classes
    joint = sets.join(classes, "sig").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    alone = shared_counts(reps.select("id", "n", "set"), buckets, whole=True).select("id", (F.col("n") - F.col("shared")).alias("alone"))
    alone = alone.groupBy("id").agg(F.min("alone").alias("alone"))
    links = staged(verified(star_pairs(reps, alone, percent), reps, percent), "ngram-stars")
    first = components(links.union(joint), "ngram")
    grouped = reps.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tested = tokens_of(grouped, whole=False)
    shared = tested.join(in_several(tested).select("h"), "h").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    parts = tested.groupBy("id").agg(F.count(F.lit(1)).alias("part"))
    wanted = grouped.join(parts, "id", "left").join(shared, "id", "left").fillna(0, ["part", "shared"]).where(may_link(percent))
    wanted = staged(wanted.select("id", "n", "component", "set"), "ngram-left")
    tokens = tokens_of(wanted, whole=True)
    tokens = tokens.join(in_several(tokens), "h")
    pairs = index_pairs(staged(signatures(tokens, percent), "ngram-signatures"), percent)
    more = staged(verified(pairs, wanted, percent), "ngram-links")
    final = components(links.union(joint).union(more), "ngram-all")
    rows = counted.join(final, "id", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
