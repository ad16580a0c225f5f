"""Removing lines that repeat earlier ones, exactly or within a few edits: segment-partition join.

Two lines within k edits share one of k + 1 segments of the shorter one: edits cannot touch them all. Every distinct
line is cut into k + 1 segments, which are indexed by length and place; the substrings of lines up to k longer
that may equal a segment, given how far edits can shift it, probe the index. Hits are verified by a banded
bit-parallel edit distance.

The shorter of two lines says how many edits they may differ by: one for each full EDIT_EVERY characters, k at most.
Below EDIT_EVERY characters only exact repeats count. These need no keys: equal lines meet by their hash in step 3.

1. Tasks read lines from whole texts and send, for each distinct line and key (length, place, content of a segment), eight
   bytes and the line's number, packed by key range. Keys that an index and a probe of different lines share give
   candidate lines; most lines end here.
2. Candidates of a key are first compared with the smallest line of the key. Lines that fall together so are one
   group; other pairs of a key are compared only between groups.
   A key with many more pairs than entries says too little: its lines are cut into PIECES pieces. At most k pieces hold
   edits, so two near lines agree outside some k of them, and a hash of all the rest is a narrower key. Where that has
   too many pairs again, the k pieces that were left out are cut the same way, down to single characters. So no pair
   within the edits is lost, and keys with many pairs hold lines that differ by hardly more than the edits.
3. Of each group of lines the first occurrence by document id and line number stays; later ones are removed. A line
   that repeats exactly is a group by itself.

Lines of every length that hold a letter or digit take part; others do from RULE characters on. If `least` is given, lines
under so many characters (after trimming) stay and are no evidence, and all others may differ by k edits. Null and empty
texts are kept as they are. Rows that repeat id and text are one document. A null id comes after all others. Lines are compared trimmed
and by 64-bit hashes.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import alone, components, slices
from obsweave.session import ship, staged

LINES_PER_BUCKET = 60_000
SENT = 1 << 20  # keys that a task gathers before it sends them, as machine integers
SEEN = 1 << 18  # line hashes that a task remembers, to send a line's keys once
BROADCAST_LINES = 1_000_000
EDIT_EVERY = 20  # characters of a line for each edit that it may differ by
CROWDED = 8  # pairs for each entry of a key beyond which the key is narrowed
PIECES = 8  # that a line, or what a key left open of it, is cut into
RULE = 40  # characters from which a line without letters and digits takes part
_SPACE = " \t\x0b\f\r"
_WORD = re.compile(r"[^\W_]")


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 segments of nearly equal size, shorter ones first."""
    short, longer = length // (k + 1), length % (k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = short + (i >= k + 1 - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, indexed: int, k: int) -> list[tuple[int, int, int]]:
    """(place, start, size): substrings of a line that may equal a segment of a line of `indexed` <= `length` characters within k edits.

    Before the segment in place i lie i segments with at least one edit each if it is the first that is shared from the
    left, and k - i behind it likewise; both bound the shift.
    """
    more, out = length - indexed, []
    for i, (start, size) in enumerate(segments(indexed, k)):
        low = max(start - i, start + more - (k - i), 0)
        high = min(start + i, start + more + (k - i), length - size)
        out += [(i, s, size) for s in range(low, high + 1)]
    return out


def within(a: str, b: str, k: int) -> int:
    """Edit distance if it is at most k, else k + 1.

    Columns of the distance table as two bit vectors over a band of 2 k + 1 cells that slides down the diagonal.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return k + 1
    lo, top = 0, len(a)
    while lo < top and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < top - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    if not a:
        return len(b)
    # band cell i of column j is row j - k + i; vertical steps up (+1) and down (-1) between neighbouring cells
    band = 2 * k + 1
    full = (1 << band) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down = full & ~((1 << k) - 1), 0  # rows from 1 on; those above are flat
    at, score = 0, 0  # distance in the middle cell, row j of column j
    m, middle = len(a), 1 << k
    for j, c in enumerate(b, 1):
        row = places.get(c, 0)
        shift = j - 1 - k
        match = (row >> shift if shift >= 0 else row << -shift) & full
        diag = (((match & up) + up) ^ up) | match | down
        diag &= full
        right = down | (full & ~(diag | up))
        left = diag & up
        if j <= m:  # along the diagonal
            score += not diag & middle
            if score > 2 * k:  # no cell of the band is further than k from the middle, and no diagonal falls
                return k + 1
        else:  # past the last row: the cell slides up within the band
            at += 1
            bit = 1 << (k - at)
            score += bool(right & bit) - bool(left & bit)
        up = left | (full & ~((diag >> 1) | right))
        down = (diag >> 1) & right
    return min(score, k + 1)


def line_hash(line: str) -> int:
    h = xxhash.xxh64_intdigest(line.encode())
    return h - (1 << 64) if h >> 63 else h


def part_lines(text: str | None, least: int | None):
    """(number, trimmed line) of the lines that take part."""
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip(_SPACE)
        if len(line) >= least if least is not None else len(line) >= RULE or _WORD.search(line):
            yield i, line


def edits(length: int, k: int, least: int | None) -> int:
    """Edits that a line of this length and a longer one may differ by."""
    return k if least is not None else min(k, length // EDIT_EVERY)


def _keys(line: str, k: int, least: int | None):
    """(key, is probe) of a line; none where only its exact repeats count."""
    n = len(line)
    own = edits(n, k, least)
    if least is None and not own:
        return
    for i, (s, size) in enumerate(segments(n, own)):
        yield xxhash.xxh64_intdigest(line[s:s + size].encode(), seed=n * (k + 1) + i), False
    for m in range(max(n - own, least or EDIT_EVERY), n + 1):
        for i, s, size in probes(n, m, edits(m, k, least)):
            yield xxhash.xxh64_intdigest(line[s:s + size].encode(), seed=m * (k + 1) + i), True


def shared_keys(texts: DataFrame, k: int, least: int | None, buckets: int) -> DataFrame:
    """(key, line, probe): entries of keys that an indexed and a probing line share, lines by hash. `texts`: (text)."""
    ship(texts.sparkSession)

    def send(batches):
        alone("line dedup")
        seen: set[int] = set()
        keys, lines = array("Q"), array("q")

        def out():
            key, line = np.frombuffer(keys, dtype=np.uint64), np.frombuffer(lines, dtype=np.int64)
            to = (key >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
            parts = [(b, order[cuts[b]:cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in parts], pa.int64()), pa.array([key[at].tobytes() for _, at in parts], pa.binary()),
                pa.array([line[at].tobytes() for _, at in parts], pa.binary())], names=["bucket", "keys", "lines"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for _, line in part_lines(text, least):
                    h = line_hash(line)
                    if h not in seen:
                        seen.add(h)
                        for key, probe in _keys(line, k, least):
                            # the last bit tells probes; the line's last bits are enough here and are made whole below
                            keys.append(key & ~1 | probe)
                            lines.append(h)
            if len(keys) > SENT:
                yield out()
                keys, lines = array("Q"), array("q")
            if len(seen) > SEEN:
                seen.clear()
        if keys:
            yield out()

    def meet(group):
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in group["keys"].to_pylist()])
        line = np.concatenate([np.frombuffer(x, np.int64) for x in group["lines"].to_pylist()])
        order = np.lexsort((line, key >> np.uint64(1)))
        key, line = key[order], line[order]
        bare, probe = key >> np.uint64(1), (key & np.uint64(1)).astype(bool)
        first = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]])) if len(bare) else np.zeros(0, int)
        size = np.diff(np.append(first, len(bare)))
        several = np.maximum.reduceat(line, first) != np.minimum.reduceat(line, first)
        both = np.maximum.reduceat(probe, first) & ~np.minimum.reduceat(probe, first)
        keep = np.repeat(several & both, size)
        return pa.table({"key": bare[keep].astype(np.int64), "line": line[keep], "probe": probe[keep]})

    sent = texts.mapInArrow(send, "bucket long, keys binary, lines binary")
    return sent.groupBy("bucket").applyInArrow(meet, "key long, line long, probe boolean").distinct()


def occurrences(docs: DataFrame, least: int | None) -> DataFrame:
    """(id, t, i, line): every line that takes part; t is the text's hash. `docs`: (id, text)."""
    ship(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        alone("line dedup")
        for batch in slices(batches):
            found = [[(i, line_hash(x)) for i, x in part_lines(t, least)] for t in batch.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int64())], names=["id", "t", "i", "line"])

    return docs.select("id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, f"id {kind}, t long, i int, line long")


def texts_of(docs: DataFrame, lines: DataFrame, least: int | None) -> DataFrame:
    """(line, content) of the wanted lines."""
    def run(batches):
        for batch in slices(batches):
            found = list({line_hash(x): x for t in batch.column(0).to_pylist() for _, x in part_lines(t, least)}.items())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["line", "content"])

    every = docs.select("text").mapInArrow(run, "line long, content string")
    wanted = F.broadcast(lines) if lines.count() <= BROADCAST_LINES else lines
    return every.join(wanted, "line", "left_semi").dropDuplicates(["line"])


def verified(pairs: DataFrame, texts: DataFrame, k: int, least: int | None) -> DataFrame:
    """(a, b) within the edits that the shorter one may differ by."""
    both = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def run(batches):
        for batch in slices(batches):
            pairs = [(x, y, edits(min(len(x), len(y)), k, least)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            good = [within(x, y, most) <= most for x, y, most in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


@lru_cache(maxsize=1 << 14)
def openings(windows: tuple[tuple[int, int, int], ...], k: int, probe: bool) -> list[tuple[list, list]]:
    """Ways to have all edits in at most k pieces of the open windows: (spans that must agree, windows still open).

    A window is (start in this line, characters in the shorter line, characters more in the longer line). The order of the ways is the
    same for both lines.
    """
    cut = []  # (window, from, to) in characters of the shorter line
    for w, (_, size, _) in enumerate(windows):
        n = min(max(2, PIECES // len(windows)), max(size, 1))
        cut += [(w, size * i // n, size * (i + 1) // n) for i in range(n)]
    ways = []
    for chosen in combinations(range(len(cut)), min(k, len(cut))):
        for shifts in product(range(-k, k + 1), repeat=len(chosen)):
            more = [0] * len(windows)
            for c, shift in zip(chosen, shifts):
                more[cut[c][0]] += shift
            if sum(map(abs, shifts)) > k or more != [x for _, _, x in windows] or any(cut[c][2] - cut[c][1] + x < 0 for c, x in zip(chosen, shifts)):
                continue
            spans, left = [], []
            for w, (start, size, total) in enumerate(windows):
                at, moved = start, 0
                for c, shift in zip(chosen, shifts):
                    v, low, high = cut[c]
                    if v == w:
                        spans.append((at, start + low + moved * probe))
                        left.append((start + low + moved * probe, high - low, shift))
                        moved += shift
                        at = start + high + moved * probe
                spans.append((at, start + size + total * probe))
            ways.append(([x for x in spans if x[0] < x[1]], left))
    return ways


def whole(length: int, k: int, least: int | None):
    """(key, is probe, windows) of a line that is open from end to end, for every length of a line that may be near it."""
    own = edits(length, k, least)
    for more in range(own + 1):
        yield length * (k + 1) + more, False, ((0, length, more),)
    for m in range(max(length - own, least or EDIT_EVERY), length + 1):
        if length - m <= edits(m, k, least):
            yield m * (k + 1) + length - m, True, ((0, m, length - m),)


def narrower_keys(line: str, key: int, probe: bool, windows, k: int, least: int | None):
    """(key, windows): keys within a key, one for each way to have all edits in few pieces of its windows."""
    shorter = len(line) - probe * sum(more for _, _, more in windows)
    for way, (spans, left) in enumerate(openings(windows, edits(shorter, k, least), probe)):
        text = "".join([line[a:b] for a, b in spans])
        yield xxhash.xxh64_intdigest(text.encode(), seed=(key * 0x9E3779B97F4A7C15 + way) & 0xFFFFFFFFFFFFFFFF), left


def narrowed(crowded: DataFrame, texts: DataFrame, k: int, least: int | None, name: str) -> DataFrame:
    """(key, line, probe, windows) of narrower keys that two lines share. `crowded`: (key, line, probe, windows), windows null where the line is open."""
    def run(batches):
        for batch in slices(batches, 64):
            keys, lines, probes, opened = array("Q"), array("q"), [], []
            for key, line, probe, flat, text in zip(*(batch.column(c).to_pylist() for c in ("key", "line", "probe", "windows", "content"))):
                if flat is None:
                    entries = whole(len(text), k, least)
                else:
                    entries = [(key, probe, tuple(zip(flat[::3], flat[1::3], flat[2::3])))]
                for key, probe, windows in entries:
                    for new, left in narrower_keys(text, key, probe, windows, k, least):
                        keys.append(new)
                        lines.append(line)
                        probes.append(probe)
                        opened.append([x for window in left for x in window])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.frombuffer(keys, np.uint64).astype(np.int64)), pa.array(np.frombuffer(lines, np.int64)),
                pa.array(probes, pa.bool_()), pa.array(opened, pa.list_(pa.int32()))], names=["key", "line", "probe", "windows"])

    both = crowded.join(texts, "line").select("key", "line", "probe", "windows", "content")
    made = staged(both.mapInArrow(run, "key long, line long, probe boolean, windows array<int>"), f"{name}-made")
    met = made.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.max("probe").alias("p"), F.min("probe").alias("q"))
    return made.join(met.where("lo <> hi and p and not q").select("key"), "key", "left_semi")


def near_lines(docs: DataFrame, k: int, least: int | None, n_lines: int) -> DataFrame:
    """(line, component) of distinct lines within few edits of another, grouped by the smallest hash reachable. `docs`: (id, text)."""
    buckets = max(16, -(-n_lines // LINES_PER_BUCKET))
    keys = staged(shared_keys(docs.select("text"), k, least, buckets), "lines-keys")
    texts = staged(texts_of(docs, keys.select("line").distinct(), least), "lines-texts")
    level, wide = 0, F.lit(True)
    while True:
        name = f"lines-{level}"
        keys = keys.join(keys.groupBy("key").agg(F.min("line").alias("a")), "key")
        stars = keys.select("a", F.col("line").alias("b")).where("a <> b").distinct()
        found = staged(verified(stars, texts, k, least), f"{name}-stars")
        if not level:
            links, groups = found, components(found, "lines").withColumnRenamed("id", "line")
        grouped = keys.join(groups, "line", "left").withColumn("component", F.coalesce("component", "line"))
        if level:  # what falls together with the smallest line of a narrower key is one group within that key
            links = links.union(found)
            near = found.select("a", F.col("b").alias("line"), F.lit(True).alias("near"))
            grouped = grouped.join(near, ["a", "line"], "left").withColumn("component", F.when(F.col("near") | (F.col("a") == F.col("line")), F.col("a")).otherwise(F.col("component")))
        several = grouped.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_if("probe").alias("p"), F.count_if(~F.col("probe")).alias("q"))
        several = several.where("lo <> hi").select("key", (F.col("p") * F.col("q") > CROWDED * (F.col("p") + F.col("q"))).alias("crowded"))
        grouped = staged(grouped.join(several, "key").withColumn("crowded", F.col("crowded") & wide), f"{name}-grouped")
        few = grouped.where("not crowded")
        left = few.where("not probe").select("key", F.col("line").alias("x"), F.col("component").alias("cx"))
        right = few.where("probe").select("key", F.col("line").alias("y"), F.col("component").alias("cy"))
        pairs = left.join(right, "key").where("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = links.union(staged(verified(pairs, texts, k, least), f"{name}-links"))
        crowded = grouped.where("crowded")
        if crowded.isEmpty():
            return components(links, "lines-all").withColumnRenamed("id", "line")
        if level:
            crowded = crowded.select("key", "line", "probe", "windows")
        else:
            crowded = crowded.select(F.lit(0).cast("long").alias("key"), "line", F.lit(False).alias("probe"), F.lit(None).cast("array<int>").alias("windows")).distinct()
        keys = staged(narrowed(crowded, texts, k, least, name), f"{name}-narrowed")
        # a window is open while it has more than one character of the shorter line
        level += 1
        wide = F.exists(F.filter("windows", lambda x, i: i % 3 == 1), lambda x: x > 1)


def repeated_lines(docs: DataFrame, k: int = 2, least: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, i, line, component): occurrences of lines that repeat an earlier one; i counts a text's lines from 0, t is the text's hash."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = staged(occurrences(rows, least).distinct(), "lines-occurrences")
    groups = near_lines(rows, k, least, every.count())
    every = every.join(groups, "line", "left").withColumn("component", F.coalesce("component", "line"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "t", "i")
    firsts = every.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", "first")
    return every.join(firsts, "component").where(place != F.col("first")).select("id", "t", "i", "line", "component")


def without_repeated_lines(docs: DataFrame, k: int = 2, least: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with repeated lines cut out of the texts, and removed_lines (their number).

    A text that loses all its lines becomes empty. A column that is called removed_lines is replaced.
    """
    gone = repeated_lines(docs, k, least, id_col, text_col).groupBy("id", "t").agg(F.collect_list("i").alias("__gone"))
    rows = docs.drop("removed_lines").withColumn("__t", F.xxhash64(text_col))
    gone = gone.select(F.col("id").alias("__id"), F.col("t").alias("__gt"), "__gone")
    rows = rows.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__gt")), "left")
    lines = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return rows.withColumn(text_col, text).withColumn("removed_lines", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).drop("__t", "__id", "__gt", "__gone")
