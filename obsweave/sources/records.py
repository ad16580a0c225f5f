"""Records of delimited files whose quoted cells may hold line breaks, read in splits.

Whether a line begins inside a quoted cell depends on all lines before it. A line is therefore a function on two states,
outside and inside a quoted cell; functions of consecutive lines compose, first over the lines of a block in the
task that reads it, then over the blocks of a file by running sums of one row per block. No task sees a whole file, lines
keep their place, and only the lines of records with line breaks are shuffled, to meet in their own group.

A quote that is never closed would swallow the rest of its file: from the line that opens it on, every line is a record of
its own, and `unclosed` names it. Blank lines are records only inside quoted cells.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.session import broadcast_within, join_small, ship, staged
from obsweave.sources.files import opened

# Where the split size follows from the number of cores, lines are written once, so that later passes see the same blocks;
# inputs of this many full splits a core keep their blocks and are read again instead.
STABLE_SPLITS = 16
BATCH_LINES = 10_000
_ANNOTATED = (
    "file string, block long, i int, nb int, rec_out int, rec_in int, before_out boolean, after_out boolean,"
    " before_in boolean, after_in boolean, blank boolean, line binary")


def leaves_open(lines: pa.Array, sep: str) -> np.ndarray:
    """Whether each line, begun outside quoted cells, ends inside one. Quotes within a cell that does not begin with one are text."""
    cell = f'(?:"(?:[^"]|"")*"(?:[^"{sep}][^{sep}]*)?|[^"{sep}][^{sep}]*|)'
    return ~pc.match_substring_regex(lines, f"^{cell}(?:{sep}{cell})*$").to_numpy(zero_copy_only=False)


def composed(out: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """State after each line, for lines that map outside to `out` and inside to `inside`: True is inside.

    The last line before with one result for both states decides, turned around by the swaps since.
    """
    place = np.arange(len(out))
    last = np.maximum.accumulate(np.where(out == inside, place, -1))
    swaps = np.cumsum(out & ~inside)
    known = out[last] ^ ((swaps - swaps[last]) % 2 == 1)
    return np.where(last >= 0, known, start ^ (swaps % 2 == 1))


class Block:
    """Lines of one block in order, for both states it can begin with."""

    def __init__(self):
        self.lines = self.filled = 0
        self.state, self.records = [False, True], [-1, -1]

    def annotate(self, lines: pa.Array, sep: str) -> list[np.ndarray]:
        n = len(lines)
        quoted = np.flatnonzero(pc.greater_equal(pc.find_substring(lines, b'"'), 0).to_numpy(zero_copy_only=False))
        out, inside = np.zeros(n, dtype=bool), np.ones(n, dtype=bool)
        if len(quoted):
            some = lines.take(pa.array(quoted))
            out[quoted] = leaves_open(some, sep)
            inside[quoted] = leaves_open(pc.binary_join_element_wise(pa.scalar(b'"'), some, pa.scalar(b"")), sep)
        blank = pc.match_substring_regex(lines, "^ *$").to_numpy(zero_copy_only=False)
        place = self.lines + np.arange(n)
        filled = self.filled + np.cumsum(~blank)
        found = []
        for h in (0, 1):
            after = composed(out, inside, self.state[h])
            before = np.concatenate([[self.state[h]], after[:-1]])
            records = self.records[h] + np.cumsum(~before & ~blank)
            self.state[h], self.records[h] = bool(after[-1]), int(records[-1])
            found += [records.astype(np.int32), before, after]
        self.lines, self.filled = int(place[-1]) + 1, int(filled[-1])
        return [place.astype(np.int32), filled.astype(np.int32), found[0], found[3], found[1], found[2], found[4], found[5], blank]


def _annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, block = None, Block()
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = pc.dictionary_encode(batch["file"]), batch["block"].to_numpy()
        codes = files.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            part = batch.slice(start, end - start)
            own = (part["file"][0].as_py(), int(blocks[start]))
            if own != key:
                key, block = own, Block()
            columns = [pa.array(x) for x in block.annotate(part["line"], part["sep"][0].as_py())]
            yield pa.RecordBatch.from_arrays(
                [part["file"], part["block"], *columns, part["line"]], names=[c.split()[0] for c in _ANNOTATED.split(", ")])


def annotated(lines: DataFrame, dialects: DataFrame, keep: bool) -> DataFrame:
    """(file, block, line) in reading order with each line's place and states in its block; `keep` writes them once."""
    ship(lines.sparkSession)
    given = join_small(lines, dialects.select("file", "sep"), "file", "inner").select("file", "block", "sep", "line")
    out = given.mapInArrow(_annotate, _ANNOTATED)
    return staged(out, "lines") if keep else out


def _annotate_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _ANNOTATED.split(", ")]
    for batch in batches:
        kept, n = [], 0
        for path, file, sep in zip(*(batch[c].to_pylist() for c in ("path", "file", "sep"))):
            with opened(path) as raw:
                lines = raw.read().removeprefix(codecs.BOM_UTF8).splitlines()
            if not lines:
                continue
            lines = pa.array(lines, pa.binary())
            columns = [pa.array(x) for x in Block().annotate(lines, sep)]
            whose = [pa.repeat(file, len(lines)), pa.repeat(pa.scalar(0, pa.int64()), len(lines))]
            kept, n = [*kept, pa.RecordBatch.from_arrays([*whose, *columns, lines], names=names)], n + len(lines)
            if n >= BATCH_LINES:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept, n = [], 0
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def annotated_files(found: DataFrame) -> DataFrame:
    """The same for small files (path, file, sep), each read whole as one block; a task holds a file and a few lines of others."""
    return found.mapInArrow(_annotate_files, _ANNOTATED)


def _by_state(name: str) -> Column:
    return F.when(F.col("state"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))


def block_states(lines: DataFrame) -> DataFrame:
    """One row per block: (file, block, n, state, records_before, filled_before, broken, open_nb, open_record).

    `broken` blocks may hold lines that begin or end inside a quoted cell. `open_nb` and `open_record` are the count of filled
    lines and the record at a quote that the file never closes, else null.
    """
    def last_opening(h):
        opens = ~F.col(f"before_{h}") & F.col(f"after_{h}")
        return F.max(F.when(opens, F.struct("nb", F.col(f"rec_{h}").alias("rec")))).alias(f"opening_{h}")

    blocks = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("nb").alias("filled"),
        *[F.max_by(f"after_{h}", "i").alias(f"end_{h}") for h in ("out", "in")],
        *[(F.max(f"rec_{h}") + 1).alias(f"records_{h}") for h in ("out", "in")], *[last_opening(h) for h in ("out", "in")])
    blocks = staged(blocks, "blocks")
    order = Window.partitionBy("file").orderBy("block")
    before, file = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    # as in `composed`, with one row per block
    swap = (F.col("end_out") & ~F.col("end_in")).cast("int")
    rows = blocks.withColumn("swap", swap).withColumn("swaps", F.sum("swap").over(order))
    fixed = F.when(F.col("end_out") == F.col("end_in"), F.struct(F.col("end_out").alias("end"), "swaps"))
    rows = rows.withColumn("last", F.last(fixed, ignorenulls=True).over(before))
    turned = (F.col("swaps") - F.col("swap") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    rows = rows.withColumn("state", F.coalesce("last.end", F.lit(False)) != turned)
    rows = rows.select("file", "block", "n", "filled", "state", *[_by_state(c).alias(c) for c in ("end", "records", "opening")])
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumn("records_before", sums("records")).withColumn("filled_before", sums("filled"))
    opening = F.struct((F.col("filled_before") + F.col("opening.nb")).alias("nb"), (F.col("records_before") + F.col("opening.rec")).alias("record"))
    rows = rows.withColumn("open", F.max(F.when(F.col("opening").isNotNull(), opening)).over(file))
    never_closed = F.max_by("end", "block").over(file)
    at_end = lambda c: F.when(never_closed, F.col(f"open.{c}"))
    return rows.select(
        "file", "block", "n", "state", "records_before", "filled_before", (F.col("state") | F.col("opening").isNotNull()).alias("broken"),
        at_end("nb").alias("open_nb"), at_end("record").alias("open_record"))


def unclosed(blocks: DataFrame) -> DataFrame:
    """(file, record): where a quote opens that its file never closes; from there on lines are records."""
    return blocks.where("open_nb IS NOT NULL").groupBy("file").agg(F.max("open_record").alias("record"))


def numbered(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, record, line, at, broken): each kept line with its record from 0; `broken` lines share theirs with others."""
    rows = lines.join(broadcast_within(blocks.drop("broken"), "file"), ["file", "block"], "left")
    same = F.col("n").isNotNull() & (F.col("i") < F.col("n"))
    state = F.when(same, F.col("state")).otherwise(F.raise_error(F.lit("the split size changed since the blocks of the files were counted")))
    rows = rows.withColumn("state", state)
    rows = rows.withColumn("gnb", F.col("filled_before") + F.col("nb")).withColumn("alone", F.coalesce(F.col("gnb") >= F.col("open_nb"), F.lit(False)))
    record = F.when(F.col("alone"), F.col("open_record") + F.col("gnb") - F.col("open_nb")).otherwise(F.col("records_before") + _by_state("rec"))
    within = ~F.col("alone") & _by_state("before")
    return rows.where(within | ~F.col("blank")).select(
        "file", record.alias("record"), "line", F.struct("block", "i").alias("at"), (within | (~F.col("alone") & _by_state("after"))).alias("broken"))


def records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, record, text) as binary; lines of one record are joined by line breaks."""
    rows = numbered(lines, blocks)
    alone = rows.where("NOT broken").select("file", "record", F.col("line").alias("text"))
    if blocks.where("broken").isEmpty():
        return alone
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    broken = rows.where("broken").groupBy("file", "record").agg(parts.alias("parts"))
    # the parts are bytes of one encoding; joined as bytes they stay what they were
    text = F.aggregate(
        F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0)), lambda a, x: F.concat(a, F.lit(b"\n"), x))
    return alone.unionByName(broken.select("file", "record", text.alias("text")))
