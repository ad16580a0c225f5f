"""Packing of tokenized documents into sequences of one length: shortest pack first over the length histogram.

1. Tasks tokenize whole texts and write ids to the shared folder. What does not fill whole sequences is a
   document's tail; a task numbers its tails of each length.
2. The histogram of tail lengths (fewer rows than a sequence has places, whatever the number of documents) is packed
   on the driver: lengths longest first, each into the packs with the most room. A pattern stands for as many packs as
   have the same contents, so work follows the number of lengths. The emptiest packs are then dissolved and cut to
   fill what room the others have left.
3. Tails get their rank within their length from the counts of the tasks, and ranks look up their place in the patterns.

A null text is empty: it has only the end id. Repeated rows are packed as often as they come. Documents over a
sequence are cut at whole sequences; other cuts come from filling. Only the few last packs stay padded.
"""

from __future__ import annotations

import bisect
import os
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import alone, remembers, slices
from obsweave.session import ship, staged

# Words whose ids a Python worker remembers at most; then it starts anew.
REMEMBERED = 400_000
TOGETHER = 256  # words of letters that are encoded as one text
_DIGIT = "1"

_PUNCTUATED = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)")

_LOADED: dict = {}


def _forget() -> None:
    _LOADED.clear()


remembers("packing", _forget)


def _coded(tokenizer, words: list[bytes]):
    """(word, ids) of each word. Words of letters are encoded many at once with digits between them: a digit is a piece by itself."""
    texts = [w.decode() for w in words]
    apart = tokenizer.encode(_DIGIT, add_special_tokens=False).ids
    joined = [k for k, t in enumerate(texts) if t.isalpha()] if len(apart) == 1 else []
    runs = [joined[i:i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
    done = set()
    for run, coded in zip(runs, tokenizer.encode_batch_fast(["".join(texts[k] + _DIGIT for k in run) for run in runs], add_special_tokens=False)):
        ids = np.array(coded.ids, dtype="<u4")
        ends = (4 * np.flatnonzero(ids == apart[0])).tolist()
        if len(ends) == len(run):
            raw = ids.tobytes()
            yield from zip([words[k] for k in run], [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends)], ends)])
            done.update(run)
    left = [k for k in range(len(words)) if k not in done]
    for k, coded in zip(left, tokenizer.encode_batch_fast([texts[k] for k in left], add_special_tokens=False)):
        yield words[k], np.array(coded.ids, dtype="<u4").tobytes()


def word_ids(path: str, texts: list[str]) -> list[bytes]:
    """Ids of whole texts, little-endian with 4 bytes each.

    White space parts words for this kind of vocabulary, so each different word is encoded once and remembered.
    Words are lower-cased by the tokenizer; doing so before saves repeats, except where special tokens may stand.
    """
    from tokenizers import Tokenizer

    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = (Tokenizer.from_file(path), {})
    tokenizer, known = _LOADED[path]
    if len(known) > REMEMBERED:
        known.clear()
    split = [(raw if b"<|" in raw else raw.lower()).split() for raw in (t.encode() for t in texts)]
    new = set().union(*split).difference(known)
    # punctuation after a letter is a token of its own, so such words consist of two that may be known
    parts = {w: m.groups() for w in new if (m := _PUNCTUATED.fullmatch(w)) and m[1].decode()[-1].isalpha()}
    bare = list({x for w in new for x in parts.get(w, (w,)) if x not in known})
    known.update(_coded(tokenizer, bare))
    known.update({w: known[x] + known[y] for w, (x, y) in parts.items()})
    return [b"".join(map(known.__getitem__, words)) for words in split]


@dataclass
class Slice:
    """Places start .. start+length of the tails of one length, for ranks from `rank` on."""

    tail: int
    rank: int
    start: int
    length: int

    def later(self, n: int) -> Slice:
        return Slice(self.tail, self.rank + n, self.start, self.length)


@dataclass
class Pattern:
    """`count` packs with the same contents and room."""

    room: int
    count: int
    slices: list[Slice]

    def split(self, n: int) -> Pattern:
        """Cuts off the first n packs."""
        first = Pattern(self.room, n, self.slices)
        self.count, self.slices = self.count - n, [s.later(n) for s in self.slices]
        return first

    def with_slice(self, s: Slice) -> Pattern:
        return Pattern(self.room - s.length, self.count, [*self.slices, s])


class Rooms:
    """Patterns by room."""

    def __init__(self):
        self.by: dict[int, list[Pattern]] = defaultdict(list)
        self.order: list[int] = []

    def add(self, p: Pattern) -> None:
        if p.count:
            if not self.by[p.room]:
                bisect.insort(self.order, p.room)
            self.by[p.room].append(p)

    def take(self, room: int, n: int) -> Pattern:
        """At most n packs of that room."""
        found = self.by[room][-1]
        if found.count > n:
            return found.split(n)
        self.by[room].pop()
        if not self.by[room]:
            self.order.remove(room)
        return found

    def all(self) -> list[Pattern]:
        return [p for room in self.order for p in self.by[room]]


def shortest_pack_first(histogram: dict[int, int], size: int) -> Rooms:
    """Patterns for tails of the given lengths and counts: longest first, into the packs with the most room."""
    packs = Rooms()
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if packs.order and packs.order[-1] >= length:
                pack = packs.take(packs.order[-1], left)
            else:
                pack = Pattern(size, left, [])
            packs.add(pack.with_slice(Slice(length, rank, 0, length)))
            rank, left = rank + pack.count, left - pack.count
    return packs


def fill_by_cutting(packs: Rooms, size: int, least: int) -> Rooms:
    """Dissolves the emptiest packs and cuts their tails to fill the room of the others, where that is `least` or more."""
    donors: list[tuple[Slice, int]] = []
    while True:
        targets = [r for r in packs.order if r >= least]
        if not targets:
            break
        if not donors:
            gap = sum(r * p.count for r in targets for p in packs.by[r])
            emptiest = targets[-1]
            used = size - emptiest
            n = max(1, min(sum(p.count for p in packs.by[emptiest]), (gap - emptiest) // size))
            if gap - emptiest < used:  # the rest cannot take in a whole pack
                break
            pack = packs.take(emptiest, n)
            donors = [(s, pack.count) for s in pack.slices]
            continue
        s, n = donors.pop()
        pack = packs.take(targets[0], n)
        if n > pack.count:
            donors.append((s.later(pack.count), n - pack.count))
        take = min(s.length, pack.room)
        packs.add(pack.with_slice(Slice(s.tail, s.rank, s.start, take)))
        if take < s.length:
            donors.append((Slice(s.tail, s.rank, s.start + take, s.length - take), pack.count))
    for s, n in donors:  # what no room is left for
        packs.add(Pattern(size, n, []).with_slice(s))
    return packs


def plan(histogram: dict[int, int], size: int, least: int) -> dict[str, np.ndarray]:
    """Where each slice of each tail goes, sorted by tail length and rank.

    Columns: tail, lo, hi (ranks), start, length (places of the tail), sequence (of rank lo), offset.
    """
    rows, sequence = [], 0
    for p in fill_by_cutting(shortest_pack_first(histogram, size), size, least).all():
        offset = 0
        for s in p.slices:
            rows.append((s.tail, s.rank, s.rank + p.count, s.start, s.length, sequence, offset))
            offset += s.length
        sequence += p.count
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 7).T
    return dict(zip(("tail", "lo", "hi", "start", "length", "sequence", "offset"), columns)) | {"sequences": sequence}


def tokenized(docs: DataFrame, path: str, end: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """Ids of each document in the shared folder, with its tail's length and number within the task."""
    ship(docs.sparkSession)

    def run(batches):
        alone("packing")
        part, tails, full = TaskContext.get().partitionId(), defaultdict(int), 0
        last = np.array([end], dtype="<u4").tobytes()
        for batch in slices(batches):
            ids = [x + last for x in word_ids(path, [t or "" for t in batch.column(1).to_pylist()])]
            n = [len(x) // 4 for x in ids]
            numbers, fulls = [], []
            for x in n:
                numbers.append(tails[x % size])
                fulls.append(full)
                tails[x % size] += 1
                full += x // size
            narrow = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids] if max(np.frombuffer(x, "<u4").max() for x in ids) < 1 << 16 else ids
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([x % size for x in n], pa.int32()), pa.array([part] * len(n), pa.int64()),
                 pa.array(numbers, pa.int64()), pa.array(fulls, pa.int64()), pa.array(narrow, pa.binary())],
                names=["doc_id", "n", "tail", "part", "number", "full", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return staged(rows.mapInArrow(run, f"doc_id {kind}, n long, tail int, part long, number long, full long, ids binary"), "packing-ids")


def pack(docs: DataFrame, path: str, end: int = 2, size: int = 4096, least: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids (binary, 4 bytes each), doc_tokens, sequence_id, offset.

    `path`: tokenizer file; `end`: id after each document; `least`: room that is left unfilled below this.
    Whole sequences of long documents have ids above all packed ones.
    """
    ids = tokenized(docs, path, end, size, id_col, text_col)
    spark = docs.sparkSession
    counts = ids.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("c"))
    histogram = {r["tail"]: r["c"] for r in counts.groupBy("tail").agg(F.sum("c").alias("c")).collect() if r["tail"]}
    places = spark.sparkContext.broadcast(plan(histogram, size, least))
    before = F.sum("c").over(_before())
    firsts = counts.select("part", "tail", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = ids.join(firsts, ["part", "tail"]).select("doc_id", "n", "tail", "part", "full", (F.col("first") + F.col("number")).alias("rank"), "ids")
    kind = ids.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        at = places.value
        tails = at["tail"]
        for batch in slices(batches):
            owner, rows = [], []
            columns = [batch.column(k).to_pylist() for k in range(1, 7)]
            for i, (n, tail, part, full, rank, raw) in enumerate(zip(*columns)):
                wide = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                for k in range(n // size):
                    owner.append(i)
                    rows.append((k * size, size, wide[4 * k * size:4 * (k + 1) * size], n, at["sequences"] + (part << 32) + full + k, 0))
                base = n - tail
                lo, hi = np.searchsorted(tails, [tail, tail + 1])
                # slices of one start are disjoint in rank; those of a tail are few
                for k in lo + np.flatnonzero((at["lo"][lo:hi] <= rank) & (rank < at["hi"][lo:hi])):
                    start, length = base + int(at["start"][k]), int(at["length"][k])
                    owner.append(i)
                    rows.append((start, length, wide[4 * start:4 * (start + length)], n, int(at["sequence"][k]) + rank - int(at["lo"][k]), int(at["offset"][k])))
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
