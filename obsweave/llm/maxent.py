"""Scoring texts with a hashed maximum-entropy language model and a unigram base.

A word's probability is that of its class after the words before it, times that of the word within its class. The most
frequent words form classes of equal size by rank; each of the others belongs to one of a fixed number of tail classes by
its last bytes. Both factors are softmaxes over rows of a hashed weight table; features of a position are a constant, the
word before, the pair before, and the second and third word before alone (skips). Within a tail class words share the
probability by their counts plus one, so every text has a probability.

Counts of all training words are summed by Spark. Weights start at what the counts say; each round, tasks walk through
their share of the training documents in small batches of gradient steps, and the changes of each row are averaged by
how often tasks used it. A training document takes part in one round. The model has a fixed size; counts of
rare words are joined, not broadcast.

Null and empty texts are the end token alone. Repeated rows are scored alike and counted as often as they come.
A null id counts as the empty text when documents are dealt out.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import slices
from obsweave.session import ship, staged

HEAD, WIDTH, TAILS = 1024, 32, 32  # words with classes of their own, words in such a class, classes of the others
CLASSES = HEAD // WIDTH + TAILS
START = HEAD + TAILS
ROWS = 1 << 14  # of either weight table
FEATURES = 5
CHUNK, STEP = 2048, 4096
# A word is frequent, and its count broadcast, if it makes up this share of the training tokens: so many can be at most 1 / share.
FREQUENT = 1e-5
REMEMBERED = 600_000

END = b" "  # no word holds white space


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def tail_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-2:]) % TAILS


def words_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """(h, tail, n): counts of all words of `docs` (text)."""
    ship(docs.sparkSession)

    def run(batches):
        seen: Counter[bytes] = Counter()

        def out():
            words = list(seen)
            found = pa.RecordBatch.from_arrays(
                [pa.array([word_hash(w) for w in words], pa.int64()), pa.array([tail_class(w) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                names=["h", "tail", "n"])
            seen.clear()
            return found

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
            if len(seen) > REMEMBERED:
                yield out()
        yield out()

    rows = docs.mapInArrow(run, "h long, tail int, n long")
    return rows.groupBy("h").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Words:
    """Frequent words, sorted by hash, and what is known of tail classes."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray  # of each frequent word, then of each tail class; the head's rank, or HEAD + tail class
    tail_log: np.ndarray  # log10 of the sum of counts plus one in each tail class
    total: int
    distinct: int

    def __post_init__(self):
        self.known: dict[bytes, int] = {}

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Place among the frequent words, or their number plus the tail class."""
        get = self.known.get
        found = [get(w) for w in words]
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list({w for w, c in zip(words, found) if c is None})
            h = np.array([word_hash(w) for w in new], dtype=np.int64)
            at = np.searchsorted(self.hashes, h)
            hit = (at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h) if len(self.hashes) else np.zeros(len(h), bool)
            own = {w: int(a) if x else len(self.hashes) + tail_class(w) for w, a, x in zip(new, at, hit)}
            self.known.update(own)
            found = [own[w] if c is None else c for w, c in zip(words, found)]
        return np.array(found, dtype=np.int64)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}


def frequent_words(counts: DataFrame) -> Words:
    """`counts`: (h, tail, n)."""
    sums = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    total, distinct = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
    by_tail = np.zeros((TAILS, 2))
    for r in sums:
        by_tail[r["tail"]] = r["n"], r["v"]
    often = counts.where(F.col("n") >= max(2, FREQUENT * total)).toArrow().sort_by("h")
    top = counts.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()  # also where fewer words are frequent
    both = {h: (t, n) for part in (often, top) for h, t, n in zip(*(part[c].to_pylist() for c in ("h", "tail", "n")))}
    head = {h: k for k, h in enumerate(top["h"].to_pylist())}
    hashes = np.array(sorted(both), dtype=np.int64)
    units = np.array([head.get(h, HEAD + both[h][0]) for h in hashes.tolist()] + [HEAD + t for t in range(TAILS)], dtype=np.int64)
    for h in head:
        by_tail[both[h][0]] -= both[h][1], 1
    return Words(hashes, np.array([both[h][1] for h in hashes.tolist()], dtype=np.int64), units, np.log10(by_tail.sum(1) + 1), total, distinct)


def first_weights(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row 0 of the class table and rows 0 .. of the word table (constant feature of each head class) say what the counts say."""
    table, inner = np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, WIDTH), np.float32)
    n = np.zeros(HEAD)
    units = words.units[:len(words.hashes)]
    n[units[units < HEAD]] = words.counts[units < HEAD]
    by_class = np.concatenate([n.reshape(-1, WIDTH).sum(1), 10 ** words.tail_log])
    table[0] = np.log(np.maximum(by_class, 0.5))
    inner[:HEAD // WIDTH] = np.where(n > 0, np.log(np.maximum(n, 1e-9)), -30).reshape(-1, WIDTH)
    return table, inner


def feature_rows(u1, u2, u3) -> np.ndarray:
    """Hashed rows of the class table for positions after u1 (one before), u2, u3."""
    span = START + 1
    parts = np.stack([u1 + span, u2 + 2 * span, u3 + 3 * span, (u1 * span + u2) + 4 * span]).astype(np.uint64)
    mixed = (parts * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    rows = 1 + mixed % np.uint64(ROWS - 1)
    return np.concatenate([np.zeros((1, len(u1)), np.int64), rows.astype(np.int64)]).T


def inner_rows(features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows of the word table: the constant has a row for each class, others are hashed with it."""
    own = HEAD // WIDTH
    mixed = ((features * CLASSES + classes[:, None]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    rows = own + (mixed % np.uint64(ROWS - own)).astype(np.int64)
    rows[:, 0] = classes
    return rows


def sums_of(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows of the table, shifted to a largest value of 0 each."""
    z = np.take(table, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        z += np.take(table, rows[:, k], axis=0)
    z -= z.max(1, keepdims=True)
    return z


def softmax(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = sums_of(table, rows)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def log_softmax_at(table: np.ndarray, rows: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Log probability of one place of each row."""
    z = sums_of(table, rows)
    chosen = z[np.arange(len(z)), right]
    np.exp(z, out=z)
    return chosen - np.log(z.sum(1))


def contexts(units: list[np.ndarray]):
    """Units of several texts in a row, with those one, two and three before."""
    pad = np.full(3, START, np.int64)
    row = np.concatenate([x for u in units for x in (pad, u)])
    lengths = np.array([len(u) for u in units])
    at = np.arange(lengths.sum()) + np.repeat(3 * np.arange(1, len(units) + 1), lengths)
    return row[at], row[at - 1], row[at - 2], row[at - 3]


def run_sums(values: np.ndarray, first: np.ndarray, lengths: np.ndarray, turns: int = 8) -> np.ndarray:
    """Sums over runs of rows: short runs all at once, a row a turn, and what is left of the long ones one by one."""
    by = np.argsort(-lengths, kind="stable")
    start, size = first[by], lengths[by]
    sums = np.take(values, start, axis=0)
    for turn in range(1, turns):
        n = np.searchsorted(-size, -turn)
        sums[:n] += np.take(values, start[:n] + turn, axis=0)
    for i in range(np.searchsorted(-size, -turns)):
        sums[i] += values[start[i] + turns:start[i] + size[i]].sum(0)
    out = np.empty_like(sums)
    out[by] = sums
    return out


class Learner:
    """Gradient steps with step sizes that fall by what each weight has seen."""

    def __init__(self, tables, rate: float):
        self.rate, self.tables = rate, [t.copy() for t in tables]
        self.seen = [np.ones_like(t) for t in tables]
        self.used = [np.zeros(len(t), np.int64) for t in tables]

    def step(self, k: int, rows: np.ndarray, right: np.ndarray) -> None:
        p = softmax(self.tables[k], rows)
        p[np.arange(len(p)), right] -= 1
        # the constant's rows are few and come first: a product with indicators sums their changes
        few = 1 if k == 0 else HEAD // WIDTH
        own = (np.arange(few)[:, None] == rows[:, 0]).astype(np.float32)
        flat = rows[:, 1:].ravel().astype(np.uint16)  # which sort by digits
        order = np.argsort(flat, kind="stable")
        flat = flat[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        lengths = np.diff(np.append(first, len(flat)))
        row = np.concatenate([np.arange(few), flat[first]])
        times = np.concatenate([own.sum(1).astype(np.int64), lengths])
        change = np.concatenate([own @ p, run_sums(np.take(p, order // (FEATURES - 1), axis=0), first, lengths)])
        seen = self.seen[k][row]
        seen += change * change
        self.seen[k][row] = seen
        np.sqrt(seen, out=seen)
        change /= seen
        change *= self.rate
        self.tables[k][row] -= change
        self.used[k][row] += times

    def learn(self, units: list[np.ndarray]) -> None:
        now, u1, u2, u3 = contexts(units)
        for s in range(0, len(now), STEP):
            e = s + STEP
            features, word = feature_rows(u1[s:e], u2[s:e], u3[s:e]), now[s:e]
            head = word < HEAD
            classes = np.where(head, word // WIDTH, word - HEAD + HEAD // WIDTH)
            self.step(0, features, classes)
            if head.any():
                self.step(1, inner_rows(features[head], classes[head]), word[head] % WIDTH)


def trained(docs: DataFrame, words: Words, rounds: int, rate: float, seed: int) -> list[np.ndarray]:
    """Weight tables after all rounds. `docs`: (id, text) of the training documents."""
    spark = docs.sparkSession
    tables, block = list(first_weights(words)), 256
    shared_words = spark.sparkContext.broadcast(words)
    for r in range(rounds):
        start = spark.sparkContext.broadcast(tables)

        def walk(batches, start=start):
            learner, own = Learner(start.value, rate), shared_words.value
            for batch in slices(batches, 64):
                learner.learn([own.units[own.codes(words_of(t))] for t in batch.column(0).to_pylist()])
            for k, before in enumerate(start.value):
                for b in range(0, ROWS, block):
                    used = learner.used[k][b:b + block]
                    if used.any():
                        change = (learner.tables[k][b:b + block] - before[b:b + block]).astype(np.float16)
                        yield _change(k, b, used, change)

        def summed(batches):
            sums: dict[tuple[int, int], list[np.ndarray]] = {}
            for batch in batches:
                for k, b, used, change in zip(*(c.to_pylist() for c in batch.columns)):
                    n = np.frombuffer(used, np.int64)
                    x = np.frombuffer(change, np.float16).reshape(block, -1).astype(np.float64) * n[:, None]
                    old = sums.setdefault((k, b), [np.zeros(block, np.int64), np.zeros_like(x)])
                    old[0] += n
                    old[1] += x
            for (k, b), (n, x) in sums.items():
                yield _change(k, b, n, (x / np.maximum(n, 1)[:, None]).astype(np.float16))

        schema = "k int, b int, used binary, change binary"
        share = docs.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(rounds)) == r).select("text")
        changes = share.mapInArrow(walk, schema).repartition("k", "b").mapInArrow(summed, schema)
        for row in changes.collect():  # as many rows as the tables have blocks
            x = np.frombuffer(row["change"], np.float16).reshape(block, -1)
            tables[row["k"]][row["b"]:row["b"] + block] += x
        start.unpersist()
    return tables


def _change(k, b, used, change) -> pa.RecordBatch:
    arrays = [pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([used.tobytes()], pa.binary()), pa.array([change.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["k", "b", "used", "change"])


def scored_parts(docs: DataFrame, words: Words, tables: list[np.ndarray]) -> DataFrame:
    """Rows of `docs` (id, out, text) with what needs no counts of rare words, and the rare words with their numbers."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((words, tables))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        own, (table, inner) = model.value
        n_often = len(own.hashes)
        often_log = np.concatenate([np.log10(own.counts + 1), np.zeros(TAILS)])
        tail_log = np.where(own.units < HEAD, 0.0, often_log - own.tail_log[np.maximum(own.units - HEAD, 0)])
        part, number = TaskContext.get().partitionId(), 0
        for batch in slices(batches, 64):
            texts = [words_of(t) for t in batch.column(2).to_pylist()]
            codes = [own.codes(t) for t in texts]
            lengths = np.array([len(c) for c in codes])
            firsts = np.cumsum(lengths) - lengths
            every = np.concatenate(codes)
            logs = tail_log[every]
            now, u1, u2, u3 = contexts([own.units[c] for c in codes])
            for s in range(0, len(now), CHUNK):
                e = s + CHUNK
                features, word = feature_rows(u1[s:e], u2[s:e], u3[s:e]), now[s:e]
                head = word < HEAD
                classes = np.where(head, word // WIDTH, word - HEAD + HEAD // WIDTH)
                logs[s:e] += log_softmax_at(table, features, classes) / math.log(10)
                if head.any():
                    logs[s:e][head] += log_softmax_at(inner, inner_rows(features[head], classes[head]), word[head] % WIDTH) / math.log(10)
            rare = [Counter([t[i] for i in np.flatnonzero(c >= n_often).tolist()]) for t, c in zip(texts, codes)]
            yield pa.RecordBatch.from_arrays([
                pa.array((part << 33) + number + np.arange(len(texts))), batch.column(0), batch.column(1), pa.array(lengths),
                pa.array(np.add.reduceat((every < n_often).astype(np.int64), firsts)), pa.array(np.add.reduceat(often_log[every], firsts)),
                pa.array(np.add.reduceat(logs, firsts)),
                pa.array([[word_hash(w) for w in r] for r in rare], pa.list_(pa.int64())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int32())),
            ], names=["row", "id", "out", "n_tokens", "n_often", "often_log", "part_log", "rare", "times"])
            number += len(texts)

    return docs.mapInArrow(run, f"row long, id {kind}, out boolean, n_tokens long, n_often long, often_log double, part_log double, rare array<long>, times array<int>")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, rate: float = 0.3, seed: int = 11) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text)."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("out"), F.col(text_col).alias("text"))
    learned = rows.where("not out")
    counts = staged(count_words(learned.select("text")), "maxent-counts")
    words = frequent_words(counts)
    tables = trained(learned.select("id", "text"), words, rounds, rate, seed)
    parts = staged(scored_parts(rows, words, tables), "maxent-parts")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    known = rare.join(counts.select("h", "n"), "h").groupBy("row").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    share = math.log10(words.total + words.distinct + 1)
    return parts.join(known, "row", "left").select(
        F.col("id").alias(id_col), F.col("out").alias("held_out"), "n_tokens", (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), (F.col("often_log") + rare_log - F.col("n_tokens") * share).alias("base_score"),
        (F.col("part_log") + rare_log).alias("score"))
