"""Quality scores: random-indexing word vectors, pooled per document, under a two-layer network with calibrated temperature.

1. Random indexing. Every word has a sparse index vector drawn from its hash: `NONZERO` places of `dims` hold +1 or -1. The
   vector of a word is the sum of the index vectors around it, `WINDOW` words to both sides, over all documents. Words
   share `buckets` rows by hash, so the table of word vectors has a fixed size, and all words of all texts count.
2. Pooling. A text is the mean and the spread of the unit vectors of its words, each with the word's index vector added,
   and the logarithm of its length. Whole texts are read; nothing but the text enters.
3. A network of one hidden layer is fitted by mini-batch steps on at most `sample` labelled rows, those of smallest hash.
   A fifth of them is held back to choose the temperature that divides the log odds, by likelihood.

The sums of all tasks are added by Spark per bucket; the driver sees the word table (buckets x dims) and the sample only.

Defined cases: null and empty texts pool to zeros and get a score like any text. Labels that are null teach nothing; an id
with several labels has their mean; ids that repeat in the documents are scored each. Rows without a numeric id are
labelled and split by the text of the id, null ids are neither labelled nor held out. Without any label all scores
are 0.5 and predicted 1, as 0.5 counts as quality. Very long words are hashed whole. Columns of the input other than the
three named are not read, so they never clash. Ties at the border of the sample are decided by id.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.llm.common import slices
from obsweave.session import ship, staged

WORD = re.compile(r"\w+|[^\w\s]")
WINDOW = 2
NONZERO = 4
# Words that a task remembers with their buckets; longer words are hashed each time.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
# Places of a text that are summed at once.
STEP = 65_536


class Buckets:
    """Bucket of each word, remembered within bounds."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, text: str) -> np.ndarray:
        words, known = WORD.findall(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.int64)
        except KeyError:
            out = []
            for w in words:
                b = known.get(w)
                if b is None:
                    b = zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.buckets
                    if len(w) <= REMEMBERED_CHARS:
                        known[w] = b
                out.append(b)
            return np.array(out, dtype=np.int64)


def index_vectors(buckets: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each buckets x NONZERO."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dims, (buckets, NONZERO)), rng.choice(np.array([-1, 1]), (buckets, NONZERO))


def context_sums(texts: DataFrame, buckets: int, dims: int, seed: int) -> DataFrame:
    """(bucket, v array<double>): sums of index vectors around the words of each bucket, over all texts."""
    def run(batches):
        places, signs = index_vectors(buckets, dims, seed)
        words, sums = Buckets(buckets), np.zeros(buckets * dims, dtype=np.int32)
        used = np.zeros(buckets, dtype=bool)

        def add(center, context):
            for s in range(0, len(center), STEP):
                c, x = center[s:s + STEP], context[s:s + STEP]
                np.add.at(sums, (c[:, None] * dims + places[x]).ravel(), signs[x].ravel().astype(np.int32))

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                w = words.of(text or "")
                used[w] = True
                for gap in range(1, WINDOW + 1):
                    add(w[:-gap], w[gap:])
                    add(w[gap:], w[:-gap])
        some, sums = np.flatnonzero(used), sums.reshape(buckets, dims)
        for s in range(0, len(some), 4096):
            part = some[s:s + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(sums[part].ravel()), dims).cast(pa.list_(pa.int32()))],
                names=["bucket", "v"])

    ship(texts.sparkSession)
    rows = texts.select("text").mapInArrow(run, "bucket int, v array<int>")
    total = rows.groupBy("bucket").agg(*[F.sum(F.col("v")[i]).cast("double").alias(f"v{i}") for i in range(dims)])
    return total.select("bucket", F.array(*[f"v{i}" for i in range(dims)]).alias("v"))


def word_table(sums: DataFrame, buckets: int, dims: int, seed: int) -> np.ndarray:
    """Unit context vectors with each bucket's own index vector added; buckets x dims single precision numbers."""
    found = sums.toArrow()
    table = np.zeros((buckets, dims))
    if found.num_rows:
        v = found["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        # what all words have around them says nothing about one of them
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        table[found["bucket"].to_numpy()] = v - v.mean(axis=0)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    places, signs = index_vectors(buckets, dims, seed)
    np.add.at(table, (np.arange(buckets)[:, None], places), signs / np.sqrt(NONZERO))
    return table.astype(np.float32)


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """docs (id, text, ...) with `x`: mean and spread of the word vectors of each text, and its log length; text is dropped."""
    buckets, dims = table.shape
    given = docs.sparkSession.sparkContext.broadcast(table)
    rest = [c for c in docs.columns if c != "text"]

    def pool(w: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * dims + 1, dtype=np.float32)
        if len(w):
            at, times = np.unique(w, return_counts=True)
            total, square = np.zeros(dims), np.zeros(dims)
            for s in range(0, len(at), STEP):
                v, n = table[at[s:s + STEP]], times[s:s + STEP]
                total += n @ v
                square += n @ (v * v)
            mean = total / len(w)
            out[:dims], out[dims:-1] = mean, np.sqrt(np.maximum(square / len(w) - mean * mean, 0))
            out[-1] = np.log1p(len(w)) / 4
        return out

    def run(batches):
        words = Buckets(buckets)
        for batch in slices(batches):
            x = np.array([pool(words.of(t or ""), given.value) for t in batch["text"].to_pylist()]).reshape(batch.num_rows, -1)
            x = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 2 * dims + 1).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], x], names=[*rest, "x"])

    ship(docs.sparkSession)
    kept = docs.select(*rest, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*rest).schema)
    return kept.mapInArrow(run, f"{schema}, x array<float>")


class Network:
    """Two layers: tanh units, then one log odds, divided by a temperature."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = np.zeros(inputs), np.ones(inputs)
        self.weights = [rng.standard_normal((inputs, hidden)) / np.sqrt(inputs), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        self.temperature = 1.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 0.01, decay: float = 1e-4) -> None:
        """Adaptive mini-batch steps down the mean cross-entropy."""
        rng = np.random.default_rng(seed)
        self.shift, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        x = (x - self.shift) / self.scale
        base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.weights[3][0] = np.log(base / (1 - base))
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(order), 128):
                at = order[s:s + 128]
                w1, b1, w2, b2 = self.weights
                h = np.tanh(x[at] @ w1 + b1)
                miss = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -500, 500))) - y[at]) / len(at)
                back = miss[:, None] * w2 * (1 - h * h)
                grads = [x[at].T @ back + decay * w1, back.sum(axis=0), h.T @ miss + decay * w2, np.array([miss.sum()])]
                step += 1
                for w, m, v, g in zip(self.weights, first, second, grads):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (1 - epoch / epochs) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of highest likelihood on rows that were not fitted, by golden-section search of its logarithm."""
        odds = self.log_odds(x)
        loss = lambda t: np.mean(np.logaddexp(0, odds / np.exp(t)) - y * odds / np.exp(t))
        low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = high - golden * (high - low), low + golden * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))


def learned(sample: list, hidden: int, epochs: int, seed: int) -> Network | None:
    """A calibrated network from (x, y) rows, or None without rows. Every fifth row calibrates, if there are enough."""
    if not sample:
        return None
    x, y = np.array([r["x"] for r in sample], dtype=np.float64), np.array([r["y"] for r in sample])
    net, kept_back = Network(x.shape[1], hidden, seed), np.arange(len(x)) % 5 == 4
    if kept_back.sum() < 5:
        kept_back[:] = False
    net.fit(x[~kept_back], y[~kept_back], epochs, seed)
    if kept_back.any():
        net.calibrate(x[kept_back], y[kept_back])
    return net


def held_out(id_: Column) -> Column:
    """Rows whose labels are never seen; null ids are not held out, as they have no label."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    buckets: int = 1 << 15, dims: int = 64, hidden: int = 32, sample: int = 20_000, epochs: int = 30, seed: int = 13,
) -> DataFrame:
    """(id, held_out, score, predicted) of every document; labels of held-out rows are never read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = word_table(context_sums(rows, buckets, dims, seed), buckets, dims, seed)
    found = staged(pooled(rows, table), "quality-pooled")
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(
        F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    given = given.groupBy("id").agg(F.avg("y").alias("y"))
    taught = found.join(given, "id").select("id", "x", "y", F.xxhash64("id").alias("draw"))
    # copies of one id count once
    taught = taught.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("x"))).where("n = 1")
    net = learned(taught.orderBy("draw", "id").limit(sample).select("x", "y").collect(), hidden, epochs, seed)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 4096):
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            score = np.full(batch.num_rows, 0.5) if net is None else net.score(x)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(score)], names=["id", "score"])

    ship(docs.sparkSession)
    scored = found.select("id", "x").mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
