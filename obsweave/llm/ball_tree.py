"""Ranked lexical search: exact maximum inner products over sparse ball trees.

1. Terms are maximal runs of letters, digits and signs beyond ASCII, with A-Z lower-cased. Counts (documents, terms,
   documents of each query term) come from one pass over all texts; a document becomes a sparse vector of integer
   term values over the terms of the queries, a query a sparse vector of integer term weights.
2. Each task cuts its documents into trees of at most TREE_ROWS documents. A node holds its centroid, the radius around it and
   the terms below it; it is split in two halves along the line between two far documents, down to LEAF documents.
3. For a query, no document of a node scores more than <query, centroid> + |query on the node's terms| * radius, rounded up
   safely. Nodes are opened best first, until no bound reaches the score of the current k-th document; documents in the
   leaves are scored exactly in 64-bit integers.
4. A task keeps the k best documents of each query over all its trees, so bounds of later trees meet higher scores. Spark
   ranks what the tasks kept.

Queries are taken in blocks of about BLOCK_TERMS (query, term) pairs, dealt by hash; a block is what the driver and each
task hold. A block meets all documents.

Defined cases: null and empty texts have no terms and are found by no query; queries without terms have no rows. Equal
scores are ordered by id, null ids last. Repeated rows of a document are documents of their own; rows of one query id
are one query with the terms of all of them. Very long texts and terms are whole. Empty tables give no rows. Only the
id and text columns are read, so further columns never clash. Values beyond 64 bits do not arise below 10^9 occurrences of a
term in a text.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.llm.common import slices
from obsweave.session import ship, staged

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_TERMS = 100_000
TREE_ROWS, TREE_VALUES, LEAF = 8_192, 2_000_000, 64
UNIT = 1_000_000_000
# Signs of ASCII that part terms, as blanks; A-Z as a-z: for bytes.translate, which leaves bytes beyond ASCII as they are.
SEPARATED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: Column) -> Column:
    """Terms of a text in order, with repeats."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, BETWEEN), lambda t: t != "")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, term), each pair once."""
    return queries.select(F.col(id_col).alias("query"), F.explode(F.array_distinct(terms_of(F.col(text_col)))).alias("term")).distinct()


def term_counts(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(id, n, ids, tfs) of documents with a term: all its terms counted, and those of the queries by number."""
    kind = docs.schema["id"].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = given.value
        for batch in slices(batches):
            lengths, ids, tfs = [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                words = (text or b"").translate(SEPARATED).split(b" ")
                lengths.append(len(words) - words.count(b""))
                found = np.array([known[w] for w in words if w in known], dtype=np.int32)
                at, times = np.unique(found, return_counts=True)
                ids.append(at)
                tfs.append(times.astype(np.int32))
            some = np.flatnonzero(lengths)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(ids[i]) for i in some])]), pa.int32())
            pick = lambda lists: pa.array(np.concatenate([lists[i] for i in some]) if len(some) else [], pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(pa.array(some)), pa.array(np.array(lengths)[some], pa.int64()),
                pa.ListArray.from_arrays(offsets, pick(ids)), pa.ListArray.from_arrays(offsets, pick(tfs)),
            ], names=["id", "n", "ids", "tfs"])

    ship(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, ids array<int>, tfs array<int>")


def weight(docs: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * with_term + 1)))


class Queries:
    """Weights of the terms of a block's queries, by query and by term."""

    def __init__(self, pairs: list[tuple[int, int]], weights: np.ndarray, queries: int):
        # terms of weight 0 add nothing to any score
        pairs = np.array([p for p in pairs if weights[p[1]] > 0], dtype=np.int64).reshape(-1, 2)
        by_query, by_term = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))], pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
        self.n, self.weights = queries, weights
        self.terms, self.starts = by_query[:, 1], np.searchsorted(by_query[:, 0], np.arange(queries + 1))
        self.of, self.term_starts = by_term[:, 0], np.searchsorted(by_term[:, 1], np.arange(len(weights) + 1))

    def query(self, q: int) -> np.ndarray:
        return self.terms[self.starts[q]:self.starts[q + 1]]

    def holding(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place in `terms`) of each query that has one of the terms."""
        first, n = self.term_starts[terms], self.term_starts[terms + 1] - self.term_starts[terms]
        place = np.repeat(np.arange(len(terms)), n)
        return self.of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[place]], place


class Rows:
    """Sparse documents: terms and integer values of row r lie from starts[r] to starts[r + 1]."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.starts, self.terms, self.values = starts, terms, values

    def take(self, rows: np.ndarray) -> Rows:
        first, n = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        starts = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(starts[-1]) - np.repeat(starts[:-1], n) + np.repeat(first, n)
        return Rows(starts, self.terms[at], self.values[at])

    def products(self, dense: np.ndarray) -> np.ndarray:
        """Inner products with a dense vector, in its own type."""
        sums = np.concatenate([np.zeros(1, dtype=dense.dtype), np.cumsum(dense[self.terms] * self.values)])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


class Tree:
    """Ball tree over `rows`; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, rows: Rows, terms: int):
        self.nodes = {}
        scaled = Rows(rows.starts, rows.terms, rows.values.astype(np.float64))
        work, dense = [(0, np.arange(len(rows.starts) - 1))], np.zeros(terms)
        while work:
            node, at = work.pop()
            own = scaled.take(at)
            support, inverse = np.unique(own.terms, return_inverse=True)
            centre = np.bincount(inverse, own.values, len(support)) / len(at)
            squares = Rows(own.starts, np.zeros(len(own.terms), dtype=np.int64), own.values * own.values).products(np.ones(1))
            dense[support] = centre
            away = squares - 2 * own.products(dense) + centre @ centre
            dense[support] = 0
            # distances of rounded sums may fall short by their own size times the precision
            radius = math.sqrt(max(away.max(), 0) + 1e-9 * (squares.max() + centre @ centre))
            leaf = len(at) <= LEAF
            self.nodes[node] = (support, centre, radius, rows.take(at) if leaf else None, at if leaf else None)
            if not leaf:
                far = int(away.argmax())
                from_far = self._from(own, squares, far, dense)
                other = int(from_far.argmax())
                order = np.argsort(from_far - self._from(own, squares, other, dense), kind="stable")
                half = len(at) // 2
                work += [(2 * node + 1, at[order[:half]]), (2 * node + 2, at[order[half:]])]

    @staticmethod
    def _from(rows: Rows, squares: np.ndarray, r: int, dense: np.ndarray) -> np.ndarray:
        own = slice(rows.starts[r], rows.starts[r + 1])
        dense[rows.terms[own]] = rows.values[own]
        out = squares - 2 * rows.products(dense) + squares[r]
        dense[rows.terms[own]] = 0
        return out

    def bounds(self, node: int, queries: Queries) -> np.ndarray:
        """For each query, a number that no document of the node scores above."""
        support, centre, radius, _, _ = self.nodes[node]
        query, place = queries.holding(support)
        pull = queries.weights[support[place]].astype(np.float64)
        product = np.bincount(query, pull * centre[place], queries.n)
        reach = np.sqrt(np.bincount(query, pull * pull, queries.n))
        return (product + reach * radius) * (1 + 1e-9) + 1


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.found = k, np.ones(queries, dtype=np.int64), [[] for _ in range(queries)]

    def offer(self, q: int, scores: np.ndarray, ids: list) -> None:
        at = np.flatnonzero(scores >= self.least[q])
        if len(at):
            rows = self.found[q] + [(-int(scores[i]), ids[i] is None, ids[i]) for i in at]
            self.found[q] = heapq.nsmallest(self.k, rows, key=lambda r: r if not r[1] else r[:2])
            if len(self.found[q]) == self.k:
                self.least[q] = -self.found[q][-1][0]


def search(tree: Tree, queries: Queries, ids: list, best: Best) -> int:
    """Offers every document that can be among the best of any query; gives the number of (query, leaf) pairs opened."""
    bounds, opened = {0: tree.bounds(0, queries)}, 0
    weights = np.zeros(len(queries.weights), dtype=np.int64)
    for q in np.flatnonzero(bounds[0] >= best.least):
        terms = queries.query(q)
        weights[terms] = queries.weights[terms]
        ready = [(-bounds[0][q], 0)]
        while ready and -ready[0][0] >= best.least[q]:
            above, node = heapq.heappop(ready)
            _, _, _, rows, at = tree.nodes[node]
            if rows is not None:
                opened += 1
                best.offer(q, rows.products(weights), [ids[i] for i in at])
                continue
            for child in (2 * node + 1, 2 * node + 2):
                if child not in bounds:
                    bounds[child] = tree.bounds(child, queries)
                bound = min(bounds[child][q], -above)
                if bound >= best.least[q]:
                    heapq.heappush(ready, (-bound, child))
        weights[terms] = 0
    return opened


def found_by_task(counts: DataFrame, queries: Queries, totals: tuple[int, int], k: int) -> DataFrame:
    """(q, id, score): the k best documents of each query in each task."""
    kind = counts.schema["id"].dataType.simpleString()
    given = counts.sparkSession.sparkContext.broadcast(queries)
    docs, terms = totals

    def run(batches):
        queries = given.value
        best = Best(queries.n, k)

        def grow(parts):
            ids = [i for p in parts for i in p["id"].to_pylist()]
            sizes = np.concatenate([p["ids"].value_lengths().to_numpy(zero_copy_only=False) for p in parts])
            flat = lambda c: np.concatenate([p[c].flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
            long = np.array([10 + 90 * n * docs // terms for p in parts for n in p["n"].to_pylist()], dtype=np.int64)
            tf, starts = flat("tfs"), np.concatenate([[0], np.cumsum(sizes)])
            values = UNIT * tf // (1000 * tf + 8 * np.repeat(long, sizes))
            search(Tree(Rows(starts, flat("ids"), values), len(queries.weights)), queries, ids, best)

        parts, rows, values = [], 0, 0
        for batch in slices(batches):
            parts.append(batch)
            rows += batch.num_rows
            values += len(batch["ids"].flatten())
            if rows >= TREE_ROWS or values >= TREE_VALUES:
                grow(parts)
                parts, rows, values = [], 0, 0
        if rows:
            grow(parts)
        out = [(q, id_, -score) for q, rows in enumerate(best.found) for score, _, id_ in rows]
        for s in range(0, len(out), 65_536):
            yield pa.RecordBatch.from_pylist(
                [{"q": q, "id": i, "score": x} for q, i, x in out[s:s + 65_536]],
                pa.schema([("q", pa.int32()), ("id", counts_id), ("score", pa.int64())]))

    from pyspark.sql.pandas.types import to_arrow_type

    counts_id = to_arrow_type(counts.schema["id"].dataType)
    ship(counts.sparkSession)
    # documents without a term of any query cannot be found
    return counts.where(F.size("ids") > 0).mapInArrow(run, f"q int, id {kind}, score long")


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", query_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """(query id, rank, document id, score): the k best documents of every query with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pairs = staged(query_terms(queries, query_col, text_col), "search-queries")
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    kinds = pairs.schema["query"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"query {kinds[0]}, id {kinds[1]}, score long")
    for b in range(blocks):
        block = pairs.where(F.col("block") == b).select("query", "term").collect()
        names = list({r["query"] for r in block})
        if not names:
            continue
        number = {q: i for i, q in enumerate(names)}
        terms = {t: i for i, t in enumerate(sorted({r["term"].encode() for r in block}))}
        counts = staged(term_counts(rows, terms), "search-terms")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = counts.select(F.explode("ids").alias("t")).groupBy("t").count()
        weights = np.zeros(len(terms), dtype=np.int64)
        for t, n in df.collect():
            weights[t] = weight(n_docs, n)
        given = Queries([(number[r["query"]], terms[r["term"].encode()]) for r in block], weights, len(names))
        found = staged(found_by_task(counts, given, (n_docs, n_terms), k), "search-found")
        keys = spark.createDataFrame(list(enumerate(names)), f"q int, query {kinds[0]}")
        out = out.unionByName(found.join(F.broadcast(keys), "q").select("query", "id", "score"))
    first = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
        F.col("query").alias(query_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
