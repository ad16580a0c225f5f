"""Ranked retrieval over vocabularies: BM25, exact cosine, reciprocal rank fusion.

corpus: (source, uri, tokens ARRAY<STRING>, embedding ARRAY<FLOAT> or null); every source is a corpus of
its own. queries: (query_id, tokens, embedding or null).

BM25 joins the tokens of the queries with postings and sums in the JVM; dense ranking joins blocks of documents with blocks
of queries, each pair of blocks one matrix product. Queries stay tables; none reaches the driver. Positions in a
list of any length come from ranges and counts. Scores are rounded to nine digits, equal scores are ordered by uri.
"""

from __future__ import annotations

import functools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.functions import fixed
from obsweave.functions.naming import corpus_place
from obsweave.operators.numbering import number_in_order
from obsweave.session import bounded_side, broadcast_within, fits_broadcast, join_small, ship, staged

BLOCK_QUERIES = 256
BLOCK_DOCUMENTS = 1024
TERM_BYTES = 64 << 20
# Pairs of a query and a document that one task sums scores for, about.
TASK_PAIRS = 1_000_000
# Lists whose length is known to stay within this are numbered by a window, others by ranges that no task holds whole.
WINDOW_ROWS = 1_000_000
DIGITS = 9
MODES = ("bm25", "dense")


def token_statistics(corpus: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(source, token, df, idf): tokens found in more than half of the documents get a share of the mean.

    `sizes` is what `corpus_statistics` gives, if it is there already.
    """
    df = corpus.select("source", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("source", "token").agg(F.count(F.lit(1)).alias("df"))
    sizes = staged(corpus_statistics(corpus), "sizes") if sizes is None else sizes
    n, d = F.col("n_docs"), F.col("df")
    raw = join_small(df, sizes.select("source", "n_docs"), "source", "inner").withColumn("_raw", F.log(n - d + 0.5) - F.log(d + 0.5))
    raw = staged(raw, "token-counts")  # read twice: for the mean and for the tokens
    means = raw.groupBy("source").agg(F.avg("_raw").alias("_mean"))
    floor = fixed.BM25_EPSILON * F.col("_mean")
    return join_small(raw, means, "source", "inner").select(
        "source", "token", "df", F.when(F.col("_raw") < 0, floor).otherwise(F.col("_raw")).alias("idf")
    )


def corpus_statistics(corpus: DataFrame) -> DataFrame:
    """(source, n_docs, avg_length)."""
    return corpus.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens")).alias("avg_length"))


def postings(corpus: DataFrame, words: DataFrame, sizes: DataFrame, parts: int) -> DataFrame:
    """(source, uri, token, impact) of the tokens in `words`: what one occurrence of a token in a query adds to a document.

    The tokens of a document stay together, so sums per document are formed before any shuffle. The number of `parts` is
    fixed: what follows holds a sum for each query of each document, which the size of the postings does not tell.
    """
    small = broadcast_within(words, "token")
    cut = corpus.select("source", "uri", F.size("tokens").alias("_dl"), F.explode("tokens").alias("token")).join(small, "token", "left_semi")
    tf = cut.repartition(parts, "source", "uri").groupBy("source", "uri", "_dl", "token").agg(F.count(F.lit(1)).alias("_tf"))
    idf = token_statistics(corpus, sizes).join(small, "token", "left_semi").select("source", "token", "idf")
    rows = tf.join(broadcast_within(idf, "token"), ["source", "token"])
    rows = join_small(rows, sizes.select("source", "avg_length"), "source", "inner")
    norm = fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("_dl") / F.col("avg_length"))
    return rows.select("source", "uri", "token", (F.col("idf") * F.col("_tf") * (fixed.BM25_K1 + 1) / (F.col("_tf") + norm)).alias("impact"))


def bm25_hits(corpus: DataFrame, queries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_id, source, uri, score) of all documents whose score is not 0, by a join of query tokens with postings.

    Query tokens are broadcast within a bound of bytes. Beyond it both sides meet by (token, salt): the postings of a token
    are spread over the salts, so a common token is no hot key.
    """
    terms = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    terms = staged(terms, "terms")
    documents = sizes.agg(F.sum("n_docs")).first()[0] or 0
    parts = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-documents * terms.select("query_id").distinct().count() // TASK_PAIRS))
    found = postings(corpus, terms.select("token").distinct(), sizes, parts)
    if fits_broadcast(terms, "token", TERM_BYTES):
        met = found.join(F.broadcast(terms), "token")
    else:
        salts = corpus.sparkSession.sparkContext.defaultParallelism
        salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = found.withColumn("_salt", F.pmod(F.xxhash64("uri"), F.lit(salts)).cast("int")).join(salted, ["token", "_salt"])
    scored = met.groupBy("query_id", "source", "uri").agg(F.round(F.sum(F.col("times") * F.col("impact")), DIGITS).alias("score"))
    return scored.where("score <> 0")


def _unit(vectors: list) -> np.ndarray:
    found = np.array(vectors, dtype=float)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _products(batches):
    """Cosines of a block of documents with a block of queries, one row per pair."""
    for batch in batches:
        for row in batch.itertuples():
            cosine = np.einsum("nd,qd->nq", _unit([d["embedding"] for d in row.documents]), _unit([q["embedding"] for q in row.asked]), optimize=False)
            n, m = cosine.shape
            yield pd.DataFrame({
                "query_id": np.tile(np.array([q["query_id"] for q in row.asked], dtype=object), n),
                "source": np.repeat(np.array([d["source"] for d in row.documents], dtype=object), m),
                "uri": np.repeat(np.array([d["uri"] for d in row.documents], dtype=object), m),
                "score": (np.round(cosine - 1, DIGITS) + 0.0).ravel(),  # no negative zero
            })


def _blocks(rows: DataFrame, name: str, size: int, columns: list[str]) -> tuple[DataFrame, int]:
    """Rows in lists of about `size`, dealt by hash, and the number of lists."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.select(F.pmod(F.xxhash64(columns[-2]), F.lit(n)).cast("int").alias("_part"), F.struct(*columns).alias("_row"))
    return dealt.groupBy("_part").agg(F.collect_list("_row").alias(name)), n


def dense_scores(corpus: DataFrame, queries: DataFrame, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, source, uri, score) of all documents and queries with a vector; score is the negative cosine distance.

    Blocks of documents and of queries are rows of two tables; each document block meets every query block once, by number.
    """
    ship(corpus.sparkSession)
    documents, _ = _blocks(corpus.where(F.col("embedding").isNotNull()), "documents", BLOCK_DOCUMENTS, ["source", "uri", "embedding"])
    asked, n = _blocks(queries.where(F.col("embedding").isNotNull()), "asked", block, ["query_id", "embedding"])
    met = documents.select("documents", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_part")).join(asked, "_part").select("documents", "asked")
    query, uri = queries.schema["query_id"].dataType.simpleString(), corpus.schema["uri"].dataType.simpleString()
    return met.mapInPandas(_products, f"query_id {query}, source string, uri {uri}, score double")


class Ranker:
    """Rankings of one corpus for one set of queries, as tables: scores, then positions by range and counts.

    Every document has a BM25 rank in its source, also those that score 0: they come after the positive ones, by uri.
    Documents and queries without a vector have no dense rank.
    """

    def __init__(self, corpus: DataFrame, queries: DataFrame, block: int = BLOCK_QUERIES):
        self.corpus = staged(corpus.select("source", "uri", "tokens", "embedding"), "corpus")
        self.asked = staged(queries.select("query_id", "tokens", "embedding"), "asked")
        self.block = block

    @functools.cached_property
    def sizes(self) -> DataFrame:
        return staged(corpus_statistics(self.corpus), "sizes")

    @functools.cached_property
    def longest(self) -> int:
        """Documents of the largest source: no list is longer."""
        return self.sizes.agg(F.max("n_docs")).first()[0] or 0

    def _numbered(self, rows: DataFrame, keys: list[str], order: list, name: str, longest: int | None = None) -> DataFrame:
        if (self.longest if longest is None else longest) > WINDOW_ROWS:
            return number_in_order(rows, keys, order, name)
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))

    @functools.cached_property
    def hits(self) -> DataFrame:
        return staged(bm25_hits(self.corpus, self.asked, self.sizes), "hits")

    @functools.cached_property
    def dense(self) -> DataFrame:
        return staged(dense_scores(self.corpus, self.asked, self.block), "dense")

    @functools.cached_property
    def hit_ranks(self) -> DataFrame:
        """Hits with their exact rank; those below 0 come after all documents that score 0."""
        numbered = self._numbered(self.hits, ["query_id", "source"], [F.desc("score"), "uri"], "_n")
        rows = join_small(numbered, self.counts, ["query_id", "source"], "inner")
        rank = F.when(F.col("score") > 0, F.col("_n")).otherwise(F.col("_n") + F.col("n_docs") - F.col("n_hits"))
        return staged(rows.select("query_id", "source", "uri", "score", rank.alias("rank")), "hit-ranks")

    @functools.cached_property
    def dense_ranks(self) -> DataFrame:
        return staged(self._numbered(self.dense, ["query_id", "source"], [F.desc("score"), "uri"], "rank"), "dense-ranks")

    @functools.cached_property
    def counts(self) -> DataFrame:
        """(query_id, source, n_docs, n_hits, n_positive) of every query and source."""
        found = self.hits.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(F.col("score") > 0).alias("n_positive"))
        sizes = self.sizes.collect()  # one row per vocabulary
        sources = F.array(*[F.struct(F.lit(r["source"]).alias("source"), F.lit(r["n_docs"]).alias("n_docs")) for r in sizes])
        every = self.asked.select("query_id", F.inline(sources))
        rows = every.join(found, ["query_id", "source"], "left")
        return staged(rows.select("query_id", "source", "n_docs", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_hits", "n_positive")]), "counts")

    @functools.cached_property
    def places(self) -> DataFrame:
        """(source, uri, place): documents of a source by uri."""
        return staged(self._numbered(self.corpus.select("source", "uri"), ["source"], ["uri"], "place"), "places")

    def _zeros(self, depths: DataFrame) -> DataFrame:
        """(query_id, source, uri, score, rank) of documents that score 0, down to the depth of each (query_id, source)."""
        lacking = self.counts.join(depths, ["query_id", "source"]).where(F.col("depth") > F.col("n_positive"))
        # among so many documents there are enough without a hit
        lacking = lacking.withColumn("reach", F.col("depth") - F.col("n_positive") + F.col("n_hits"))
        lacking = staged(lacking, "lacking")
        reach = lacking.agg(F.max("reach")).first()[0]
        if reach is None:
            return self.hits.limit(0).withColumn("rank", F.lit(0).cast("long"))
        if reach <= WINDOW_ROWS:
            by_uri = Window.partitionBy("source").orderBy("uri")
            first = self.corpus.select("source", "uri", F.row_number().over(by_uri).alias("place")).where(F.col("place") <= reach)
        else:
            first = self.places.where(F.col("place") <= reach)
        near = join_small(first, lacking, "source", "inner").where(F.col("place") <= F.col("reach"))
        keys = ["query_id", "source", "uri"]
        near = staged(near, "near-zeros")
        near = near.join(join_small(self.hits, near.select(*keys), keys, "left_semi"), keys, "left_anti")
        near = self._numbered(near, ["query_id", "source"], ["uri"], "_n", reach)
        rows = near.select("query_id", "source", "uri", F.lit(0.0).alias("score"), (F.col("n_positive") + F.col("_n")).alias("rank"), "depth")
        return rows.where(F.col("rank") <= F.col("depth")).drop("depth")

    def top(self, depth: int, modes: tuple[str, ...] = MODES) -> DataFrame:
        """(mode, source, query_id, uri, score, rank) of the best `depth` documents per query and source."""
        best = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "uri")
        parts = []
        for mode in modes:
            scored = self.hits.where("score > 0") if mode == "bm25" else self.dense
            ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= depth)
            if mode == "bm25":
                zeros = self._zeros(self.counts.select("query_id", "source", F.lit(depth).alias("depth")))
                ranked = ranked.withColumn("rank", F.col("rank").cast("long")).unionByName(zeros)
                below = self.hits.where("score < 0").limit(1)
                if not below.isEmpty():
                    ranked = ranked.unionByName(self.hit_ranks.where((F.col("score") < 0) & (F.col("rank") <= depth)))
            parts.append(ranked.select(F.lit(mode).alias("mode"), "source", "query_id", "uri", "score", F.col("rank").cast("int").alias("rank")))
        return reduce(DataFrame.unionByName, parts)

    def within(self, depths: DataFrame) -> DataFrame:
        """(source, query_id, uri) ranked down to the depth of each (query_id, source) in either list."""
        keys = ["query_id", "source"]
        parts = [self._zeros(depths).select(*keys, "uri")]
        for ranked in (self.hit_ranks, self.dense_ranks):
            parts.append(join_small(ranked, depths, keys, "inner").where(F.col("rank") <= F.col("depth")).select(*keys, "uri"))
        return reduce(DataFrame.unionByName, parts).distinct()

    def ranks(self, pairs: DataFrame) -> DataFrame:
        """Exact ranks of the listed (source, query_id, uri) among all documents: (mode, source, query_id, uri, score, rank).

        A list within the bound of `join_small` goes to the tasks that read the ranks, so that these are not shuffled for it.
        """
        keys = ["query_id", "source", "uri"]
        pairs = staged(pairs.select(*keys).distinct(), "pairs")
        few = bounded_side(pairs)
        listed = pairs if few is None else F.broadcast(few)
        hit = staged(self.hit_ranks.join(listed, keys, "left_semi").select(*keys, "score", "rank"), "listed-hits")
        rest = staged(pairs.join(hit, keys, "left_anti"), "listed-zeros")
        # hits before a document that scores 0, by uri: its place among hits and listed documents, less the listed ones
        wanted = join_small(self.hits, rest.select("query_id", "source").distinct(), ["query_id", "source"], "left_semi")
        both = wanted.select(*keys, F.lit(0).alias("_listed")).unionByName(rest.select(*keys, F.lit(1).alias("_listed")))
        mixed = self._numbered(both, ["query_id", "source"], ["uri"], "_all").where("_listed = 1").drop("_listed")
        mixed = self._numbered(mixed, ["query_id", "source"], ["uri"], "_own")
        zero = join_small(self.places, staged(mixed, "zeros-before"), ["source", "uri"], "inner").join(self.counts, ["query_id", "source"])
        zero = zero.select(*keys, F.lit(0.0).alias("score"), (F.col("n_positive") + F.col("place") - (F.col("_all") - F.col("_own"))).alias("rank"))
        dense = self.dense_ranks.join(listed, keys, "left_semi").select(*keys, "score", "rank")
        rank = F.col("rank").cast("long").alias("rank")
        columns = lambda rows, mode: rows.select(F.lit(mode).alias("mode"), "source", "query_id", "uri", "score", rank)
        return columns(hit.unionByName(zero), "bm25").unionByName(columns(dense, "dense"))

    def fused(self, k: int) -> DataFrame:
        """(query_id, source, uri, rank, rrf, bm25_rank, dense_rank, distance) of the best k by rank fusion.

        A document outside the best 60 + 2k of both lists scores below 1 / (60 + k), which the first k of
        either list reach, so it cannot be among the best k. The others get their exact ranks.
        """
        depth = fixed.RRF_OFFSET + 2 * k
        near = staged(self.top(depth).select("source", "query_id", "uri").distinct(), "candidates")
        return fuse(self.ranks(near), k)

    def fused_ranks(self, pairs: DataFrame) -> DataFrame:
        """(query_id, source, uri, rank) of the listed pairs in the fused list of their source, exact at any depth.

        What comes before a document with the fused score r has a share of at least r / 2 from one of the lists, so it lies
        within 2 / r - 60 of it; these documents are fused, and no others can matter.
        """
        own = staged(fuse(self.ranks(pairs), None, self.longest), "own-ranks")
        depths = own.groupBy("query_id", "source").agg((F.floor(2 / F.min("rrf")) - fixed.RRF_OFFSET + 1).cast("long").alias("depth"))
        near = self.within(staged(depths, "depths")).unionByName(own.select("query_id", "source", "uri")).distinct()
        ranked = fuse(self.ranks(staged(near, "near")), None, self.longest)
        keys = ["query_id", "source", "uri"]
        return ranked.join(pairs.select(*keys).distinct(), keys, "left_semi").select(*keys, "rank")


def fuse(ranks: DataFrame, k: int | None, longest: int = WINDOW_ROWS + 1) -> DataFrame:
    """Best k (None: all) per query and source by the sum of 1 / (60 + rank) over both lists; ties by dense rank, then uri."""
    of = lambda mode, column: F.max(F.when(F.col("mode") == mode, F.col(column)))
    both = ranks.groupBy("query_id", "source", "uri").agg(
        of("bm25", "rank").alias("bm25_rank"), of("dense", "rank").alias("dense_rank"), of("dense", "score").alias("_dense")
    )
    share = lambda column: F.coalesce(1 / (fixed.RRF_OFFSET + F.col(column)), F.lit(0.0))
    scored = both.withColumn("rrf", share("dense_rank") + share("bm25_rank"))
    order = [F.desc("rrf"), F.asc_nulls_last("dense_rank"), "uri"]
    if k is None and longest > WINDOW_ROWS:
        ranked = number_in_order(scored, ["query_id", "source"], order, "rank")
    else:
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(*order)))
        ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    return ranked.select(
        "query_id", "source", "uri", "rank", "rrf", "bm25_rank", "dense_rank", F.round(F.coalesce(0.0 - F.col("_dense"), F.lit(1.0)), 3).alias("distance")
    )


def menu(fused: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidate menu: the fused list with labels."""
    labels = corpus.select("source", "uri", "label")
    return join_small(labels, fused.select("query_id", "source", "rank", "uri", "distance"), ["source", "uri"], "inner")


def gold_ranks(ranker: Ranker, gold: DataFrame) -> DataFrame:
    """Rank of each query's gold document in its own corpus by every mode, exact at any depth.

    `gold` is (query_id, source, uri), one row per query, written once before.
    """
    single = ranker.ranks(gold).select("query_id", "source", "uri", "mode", "rank")
    hybrid = ranker.fused_ranks(gold).select("query_id", "source", "uri", F.lit("hybrid").alias("mode"), F.col("rank").cast("long").alias("rank"))
    return single.unionByName(hybrid)


def recall_at(ranks: DataFrame, gold: DataFrame, by: list[str], depths: list[int] = fixed.RECALL_DEPTHS, modes: list[str] | None = None) -> DataFrame:
    """Share of gold rows ranked within k, for each k; a gold row without a rank is a miss."""
    n = gold.count()
    hits = ranks.select(*by, "rank", F.explode(F.array(*[F.lit(k) for k in depths])).alias("k")).groupBy(*by, "k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("hits"))
    if modes is not None:  # a mode without any rank has no hits, and still a row
        spark = ranks.sparkSession
        every = spark.createDataFrame([(m, k) for m in modes for k in depths], "mode string, k int")
        hits = every.join(hits, ["mode", "k"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return hits.withColumn("n", F.lit(n).cast("long")).withColumn("recall", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0))


def top1_baseline(menus: DataFrame, gold: DataFrame) -> DataFrame:
    """How often the nearest candidate of all corpora, and the first of the gold's own corpus, is the gold.

    Queries without a menu do not count.
    """
    place = F.struct("distance", corpus_place(F.col("source")).alias("corpus"), "rank")
    nearest = menus.groupBy("query_id").agg(F.min_by(F.struct("source", "uri"), place).alias("any"))
    own = menus.where(F.col("rank") == 1).select("query_id", "source", F.col("uri").alias("own"))
    joined = gold.join(nearest, "query_id").join(own, ["query_id", "source"], "left")
    any_hit = (F.col("any.uri") == F.col("uri")) & (F.col("any.source") == F.col("source"))
    rate = lambda hit: F.coalesce(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), F.lit(0.0))
    return joined.agg(F.count(F.lit(1)).alias("n"), rate(any_hit).alias("top1_any"), rate(F.col("own") == F.col("uri")).alias("top1_gold_corpus"))


def _class_task(uris, vectors):
    def run(batches):
        for batch in batches:
            found = np.array(batch["embedding"].tolist(), dtype=float)
            found /= np.linalg.norm(found, axis=1, keepdims=True)
            cosine = np.round(np.einsum("nd,qd->nq", found, vectors, optimize=False), DIGITS)
            best = cosine.argmax(axis=1)  # the first of equals; classes are in uri order
            yield pd.DataFrame({"phrase_id": batch["phrase_id"], "class_uri": uris[best], "score": cosine[np.arange(len(best)), best]})
    return run


def nearest_class(phrases: DataFrame, classes: DataFrame, threshold: float = fixed.CLASS_THRESHOLD, block: int = 10_000) -> DataFrame:
    """(phrase_id, class_uri, score): class with the highest cosine, null below the threshold.

    `phrases` is (phrase_id, phrase, embedding): blank ones stay untyped. `classes` is (uri, embedding), a
    vocabulary; it goes to the tasks in blocks.
    """
    ship(phrases.sparkSession)
    kind, uri = phrases.schema["phrase_id"].dataType.simpleString(), classes.schema["uri"].dataType.simpleString()
    named = phrases.where((F.trim("phrase") != "") & F.col("embedding").isNotNull()).select("phrase_id", "embedding")
    parts = -(-classes.count() // block)
    numbered = classes.select("uri", "embedding", F.pmod(F.xxhash64("uri"), F.lit(max(1, parts))).alias("_part"))
    found = []
    for part in range(max(1, parts)):
        rows = numbered.where(F.col("_part") == part).orderBy("uri").collect()  # about one block
        if not rows:
            continue
        vectors = np.array([r["embedding"] for r in rows], dtype=float)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        task = _class_task(np.array([r["uri"] for r in rows]), vectors)
        found.append(named.mapInPandas(task, f"phrase_id {kind}, class_uri {uri}, score double"))
    if not found:
        return phrases.select("phrase_id", F.lit(None).cast(uri).alias("class_uri"), F.lit(None).cast("double").alias("score"))
    best = reduce(DataFrame.unionByName, found)
    if len(found) > 1:
        best = best.groupBy("phrase_id").agg(F.min_by(F.struct("class_uri", "score"), F.struct(-F.col("score"), F.col("class_uri"))).alias("b")).select("phrase_id", "b.*")
    typed = phrases.select("phrase_id").join(best, "phrase_id", "left")
    return typed.select("phrase_id", F.when(F.col("score") >= threshold, F.col("class_uri")).alias("class_uri"), F.round("score", 3).alias("score"))


def query_variants(columns: DataFrame) -> DataFrame:
    """The query texts a retrieval study compares, one row per variant.

    `columns` is (query_id, column, stem, phrase, context, unit, description); missing texts are null.
    """
    from obsweave.functions.text import query_text

    none = F.lit(None).cast("string")
    col = F.col
    raw = lambda context: query_text(col("column"), col("stem"), none, context)
    named = lambda context: query_text(col("column"), none, col("phrase"), context)
    more = lambda text, *parts: F.trim(F.concat_ws(" ", text, *[F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in parts]))
    variants: list[tuple[str, Column]] = [
        ("raw", raw(none)), ("raw+meta", raw(col("context"))), ("phrase", named(none)), ("phrase+meta", named(col("context"))),
        ("raw+meta+unit", more(raw(col("context")), col("unit"))),
        ("raw+meta+unit+device", more(raw(col("context")), col("unit"), col("description"))),
        ("phrase+meta+unit", more(named(col("context")), col("unit"))),
    ]
    return columns.select("query_id", F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), t.alias("text")) for n, t in variants])))
