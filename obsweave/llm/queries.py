"""Registered queries of the operators: whole tables in, digest columns out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm import (
    ball_tree, bpe, language_id, line_dedup, maxent, near_vectors, ngram_join, packing, pii, pooled_quality, quality_rules, vector_codes,
    warc,
)
from obsweave.llm.common import table
from obsweave.session import shared_dir, staged

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PII_KEY = "key of this run"  # a production run takes it from its secret store
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op7_maxent(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all documents under the unigram base and the model."""
    return maxent.scores(table(spark, folder, "documents"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page by its text, its declaration, its address and its host."""
    pages, url, html = table(spark, folder, "pages"), F.col("url"), F.col("html")
    pages = staged(pages.select("page_id", "url", language_id.declared_in(html).alias("lang"), language_id.visible(html).alias("text")), "pages-text")
    found = language_id.identify(pages, suffix=language_id.suffix_of(url), host=language_id.host_of(url), keep=["page_id", "lang"])
    return found.select("page_id", "language", "probability", "text_language", F.col("lang").alias("declared"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with pseudonyms in place of personal data."""
    done = pii.pseudonymize(table(spark, folder, "documents"), PII_KEY)
    return done.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_distinct("found.kind").alias("kinds"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and their text again, as digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, BYTE_BPE).drop("text"), BYTE_BPE)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Text statistics of every document and what rules learned from all labels say of it."""
    return quality_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents by three-word shingles, similarity 0.9."""
    return ngram_join.ngram_join(table(spark, folder, "documents"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without lines that repeat earlier ones within two edits."""
    done = line_dedup.without_repeated_lines(table(spark, folder, "documents"))
    return done.select("doc_id", "text", "removed_lines")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 4096 tokens."""
    pieces = packing.pack(table(spark, folder, "documents"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages through archives in the shared folder: digests of what comes back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive_pages(table(spark, folder, "pages"), path)
    whole = warc.read_archives(spark, path).where("record_type = 'response'").withColumn("digest", F.sha2("payload", 256))
    again = warc.read_archives(spark, path, payload=False).where("record_type = 'revisit'").withColumn("digest", F.col("payload_digest"))
    return whole.unionByName(again).select(
        _page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", _page("refers_to").alias("refers_to"),
    )


def op10_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of equal label."""
    return near_vectors.near_vectors(table(spark, folder, "embeddings"))


def op11_ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item among all documents."""
    return ball_tree.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors: eight parts, sixteen entries each, six rounds."""
    coded, books = vector_codes.vector_codes(table(spark, folder, "embeddings"))
    return vector_codes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), F.concat_ws("", F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))).alias("code"), "error",
        "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


def op13_pooled_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents by a network over pooled word vectors."""
    return pooled_quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _page(urn: str):
    return F.expr("try_cast(x AS BIGINT)".replace("x", f"nullif(regexp_extract({urn}, '^<urn:page:(.*)>$', 1), '')"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_join": op2_ngram_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op6_warc": op6_warc,
    "op5_pii": op5_pii,
    "op8_language_id": op8_language_id,
    "op7_maxent": op7_maxent,
    "op9_bpe": op9_bpe,
    "op10_near_vectors": op10_near_vectors,
    "op11_ball_tree": op11_ball_tree,
    "op12_vector_codes": op12_vector_codes,
    "op13_pooled_quality": op13_pooled_quality,
}


def _codes_sql(rounds: int = 6) -> str:
    """Exact Lloyd rounds as a chain of tables: assignment of every part, then replaced entries."""
    nearest = """
        SELECT vec_id, p, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS away FROM (
            SELECT vec_id, p, e, sum((parts.x - b.x) * (parts.x - b.x))::BIGINT AS d FROM parts JOIN book{r} b USING (p, i) GROUP BY ALL
        ) GROUP BY vec_id, p"""
    replaced = """
        SELECT b.p, b.e, b.i, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x FROM book{r} b LEFT JOIN (
            SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM parts JOIN near{r} USING (vec_id, p) GROUP BY p, e, i
        ) m USING (p, e, i)"""
    steps = "".join(
        f", near{r} AS MATERIALIZED ({nearest.format(r=r)}), book{r + 1} AS MATERIALIZED ({replaced.format(r=r)})" for r in range(rounds))
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT vec_id, i // (len(v) // 8) AS p, i % (len(v) // 8) AS i, x
            FROM (SELECT vec_id, v, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM kept)
        ), book0 AS MATERIALIZED (
            SELECT p, e, i, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16)
            USING (vec_id)
        ){steps}, last AS MATERIALIZED ({nearest.format(r=rounds)}), coded AS (
            SELECT vec_id, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(away)::BIGINT AS error FROM last GROUP BY vec_id
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""



ORACLES: dict[str, str] = {
    "op11_ball_tree": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
        m AS (SELECT doc_id, 10 + (90 * len(terms) * s.n) // s.l AS m FROM d, s),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
        w AS (
            SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, s.n
        ), found AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM found WHERE score > 0
        ) SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_vector_codes": _codes_sql(),
    "op6_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (SELECT d, min(page_id) AS low FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
            CASE WHEN n >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND page_id <> low THEN low END AS refers_to
        FROM p LEFT JOIN f USING (d)
    """,
}
