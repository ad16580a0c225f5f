"""Documents through the stages of a training-data pipeline.

Every stage but the last returns the columns of its input. Rows pass as they are where a stage has nothing to say:
null ids link with nothing, null and empty texts are rejected by the first stage, rows that repeat a document share its
fate, and further columns pass unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm import language_id, line_dedup, ngram_join, packing, pii
from obsweave.llm.queries import PII_KEY, WORD_BPE
from obsweave.session import shared_dir

# Ids of removed documents are broadcast up to this number; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, with n_chars of the present text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts whose language stays open (under even odds); lang becomes what the evidence says.

    Where no row declares a language there is no model, and texts with a letter pass.
    """
    host = F.col("source") if "source" in docs.columns else None
    found = language_id.identify(docs, declared_col="lang", host=host)
    kept = found.where(F.col("text").rlike(r"\p{L}") & (F.coalesce("probability", F.lit(1.0)) >= 0.5))
    return kept.withColumn("lang", F.coalesce("language", "lang")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that repeat an earlier one, from 20 characters on within one edit and from 40 within two; documents that lose all their words go."""
    done = line_dedup.without_repeated_lines(docs)
    return _sized(done.where((F.col("removed_lines") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]")), docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link with a similarity of 0.8 or more, that with the smallest id stays."""
    groups = ngram_join.ngram_join(docs, size=5, percent=80)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    gone = ngram_join.staged(gone, "pipeline-gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in all texts."""
    return _sized(pii.pseudonymize(docs, PII_KEY, found_col="__found"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("PII", pseudonymize),
    ("packing", pack),
]

# Learned models, edit distances and packing have no SQL form; tests hold every stage against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet in the shared folder and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '_')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
