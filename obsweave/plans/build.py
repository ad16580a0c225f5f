"""From folders of tables to one graph: profile, decide, assemble, materialize.

Decisions made by people or models come in as tables (see `Decisions`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.functions import naming, text
from obsweave.operators import decide, evidence, graph, profile, reshape, retrieve
from obsweave.operators.numbering import number_in_order
from obsweave.session import join_small, staged
from obsweave.sources import folder

DECISION = "column_key string, sensor_id string, property_uri string, property_label string, unit string, feature_id string, column_class string"
ENTITY = "id string, label string"
FEATURE = "id string, label string, kind string, class_uri string"
SAMPLED = "file string, sampler_id string, feature_id string"
MENU = "column_key string, source string, rank int, uri string, label string"


@dataclass
class Profile:
    """Profiled dataset: raw rows, one row per column, one row per file, and the rows where a quote is never closed."""

    dataset_id: str
    rows: DataFrame
    columns: DataFrame
    files: DataFrame
    unclosed: DataFrame | None = None


@dataclass
class Decisions:
    decisions: DataFrame
    sensors: DataFrame
    features: DataFrame
    samplers: DataFrame
    sampled_files: DataFrame
    menus: DataFrame
    units: DataFrame


@dataclass
class Resolved:
    """Decided dataset: one row per column, its mapping, its declarations."""

    columns: DataFrame
    mapping: DataFrame
    entities: DataFrame


def profile_folder(spark: SparkSession, root: str, dataset_id: str) -> Profile:
    """Find the tables below a folder and profile them. The profile is written once; it is small."""
    tables = folder.discover(spark, root).where("kind = 'table'")
    found = staged(folder.dialects(folder.heads(tables)), "dialects")
    lines, blocks = folder.table_lines(spark, root, found)
    rows = folder.rows_of(lines, blocks, found)
    columns, files = profile.profile(rows)
    files = staged(files.join(found.select("file", "sep", "encoding", "header_rows"), "file"), "files")
    keyed = columns.withColumn("column_key", naming.column_key(F.col("file"), F.col("column")))
    keyed = number_in_order(keyed, [], ["file", "pos"], "ord")
    return Profile(dataset_id, rows, keyed, files, folder.unclosed_quotes(blocks, found))


def columns_named_like(columns: DataFrame, text: str) -> DataFrame:
    """Columns whose name holds a text, whatever its case."""
    return columns.where(F.contains(F.lower("column"), F.lit(text.lower())))


def evidence_chunks(spark: SparkSession, root: str, found: Profile, documentation: bool = True) -> DataFrame:
    """(source, text) of the files' structure and, with documentation, the companion texts."""
    chunks = evidence.structure_chunks(found.columns)
    if not documentation:
        return evidence.structure_only(chunks)
    # the first piece of a text is longer than a chunk may be, or all of it
    return chunks.unionByName(evidence.companion_chunks(folder.companions(spark, root).where("piece = 0")))


def retrieval_queries(found: Profile, phrases: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, text) of every observable column: its phrase, or its name and file stem, and its context.

    `phrases` is (column_key, phrase), `contexts` (dataset_id, column, context); contexts of other datasets do not count.
    """
    columns = found.columns.where(profile.observable(F.col("role")))
    columns = columns.join(decide.clean_phrases(phrases, columns), "column_key", "left")
    own = contexts.where(F.col("dataset_id") == found.dataset_id) if "dataset_id" in contexts.columns else contexts
    columns = join_small(columns, own.groupBy("column").agg(F.min("context").alias("context")), "column", "left")
    stem = F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), r"\.[^.]+$", "")
    return columns.select(F.col("column_key").alias("query_id"), text.query_text(F.col("column"), stem, F.col("phrase"), F.col("context")).alias("text"))


def metadata_contexts(spark: SparkSession, root: str, found: Profile) -> DataFrame:
    """(dataset_id, column, context): lines of the dataset's companion texts, in the order of their names, that name an observable column."""
    texts = number_in_order(staged(folder.companions(spark, root).select("file", "piece", "text"), "companions"), [], ["file", "piece"], "ord")
    documents = texts.select(F.lit(found.dataset_id).alias("dataset_id"), (F.col("ord") - 1).alias("ord"), "text")
    columns = found.columns.where(profile.observable(F.col("role"))).select(F.lit(found.dataset_id).alias("dataset_id"), "column").distinct()
    return evidence.metadata_context(documents, columns)


def folder_menus(
    spark: SparkSession, root: str, found: Profile, phrases: DataFrame, corpus: DataFrame, k: int, vectors: DataFrame | None = None, contexts: bool = True,
) -> DataFrame:
    """Candidate menus of all observable columns, from the folder's own texts in one build.

    `corpus` is (source, uri, label, tokens, embedding); `vectors` (query_id, embedding) holds what a model made of
    `retrieval_queries`; without it the lists are ranked by words alone.
    """
    none = spark.createDataFrame([], "dataset_id string, column string, context string")
    queries = retrieval_queries(found, phrases, metadata_contexts(spark, root, found) if contexts else none)
    queries = queries.select("query_id", text.tokens(F.col("text")).alias("tokens"))
    if vectors is None:
        queries = queries.withColumn("embedding", F.lit(None).cast("array<float>"))
    else:
        queries = queries.join(vectors.select("query_id", "embedding"), "query_id", "left")
    return menus(retrieve.Ranker(corpus, queries), corpus, k)


def menus(ranker: retrieve.Ranker, corpus: DataFrame, k: int) -> DataFrame:
    """Candidate menus of all queries, keyed by column."""
    return retrieve.menu(ranker.fused(k), corpus).select(F.col("query_id").alias("column_key"), "source", "rank", "uri", "label", "distance")


def decide_columns(found: Profile, given: Decisions) -> Resolved:
    """Guarded decisions, the mapping table and what must be declared."""
    ds = found.dataset_id
    columns = found.columns.select("column_key", "file", "column", "ord", "role", "dtype")
    features = decide.with_defaults(given.features)
    df = decide.resolve(columns, given.decisions, given.menus, given.units, features, given.samplers, given.sampled_files)
    no = F.lit(None).cast("string")

    def declared(kind, entities, class_uri=no):
        uri = naming.scoped_uri({"FeatureOfInterest": "feature"}.get(kind, kind.lower()), F.lit(ds), F.col("id"))
        return entities.select(F.lit(kind).alias("kind"), uri.alias("uri"), "label", class_uri.alias("class_uri"))

    registry = decide.property_registry(df)
    entities = graph.add(
        declared("Sensor", decide.prune(decide.with_defaults(given.sensors), df, "sensor_id")),
        registry.select(F.lit("ObservableProperty").alias("kind"), F.col("property_uri").alias("uri"), "label", no.alias("class_uri")),
        declared("FeatureOfInterest", decide.prune(features, df, "feature_id"), F.col("class_uri")),
        declared("Sampler", decide.used_samplers(decide.with_defaults(given.samplers), df)),
    )
    mapping = staged(decide.mapping(df, ds), "mapping")
    same = mapping.groupBy("file_id", "value_col").count().where("count > 1").limit(1).collect()
    if same:
        raise ValueError(f"two files of {ds} have the id {same[0]['file_id']}")
    return Resolved(df, mapping, entities)


def normalized(found: Profile, max_rows: int | None = None) -> DataFrame:
    long = profile.normalize(found.rows, found.columns, found.files, max_rows)
    return long.withColumnRenamed("column", "value_col").withColumn("row", F.col("row").cast("string"))


def observations(found: Profile, resolved: Resolved, max_rows: int | None = None) -> DataFrame:
    return reshape.observations(normalized(found, max_rows), resolved.mapping)


def dataset_graph(found: Profile, resolved: Resolved, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(data triples, declaration triples) of one dataset, each a set."""
    long = normalized(found, max_rows)
    obs = reshape.observations(long, resolved.mapping)
    sampled = reshape.with_prefixes(resolved.mapping.where("sampled")).select("file_id", "sample_prefix", "sampling_prefix", "sampler_uri", "sample_feature_uri").distinct()
    samples = join_small(long.where("pos = 0").select("file_id", "row", "result_time"), sampled, "file_id", "inner")
    data = graph.add(graph.observation_triples(obs), graph.sample_triples(samples))
    same = reshape.slug_collisions(resolved.mapping)
    if not same.isEmpty():  # columns that share URIs can repeat a triple; only their files are deduplicated
        files = same.select("file_id").distinct()
        file_id = F.regexp_extract("s", "/(?:obs|result|sample|sampling)/[^/]+/([^/]+)/", 1)
        marked = data.withColumn("file_id", file_id)
        data = join_small(marked, files, "file_id", "left_anti").select(*data.columns).unionByName(
            join_small(marked, files, "file_id", "left_semi").select(*data.columns).distinct())
    return data, graph.declarations(resolved.entities)


def merged_graph(datasets: list[tuple[Profile, Resolved]], max_rows: int | None = None) -> DataFrame:
    """One graph of several datasets as a set of triples.

    Data is scoped by dataset and taken as it is; only declarations can repeat. Dataset ids with equal slugs
    would share data URIs too, then everything is deduplicated.
    """
    parts = [dataset_graph(found, resolved, max_rows) for found, resolved in datasets]
    slugs = {re.sub("[^a-z0-9]+", "-", found.dataset_id.lower()).strip("-") for found, _ in datasets}
    if len(slugs) < len(datasets):
        return graph.merge(*[t for part in parts for t in part])
    return graph.merge_scoped([data for data, _ in parts], [declared for _, declared in parts])
