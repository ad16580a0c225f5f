"""Decisions on columns: guards, unification, units, features, samplers, and the mapping they lead to.

columns: (file, column, ord, role, dtype) with column_key; ord is the order of the profile.
decisions: (column_key, sensor_id, property_uri, property_label, unit, feature_id, column_class).
menus: (column_key, source, rank, uri, label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.functions import fixed, naming
from obsweave.functions.text import fold_unit, unit_alias
from obsweave.operators.numbering import number_by
from obsweave.operators.profile import observable
from obsweave.session import join_small, staged

MINT = "MINT"


def _listed():
    """Place of a candidate in its column's menu."""
    return F.struct(naming.corpus_place(F.col("source")).alias("corpus"), "rank")


def clean_phrases(phrases: DataFrame, columns: DataFrame) -> DataFrame:
    """Phrases of requested columns, trimmed; blank ones left out."""
    wanted = columns.select("column_key").distinct()
    kept = phrases.select("column_key", F.trim("phrase").alias("phrase")).where(F.col("phrase") != "")
    return kept.join(wanted, "column_key", "left_semi")


def decided(columns: DataFrame, decisions: DataFrame) -> DataFrame:
    """Columns with their decision; `resolved` tells whether there is one. Only observable columns are decided."""
    wanted = columns.where(observable(F.col("role"))).select("column_key").distinct()
    decisions = decisions.join(wanted, "column_key", "left_semi")
    return columns.join(decisions.withColumn("resolved", F.lit(True)), "column_key", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def demote(df: DataFrame) -> DataFrame:
    """Columns classed as no measurement lose their decision; unknown classes become null and stay."""
    cls = F.when(F.col("column_class").isin(fixed.COLUMN_CLASSES), F.col("column_class"))
    out = df.withColumn("column_class", cls).withColumn("demoted", F.coalesce(F.col("column_class") != "measurement", F.lit(False)))
    cleared = {c: F.when(~F.col("demoted"), F.col(c)) for c in ("sensor_id", "property_uri", "property_label", "unit", "feature_id")}
    return out.withColumns(cleared).withColumn("resolved", F.col("resolved") & ~F.col("demoted"))


def expand_curies(df: DataFrame, menus: DataFrame) -> DataFrame:
    """Short identifiers become the URIs of the column's own menu; others stay."""
    short = menus.groupBy("column_key", naming.curie(F.col("source"), F.col("uri")).alias("property_uri")).agg(F.max_by("uri", _listed()).alias("_full"))
    joined = df.join(short, ["column_key", "property_uri"], "left")
    return joined.withColumn("property_uri", F.coalesce("_full", "property_uri")).drop("_full")


def guard_membership(df: DataFrame, menus: DataFrame) -> DataFrame:
    """A chosen URI must be in the column's own menu, else a property is minted from label or name."""
    own = menus.groupBy("column_key", F.col("uri").alias("property_uri")).agg(
        F.max_by(F.struct("label", "source"), _listed()).alias("_hit")
    )
    choice = df.withColumn("property_uri", F.coalesce("property_uri", F.lit(MINT)))
    joined = choice.join(own, ["column_key", "property_uri"], "left")
    hit = F.col("_hit").isNotNull()
    # an empty label counts as none
    label = F.when(hit, F.col("_hit.label")).otherwise(F.coalesce(F.nullif("property_label", F.lit("")), "column"))
    uri = F.when(hit, F.col("property_uri")).otherwise(naming.property_uri(label))
    resolved = F.col("resolved")
    return joined.withColumns({
        "property_uri": F.when(resolved, uri), "property_label": F.when(resolved, label),
        "property_source": F.when(resolved, F.when(hit, F.col("_hit.source")).otherwise("minted")),
    }).drop("_hit")


def unify_labels(df: DataFrame) -> DataFrame:
    """A minted property with the label of a reused one takes that one; the first column with it wins."""
    key = F.lower(F.trim("property_label"))
    reused = df.where(F.col("property_source") != "minted").groupBy(key.alias("_key")).agg(
        F.min_by(F.struct("property_uri", "property_label", "property_source"), "ord").alias("_first")
    )
    joined = join_small(df.withColumn("_key", key), reused, "_key", "left")
    swap = (F.col("property_source") == "minted") & F.col("_first").isNotNull()
    swapped = {c: F.when(swap, F.col(f"_first.{c}")).otherwise(F.col(c)) for c in ("property_uri", "property_label", "property_source")}
    return joined.withColumns(swapped).drop("_key", "_first")


def property_registry(df: DataFrame) -> DataFrame:
    """One declaration per property; the first label in column order wins."""
    return df.where(F.col("property_uri").isNotNull()).groupBy("property_uri").agg(
        F.min_by("property_label", "ord").alias("label"), F.min_by("property_source", "ord").alias("source")
    )


def resolve_units(df: DataFrame, index: DataFrame) -> DataFrame:
    """Unit URI of a unit text: the raw spelling, the folded one, its alias, the folded alias; first known.

    One lookup per distinct text; the texts of a unit column are few against its rows.
    """
    texts = df.select("unit").where(F.col("unit") != "").distinct()
    raw, alias = F.trim("unit"), unit_alias(F.col("unit"))
    keys = texts.select("unit", F.posexplode(F.array(raw, fold_unit(raw), alias, fold_unit(alias))).alias("_place", "key")).where(F.col("key") != "")
    found = join_small(keys, index, "key", "inner").groupBy("unit").agg(F.min_by("unit_uri", "_place").alias("unit_uri"))
    return join_small(df, found, "unit", "left")


def bind_features(df: DataFrame, features: DataFrame) -> DataFrame:
    """A feature must be declared, else the column has none."""
    declared = features.where(F.col("id") != "").select(F.col("id").alias("feature_id"), F.lit(True).alias("_known")).distinct()
    return join_small(df, declared, "feature_id", "left").withColumn("feature_id", F.when(F.col("_known"), F.col("feature_id"))).drop("_known")


def attach_sampling(df: DataFrame, sampled_files: DataFrame, samplers: DataFrame, features: DataFrame) -> DataFrame:
    """Mark sampled files: adds sampled, sampler_id and, for kept columns, the file's feature.

    `sampled_files` is (file, sampler_id, feature_id). An undeclared sampler becomes null. An undeclared
    feature becomes the single feature of the file's kept columns, else null. Files without a kept column
    are not sampled.
    """
    kept = observable(F.col("role")) & F.col("property_uri").isNotNull()
    marks = sampled_files.groupBy(F.trim(F.split_part("file", F.lit("::"), F.lit(1))).alias("file")).agg(
        F.max_by(F.struct(F.col("sampler_id").alias("sampler"), F.col("feature_id").alias("feature")), F.struct("file", "sampler_id", "feature_id")).alias("_mark")
    )
    named = lambda table, name: table.where(F.col("id") != "").select(F.col("id").alias(name), F.lit(True).alias(f"{name}_known")).distinct()
    marks = join_small(marks.select("file", "_mark.*"), named(samplers, "sampler"), "sampler", "left")
    marks = join_small(marks, named(features, "feature"), "feature", "left")
    bound = df.where(kept).groupBy("file").agg(F.min("feature_id").alias("_low"), F.max("feature_id").alias("_high"))
    of_file = marks.join(bound, "file").select(
        "file", F.lit(True).alias("sampled"), F.when(F.col("sampler_known"), F.col("sampler")).alias("sampler_id"),
        F.when(F.col("feature_known"), F.col("feature")).when(F.col("_low") == F.col("_high"), F.col("_low")).alias("_feature"),
    )
    joined = join_small(df, of_file, "file", "left").withColumn("sampled", F.coalesce("sampled", F.lit(False)))
    return joined.withColumn("feature_id", F.when(F.col("sampled") & kept, F.col("_feature")).otherwise(F.col("feature_id"))).withColumnRenamed("_feature", "sample_feature_id")


def prune(declared: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Declared sensors or features that a kept column names; all of them when nothing was demoted."""
    used = df.where(F.col("property_uri").isNotNull() & F.col(column).isNotNull()).select(F.col(column).alias("id")).distinct()
    if df.where("demoted").limit(1).count() == 0:
        return declared
    return declared.join(used, "id", "left_semi")


def used_samplers(samplers: DataFrame, df: DataFrame) -> DataFrame:
    used = df.where("sampled").select(F.col("sampler_id").alias("id")).where(F.col("id").isNotNull()).distinct()
    return samplers.join(used, "id", "left_semi")


def with_defaults(entities: DataFrame) -> DataFrame:
    """Entities with an id; an empty kind phrase becomes the label, an empty label the id."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    named = entities.where(F.col("id") != "")
    if "kind" in entities.columns:
        named = named.withColumn("kind", F.trim(F.coalesce(full("kind"), full("label"), F.lit(""))))
    return named.withColumn("label", F.coalesce(full("label"), "id"))


def buildable(df: DataFrame) -> DataFrame:
    """Observable columns with a property and a sensor."""
    return df.where(observable(F.col("role")) & F.col("property_uri").isNotNull() & F.col("sensor_id").isNotNull())


def mapping(df: DataFrame, dataset_id: str) -> DataFrame:
    """Mapping table of the buildable columns. In a sampled file the feature hangs on the sample instead."""
    ds = F.lit(dataset_id)
    uri = lambda kind, column: naming.scoped_uri(kind, ds, F.col(column))
    return buildable(df).select(
        ds.alias("dataset_id"), naming.file_id(F.col("file")).alias("file_id"), F.col("column").alias("value_col"),
        F.when(F.col("dtype").isin(fixed.NUMERIC_DTYPES), "xsd:double").otherwise("xsd:string").alias("value_dtype"),
        uri("sensor", "sensor_id").alias("sensor_uri"), "property_uri", "unit_uri",
        F.when(~F.col("sampled"), uri("feature", "feature_id")).alias("foi_uri"), "sampled",
        F.when(F.col("sampled"), uri("sampler", "sampler_id")).alias("sampler_uri"),
        F.when(F.col("sampled"), uri("feature", "sample_feature_id")).alias("sample_feature_uri"),
    )


def resolve(columns: DataFrame, decisions: DataFrame, menus: DataFrame, index: DataFrame, features: DataFrame, samplers: DataFrame, sampled_files: DataFrame) -> DataFrame:
    """All guards in order: one row per column with its final decision, written once for the steps that follow."""
    df = demote(decided(columns, decisions))
    # the next steps each look up something found in these rows
    df = staged(guard_membership(expand_curies(df, menus), menus), "guarded")
    df = unify_labels(df)
    df = resolve_units(df, index)
    df = bind_features(df, features)
    return staged(attach_sampling(df, sampled_files, samplers, features), "resolved")


def shared_lists(menus: DataFrame, columns: DataFrame) -> DataFrame:
    """(column_key, list_name, curies): every distinct ranked list once, named L1.. as first seen.

    A list has at most k entries per vocabulary. Lists are numbered in buckets of the column order, so no
    task sees them all.
    """
    entry = F.struct(_listed().alias("at"), naming.curie(F.col("source"), F.col("uri")).alias("curie"))
    lists = menus.groupBy("column_key").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["curie"]).alias("curies"))
    keyed = staged(columns.select("column_key", "ord").join(lists, "column_key"), "lists")
    first = keyed.groupBy("curies").agg(F.min("ord").alias("_first"))
    named = number_by(first, "_first", "_no").select("curies", F.concat(F.lit("L"), F.col("_no").cast("string")).alias("list_name"))
    return keyed.join(named, "curies").select("column_key", "list_name", "curies")


def shared_concepts(menus: DataFrame, columns: DataFrame) -> DataFrame:
    """(curie, label): every candidate once, with the label of its first appearance."""
    seen = menus.join(columns.select("column_key", "ord"), "column_key")
    return seen.groupBy(naming.curie(F.col("source"), F.col("uri")).alias("curie")).agg(F.min_by("label", F.struct("ord", _listed().alias("at"))).alias("label"))


def split_columns(gold: DataFrame) -> DataFrame:
    """Gold rows whose column names several ('A / B / C') become one row per column."""
    return gold.withColumn("column", F.explode(F.split("column", " / "))).withColumn("column", F.trim("column"))
