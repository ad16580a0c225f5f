"""Vocabularies as retrieval documents, from triples or records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.functions import fixed
from obsweave.session import join_small

DESCRIPTIONS = [fixed.QUDT + "plainTextDescription", fixed.DCTERMS_DESCRIPTION, fixed.RDFS_COMMENT]

# Parts that the units of one spelling are dealt into.
_SALTS = 16


def quantity_kind_docs(triples: DataFrame, namespace: str = fixed.QUANTITY_KIND) -> DataFrame:
    """(uri, label, doc) with doc = 'label. description'.

    The label is an English or untagged one, else any; the description comes from the first of three
    predicates that is present. Equal choices are made by text order.
    """
    mine = triples.where(F.startswith("s", F.lit(namespace)) & F.col("p").isin([fixed.RDFS_LABEL, *DESCRIPTIONS]))
    foreign = F.when(F.col("o_lang").isNull() | (F.col("o_lang") == "en"), 0).otherwise(1)
    place = F.lit(None).cast("int")
    for i, p in enumerate(DESCRIPTIONS):
        place = F.when(F.col("p") == p, i).otherwise(place)
    label = F.when(F.col("p") == fixed.RDFS_LABEL, F.struct(foreign.alias("rank"), F.col("o").alias("text")))
    about = F.when(place.isNotNull(), F.struct(place.alias("rank"), F.col("o").alias("text")))
    found = mine.groupBy(F.col("s").alias("uri")).agg(F.min(label)["text"].alias("label"), F.coalesce(F.min(about)["text"], F.lit("")).alias("_about"))
    return found.where(F.col("label") != "").select("uri", "label", F.trim(F.concat("label", F.lit(". "), "_about")).alias("doc"))


def concept_docs(triples: DataFrame) -> DataFrame:
    """(uri, label, doc) with doc = 'label. definition. parent labels', empty parts left out."""
    text = triples.where(F.col("p").isin(fixed.SKOS_PREF_LABEL, fixed.SKOS_DEFINITION)).groupBy(F.col("s").alias("uri")).agg(
        F.min(F.when(F.col("p") == fixed.SKOS_PREF_LABEL, F.col("o"))).alias("label"),
        F.min(F.when(F.col("p") == fixed.SKOS_DEFINITION, F.col("o"))).alias("_definition"),
    ).where(F.col("label") != "")
    parents = parent_labels(triples, text.select("uri", "label"))
    part = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return text.join(parents, "uri", "left").select(
        "uri", "label", F.concat_ws(". ", "label", part(F.col("_definition")), part(F.col("parents"))).alias("doc")
    )


def parent_labels(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """(uri, parents): labels of the broader concepts, in text order."""
    broader = triples.where(F.col("p") == fixed.SKOS_BROADER).select(F.col("s").alias("uri"), F.col("o").alias("parent")).distinct()
    named = labels.select(F.col("uri").alias("parent"), F.col("label").alias("parent_label"))
    joined = join_small(broader, named, "parent", "inner")
    return joined.groupBy("uri").agg(F.array_join(F.array_sort(F.collect_list("parent_label")), " ").alias("parents"))  # parents of one concept


def feature_class_doc() -> Column:
    """'English label. English definition (Dutch label)' of a feature class."""
    english = F.coalesce(F.nullif("label_en", F.lit("")), F.col("label_nl"))
    return F.trim(F.concat(english, F.lit(". "), F.coalesce("def_en", F.lit("")), F.lit(" ("), F.col("label_nl"), F.lit(")")))


def units_index(units: DataFrame) -> DataFrame:
    """(key, unit_uri): spelling index of units from (uri, ucum_codes, symbols).

    A key belongs to the first unit in uri order that has it; inside a unit codes come before symbols and
    the raw spelling before the folded one.
    """
    from obsweave.functions.text import fold_unit

    none = F.array().cast("array<string>")
    codes = F.concat(F.coalesce("ucum_codes", none), F.coalesce("symbols", none))
    keys = units.select("uri", F.explode(codes).alias("raw")).select("uri", F.explode(F.array(F.col("raw"), fold_unit(F.col("raw")))).alias("key"))
    # minima of texts sort their rows: these are dealt out first, frequent keys too, so that no task sorts a whole scan split
    dealt = keys.withColumn("_salt", F.pmod(F.xxhash64("uri"), F.lit(_SALTS))).repartition("key", "_salt")
    firsts = dealt.groupBy("key", "_salt").agg(F.min("uri").alias("uri"))
    return firsts.groupBy("key").agg(F.min("uri").alias("unit_uri"))
