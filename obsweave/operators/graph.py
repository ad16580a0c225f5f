"""Triples (s, p, o, o_kind, o_datatype, o_lang) of observations, results, samples and declarations.

All of it is one projection and one generator per input row: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.functions.fixed import QUDT, RDF_TYPE, RDFS_LABEL, SOSA, XSD

TRIPLE = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]


def _triple(s: Column, p: str, o: Column, datatype: Column | None = None, lang: str | None = None, literal: bool = False) -> Column:
    no = F.lit(None).cast("string")
    return F.struct(
        s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("literal" if literal else "iri").alias("o_kind"),
        (no if datatype is None else datatype).alias("o_datatype"), (no if lang is None else F.lit(lang)).alias("o_lang"),
    )


def _spread(df: DataFrame, triples: list[Column], only: Collection[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """The triples of every row that have a subject and an object.

    With `only`, triples whose predicate (of types: class) is not in it are not built; `names` says what each one has.
    """
    if only is not None:
        triples = [t for t, name in zip(triples, names, strict=True) if name in only]
        if not triples:
            return df.limit(0).select(F.inline(F.array(_triple(F.lit(None).cast("string"), "", F.lit(None).cast("string")))))
    return df.select(F.inline(F.array(*triples))).where(F.col("s").isNotNull() & F.col("o").isNotNull())


def _time(s: Column) -> Column:
    return _triple(s, SOSA + "resultTime", F.col("result_time"), F.lit(XSD + "dateTime"), literal=True)


OBSERVATION_NAMES = [
    SOSA + "Observation", *(SOSA + p for p in ("resultTime", "madeBySensor", "observedProperty", "hasFeatureOfInterest", "hasResult", "hasSimpleResult")),
    QUDT + "QuantityValue", QUDT + "numericValue", QUDT + "unit",
]
SAMPLE_NAMES = [SOSA + p for p in ("Sample", "isSampleOf", "isResultOf", "Sampling", "resultTime", "hasResult", "madeBySampler", "hasFeatureOfInterest")]


def observation_triples(obs: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """Observations and their results; with `only`, of these predicates and (for types) classes.

    The feature of interest is the mapped one, or the row's sample in a sampled file. With a unit the
    value hangs on a result node, which exists even when the value is missing; without one it is a
    simple result. `sensor_uri` may come from the mapping or from the row.
    """
    # subjects are built once per observation, below the generator
    row = F.col("row")
    named = obs.select(
        "*", F.concat(F.lit(XSD), F.substring("value_dtype", 5, 50)).alias("_dtype"), F.concat("obs_prefix", row).alias("_s"), F.when(F.col("unit_uri").isNotNull(), F.concat("result_prefix", row)).alias("_result"),
        F.when(F.col("sampled"), F.concat("sample_prefix", row)).otherwise(F.col("foi_uri")).alias("_foi"),
    )
    s, result = F.col("_s"), F.col("_result")
    return _spread(named, [
        _triple(s, RDF_TYPE, F.lit(SOSA + "Observation")),
        _time(s),
        _triple(s, SOSA + "madeBySensor", F.col("sensor_uri")),
        _triple(s, SOSA + "observedProperty", F.col("property_uri")),
        _triple(s, SOSA + "hasFeatureOfInterest", F.col("_foi")),
        _triple(s, SOSA + "hasResult", result),
        _triple(s, SOSA + "hasSimpleResult", F.when(F.col("unit_uri").isNull(), F.col("value")), F.col("_dtype"), literal=True),
        _triple(result, RDF_TYPE, F.lit(QUDT + "QuantityValue")),
        _triple(result, QUDT + "numericValue", F.col("value"), F.col("_dtype"), literal=True),
        _triple(result, QUDT + "unit", F.col("unit_uri")),
    ], only, OBSERVATION_NAMES)


def sample_triples(rows: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """One sample and one sampling per row of a sampled file; `only` as for observations.

    Rows carry sample_prefix, sampling_prefix, row, result_time, sampler_uri and sample_feature_uri.
    """
    named = rows.select("*", F.concat("sample_prefix", "row").alias("_sample"), F.concat("sampling_prefix", "row").alias("_sampling"))
    sample, sampling = F.col("_sample"), F.col("_sampling")
    return _spread(named, [
        _triple(sample, RDF_TYPE, F.lit(SOSA + "Sample")),
        _triple(sample, SOSA + "isSampleOf", F.col("sample_feature_uri")),
        _triple(sample, SOSA + "isResultOf", sampling),
        _triple(sampling, RDF_TYPE, F.lit(SOSA + "Sampling")),
        _time(sampling),
        _triple(sampling, SOSA + "hasResult", sample),
        _triple(sampling, SOSA + "madeBySampler", F.col("sampler_uri")),
        _triple(sampling, SOSA + "hasFeatureOfInterest", F.col("sample_feature_uri")),
    ], only, SAMPLE_NAMES)


def declarations(entities: DataFrame) -> DataFrame:
    """Typed, labelled nodes from (kind, uri, label, class_uri); kind is one of the four SOSA classes."""
    s = F.col("uri")
    label = F.when(F.col("label") != "", F.col("label"))
    is_property = F.col("kind") == "ObservableProperty"
    return _spread(entities, [
        _triple(s, RDF_TYPE, F.concat(F.lit(SOSA), F.col("kind"))),
        _triple(s, RDF_TYPE, F.when(F.col("kind") == "FeatureOfInterest", F.col("class_uri"))),
        _triple(s, RDFS_LABEL, F.when(~is_property, label), literal=True),
        _triple(s, RDFS_LABEL, F.when(is_property, label), lang="en", literal=True),
    ])


def multipliers(units: DataFrame) -> DataFrame:
    """Conversion multipliers as triples, from (unit_uri, multiplier)."""
    return _spread(units, [_triple(
        F.col("unit_uri"), QUDT + "conversionMultiplier", F.col("multiplier").cast("string"), F.lit(XSD + "double"), literal=True
    )])


def add(*graphs: DataFrame) -> DataFrame:
    """Graphs put together when their subjects are known to differ."""
    return reduce(DataFrame.unionByName, graphs)


def merge(*graphs: DataFrame) -> DataFrame:
    """Graphs as one set of triples: what several datasets declare alike is kept once."""
    return add(*graphs).distinct()


def merge_scoped(data: list[DataFrame], shared: list[DataFrame]) -> DataFrame:
    """The same set as `merge`, without shuffling the data.

    Observation, result, sample and sampling URIs carry dataset, file, column and row, so no two rows
    give the same triple as long as no slugs collide (`reshape.slug_collisions`); only the
    declarations can repeat.
    """
    return add(*data, merge(*shared))
