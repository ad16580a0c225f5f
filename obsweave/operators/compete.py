"""Questions across datasets: shared properties, values in one unit, sensors of a property.

Each question has two forms with the same answer. The `*_of_observations` form reads the long
observation table once; its `dataset` is the slug in the observation URIs. The other one takes any graph of triples and joins on shared subjects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.functions import naming
from obsweave.functions.fixed import QUDT, RDF_TYPE, RDFS_LABEL, SOSA
from obsweave.session import join_small

# What each question looks at in a graph (see `graph.observation_triples`).
NEEDED = {
    "shared_properties": [SOSA + "Observation", SOSA + "observedProperty"],
    "converted_range": [SOSA + "Observation", SOSA + "observedProperty", SOSA + "hasResult", QUDT + "numericValue", QUDT + "unit"],
    "sensors": [SOSA + "Observation", SOSA + "observedProperty", SOSA + "madeBySensor"],
}


def _shared(counts: DataFrame) -> DataFrame:
    """From counts per (property_uri, dataset): at most one row per dataset and property by now."""
    return counts.groupBy("property_uri").agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("n").alias("observations"),
        F.array_join(F.array_sort(F.collect_list("dataset")), ", ").alias("which"),
    ).where("datasets > 1").orderBy(F.desc("datasets"), F.desc("observations"), "property_uri")


def shared_properties_of_observations(obs: DataFrame) -> DataFrame:
    """Properties observed in more than one dataset."""
    return _shared(obs.groupBy("property_uri", "dataset").agg(F.count(F.lit(1)).alias("n")))


def converted_range_of_observations(obs: DataFrame, units: DataFrame, prop: str | None = None) -> DataFrame:
    """Count and range of value times unit multiplier, per property, dataset and unit."""
    obs = obs if prop is None else obs.where(F.col("property_uri") == prop)
    # factors never reorder values inside one unit, so count, min and max come first
    raw = obs.where(F.col("value_num").isNotNull() & F.col("unit_uri").isNotNull()).groupBy(
        "property_uri", "dataset", "unit_uri"
    ).agg(F.count(F.lit(1)).alias("n"), F.min("value_num").alias("_lo"), F.max("value_num").alias("_hi"))
    return _converted(raw, units)


def _converted(raw: DataFrame, units: DataFrame) -> DataFrame:
    low, high = F.col("_lo") * F.col("multiplier"), F.col("_hi") * F.col("multiplier")
    return raw.join(units, "unit_uri").select(
        "property_uri", "dataset", "unit_uri", "n", F.least(low, high).alias("min_value"), F.greatest(low, high).alias("max_value")
    ).orderBy("property_uri", "dataset", "unit_uri")


def sensors_of_observations(obs: DataFrame, labels: DataFrame, prop: str) -> DataFrame:
    """Sensors that observe a property, with their label when there is one."""
    counts = obs.where(F.col("property_uri") == prop).groupBy("dataset", "sensor_uri").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(labels, "sensor_uri", "left").select("dataset", "sensor_uri", "label", "n").orderBy("dataset", "sensor_uri")


def _object(triples: DataFrame, p: str, name: str, subject: str = "s") -> DataFrame:
    return triples.where(F.col("p") == p).select(F.col("s").alias(subject), F.col("o").alias(name))


def _subjects(triples: DataFrame, **links: str) -> DataFrame:
    """Observations with one object of each named predicate: one aggregation instead of a join per predicate."""
    observation = (F.col("p") == RDF_TYPE) & (F.col("o") == SOSA + "Observation")
    wanted = triples.where(observation | F.col("p").isin(list(links.values())))
    per = wanted.groupBy("s").agg(
        F.max(observation).alias("_obs"), *[F.max(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in links.items()]
    )
    return per.where("_obs").drop("_obs")


def shared_properties(triples: DataFrame) -> DataFrame:
    obs = _subjects(triples, property_uri=SOSA + "observedProperty").where("property_uri is not null")
    return _shared(obs.groupBy("property_uri", naming.dataset_of(F.col("s")).alias("dataset")).agg(F.count(F.lit(1)).alias("n")))


def converted_range(triples: DataFrame, prop: str | None = None) -> DataFrame:
    obs = _subjects(triples, property_uri=SOSA + "observedProperty", result=SOSA + "hasResult").where("property_uri is not null")
    obs = obs if prop is None else obs.where(F.col("property_uri") == prop)
    nodes = triples.where(F.col("p").isin(QUDT + "numericValue", QUDT + "unit")).groupBy(F.col("s").alias("result")).agg(
        F.max(F.when(F.col("p") == QUDT + "numericValue", F.col("o").try_cast("double"))).alias("value_num"),
        F.max(F.when(F.col("p") == QUDT + "unit", F.col("o"))).alias("unit_uri"),
    ).where("value_num is not null and unit_uri is not null")
    raw = obs.join(nodes, "result").groupBy("property_uri", naming.dataset_of(F.col("s")).alias("dataset"), "unit_uri").agg(
        F.count(F.lit(1)).alias("n"), F.min("value_num").alias("_lo"), F.max("value_num").alias("_hi")
    )
    units = _object(triples, QUDT + "conversionMultiplier", "multiplier", "unit_uri").withColumn("multiplier", F.col("multiplier").cast("double"))
    return _converted(raw, units)


def sensors(triples: DataFrame, prop: str) -> DataFrame:
    obs = _subjects(triples, property_uri=SOSA + "observedProperty", sensor_uri=SOSA + "madeBySensor")
    counts = obs.where((F.col("property_uri") == prop) & F.col("sensor_uri").isNotNull()).groupBy(
        naming.dataset_of(F.col("s")).alias("dataset"), "sensor_uri"
    ).agg(F.count(F.lit(1)).alias("n"))
    labels = _object(triples, RDFS_LABEL, "label", "sensor_uri")
    return counts.join(labels, "sensor_uri", "left").select("dataset", "sensor_uri", "label", "n").orderBy("dataset", "sensor_uri")


def units_in_use(triples: DataFrame, units: DataFrame) -> DataFrame:
    """Multipliers of the units the graph uses."""
    used = triples.where(F.col("p") == QUDT + "unit").select(F.col("o").alias("unit_uri")).distinct()
    return join_small(used, units.select("unit_uri", "multiplier"), "unit_uri", "inner")
