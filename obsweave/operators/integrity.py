"""Checks on a graph of triples, and the counts that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.functions import naming
from obsweave.functions.fixed import QUDT, RDF_TYPE, SOSA, XSD
from obsweave.operators.scalars import side_by_side

LINKS = [SOSA + p for p in (
    "madeBySensor", "observedProperty", "hasFeatureOfInterest", "hasResult", "isSampleOf", "isResultOf", "madeBySampler"
)]
DECLARED = [
    ("Sensor", "madeBySensor"), ("ObservableProperty", "observedProperty"),
    ("FeatureOfInterest", "hasFeatureOfInterest"), ("Sampler", "madeBySampler"),
]
SHAPES = {
    "Observation": ["resultTime", "madeBySensor", "observedProperty", "hasFeatureOfInterest", "hasResult|hasSimpleResult"],
    "Sample": ["isSampleOf", "isResultOf"],
    "Sampling": ["madeBySampler", "hasFeatureOfInterest", "resultTime", "hasResult"],
}

# What each check looks at: predicates, and classes of types (see `graph.observation_triples`). Dangling links need every type.
NEEDED = {
    "cardinality": [SOSA + q for c, ps in SHAPES.items() for q in (c, *"|".join(ps).split("|"))],
    "dangling": [*LINKS, *(SOSA + c for c in SHAPES), QUDT + "QuantityValue"],
    "unused": [SOSA + x for pair in DECLARED for x in pair],
    "completeness": [QUDT + "QuantityValue", QUDT + "numericValue", QUDT + "unit", SOSA + "resultTime"],
    "sample_shape": [SOSA + x for x in ("Sample", "Sampling", "isSampleOf", "madeBySampler", "hasFeatureOfInterest")],
    "not_about_samples": [SOSA + x for x in ("Observation", "Sample", "hasFeatureOfInterest")],
}


def _is_a(name: str) -> Column:
    return (F.col("p") == RDF_TYPE) & (F.col("o") == name)


def census(triples: DataFrame) -> DataFrame:
    """Counts of triples by predicate, observations apart from other types."""
    # whole predicates are counted first; only the few counts are named
    counts = triples.groupBy("p", F.coalesce(_is_a(SOSA + "Observation"), F.lit(False)).alias("_obs")).agg(F.count(F.lit(1)).alias("_n"))
    kind = F.when(F.col("_obs"), "Observation").when(F.col("p") == RDF_TYPE, "other type").otherwise(naming.last_segment(F.col("p")))
    return counts.groupBy(kind.alias("kind")).agg(F.sum("_n").alias("n"))


def expected_counts(obs: DataFrame) -> DataFrame:
    """Rows, columns and values per file, from the long rows."""
    return obs.groupBy("file_id", "value_col").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value")).groupBy("file_id").agg(
        F.max("n").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"), F.sum("n").alias("n_observations"), F.sum("n_value").alias("n_values")
    )


def reconcile(expected: DataFrame, counted: DataFrame) -> DataFrame:
    """Expected against counted observations and result values."""
    n = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    have = counted.agg(
        F.sum("n").alias("triples"), n("Observation").alias("observations"), n("numericValue", "hasSimpleResult").alias("result_values")
    )
    want = expected.agg(F.sum("n_observations").alias("observations_expected"), F.sum("n_values").alias("values_expected"))
    return side_by_side(have, want).withColumns({
        "observations_match": F.col("observations") == F.col("observations_expected"),
        "values_match": F.col("result_values") == F.col("values_expected"),
    })


def cardinality(triples: DataFrame) -> DataFrame:
    """Subjects of a shape class without exactly one object of a required predicate.

    One aggregation by subject serves all shapes. A row's triples leave the same task, so its counts are
    summed before the shuffle.
    """
    needed = sorted({p for ps in SHAPES.values() for p in ps})
    count = lambda ps: F.count_if(F.col("p").isin([SOSA + p for p in ps.split("|")]))
    member = (F.col("p") == RDF_TYPE) & F.col("o").isin([SOSA + c for c in SHAPES])
    per = triples.where(member | F.col("p").isin([SOSA + q for p in needed for q in p.split("|")])).groupBy("s").agg(
        *[F.max(_is_a(SOSA + c)).alias(f"is_{c}") for c in SHAPES], *[count(p).alias(p) for p in needed],
    )
    checks = F.array(*[
        F.struct(F.lit(c).alias("class"), F.lit(p).alias("required"), F.col(f"is_{c}").alias("member"), F.col(f"`{p}`").alias("n"))
        for c, ps in SHAPES.items() for p in ps
    ])
    return (
        per.select(F.inline(checks)).where("member").groupBy("class", "required")
        .agg(F.count(F.lit(1)).alias("subjects"), F.count_if(F.col("n") != 1).alias("violations"))
    )


def _ends(triples: DataFrame, links: list[str] = LINKS, classes: list[str] | None = None) -> DataFrame:
    """Per identifier, of those with one of the classes or links (all by default), whether it is typed, with which declared classes, and which links name it.

    One pass and one aggregation of flags, instead of joining the graph with itself: a triple counts for its
    subject when it gives a type and for its object when it is a link. An identifier named by a third of all
    triples is already one row per task before the shuffle.
    """
    p, is_type = F.col("p"), F.col("p") == RDF_TYPE
    is_type = is_type if classes is None else is_type & F.col("o").isin(classes)
    no = F.lit(None).cast("string")
    link = p.isin(links) & (F.col("o_kind") == "iri")
    both = F.array(
        F.struct(F.when(is_type, F.col("s")).alias("id"), F.col("o").alias("class"), no.alias("link")),
        F.struct(F.when(link, F.col("o")).alias("id"), no.alias("class"), p.alias("link")),
    )
    rows = triples.where(is_type | link).select(F.inline(both)).where(F.col("id").isNotNull())
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    return rows.groupBy("id").agg(
        some(F.col("class").isNotNull()).alias("typed"), *[some(F.col("class") == SOSA + c).alias(f"is_{c}") for c, _ in DECLARED],
        *[some(F.col("link") == x).alias(f"by_{x.rsplit('/', 1)[-1]}") for x in links],
    )


def _positive(counts: DataFrame, name: str) -> DataFrame:
    """The columns of one row of counts as rows (name, n), zeros left out."""
    rows = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias("n")) for c in counts.columns])
    return counts.select(F.inline(rows)).where("n > 0")


def dangling(triples: DataFrame) -> DataFrame:
    """Linked identifiers that have no type, counted by predicate."""
    names = [x.rsplit("/", 1)[-1] for x in LINKS]
    return _positive(_ends(triples).where(~F.col("typed")).agg(*[F.count_if(f"by_{n}").alias(n) for n in names]), "predicate")


def unused(triples: DataFrame) -> DataFrame:
    """Declared entities no link names, counted by class."""
    ends = _ends(triples, [SOSA + x for _, x in DECLARED], [SOSA + c for c, _ in DECLARED])
    return _positive(ends.agg(*[F.count_if(F.col(f"is_{c}") & ~F.col(f"by_{x}")).alias(c) for c, x in DECLARED]), "class")


def completeness(triples: DataFrame) -> DataFrame:
    """Quantity values without number or unit, and times that are not xsd:dateTime."""
    mine = triples.where(_is_a(QUDT + "QuantityValue") | F.col("p").isin(QUDT + "numericValue", QUDT + "unit", SOSA + "resultTime"))
    # times need no subject: all of them are one group
    per = mine.groupBy(F.when(F.col("p") != SOSA + "resultTime", F.col("s")).alias("s")).agg(
        F.max(_is_a(QUDT + "QuantityValue")).alias("qv"),
        F.max(F.col("p") == QUDT + "numericValue").alias("num"), F.max(F.col("p") == QUDT + "unit").alias("unit"),
        F.count_if((F.col("p") == SOSA + "resultTime") & ~F.col("o_datatype").eqNullSafe(XSD + "dateTime")).alias("untyped"),
    )
    return per.agg(
        F.count_if("qv").alias("quantity_values"), F.count_if(F.col("qv") & ~F.col("num")).alias("without_value"),
        F.count_if(F.col("qv") & ~F.col("unit")).alias("without_unit"),
        F.coalesce(F.sum("untyped"), F.lit(0)).alias("times_not_datetime"),
    )


def sample_shape(triples: DataFrame) -> DataFrame:
    """Counts of samples, samplings and links to a sample as feature of interest, in one pass by identifier."""
    p, is_foi = F.col("p"), F.col("p") == SOSA + "hasFeatureOfInterest"
    no = F.lit(None).cast("string")
    wanted = _is_a(SOSA + "Sample") | _is_a(SOSA + "Sampling") | p.isin(SOSA + "isSampleOf", SOSA + "madeBySampler") | is_foi
    both = F.array(
        F.struct(F.when(~is_foi, F.col("s")).alias("id"), p.alias("p"), F.col("o").alias("o")),
        F.struct(F.when(is_foi, F.col("o")).alias("id"), p.alias("p"), no.alias("o")),
    )
    rows = triples.where(wanted).select(F.inline(both)).where(F.col("id").isNotNull())
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    per = rows.groupBy("id").agg(
        some(_is_a(SOSA + "Sample")).alias("sample"), some(_is_a(SOSA + "Sampling")).alias("sampling"),
        some(p == SOSA + "isSampleOf").alias("of"), some(p == SOSA + "madeBySampler").alias("by"), F.count_if(is_foi).alias("links"),
    )
    return per.agg(
        F.count_if("sample").alias("samples"), F.count_if("sampling").alias("samplings"),
        F.count_if(F.col("sample") & F.col("of")).alias("samples_with_feature"),
        F.count_if(F.col("sampling") & F.col("by")).alias("samplings_with_sampler"),
        F.coalesce(F.sum(F.when(F.col("sample"), F.col("links"))), F.lit(0)).alias("observations_about_a_sample"),
    )


def samples(triples: DataFrame) -> DataFrame:
    return triples.where(_is_a(SOSA + "Sample")).select(F.col("s").alias("sample"))


def not_about_samples(triples: DataFrame, sampled_files: DataFrame) -> DataFrame:
    """Observations of sampled files none of whose features of interest is a sample, also those without any, counted by file."""
    observed = triples.where(_is_a(SOSA + "Observation")).select("s", F.regexp_extract("s", "/obs/[^/]+/([^/]+)/", 1).alias("file_id"))
    mine = observed.join(sampled_files.select("file_id"), "file_id", "left_semi")
    foi = triples.where(F.col("p") == SOSA + "hasFeatureOfInterest").select("s", F.col("o").alias("sample"))
    about = foi.join(samples(triples), "sample", "left_semi").select("s")
    return mine.join(about, "s", "left_anti").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
