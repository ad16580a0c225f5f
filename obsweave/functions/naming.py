"""Identifiers: slugs, URIs, short tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsweave.functions import fixed


def slug(value: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one dash, no dash at the ends."""
    return F.btrim(F.regexp_replace(F.lower(value.cast("string")), "[^a-z0-9]+", "-"), F.lit("-"))


def _uri(kind: str, *parts: Column) -> Column:
    return F.concat_ws("/", F.lit(f"{fixed.BASE}/{kind}"), *[slug(p) for p in parts])


def scoped_uri(kind: str, dataset_id: Column, local_id: Column) -> Column:
    """URI of a sensor, feature or sampler; null when the local id is null."""
    return F.when(local_id.isNotNull(), _uri(kind, dataset_id, local_id))


def property_uri(label: Column) -> Column:
    """URI of a property minted from its label; shared by all datasets."""
    return _uri("property", label)


def row_prefix(kind: str, dataset_id: Column, file_id: Column, value_col: Column | None = None) -> Column:
    """URI of an obs, result, sample or sampling up to its row number."""
    parts = [dataset_id, file_id] + ([] if value_col is None else [value_col])
    return F.concat(_uri(kind, *parts), F.lit("/"))


def file_id(file: Column) -> Column:
    """Slug of a relative path without its suffix."""
    return slug(F.regexp_replace(file, r"\.[^./]+$", ""))


def corpus_place(source: Column) -> Column:
    """Sort key of a corpus: the fixed order, others after it by name."""
    place = F.array_position(F.array(*map(F.lit, fixed.CORPORA)), source)
    return F.struct(F.when(place > 0, place).otherwise(len(fixed.CORPORA) + 1).alias("place"), source.alias("source"))


def column_key(file: Column, column: Column) -> Column:
    return F.concat(file, F.lit("::"), column)


def dataset_of(observation: Column) -> Column:
    """Dataset part of an observation URI; any other text is returned as it is."""
    return F.regexp_replace(observation, f"^{fixed.BASE}/obs/([^/]+)/.*$", "$1")


def last_segment(uri: Column) -> Column:
    return F.regexp_extract(uri, "([^/]*)$", 1)


def curie(source: Column, uri: Column) -> Column:
    return F.concat(source, F.lit(":"), last_segment(uri))


def token(value: Column) -> Column:
    """Short token of a URI or CURIE; unknown forms stay as they are, empty ones become null."""
    local = last_segment(F.rtrim(value, F.lit("/")))
    out = F.when(value.isNull() | (value == ""), F.lit(None).cast("string"))
    for needle, prefix in fixed.TOKEN_FAMILIES:
        out = out.when(F.contains(value, F.lit(needle)), F.concat(F.lit(prefix + ":"), local))
    out = out.when(F.startswith(value, F.lit("ex:property/")), F.concat(F.lit("mint:"), local))
    return out.otherwise(value)


def unit_token(value: Column) -> Column:
    """Short token of a unit, units listed under two identifiers made one."""
    out = token(value)
    for other, kept in fixed.UNIT_EQUIVALENTS.items():
        out = F.when(out == other, F.lit(kept)).otherwise(out)
    return out
