"""Cell values: numbers, times, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsweave.functions import fixed


def known(value: Column) -> Column:
    """Null for the texts that mean "no value"."""
    return F.when(~value.isin(fixed.NULL_TEXTS), value)


def dot(value: Column, decimal: Column) -> Column:
    return F.when(decimal == ",", F.replace(value, F.lit(","), F.lit("."))).otherwise(value)


def number(value: Column) -> Column:
    """Double of a plain number text, else null. The gate keeps out what a cast alone would take ('1d')."""
    text = F.trim(value)
    return F.when(text.rlike(fixed.NUMBER), text.try_cast("double"))


def parse_with(value: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(p)) for p in patterns])


def parse_time(value: Column, fmt: Column) -> Column:
    """Instant of a text in the named format; one branch per format, so every pattern is a constant."""
    zone = F.regexp_extract(offset(value), r"^([+-])(\d\d):(\d\d)$", 0)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    shift = F.coalesce(F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes), F.lit(0))
    out = F.when(fmt == fixed.AMBIGUOUS, ambiguous_local(value) - F.make_dt_interval(mins=shift))
    for name, patterns in fixed.DATE_FORMATS:
        out = out.when(fmt == name, parse_with(value, patterns))
    return out


def ambiguous_local(value: Column) -> Column:
    """Local time of a text that no named format fits, day first; an offset after the time and digits past microseconds are left out."""
    bare = F.regexp_replace(value, r"(:\d{1,2}(?:\.\d+)?)\s*([Zz]|[+-]\d{2}:?\d{2})$", "$1")
    return parse_with(F.regexp_replace(bare, r"(\.\d{6})\d+$", "$1"), fixed.AMBIGUOUS_PATTERNS)


def iso(instant: Column) -> Column:
    """ISO 8601 text of a timestamp, with six digits of a second only where they are not zero."""
    text = F.translate(instant.cast("string"), " ", "T")
    return F.rpad(text, F.when(F.length(text) > 19, 26).otherwise(19), F.lit("0"))


def offset(value: Column) -> Column:
    """UTC offset at the end of a text as +hh:mm, empty when there is none."""
    found = F.regexp_extract(value, r":\d{1,2}(?:\.\d+)?\s*([Zz]|[+-]\d{2}:?\d{2})$", 1)
    return (
        F.when(found == "", F.lit(""))
        .when(F.upper(found) == "Z", F.lit("+00:00"))
        .otherwise(F.concat(F.left(found, F.lit(3)), F.lit(":"), F.right(found, F.lit(2))))
    )


def local_time(value: Column, fmt: Column) -> Column:
    """Local time of a text in the named format, its UTC offset left out; null when it does not parse.

    The instant alone would lose the offset, so the text is parsed without it (see `with_offset`).
    """
    bare = F.regexp_replace(value, r"([Zz]|[+-]\d{2}:?\d{2})$", "")
    out = F.when(fmt == fixed.AMBIGUOUS, ambiguous_local(value))
    for name, patterns in fixed.DATE_FORMATS:
        if name.endswith("%z"):
            zoned = F.when(offset(value) != "", F.try_to_timestamp(bare, F.lit(patterns[0].removesuffix("XXX"))))
            out = out.when(fmt == name, zoned)
        else:
            out = out.when(fmt == name, parse_with(value, patterns))
    return out


def with_offset(local: Column, value: Column, fmt: Column) -> Column:
    """ISO 8601 text of a local time, followed by the offset its source text had."""
    return F.concat(iso(local), F.when(F.endswith(fmt, F.lit("%z")) | (fmt == fixed.AMBIGUOUS), offset(value)).otherwise(F.lit("")))


def duration_text(micros: Column) -> Column:
    """Microseconds as 'N days hh:mm:ss', days floored as in pandas."""
    day = 86_400_000_000
    days = F.floor(micros / day).cast("long")
    rest = F.pmod(micros, F.lit(day))
    sign = F.when(days < 0, F.lit("+")).otherwise(F.lit(""))
    sec = F.floor(rest / 1_000_000).cast("long")
    frac = F.pmod(rest, F.lit(1_000_000))
    clock = F.format_string(
        "%02d:%02d:%02d",
        F.floor(sec / 3600).cast("int"), F.floor(F.pmod(sec, F.lit(3600)) / 60).cast("int"), F.pmod(sec, F.lit(60)).cast("int"),
    )
    clock = F.when(frac == 0, clock).otherwise(F.concat(clock, F.format_string(".%06d", frac.cast("int"))))
    return F.concat(days.cast("string"), F.lit(" days "), sign, clock)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors, in double precision."""
    def dot_product(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)
    return dot_product(a, b) / F.sqrt(dot_product(a, a) * dot_product(b, b))
