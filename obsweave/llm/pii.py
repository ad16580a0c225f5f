"""Pseudonyms for personal data: keyed Feistel permutations within the format of what they replace.

Card numbers (Luhn), social security numbers, phone numbers, IPv4 addresses and calendar dates are found, validated, and
permuted among the valid values of their format, so that equal values get equal pseudonyms in all documents, different
values stay different, and whoever has the key can go back. Mail addresses and secrets (access keys, tokens, passwords)
have no bounded domain and get a keyed digest in their shape instead. Numbers that fail validation stay.

A secret is what follows its name: up to the closing quote, or without quotes up to white space, a quote that ends a
word, or the stops (. , ;) of a sentence, so that one secret looks the same within a sentence and at its end.

All of it is column functions: a text is split at what may be personal, each match is replaced, and the parts are joined.
Null texts stay null, empty ones empty. Whole texts are read, very long ones and unbroken runs in time in proportion to
their length. Rows that repeat a text get the same pseudonyms. An empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Names of secrets, values without quotes (possessive, so that long ones need no stack), phone numbers without a country code.
_NAMES = "(?i:password|passwd|secret|token|api_key)"
_NAMED = rf"{_NAMES} ?(?:=>|:=|[=:]) ?"
_BARE = r"(?:[^\s\"'.,;]++|[.,;]++(?=[^\s.,;\"'])|(?<=[^\s\"'=:>])[\"'](?=[^\s\"'.,;)}\]>]))++"
_LOCAL = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"

# A label of a domain has at most 63 characters, a domain at most 127 labels, by the standard of domain names.
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"

# Shapes of personal data, most specific first. Runs are anchored and possessive, so that a text of any length
# takes time in proportion and no stack.
SHAPES = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@{_LABEL}(?:\.{_LABEL}){{1,126}}+",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"{_NAMED}(?:\"[^\"\r\n]+\"|'[^'\r\n]+'|[\"']?{_BARE})",
    "phone": rf"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?{_LOCAL}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
ANY = "|".join(SHAPES.values())
# Every match holds one of these.
SIGN = f"[0-9@]|AKIA|ASIA|{_NAMES}"

# Dates are permuted within spans of so many days, 256 squared, that start at 1920-01-01 and before and after.
_SPAN, _FIRST = 256, "1920-01-01"
_AFTER_12TH = 146_097 / 4_800 - 12  # mean number of days of a month after the 12th


def feistel(a: Column, b: Column, size_a, size_b, key: str, tag: str, inverse: bool = False) -> Column:
    """struct(a, b): a keyed permutation of the pairs below (size_a, size_b); halves take turns in adding a digest of the other."""
    sizes = [F.lit(s).cast("long") if isinstance(s, int) else s for s in (size_a, size_b)]
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(state: Column, r: Column) -> Column:
        def moved(own: str, other: str, size: Column) -> Column:
            text = F.concat_ws("|", F.lit(key), F.lit(tag), sizes[0].cast("string"), sizes[1].cast("string"), r.cast("string"), state[other].cast("string"))
            digest = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")
            return F.pmod(state[own] - digest if inverse else state[own] + digest, size)
        even = F.struct(moved("a", "b", sizes[0]).alias("a"), state["b"].alias("b"))
        return F.when(r % 2 == 0, even).otherwise(F.struct(state["a"].alias("a"), moved("b", "a", sizes[1]).alias("b")))

    rounds = list(range(ROUNDS))
    return F.aggregate(F.array(*map(F.lit, reversed(rounds) if inverse else rounds)), start, turn)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("long")


def _permuted_digits(d: Column, key: str, tag: str, inverse: bool) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    x = feistel(F.substring(d, F.lit(1), u), F.substring(d, u + 1, n), _power(u), _power(n - u), key, tag, inverse)
    return F.concat(F.lpad(x["a"].cast("string"), u, "0"), F.lpad(x["b"].cast("string"), n - u, "0"))


def _poured(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced, in order, by `digits`."""
    chars = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s, c):
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(chars, start, put, lambda s: s["out"])


def luhn_sum(d: Column, skip: int = 0) -> Column:
    """Luhn's sum of a string of digits; `skip` 1 leaves room for a check digit to the right."""
    weights = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(
        (i + skip) % 2 == 1, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(F.filter(weights, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str, inverse: bool) -> Column:
    d = _digits(m)
    body = _permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", inverse)
    check = F.pmod(10 - F.pmod(luhn_sum(body, 1), F.lit(10)), F.lit(10))
    return F.when(luhn_sum(d) % 10 == 0, _poured(m, F.concat(body, check.cast("string"))))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    """All but a country code is permuted."""
    pattern = rf"^(\+?1[ .-]?)?({_LOCAL})$"  # an area code may start with 1, too
    code, rest = F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)
    return F.concat(code, _poured(rest, _permuted_digits(_digits(rest), key, "phone", inverse)))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.split(m, "-")[k].cast("int") for k in range(3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    x = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", inverse)
    a = F.floor(x["a"] / 99)
    area = F.when(a >= 665, a + 2).otherwise(a + 1)
    parts = (F.lpad(area.cast("string"), 3, "0"), F.lpad((x["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["b"] + 1).cast("string"), 4, "0"))
    return F.when(valid, F.concat_ws("-", *parts))


def _ip(m: Column, key: str, inverse: bool) -> Column:
    o = [F.split(m, r"\.")[k].cast("int") for k in range(4)]
    valid = functools.reduce(lambda p, q: p & q, (x < 256 for x in o))
    x = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip", inverse)
    parts = [F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256]
    return F.when(valid, F.concat_ws(".", *(p.cast("string") for p in parts)))


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Year first with hyphens, day first with dots; with slashes month first, and day first where that is no date."""
    def within(pattern: str) -> Column:
        days = F.datediff(F.try_to_timestamp(m, F.lit(pattern)).cast("date"), F.lit(_FIRST).cast("date"))
        span, place = F.floor(days / (_SPAN * _SPAN)), F.pmod(days, F.lit(_SPAN * _SPAN))
        x = feistel(F.floor(place / _SPAN), place % _SPAN, _SPAN, _SPAN, key, "date", inverse)
        moved = F.date_add(F.lit(_FIRST).cast("date"), (span * _SPAN * _SPAN + x["a"] * _SPAN + x["b"]).cast("int"))
        return F.date_format(moved, pattern)
    slashes = F.coalesce(within("MM/dd/yyyy"), _day_first(m, key, inverse))
    return F.when(m.contains("-"), within("yyyy-MM-dd")).when(m.contains("/"), slashes).otherwise(within("dd.MM.yyyy"))


def _day_first(m: Column, key: str, inverse: bool) -> Column:
    """dd/MM/yyyy after the 12th, permuted among such dates: others read month first, so neither kind becomes the other.

    A date's place is the number of such dates since _FIRST, that is its days less twelve for each month begun.
    """
    first = F.lit(_FIRST).cast("date")
    start = lambda month: F.datediff(F.add_months(first, month.cast("int")), first)
    date = F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).cast("date")
    months = (F.year(date) - int(_FIRST[:4])) * 12 + F.month(date) - 1
    number = F.datediff(date, first) - 12 * (months + 1)
    square = _SPAN * _SPAN

    def permuted(n: Column) -> Column:
        place = F.pmod(n, F.lit(square))
        x = feistel(F.floor(place / _SPAN), place % _SPAN, _SPAN, _SPAN, key, "day first", inverse)
        return _with(x, lambda x: F.floor(n / square) * square + x["a"] * _SPAN + x["b"])

    def dated(n: Column) -> Column:
        reached = lambda month: start(month) - 12 * month <= n
        month = _with(F.floor(n / _AFTER_12TH), lambda g: F.when(reached(g + 1), g + 1).when(reached(g), g).otherwise(g - 1))
        return F.date_format(F.date_add(first, (n + 12 * (month + 1)).cast("int")), "dd/MM/yyyy")

    return F.when(F.dayofmonth(date) > 12, _with(_with(number, permuted), dated))


def _with(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(m: Column, key: str, tag: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), m), 256)


def _email(m: Column, key: str, inverse: bool) -> Column:
    return F.concat(F.lit("p"), F.substring(_digest(F.lower(m), key, "email"), 1, 12), F.lit("@mail.invalid"))


def _access_key(m: Column, key: str, inverse: bool) -> Column:
    return F.concat(F.substring(m, 1, 4), F.upper(F.substring(_digest(m, key, "access_key"), 1, 16)))


def _secret(m: Column, key: str, inverse: bool) -> Column:
    """The value after its name becomes a digest of as many characters, 64 at most."""
    pattern = rf"(?s)^({_NAMED}[\"']?)(.*?)([\"']?)$"
    value = F.regexp_extract(m, pattern, 2)
    return F.concat(F.regexp_extract(m, pattern, 1), F.substring(_digest(value, key, "secret"), F.lit(1), F.length(value)), F.regexp_extract(m, pattern, 3))


_MAKERS = {"email": _email, "access_key": _access_key, "secret": _secret, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip, "card": _card}


def kind_of(m: Column) -> Column:
    """Name of the first shape that fits the whole match."""
    found = None
    for name, pattern in SHAPES.items():
        fits = m.rlike(f"^(?:{pattern})$")
        found = F.when(fits, name) if found is None else found.when(fits, name)
    return found


def replaced(m: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a match; null where validation fails."""
    kind = kind_of(m)
    made = None
    for name, maker in _MAKERS.items():
        made = F.when(kind == name, maker(m, key, inverse)) if made is None else made.when(kind == name, maker(m, key, inverse))
    return made


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "found", inverse: bool = False) -> DataFrame:
    """`docs` with replaced texts and `found`: array of (kind, pseudonym) in order of appearance; clashing columns are replaced.

    `inverse` brings numbers and dates back; digests stay.
    """
    text = F.col(text_col)
    matches = F.when(text.rlike(SIGN), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    rows = docs.withColumn("__matches", matches)
    made = F.transform("__matches", lambda m: F.struct(kind_of(m).alias("kind"), replaced(m, key, inverse).alias("new"), m.alias("old")))
    rows = rows.withColumn("__made", made)
    parts = F.zip_with(F.split(text, ANY), "__made", lambda p, x: F.concat(p, F.coalesce(x["new"], x["old"], F.lit(""))))
    done = F.when(F.size("__made") > 0, F.array_join(parts, "")).otherwise(text)
    valid = F.filter("__made", lambda x: x["new"].isNotNull())
    found = F.coalesce(F.transform(valid, lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("pseudonym"))), F.array().cast("array<struct<kind:string,pseudonym:string>>"))
    return rows.withColumn(found_col, found).withColumn(text_col, done).drop("__matches", "__made")
