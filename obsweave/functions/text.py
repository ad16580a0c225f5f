"""Text: tokens, cleaned terms, query texts, N-Triples escapes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsweave.functions import fixed


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def tokens(value: Column) -> Column:
    """Lower case, underscores as spaces, split at white space."""
    parts = F.split(F.translate(F.lower(value), "_", " "), r"(?U)\s+")
    return F.filter(parts, lambda t: t != "")


def clean_term(name: Column) -> Column:
    """Column name as words: camel case split, trailing numbers dropped, abbreviations spelled out."""
    s = F.regexp_replace(F.trim(name), "(?<=[a-z])(?=[A-Z])", " ")
    s = F.regexp_replace(s, r"[_\-/]+", " ")
    s = F.regexp_replace(s, r"(?U)(?<=[A-Za-z])\s*\d+\b", "")
    words = F.filter(F.split(s, r"(?U)\s+"), lambda t: (t != "") & ~t.rlike(r"(?U)^\d+$"))
    words = F.transform(words, lambda t: F.coalesce(_lookup(fixed.ABBREVIATIONS, F.lower(t)), t))
    return F.array_join(words, " ")


def query_text(column: Column, stem: Column, phrase: Column, context: Column) -> Column:
    """Retrieval query: a phrase stands for both the column name and the file stem."""
    name = F.translate(F.coalesce(phrase, column), "_", " ")
    words = F.when(phrase.isNull(), F.translate(stem, "_-", "  "))
    words = F.when(words != "", words)
    return F.concat_ws(" ", name, words, context)


def dense_text(query: Column) -> Column:
    return F.concat(F.lit(fixed.QUERY_PREFIX), query)


def escape(value: Column) -> Column:
    """Literal text as N-Triples writes it."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


def unescape(value: Column) -> Column:
    """Text of an N-Triples literal or address: `\\u` and `\\U` escapes by code point, letters by their sign.

    Code points that are none become the replacement character; other escapes stay as they are.
    """
    unit, lone = r"\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}", F.lit("\ufffd")
    pair = r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}"
    pieces = F.regexp_extract_all(value, F.lit(rf"(?s){pair}|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}}|\\.|[^\\]+"), 0)
    point = r"^\\U00(?:0(?!0[dD][89a-fA-F])[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}$"
    signs = {r"\\": "\\", r"\"": '"', r"\'": "'", r"\n": "\n", r"\r": "\r", r"\t": "\t", r"\b": "\b", r"\f": "\f"}

    def sign(piece):
        out = F.when(~F.startswith(piece, F.lit("\\")), piece)
        hexed = F.unhex(F.replace(piece, F.lit("\\u"), F.lit("")))
        out = out.when(piece.rlike(f"^(?:{unit}|{pair})$"), F.decode(hexed, "UTF-16BE"))
        out = out.when(piece.rlike(point), F.decode(F.unhex(F.substring(piece, 3, 8)), "UTF-32"))
        out = out.when(piece.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), lone)
        for escaped, raw in signs.items():
            out = out.when(piece == escaped, raw)
        return out.otherwise(piece)

    return F.when(F.contains(value, F.lit("\\")), F.array_join(F.transform(pieces, sign), "")).otherwise(value)


def truncate(value: Column, limit: int = fixed.EVIDENCE_CHARS) -> Column:
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit(fixed.TRUNCATED))).otherwise(value)


def not_blank(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def fold_unit(value: Column) -> Column:
    """Unit spelling with Unicode variants folded and white space removed; case kept."""
    folded = F.translate(F.trim(value), "µμ²³·", "uu23.")
    return F.regexp_replace(folded, r"(?U)\s+", "")


def unit_alias(value: Column) -> Column:
    return _lookup(fixed.UNIT_ALIASES, F.lower(fold_unit(value)))
