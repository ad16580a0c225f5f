"""Language identification by fusing evidence: the text, the declared language, the address suffix and the host.

1. A text model counts hashed letter trigrams of all words by declared language, in one pass and with a table of fixed
   size. Words that few languages share weigh in through their trigrams; a word's likelihoods are computed once per worker.
2. Every text gets a likelihood for each language. What languages were declared, and which suffixes and hosts occur,
   is counted against the language the text alone suggests, by grouped aggregation over all rows.
3. Declarations and suffixes become likelihoods, and hosts priors: shares of a host are smoothed by those of its domain,
   these by those of all rows, so that a host with few rows says little.
4. The posterior is the normalized product. Words of a text repeat and depend on each other, so the text's log
   likelihood is scaled down and bounded.

Null and empty texts, and texts without letters, have no text evidence and are decided by the other parts. Null
declarations, suffixes and hosts say nothing. Without any declared language there is no posterior: language is null.
Repeated rows count as often as they come. New columns win over columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import alone, slices
from obsweave.session import ship, staged

BUCKETS = 1 << 15
LANGUAGES = 64  # languages of one text model; more of them take several, one after the other
REMEMBERED = 100_000
BROADCAST_KEYS = 50_000  # rows of a table of evidence that is broadcast, fewer with more than LANGUAGES languages

_NO_LETTERS = re.compile(r"[\W\d_]+")
_BORDER = ord("\n")


def trigrams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the token, bucket) of all letter trigrams, in order; borders of letters count as a space.

    All tokens are one row of characters with line ends between them, and trigrams across a line end are left out.
    """
    row = "\n".join([f" {_NO_LETTERS.sub(' ', t.lower()).strip()} " for t in tokens])
    c = np.frombuffer(row.encode("utf-32-le"), dtype="<u4")
    ends = c == _BORDER
    inside = ~(ends[:-2] | ends[1:-1] | ends[2:])
    place = np.cumsum(ends)[:-2][inside]
    c = c.astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return place, (h >> np.uint64(49)).astype(np.int64)[inside]


def tokens_of(text: str | None) -> list[str]:
    return text.split() if text else []


def in_parts(tokens: list[str], size: int = 20_000):
    for start in range(0, len(tokens), size):
        yield tokens[start:start + size]


def trigram_counts(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts (language, bucket) over all `rows` (declared, text)."""
    ship(rows.sparkSession)
    place = {x: k for k, x in enumerate(languages)}

    def run(batches):
        alone("language ID")
        sums = np.zeros((len(place), BUCKETS), np.int64)
        seen: dict[int, Counter] = defaultdict(Counter)

        def pour():
            for k, counter in seen.items():
                for part in in_parts(list(counter)):
                    place, bucket = trigrams(part)
                    times = np.fromiter(map(counter.__getitem__, part), np.int64, len(part))
                    sums[k] += np.bincount(bucket, times[place], BUCKETS).astype(np.int64)
            seen.clear()

        for batch in slices(batches):
            for declared, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[place[declared]].update(tokens_of(text))
            if sum(map(len, seen.values())) > REMEMBERED:
                pour()
        pour()
        for k, x in enumerate(sums):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["k", "bucket", "n"])

    counts = rows.where(F.col("declared").isin(languages)).mapInArrow(run, "k int, bucket int, n long")
    table = counts.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most LANGUAGES * BUCKETS rows
    out = np.zeros((len(languages), BUCKETS))
    out[table["k"].to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


class TextModel:
    def __init__(self, counts: np.ndarray):
        self.log = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, self.log.shape[1] + 1), np.float32)

    def __getstate__(self):
        return {"log": self.log, "known": {}, "rows": self.rows[:0]}

    def look_up(self, tokens: list[str]) -> None:
        """Remembers sums of log likelihoods of new tokens, and whether they have letters."""
        new = []
        for part in in_parts(list({t for t in tokens if t not in self.known})):
            place, bucket = trigrams(part)
            found = np.zeros((len(part), self.rows.shape[1]), np.float32)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            if len(first):
                found[place[first], :-1] = np.add.reduceat(self.log[bucket], first, axis=0)
            letters = np.bincount(place, minlength=len(part)) > 0
            letters &= [any(map(str.isalpha, t)) for t in part]
            found[~letters] = 0
            found[:, -1] = letters
            self.known.update(zip(part, range(len(self.rows) + sum(map(len, new)), len(self.rows) + sum(map(len, new)) + len(part))))
            new.append(found)
        if new:
            self.rows = np.concatenate([self.rows, *new])

    def likelihoods(self, texts: list[str | None]) -> list[list[float]]:
        """Mean log likelihood per word for each language, and the number of words behind it."""
        split = [tokens_of(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        self.look_up([t for tokens in split for t in tokens])
        out = []
        for tokens in split:
            at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
            *sums, n = self.rows[at].sum(0, dtype=np.float64)
            out.append([*(np.array(sums) / max(n, 1)).tolist(), float(n)])
        return out


def with_means(rows: DataFrame, model: TextModel, text_col: str) -> DataFrame:
    """`rows` with the means of the model's languages put behind __mean, and __words, the number of words."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c not in ("__mean", "__words")]

    def run(batches):
        alone("language ID")
        for batch in slices(batches):
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            found = shared.value.likelihoods(columns[text_col].to_pylist())
            before = columns["__mean"].to_pylist() if "__mean" in columns else [[]] * len(found)
            means = pa.array([[*x, *y[:-1]] for x, y in zip(before, found)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[columns[c] for c in names], means, pa.array([y[-1] for y in found], pa.float64())], names=[*names, "__mean", "__words"])
        shared.value.forget()  # workers outlive their tasks

    more = [T.StructField("__mean", T.ArrayType(T.DoubleType())), T.StructField("__words", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in names], *more]))


def with_text_evidence(rows: DataFrame, learn: DataFrame, names: list[str], text_col: str) -> DataFrame:
    """`rows` with __text: for each language the mean log likelihood per word relative to the best, times the square root of the number of words.

    A model holds LANGUAGES of them; with more, the rows pass one model after the other and are written in between.
    """
    for start in range(0, len(names), LANGUAGES):
        if start:
            rows = staged(rows, "language-means")
        rows = with_means(rows, TextModel(trigram_counts(learn, names[start:start + LANGUAGES])), text_col)
    best = F.array_max("__mean")
    return rows.withColumn("__text", F.transform("__mean", lambda x: (x - best) * F.sqrt("__words"))).drop("__mean", "__words")


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def _total(numbers: str) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x)


def _share_table(counts: DataFrame, key: str, n_languages: int) -> DataFrame:
    """(key, n: array of counts by language)."""
    sums = counts.where(F.col(key).isNotNull()).groupBy(key, "best").agg(F.sum("c").cast("double").alias("c"))
    found = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("best", "c"))).alias("n"))  # at most n_languages
    return found.select(key, F.transform(F.sequence(F.lit(0), F.lit(n_languages - 1)), lambda k: F.coalesce(F.try_element_at("n", k), F.lit(0.0))).alias("n"))


def host_priors(counts: DataFrame, n_languages: int, overall: list[float], strength: float) -> DataFrame:
    """(host, prior: array of log probabilities): host smoothed by domain, domain by all rows."""
    base = F.array(*map(F.lit, overall))
    hosts = _share_table(counts, "host", n_languages).withColumn("domain", domain_of(F.col("host")))
    domains = _share_table(counts.withColumn("domain", domain_of(F.col("host"))), "domain", n_languages)
    domains = domains.select("domain", F.zip_with("n", base, lambda n, p: (n + strength * p)).alias("d"), _total("n").alias("dt"))
    domains = domains.select("domain", F.transform("d", lambda x: x / (F.col("dt") + strength)).alias("d"))
    joined = hosts.join(domains, "domain").withColumn("ht", _total("n"))
    return joined.select("host", F.zip_with("n", "d", lambda n, p: F.log((n + strength * p) / (F.col("ht") + strength))).alias("prior"))


def likelihoods_of(counts: DataFrame, key: str, n_languages: int, overall: list[float], strength: float) -> DataFrame:
    """(key, likely: array of log P(value | language) up to a constant) for each value of `key`.

    That is P(language | value) / P(language), smoothed towards 1.
    """
    base = F.array(*map(F.lit, overall))
    sums = _share_table(counts, key, n_languages).withColumn("t", _total("n"))
    return sums.select(key, F.zip_with("n", base, lambda n, p: F.log((n + strength * p) / (F.col("t") + strength) / p)).alias("likely"))


def with_evidence(rows: DataFrame, evidence: DataFrame, key: str, name: str, n_languages: int) -> DataFrame:
    """`rows` with the evidence of __key as __name; beyond the bound the join shuffles, and adaptive execution splits hot keys."""
    evidence = staged(evidence.toDF(f"__{key}", f"__{name}"), f"language-{name}")
    small = evidence.count() <= min(BROADCAST_KEYS, BROADCAST_KEYS * LANGUAGES // n_languages)
    return rows.join(F.broadcast(evidence) if small else evidence, f"__{key}", "left")


def identify(
    docs: DataFrame, text_col: str = "text", declared_col: str | None = "lang", suffix: Column | None = None, host: Column | None = None,
    model_rows: DataFrame | None = None, weight: float = 1.0, bound: float = 12.0, strength: float = 20.0, keep: list[str] | None = None,
) -> DataFrame:
    """`docs` with language (the most probable one), probability, and text_language (by the text alone).

    `model_rows`: (declared, text) to learn the text model from, `docs` by default. `suffix`, `host`: columns of `docs`.
    `weight`, `bound`: scale of the text evidence and its limit in nats; `strength`: rows that a prior counts for.
    `keep`: columns of `docs` in the result, all by default. The kept columns are written once with the evidence of the text.
    """
    null = F.lit(None).cast("string")
    declared = F.lower(F.col(declared_col)) if declared_col else null
    learn = model_rows if model_rows is not None else docs.select(declared.alias("declared"), F.col(text_col).alias("text"))
    learn = learn.where("declared is not null")
    names = [r["declared"] for r in learn.select("declared").distinct().collect()]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("language", "probability", "text_language")]
    if not names:
        return docs.select(*kept, null.alias("language"), F.lit(None).cast("double").alias("probability"), null.alias("text_language"))
    names.sort()
    n = len(names)
    text = [] if text_col in kept else [F.col(text_col).alias("__body")]
    rows = docs.select(*kept, *text, declared.alias("__declared"), (suffix if suffix is not None else null).alias("__suffix"), (host if host is not None else null).alias("__host"))
    rows = with_text_evidence(rows, learn, names, "__body" if text else text_col)
    rows = staged(rows.drop("__body"), "language-evidence")
    best = F.array_position("__text", F.array_max("__text")).cast("int") - 1
    has_text = F.exists("__text", lambda x: x < 0) if n > 1 else F.lit(True)
    counts = rows.where(has_text).select(best.alias("best"), F.col("__declared").alias("declared"), F.col("__suffix").alias("suffix"), F.col("__host").alias("host"))
    counts = staged(counts.groupBy("best", "declared", "suffix", "host").agg(F.count(F.lit(1)).alias("c")), "language-counts")
    seen = {r["best"]: r["c"] for r in counts.groupBy("best").agg(F.sum("c").alias("c")).collect()}
    total = sum(seen.values())
    overall = [(seen.get(k, 0) + 1) / (total + n) for k in range(n)]
    evidence = [F.transform("__text", lambda x: F.greatest(x * weight, F.lit(-bound)))]
    for key, given in (("declared", declared_col is not None), ("suffix", suffix is not None)):
        if given:
            rows = with_evidence(rows, likelihoods_of(counts, key, n, overall, strength), key, f"of_{key}", n)
            evidence.append(F.coalesce(f"__of_{key}", F.array(*[F.lit(0.0)] * n)))
    if host is not None:
        rows = with_evidence(rows, host_priors(counts, n, overall, strength), "host", "prior", n)
    prior = F.array(*(F.lit(float(np.log(p))) for p in overall))
    evidence.append(F.coalesce(F.col("__prior"), prior) if host is not None else prior)
    score = evidence[0]
    for more in evidence[1:]:
        score = F.zip_with(score, more, lambda x, y: x + y)
    rows = rows.withColumn("__score", score)
    top = F.array_max("__score")
    mass = F.aggregate(F.transform("__score", lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    by_name = F.array(*map(F.lit, names))
    text_best = F.when(has_text, F.get(by_name, best))
    return rows.select(
        *kept, F.get(by_name, F.array_position("__score", top).cast("int") - 1).alias("language"), (1 / mass).alias("probability"), text_best.alias("text_language"))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(url: Column) -> Column:
    """Last label of the host."""
    return F.nullif(F.regexp_extract(host_of(url), r"\.([^.]+)$", 1), F.lit(""))


def declared_in(html: Column) -> Column:
    """The language that the html element declares, without its region."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def visible(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments, tags or entities."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?[a-zA-Z0-9]+;", " ")
