"""Quality rules: decision lists of threshold conditions, learned from labelled text statistics.

`statistics` measures whole texts with column functions. `learn` covers the bad labelled rows rule by rule: a rule grows
by the condition `feature <= t` or `feature > t` that best tells bad rows from good ones among those it
still covers, is cut back to the prefix that does best on rows held out from growing, and joins the list if it is
precise enough there; rows it covers are then set aside. Thresholds lie midway between quantiles of the good and of
the bad rows, and of thresholds that do equally well the middle one is taken, which keeps a margin. Every
step is one aggregation of (feature, quantile) counts, so nothing but those counts reaches the driver.
`verdict` turns the list into one conditional expression.

A null text is empty: all counts are 0. Repeated rows are measured alike. Labels of one id that contradict each other
count as bad; null labels and ids are left out. Without labels of both kinds there are no rules and all is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.session import staged

_SPACE = " \t\n\x0b\f\r"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_digits, n_marks."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    rows = rows.select(
        "id", words.alias("words"), lines.alias("lines"), count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"), count(r"[0-9]").alias("n_digits"), count(r"[!?]").alias("n_marks"),
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))))
    rows = rows.withColumn("windows", F.array_sort(windows))
    same = lambda x, k: F.get("windows", k)["h"] == x["h"]
    again = F.filter("windows", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    rows = rows.withColumn("starts", F.array_sort(F.transform(again, lambda x: x["i"])))
    # a window adds three words, or as many as lie past the window before it
    added = F.transform("starts", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get("starts", k - 1), F.lit(-3))))
    return rows.select(
        "id", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(added, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), "n_upper", "n_digits", "n_marks",
    )


def features() -> dict[str, Column]:
    """What rules may ask: shares, and the length."""
    share = lambda part, of: F.col(part) / F.greatest(F.col(of), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        "marks": share("n_marks", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"

    def column(self) -> Column:
        return F.expr(f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D")


def holds(conditions) -> Column:
    found = F.lit(True)
    for c in conditions:
        found = found & c.column()
    return found


def verdict(rules: list[list[Condition]]) -> Column:
    """True for rows to keep: the first rule that holds rejects, else the row stays."""
    if not rules:
        return F.lit(True)
    chain = F.when(holds(rules[0]), False)
    for rule in rules[1:]:
        chain = chain.when(holds(rule), False)
    return chain.otherwise(True)


def learn(
    labelled: DataFrame, quantiles: int = 32, most_rules: int = 12, most_conditions: int = 3, precision: float = 0.95, least: float = 0.002,
) -> list[list[Condition]]:
    """Rules for rows with columns `features()`, `bad` (boolean) and `held` (boolean: out of growing, for pruning).

    A rule needs the `precision` on both parts and covers at least the share `least` of the bad rows.
    """
    names = [c for c in labelled.columns if c not in ("bad", "held")]
    parts = labelled.groupBy("bad").agg(
        *(F.percentile_approx(c, [k / quantiles for k in range(quantiles + 1)], 10_000).alias(c) for c in names), F.count(F.lit(1)).alias("n")).collect()
    if len(parts) < 2:
        return []
    n_bad = next(p["n"] for p in parts if p["bad"])
    seen = {c: sorted({t for p in parts for t in p[c]}) for c in names}
    cuts = {c: [(x + y) / 2 for x, y in zip(seen[c], seen[c][1:])] or seen[c] for c in names}
    # number of thresholds below the value: value > cuts[k] exactly if its bin is over k
    bins = F.array(*(_bin(c, cuts[c]) for c in names))
    rows = staged(labelled.withColumn("bins", bins), "quality-bins")
    rules: list[list[Condition]] = []
    while len(rules) < most_rules:
        left = rows.where(verdict(rules))
        rule = _grow(left.where("not held"), names, cuts, most_conditions)
        rule = rule and _prune(left, rule, precision, max(2, least * n_bad))
        if not rule:
            break
        rules.append(rule)
    return rules


def _bin(feature: str, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(float(t)) for t in cuts)), lambda t: F.col(feature) > t))


def _counts(rows: DataFrame, names: list[str]) -> dict[str, dict[int, tuple[int, int]]]:
    """Bad and good rows by feature and bin."""
    table = rows.select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(
        F.sum(F.col("bad").cast("long")).alias("bad"), F.sum((~F.col("bad")).cast("long")).alias("good")).collect()
    found: dict[str, dict[int, tuple[int, int]]] = {c: {} for c in names}
    for r in sorted(table):
        found[names[r["f"]]][r["bin"]] = (r["bad"], r["good"])
    return found


def _grow(rows: DataFrame, names: list[str], cuts: dict[str, list[float]], most: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        counts = _counts(rows.where(holds(rule)), names)
        bad, good = (sum(x[k] for x in counts[names[0]].values()) for k in (0, 1))
        if not bad or not good and rule:
            break
        best, best_gain = [], 0.0
        for name in names:
            for k, t in enumerate(cuts[name]):
                over = [sum(x[j] for b, x in counts[name].items() if b > k) for j in (0, 1)]
                for above, (p, n) in ((True, over), (False, (bad - over[0], good - over[1]))):
                    if p and n < good:
                        gain = p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((bad + 0.5) / (bad + good + 1)))
                        if gain > best_gain + 1e-9:
                            best, best_gain = [], gain
                        if gain > best_gain - 1e-9 and (not best or (best[0].feature, best[0].above) == (name, above)):
                            best.append(Condition(name, above, float(t)))
        if not best:
            break
        rule.append(best[len(best) // 2])
    return rule


def _prune(rows: DataFrame, rule: list[Condition], precision: float, least: float) -> list[Condition]:
    """The prefix that does best on held-out rows, if it is precise and covers enough."""
    sums = []
    for k in range(1, len(rule) + 1):
        inside = holds(rule[:k])
        for part in ("held", "not held"):
            for kind in ("bad", "not bad"):
                sums.append(F.sum((inside & F.expr(f"{part} and {kind}")).cast("long")))
    seen = [x or 0 for x in rows.agg(*sums).first()]
    best, best_worth = [], None
    for k in range(len(rule)):
        held_bad, held_good, bad, good = seen[4 * k:4 * k + 4]
        worth = (held_bad - held_good + 1) / (held_bad + held_good + 2)
        precise = bad >= precision * (bad + good) and held_bad >= precision * (held_bad + held_good) and bad + held_bad >= least
        if precise and (best_worth is None or worth > best_worth):
            best, best_worth = rule[:k + 1], worth
    return best


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics of every row, base_failed, and kept: what the learned rules say of rows that pass the base.

    `labels`: id and 0 (bad) or 1. Every labelled row is used.
    """
    measured = staged(statistics(docs, id_col, text_col), "quality-statistics").withColumn("base_failed", base_failed())
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    columns = features()
    rows = measured.where("not base_failed").join(known, "id").select(
        *(c.alias(name) for name, c in columns.items()), (F.col("label") == 0).alias("bad"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("held"))
    rules = learn(rows)
    asked = measured.withColumns({f"{name}": c for name, c in columns.items()})
    return asked.withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop(*columns).withColumnRenamed("id", id_col)
