"""Decisions scored against gold tables.

gold: (key, property, source, unit, feature, sensor, accept ARRAY<STRING>, soft); source is reuse or mint.
pred: (key, property, source, unit, feature, sensor). Both may carry grouping columns such as a run;
the functions take them as `by`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.functions import naming
from obsweave.operators.profile import observable
from obsweave.operators.scalars import side_by_side
from obsweave.session import join_small

ANY_MINT = "mint:*"
CHECKS = {"property": "prop_ok", "property_lenient": "prop_ok_lenient", "reuse_mint": "rm_ok", "unit": "unit_ok", "feature": "feature_ok"}


def gold_rows(raw: DataFrame) -> DataFrame:
    """Gold rows with short tokens; `soft` marks rows noted as approximate or expert choices."""
    note = F.lower(F.coalesce("note", F.lit("")))
    none = F.array().cast("array<string>")
    kept = [c for c in raw.columns if c not in ("observedProperty", "decision", "unit", "feature", "feature_gwsw", "sensor", "accept", "note")]
    return raw.select(
        *kept, naming.token(F.col("observedProperty")).alias("property"), F.col("decision").alias("source"), naming.unit_token(F.col("unit")).alias("unit"),
        F.coalesce(naming.token(F.col("feature_gwsw")), F.lit("untyped")).alias("feature"), "sensor",
        F.transform(F.coalesce("accept", none), lambda a: F.when(a == ANY_MINT, a).otherwise(naming.token(a))).alias("accept"),
        (F.contains(note, F.lit("approximate")) | F.contains(note, F.lit("expert"))).alias("soft"),
    )


def predictions(resolved: DataFrame, registry: DataFrame, features: DataFrame) -> DataFrame:
    """Scored rows of a resolved profile: its observable columns with a property.

    `features` is (id, class_uri).
    """
    rows = resolved.where(observable(F.col("role")) & F.col("property_uri").isNotNull())
    rows = join_small(rows, registry.select("property_uri", F.col("source").alias("_source")), "property_uri", "left")
    rows = join_small(rows, features.select(F.col("id").alias("feature_id"), "class_uri"), "feature_id", "left")
    return rows.select(
        F.col("column_key").alias("key"), naming.token(F.col("property_uri")).alias("property"),
        F.when(F.col("_source") == "minted", "mint").otherwise("reuse").alias("source"), naming.unit_token(F.col("unit_uri")).alias("unit"),
        F.coalesce(naming.token(F.col("class_uri")), F.lit("untyped")).alias("feature"), F.col("sensor_id").alias("sensor"), "file", "column",
    )


def compare(gold: DataFrame, pred: DataFrame, by: list[str] = []) -> DataFrame:
    """All keys of both sides with status matched, missed or spurious; columns get g_ and p_ prefixes."""
    keys = [*by, "key"]
    g = gold.select(*keys, *[F.col(c).alias(f"g_{c}") for c in ("property", "source", "unit", "feature", "sensor", "accept", "soft")], F.lit(True).alias("_g"))
    p = pred.select(*keys, *[F.col(c).alias(f"p_{c}") for c in ("property", "source", "unit", "feature", "sensor")], F.lit(True).alias("_p"))
    status = F.when(F.col("_g") & F.col("_p"), "matched").when(F.col("_g"), "missed").otherwise("spurious")
    return g.join(p, keys, "full").withColumn("status", status).drop("_g", "_p")


def mark(compared: DataFrame, menus: DataFrame | None = None) -> DataFrame:
    """Checks of every matched row; nulls equal nulls. `in_menu` holds for gold reuse rows only.

    A gold mint row accepts any minted property. `menus` is (key, uri).
    """
    mint = F.col("p_source") == "mint"
    prop = F.when(F.col("g_source") == "mint", mint).otherwise(F.col("g_property").eqNullSafe(F.col("p_property")))
    # array_contains is null for a null property, which no accepted answer equals
    accepted = F.coalesce(F.array_contains("g_accept", F.col("p_property")), F.lit(False)) | (F.array_contains("g_accept", ANY_MINT) & mint)
    out = compared.where("status = 'matched'").withColumn("prop_ok", prop).withColumns({
        "prop_ok_lenient": F.col("prop_ok") | accepted, "rm_ok": F.col("g_source").eqNullSafe(F.col("p_source")),
        "unit_ok": F.col("g_unit").eqNullSafe(F.col("p_unit")), "feature_ok": F.col("g_feature").eqNullSafe(F.col("p_feature")),
    })
    if menus is None:
        return out.withColumn("in_menu", F.lit(None).cast("boolean"))
    offered = menus.select("key", naming.token(F.col("uri")).alias("g_property"), F.lit(True).alias("_in")).distinct()
    return out.join(offered, ["key", "g_property"], "left").withColumn("in_menu", F.when(F.col("g_source") == "reuse", F.coalesce("_in", F.lit(False)))).drop("_in")


def _rate(hits: Column, total: Column) -> Column:
    return F.when(total > 0, hits / total).otherwise(0.0)


def layers(compared: DataFrame, marked: DataFrame, by: list[str] = []) -> DataFrame:
    """One row per group: coverage, spurious rate and the accuracy of every decision layer."""
    status = lambda s: F.count_if(F.col("status") == s)
    sides = compared.groupBy(*by).agg(
        (status("matched") + status("missed")).alias("n_gold"), (status("matched") + status("spurious")).alias("n_pred"),
        status("matched").alias("n_matched"), status("spurious").alias("n_spurious"),
    )
    hits = marked.groupBy(*by).agg(
        F.count("in_menu").alias("menu_total"), F.count_if("in_menu").alias("menu_hits"), F.count_if(~F.col("g_soft")).alias("strict_total"),
        F.count_if(~F.col("g_soft") & F.col("prop_ok")).alias("strict_hits"), *[F.count_if(c).alias(f"{n}_hits") for n, c in CHECKS.items()],
    )
    both = _beside(sides, hits, by)
    n = F.col("n_matched")
    zero = [c for c in hits.columns if c not in by]
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    return both.withColumns({
        "coverage": _rate(n, F.col("n_gold")), "spurious_rate": _rate(F.col("n_spurious"), F.col("n_pred")),
        "menu_recall": _rate(F.col("menu_hits"), F.col("menu_total")), "property_strict": _rate(F.col("strict_hits"), F.col("strict_total")),
        **{f"{name}_acc": _rate(F.col(f"{name}_hits"), n) for name in CHECKS},
    })


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Rows of two per-group results side by side; without groups both have one row."""
    return a.join(b, by, "left") if by else side_by_side(a, b)


def partition_agreement(pairs: DataFrame, by: list[str] = []) -> DataFrame:
    """Pair-counting precision, recall, F1 and adjusted Rand index of two labelings (a, b).

    Only the contingency table is grouped again; pairs are counted from group sizes, never listed.
    """
    two = lambda n: n.cast("double") * (n.cast("double") - 1) / 2
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    cells = pairs.groupBy(*by, text("a").alias("a"), text("b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, name: cells.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias(name))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("both"))
    out = _beside(_beside(total, side("a", "same_a"), by), side("b", "same_b"), by)
    p = F.when(F.col("same_b") > 0, F.col("both") / F.col("same_b")).otherwise(1.0)
    r = F.when(F.col("same_a") > 0, F.col("both") / F.col("same_a")).otherwise(1.0)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    expected = F.col("same_a") * F.col("same_b") / F.when(F.col("n") > 1, two(F.col("n")))
    most = (F.col("same_a") + F.col("same_b")) / 2
    ari = F.when((F.col("n") < 2) | (most == expected), 1.0).otherwise((F.col("both") - expected) / F.when(most != expected, most - expected))
    return out.withColumns({"precision": p, "recall": r}).withColumns({"f1": f1, "ari": ari}).select(*by, "n", "precision", "recall", "f1", "ari")


def sensor_agreement(compared: DataFrame, by: list[str] = []) -> DataFrame:
    matched = compared.where("status = 'matched'")
    return partition_agreement(matched.select(*by, F.col("g_sensor").alias("a"), F.col("p_sensor").alias("b")), by)


def harmonization(marked: DataFrame, by: list[str] = []) -> DataFrame:
    """Gold concepts of at least two matched columns, and whether these got one property, for each group of `by`.

    Distinct answers are counted first, so a list holds vocabulary entries, not columns.
    """
    answers = marked.groupBy(*by, "g_property", "p_property").agg(F.count(F.lit(1)).alias("n"))
    return answers.groupBy(*by, F.col("g_property").alias("concept")).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list("p_property")).alias("answers"), (F.count(F.lit(1)) == 1).alias("converged")
    ).where("n >= 2")


def harmonization_rate(groups: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return groups.agg(n.alias("groups"), F.count_if("converged").alias("converged"), _rate(F.count_if("converged"), n).alias("rate"))


def convergence(gold: DataFrame, pred: DataFrame, by: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """Answers per concept found in at least two dataset families: (summary, counts per family), for each group of `by`.

    Both sides carry `family`; a missing prediction is a null answer. Equal counts go to the first answer
    in text order, null last.
    """
    given, keys = gold.select(*by, "family", "key", F.col("property").alias("concept")), [*by, "family", "key"]
    rows = given.join(pred.select(*keys, F.col("property").alias("chosen")), keys, "left")
    counts = rows.groupBy(*by, "concept", "family", "chosen").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy(*by, "concept").agg(F.count_distinct("family").alias("families"), F.sum("n").alias("columns")).where("families >= 2")
    answers = counts.groupBy(*by, "concept", "chosen").agg(F.sum("n").alias("n")).groupBy(*by, "concept").agg(
        F.min_by(F.struct("chosen", "n"), F.struct(-F.col("n"), F.col("chosen").isNull(), F.col("chosen"))).alias("_top")
    )
    summary = spread.join(answers, [*by, "concept"]).select(
        *by, "concept", "families", "columns", F.col("_top.chosen").alias("most_common"), F.col("_top.n").alias("on_most_common"))
    return summary, counts.join(spread.select(*by, "concept"), [*by, "concept"], "left_semi")


def run_variance(metrics: DataFrame, names: list[str], by: list[str] = []) -> DataFrame:
    """Mean and population deviation of metrics over runs; null values are left out."""
    long = metrics.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])))
    return long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("runs"))


def stability(marked: DataFrame) -> DataFrame:
    """Per column over runs: correct runs and distinct answers (a column has as many rows as runs)."""
    return marked.groupBy("key").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("prop_ok").alias("correct_runs"), F.array_sort(F.collect_set("p_property")).alias("answers")
    )


def property_sources(registry: DataFrame, by: list[str] = []) -> DataFrame:
    return registry.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n"))


def demotions(resolved: DataFrame, gold: DataFrame) -> DataFrame:
    """Demoted columns per class, and how many of them the gold has (wrong demotions)."""
    gone = resolved.where(observable(F.col("role")) & (F.col("column_class") != "measurement")).select(F.col("column_key").alias("key"), "column_class")
    known = gone.join(gold.select("key", F.lit(True).alias("in_gold")).distinct(), "key", "left")
    return known.groupBy("column_class").agg(F.count(F.lit(1)).alias("demoted"), F.count("in_gold").alias("wrong_demotions"))


def phrase_agreement(phrases: DataFrame, runs: list[str], other: tuple[str, str]) -> DataFrame:
    """Keys with one phrase in all `runs`, and with one phrase in both runs of `other`; no phrase is a value too.

    `phrases` is (run, key, phrase) with one row per run and key.
    """
    of = lambda run: F.max(F.when(F.col("run") == run, F.col("phrase")))
    names = sorted({*runs, *other})
    wide = phrases.groupBy("key").agg(*[of(r).alias(r) for r in names])
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    every = F.lit(True)
    for r in runs[1:]:
        every = every & same(runs[0], r)
    return wide.agg(F.count(F.lit(1)).alias("keys"), F.count_if(every).alias("identical_runs"), F.count_if(same(*other)).alias("identical_other"))


def detection_confusion(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives and misses of two key sets."""
    f, e = found.select(*keys, F.lit(True).alias("_f")).distinct(), expected.select(*keys, F.lit(True).alias("_e")).distinct()
    return f.join(e, keys, "full").agg(
        F.count_if(F.col("_f") & F.col("_e")).alias("true_positive"), F.count_if(F.col("_f") & F.col("_e").isNull()).alias("false_positive"),
        F.count_if(F.col("_f").isNull() & F.col("_e")).alias("false_negative"),
    )


def unknown_identifiers(gold: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Gold identifiers no vocabulary has; minted ones are always fine.

    `gold` is (observedProperty, unit, feature_gwsw, accept), `vocabulary` (token).
    """
    none = F.array().cast("array<string>")
    every = F.concat(F.array("observedProperty", "unit", "feature_gwsw"), F.coalesce("accept", none))
    named = gold.select(F.explode(every).alias("token")).where(F.col("token").isNotNull() & ~F.col("token").rlike("^(mint|ex):")).distinct()
    return named.join(vocabulary.select("token").distinct(), "token", "left_anti")


def nonexistent_answers(gold: DataFrame, answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Answers given without a menu: accuracy on gold columns and identifiers in no vocabulary.

    `gold` is (key, property, source), `answers` (key, property_uri) with MINT for minting, `vocabulary` (token).
    """
    minted = F.coalesce("property_uri", F.lit("MINT")) == "MINT"
    rows = answers.select("key", minted.alias("minted"), F.when(~minted, naming.token(F.col("property_uri"))).alias("token"))
    known = vocabulary.select("token", F.lit(True).alias("_known")).distinct()
    rows = rows.join(known, "token", "left").withColumn("missing", ~F.col("minted") & F.col("_known").isNull()).drop("_known")
    own = rows.join(gold.select("key", "property", "source"), "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("token") == F.col("property")).alias("correct"),
        F.count_if((F.col("source") == "mint") == F.col("minted")).alias("reuse_mint"), F.count_if("minted").alias("minted"), F.count_if("missing").alias("missing_gold"),
    )
    every = rows.agg(F.count_if(~F.col("minted")).alias("uris_total"), F.count_if("missing").alias("uris_missing"))
    out = _beside(own, every, [])
    return out.withColumns({"property_acc": _rate(F.col("correct"), F.col("n")), "reuse_mint_acc": _rate(F.col("reuse_mint"), F.col("n"))})


def error_listing(compared: DataFrame, marked: DataFrame, by: list[str] = []) -> DataFrame:
    """Rows with a wrong property or unit, missed and spurious keys: (kind, key, gold, pred)."""
    row = lambda df, kind, g, p: df.select(*by, F.lit(kind).alias("kind"), "key", F.col(g).alias("gold"), F.col(p).alias("pred"))
    return (
        row(marked.where(~F.col("prop_ok")), "property", "g_property", "p_property")
        .unionByName(row(marked.where(~F.col("unit_ok")), "unit", "g_unit", "p_unit"))
        .unionByName(row(compared.where("status = 'missed'"), "missed", "g_property", "p_property"))
        .unionByName(row(compared.where("status = 'spurious'"), "spurious", "g_property", "p_property"))
    )


def key_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the union, the intersection and both differences of two key sets."""
    both = a.select("key", F.lit(1).alias("_a")).distinct().join(b.select("key", F.lit(1).alias("_b")).distinct(), "key", "full")
    return both.agg(
        F.count(F.lit(1)).alias("in_any"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"),
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
    )


def call_log_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Calls, seconds and tokens of external calls."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )


def for_runs(gold: DataFrame, runs: list, name: str = "run") -> DataFrame:
    """Gold rows once per run of a short list."""
    return gold.withColumn(name, F.explode(F.array(*[F.lit(r) for r in runs])))
