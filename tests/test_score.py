import itertools
import json
import random

import pytest

from obsweave.operators import score
from obsweave.sources import sinks, tables

GOLD = "key string, property string, source string, unit string, feature string, sensor string, accept array<string>, soft boolean"
PRED = "key string, property string, source string, unit string, feature string, sensor string"


@pytest.fixture
def sides(rows):
    gold = rows(
        GOLD, ("a", "gemet:1", "reuse", "unit:M", "untyped", "s1", [], False), ("b", "mint:x", "mint", None, "gwsw:P", "s1", [], True),
        ("c", "gemet:1", "reuse", "unit:M", "untyped", "s2", ["gemet:7"], False), ("d", "gemet:2", "reuse", None, "untyped", "s2", ["mint:*"], False), ("e", "gemet:3", "reuse", None, "untyped", "s3", [], False),
    )
    pred = rows(
        PRED, ("a", "gemet:1", "reuse", "unit:M", "untyped", "p1"), ("b", "mint:other", "mint", None, "untyped", "p1"), ("c", "gemet:7", "reuse", "unit:K", "untyped", "p1"),
        ("d", "mint:q", "mint", None, "untyped", "p2"), ("z", "gemet:9", "reuse", None, "untyped", "p2"),
    )
    return gold, pred


def test_layers(rows, sides):
    compared = score.compare(*sides)
    menus = rows("key string, uri string", ("a", "http://x/concept/1"), ("c", "http://x/concept/7"), ("b", "http://x/concept/1"))
    row = score.layers(compared, score.mark(compared, menus)).first()
    assert (row["n_gold"], row["n_pred"], row["n_matched"], row["n_spurious"]) == (5, 5, 4, 1)
    assert (row["coverage"], row["spurious_rate"]) == (0.8, 0.2)
    assert (row["menu_hits"], row["menu_total"]) == (1, 3)
    assert (row["property_hits"], row["property_lenient_hits"], row["reuse_mint_hits"], row["unit_hits"], row["feature_hits"]) == (2, 4, 3, 3, 3)
    assert (row["strict_hits"], row["strict_total"], row["property_acc"]) == (1, 3, 0.5)


def test_layers_without_a_match(rows):
    gold, pred = rows(GOLD, ("a", "p", "reuse", None, "untyped", "s", [], False)), rows(PRED, ("b", "p", "reuse", None, "untyped", "s"))
    compared = score.compare(gold, pred)
    row = score.layers(compared, score.mark(compared)).first()
    assert (row["coverage"], row["property_acc"], row["menu_recall"]) == (0.0, 0.0, 0.0)


def test_error_listing(sides):
    compared = score.compare(*sides)
    got = {(r["kind"], r["key"]) for r in score.error_listing(compared, score.mark(compared)).collect()}
    assert got == {("property", "c"), ("property", "d"), ("unit", "c"), ("missed", "e"), ("spurious", "z")}


def test_harmonization(sides):
    groups = score.harmonization(score.mark(score.compare(*sides)))
    assert [(r["concept"], r["n"], r["answers"], r["converged"]) for r in groups.collect()] == [("gemet:1", 2, ["gemet:1", "gemet:7"], False)]
    assert score.harmonization_rate(groups).first()["rate"] == 0.0


def brute_agreement(pairs):
    tp = fp = fn = tn = 0
    for (a, b), (c, d) in itertools.combinations(pairs, 2):
        tp += a == c and b == d
        fn += a == c and b != d
        fp += a != c and b == d
        tn += a != c and b != d
    n = tp + fp + fn + tn
    p, r = tp / (tp + fp) if tp + fp else 1.0, tp / (tp + fn) if tp + fn else 1.0
    if not n:
        return p, r, 1.0
    expected, most = (tp + fn) * (tp + fp) / n, ((tp + fn) + (tp + fp)) / 2
    return p, r, 1.0 if most == expected else (tp - expected) / (most - expected)


@pytest.mark.parametrize("n,a,b", [(1, 1, 1), (2, 1, 1), (2, 2, 2), (40, 4, 3), (60, 5, 60), (30, 1, 6)])
def test_partition_agreement(spark, n, a, b):
    rng = random.Random(n)
    pairs = [(f"a{rng.randrange(a)}", f"b{rng.randrange(b)}") for _ in range(n)]
    row = score.partition_agreement(spark.createDataFrame(pairs, "a string, b string")).first()
    assert (row["precision"], row["recall"], row["ari"]) == pytest.approx(brute_agreement(pairs))


def test_missing_sensor_is_a_group(rows):
    assert score.partition_agreement(rows("a string, b string", (None, "x"), (None, "x"), ("s", "y"))).first()["ari"] == 1.0


def test_convergence(rows):
    gold = rows("family string, key string, property string", ("x", "1", "c"), ("y", "1", "c"), ("y", "2", "c"), ("x", "2", "d"))
    pred = rows("family string, key string, property string", ("x", "1", "p"), ("y", "1", "q"))
    summary, counts = score.convergence(gold, pred)
    assert [tuple(r) for r in summary.collect()] == [("c", 2, 3, "p", 1)]
    assert {tuple(r) for r in counts.collect()} == {("c", "x", "p", 1), ("c", "y", "q", 1), ("c", "y", None, 1)}


def test_run_variance_ignores_null(rows):
    got = {r["metric"]: (r["mean"], r["std"], r["runs"]) for r in score.run_variance(rows("run int, a double, b double", (1, 1.0, None), (2, 3.0, 2.0)), ["a", "b"]).collect()}
    assert got == {"a": (2.0, 1.0, 2), "b": (2.0, 0.0, 1)}


def test_phrase_agreement_counts_missing_phrases(rows):
    phrases = rows("run string, key string, phrase string", ("r1", "a", "x"), ("r2", "a", "x"), ("r3", "a", "x"), ("r1", "b", "x"), ("r2", "b", "x"), ("o", "c", "y"), ("r1", "d", "z"), ("r2", "d", "z"), ("r3", "d", "w"), ("o", "d", "z"))
    row = score.phrase_agreement(phrases, ["r1", "r2", "r3"], ("r1", "o")).first()
    # c has no phrase in any of the three runs
    assert (row["keys"], row["identical_runs"], row["identical_other"]) == (4, 2, 1)


def test_confusion(rows):
    row = score.detection_confusion(rows("f string", ("a",), ("b",)), rows("f string", ("b",), ("c",), ("d",)), ["f"]).first()
    assert tuple(row) == (1, 1, 2)


def test_gold_file(spark, tmp_path):
    doc = {"dataset": "g", "observations": [
        {"file": "f.csv", "column": "c", "observedProperty": "gemet:1", "decision": "reuse", "unit": "unit:MicroS-PER-CentiM", "feature_gwsw": None, "sensor": "s", "accept": ["mint:*", "ex:property/y"], "note": "Expert: ok"},
        {"file": "f.csv", "column": "d / e", "observedProperty": "ex:property/x", "decision": "mint", "unit": None, "feature_gwsw": "gwsw:P", "sensor": "s"},
    ]}
    (tmp_path / "gold.json").write_text(json.dumps(doc))
    got = score.gold_rows(tables.gold(spark, str(tmp_path / "gold.json"))).orderBy("column").collect()
    assert [(r["property"], r["unit"], r["feature"], r["accept"], r["soft"]) for r in got] == [
        ("gemet:1", "unit:MicroS-PER-CM", "untyped", ["mint:*", "mint:y"], True), ("mint:x", None, "gwsw:P", [], False),
    ]


def test_report_and_feature_classes(spark, rows, tmp_path):
    sinks.write_report(rows("a int", (1,)), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["a"] == 1
    (tmp_path / "v.jsonl").write_text('{"uri": "u", "label_nl": "Put", "def_en": "A pit."}\n')
    from obsweave.operators.vocab import feature_class_doc
    assert tables.feature_classes(spark, str(tmp_path / "v.jsonl")).select(feature_class_doc()).first()[0] == "Put. A pit. (Put)"


def test_call_log(rows):
    log = rows("config string, seconds double, input_tokens long, output_tokens long", ("a", 1.0, 2, 3), ("a", 3.0, 4, 5))
    assert tuple(score.call_log_summary(log, ["config"]).first()) == ("a", 2, 4.0, 2.0, 3.0, 6, 8)
