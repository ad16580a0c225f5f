import json
import random

from pyspark.sql import functions as F

from obsweave.operators import decide, evidence, relational
from obsweave.operators.numbering import number_by, number_in_order
from obsweave.sources import sinks

FACTS = "timestamp string, variable string, site string, device string, device_type string, value double"


def test_special_values_and_pivot(spark, rows, tmp_path):
    facts = rows(
        FACTS, ("t1", "h", "s", "d", "k", 1.0), ("t1", "q", "s", "d", "k", -999.0), ("t2", "h", "s", "d", "k", -999.0), ("t3", "h", "s", "e", "m", -999.0), ("t1", "h", "s", "d", "k", 2.0),
    )
    special = rows("device_type string, value double", ("k", -999.0), ("k", None))
    clean = relational.null_special_values(facts, special).withColumn("n", F.monotonically_increasing_id())
    assert clean.where("value is null").count() == 2
    wide = relational.to_wide(clean, ["site", "device", "timestamp"], ["h", "q"], ["value"])
    # t2 has no value left and vanishes
    assert {tuple(r) for r in wide.collect()} == {("s", "d", "t1", 1.0, None), ("s", "e", "t3", -999.0, None)}
    sinks.write_sites(wide, str(tmp_path / "w"))
    assert (tmp_path / "w" / "site=s" / "device=e").exists()
    files = relational.device_files(clean)
    assert {(r["device"], tuple(r["variables"]), r["n_rows"]) for r in files.collect()} == {("d", ("h",), 1), ("e", ("h",), 1)}


def test_site_metadata(rows):
    files = rows("site string, device string, variables array<string>, n_rows long", ("s", "d", ["h", "q"], 1))
    devices = rows("device string, device_type string, serial string, description string", ("d", "k", None, "x"))
    variables = rows("variable string, unit string, description string", ("h", "m", "level"), ("q", "l/s", None))
    special = rows("device_type string, value double, meaning string", ("k", -1.0, "off"))
    doc = json.loads(relational.site_metadata(files, devices, variables, rows("site string, description string", ("s", "here")), special).first()["metadata"])
    assert doc == {
        "site": {"site": "s", "description": "here"},
        "devices": [{"device": "d", "file": "d.csv", "serial": None, "description": "x", "device_type": "k", "type_description": None, "manufacturer": None, "special_values": [{"value": -1.0, "meaning": "off"}]}],
        "variables": [{"variable": "h", "unit": "m", "description": "level"}, {"variable": "q", "unit": "l/s", "description": None}],
    }


def test_greedy_cover(spark):
    rng = random.Random(3)
    sites = {f"s{i:02d}": {f"v{rng.randrange(40)}" for _ in range(rng.randint(1, 9))} for i in range(15)}
    cost = {s: rng.randint(1, 3) + len(v) for s, v in sites.items()}
    left, want = set().union(*sites.values()), []
    while left:
        best = min(sites, key=lambda s: (-len(left & sites[s]), cost[s], s))
        want.append(best)
        left -= sites[best]
    pairs = spark.createDataFrame([(s, v) for s, vs in sites.items() for v in vs], "site string, variable string")
    costs = spark.createDataFrame(list(cost.items()), "site string, columns int")
    got = relational.greedy_cover(pairs, costs).orderBy("step").collect()
    assert [r["site"] for r in got] == want


def test_sites_that_share_nothing_are_taken_in_one_round(rows, monkeypatch):
    rounds = []
    staged = relational.staged
    monkeypatch.setattr(relational, "staged", lambda df, name: rounds.append(name) or staged(df, name))
    pairs = [(f"s{i:02d}", f"v{i}-{k}") for i in range(30) for k in range(1 + i % 3)] + [("t", "v0-0"), ("no cost", "w")]
    costs = rows("site string, columns int", *[(f"s{i:02d}", 2) for i in range(30)], ("t", 1))
    got = relational.greedy_cover(rows("site string, variable string", *pairs), costs).orderBy("step").collect()
    assert [(r["step"], r["gain"]) for r in got] == [(i + 1, 3 - i // 10) for i in range(30)] and "s00" not in {r["site"] for r in got}
    assert rounds.count("cover-taken") == 1


def test_number_by_across_buckets(spark):
    df = spark.range(0, 1000).where("id % 3 = 0").withColumnRenamed("id", "ord")
    got = number_by(df, "ord", "no", bucket=50).orderBy("ord").collect()
    assert [r["no"] for r in got] == list(range(1, len(got) + 1))


def test_shared_lists_are_named_as_first_seen(rows):
    columns = rows("column_key string, ord long", ("c", 1), ("a", 2), ("b", 3))
    menus = rows("column_key string, source string, rank int, uri string, label string", ("a", "g", 2, "u/2", "two"), ("a", "g", 1, "u/1", "one"), ("b", "g", 1, "u/3", "x"), ("c", "g", 1, "u/1", "uno"), ("c", "g", 2, "u/2", "two"))
    got = {r["column_key"]: (r["list_name"], r["curies"]) for r in decide.shared_lists(menus, columns).collect()}
    assert got == {"c": ("L1", ["g:1", "g:2"]), "a": ("L1", ["g:1", "g:2"]), "b": ("L2", ["g:3"])}
    labels = {r["curie"]: r["label"] for r in decide.shared_concepts(menus, columns).collect()}
    assert labels == {"g:1": "uno", "g:2": "two", "g:3": "x"}


def brute_context(name, text):
    """The documented rule on one text, line by line, for plain word names."""
    import re
    lines = text.split("\n")
    kept, chars = [], 0
    bad = lambda x: len(x) > 160 or "http" in x.lower()
    for i, line in enumerate(lines):
        if bad(line):
            continue
        if re.search(rf"\b{re.escape(name)}\b", line, re.I):
            for near in (x.strip() for x in lines[i:i + 3]):
                if near and not bad(near) and near not in kept:
                    kept.append(near)
                    chars += len(near)
        if chars > 200:
            break
    return " ".join(kept)


def test_metadata_context(spark):
    rng = random.Random(5)
    words = ["level", "flow", "Level", "pH[]", "http://x", "levels", "y" * 170, "metres", " "]
    docs, texts = [], {}
    for ds in ("a", "b", "c"):
        parts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) for _ in range(5)]
        parts[1] = "one line level"
        docs += [(ds, i, p) for i, p in enumerate(parts)]
        texts[ds] = "\n".join(parts)
    names = ["level", "flow", "metres"]
    documents = spark.createDataFrame(docs, "dataset_id string, ord int, text string")
    wanted = spark.createDataFrame([(d, n) for d in texts for n in names + ["none"]], "dataset_id string, column string")
    got = {(r["dataset_id"], r["column"]): r["context"] for r in evidence.metadata_context(documents, wanted).collect()}
    want = {(d, n): brute_context(n, t) for d, t in texts.items() for n in names}
    assert got == {k: v for k, v in want.items() if v}
    plan = evidence.metadata_context(documents, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_of_several_words_of_signs_and_of_any_case(rows):
    text = "The Water Level_1 here\nwater-level\nwater  level\nÜBERLAUF: m%s\n%\nx water levels"
    names = ["water level_1", "level", "Überlauf", "%", "water level", "m%s"]
    got = evidence.metadata_context(rows("dataset_id string, ord int, text string", ("d", 0, text)), rows("dataset_id string, column string", *[("d", n) for n in names]))
    found = {r["column"]: r["context"] for r in got.collect()}
    want = {n: brute_context(n, text) for n in names}
    assert found == {k: v for k, v in want.items() if v} and set(found) == {"water level_1", "level", "Überlauf", "%", "m%s"}


def test_long_structure_chunk_is_cut_the_same(spark):
    n = 1000
    cols = spark.createDataFrame([("d/f.csv", i, f"column {i}", "unknown", [str(i)]) for i in range(n)], "file string, pos int, column string, role string, sample_values array<string>")
    text = evidence.structure_chunks(cols).first()["text"]
    lines = ["file: d/f.csv", "folder: d"]
    for i in range(n):
        lines += [f"  - column_key: d/f.csv::column {i}", f"    name=column {i}  observation=?  unit=?  samples=[{i}]"]
    assert text == "\n".join(lines)[:20000] + "\n…[truncated]"


def test_numbers_in_order_over_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") % 10 == 1, "rare").otherwise("hot")).alias("key"), (F.col("id") * 7919 % 5000).alias("x"), "id")
    got = number_in_order(rows.repartition(9), ["key"], [F.desc("x")], "no").collect()
    for key in (None, "rare", "hot"):
        own = sorted((r for r in got if r["key"] == key), key=lambda r: -r["x"])
        assert [r["no"] for r in own] == list(range(1, len(own) + 1)) and own
    whole = number_in_order(rows, [], ["x"], "no")
    assert whole.where("no <> x + 1").isEmpty() and whole.count() == 5000
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan
    assert number_in_order(rows.limit(0), [], ["x"], "no").count() == 0
