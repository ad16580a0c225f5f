"""Two small datasets from folders to one graph."""

import pytest
from pyspark.sql import functions as F

from obsweave.functions.fixed import SOSA
from obsweave.operators import compete, graph, integrity, reshape, vocab
from obsweave.plans import build
from obsweave.sources import sinks, tables

CONCEPT = "http://www.eionet.europa.eu/gemet/concept/9190"
UNIT = "http://qudt.org/vocab/unit/"


@pytest.fixture(scope="module")
def datasets(spark, tmp_path_factory):
    one, two = tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("two")
    (one / "lab data").mkdir()
    (one / "inflow.csv").write_text("timestamp,water_level,flow,extra\n" + "".join(f"2020-01-01T00:{i:02d}:00+01:00,{i if i % 4 else ''},{i}.5,{i}\n" for i in range(12)))
    (one / "lab data" / "samples.csv").write_text("timestamp,COD1,COD2\n2020-01-01 10:00:00,5,6\n2020-01-02 10:00:00,7,\n")
    (two / "station.tsv").write_bytes("Time\tLevel[mm]\tµ\n01.01.2020 00:00\t1500,5\tx\n01.01.2020 00:05\t-20,5\ty\n".encode("latin-1"))

    def given(decisions, **tables_):
        df = lambda schema, key: spark.createDataFrame(tables_.get(key, []), schema)
        units = spark.createDataFrame([(UNIT + "M", ["m"], ["m"]), (UNIT + "MilliM", ["mm"], ["mm"]), (UNIT + "MilliGM-PER-L", ["mg/L"], [])], "uri string, ucum_codes array<string>, symbols array<string>")
        return build.Decisions(
            spark.createDataFrame(decisions, build.DECISION), df(build.ENTITY, "sensors"), df(build.FEATURE, "features"), df(build.ENTITY, "samplers"),
            df(build.SAMPLED, "sampled"), df(build.MENU, "menus"), vocab.units_index(units),
        )

    first = given(
        [
            ("inflow.csv::water_level", "probe", CONCEPT, None, "m", "channel", "measurement"), ("inflow.csv::flow", "probe", "MINT", "Water  level", "odd", "channel", None),
            ("inflow.csv::extra", "idle", "MINT", "Extra", None, "channel", "derived"), ("lab data/samples.csv::COD1", "lab", "MINT", "COD", "MG/L", None, None),
            ("lab data/samples.csv::COD2", "lab", "MINT", "cod ", "mg/l", "nowhere", "measurement"),
        ],
        sensors=[("probe", "Probe"), ("lab", ""), ("idle", "Idle")], features=[("channel", "Channel", "", "http://data.gwsw.nl/Kanaal"), ("spare", "", None, None)],
        samplers=[("bottle", "Bottle"), ("spare", "x")], sampled=[("lab data/samples.csv::x", "bottle", "channel")],
        menus=[("inflow.csv::water_level", "gemet", 1, CONCEPT, "water level")],
    )
    second = given([("station.tsv::Level[mm]", "s", "gemet:9190", None, " mm ", "pit", None), ("station.tsv::µ", "s", "http://nowhere", "Note", None, "pit", None)], sensors=[("s", "Station")], features=[("pit", "Pit", None, None)], menus=[("station.tsv::Level[mm]", "gemet", 1, CONCEPT, "water level")])
    out = []
    for root, name, decisions in ((one, "One", first), (two, "two", second)):
        found = build.profile_folder(spark, str(root), name)
        out.append((found, build.decide_columns(found, decisions)))
    return out


@pytest.fixture(scope="module")
def merged(datasets):
    return build.merged_graph(datasets).cache()


def test_decisions(datasets):
    got = {r["column_key"]: r for r in datasets[0][1].columns.collect()}
    level, flow, extra = got["inflow.csv::water_level"], got["inflow.csv::flow"], got["inflow.csv::extra"]
    assert (level["property_uri"], level["property_source"], level["unit_uri"]) == (CONCEPT, "gemet", UNIT + "M")
    assert (flow["property_uri"], flow["property_source"], flow["unit_uri"]) == ("http://example.org/property/water-level", "minted", None)
    assert (extra["property_uri"], extra["sensor_id"], extra["demoted"]) == (None, None, True)
    cod = [got[f"lab data/samples.csv::COD{i}"] for i in (1, 2)]
    assert [c["unit_uri"] for c in cod] == [UNIT + "MilliGM-PER-L"] * 2
    # the declared feature of the sampled file goes to all of its kept columns
    assert [(c["sampled"], c["sampler_id"], c["feature_id"]) for c in cod] == [(True, "bottle", "channel")] * 2


def test_declarations_are_pruned(datasets):
    got = {(r["kind"], r["uri"].rsplit("/", 1)[-1]): r["label"] for r in datasets[0][1].entities.collect()}
    assert got == {
        ("Sensor", "probe"): "Probe", ("Sensor", "lab"): "lab", ("FeatureOfInterest", "channel"): "Channel", ("Sampler", "bottle"): "Bottle",
        ("ObservableProperty", "9190"): "water level", ("ObservableProperty", "water-level"): "Water  level", ("ObservableProperty", "cod"): "COD",
    }


def test_closed_form_count(datasets):
    found, resolved = datasets[0]
    data, declared = build.dataset_graph(found, resolved)
    obs = build.observations(found, resolved)
    with_unit, values = obs.where("unit_uri is not null").count(), obs.where("value is not null").count()
    assert (obs.count(), with_unit) == (28, 16)
    # per observation: type, time, sensor, property, feature, result link; per result: type and unit; then the values
    expected = 5 * obs.count() + 3 * with_unit + values + 8 * 2
    assert data.count() == data.distinct().count() == expected
    # four types and labels of sensors and sampler, three properties, one feature with a class
    assert declared.count() == 2 * 2 + 2 + 2 * 3 + 3


def test_integrity(merged):
    assert {r["required"]: r["violations"] for r in integrity.cardinality(merged).collect() if r["violations"]} == {}
    assert integrity.dangling(merged).count() == 0
    assert integrity.unused(merged).count() == 0
    row = integrity.completeness(merged).first()
    assert (row["quantity_values"], row["without_value"], row["without_unit"], row["times_not_datetime"]) == (18, 4, 0, 0)
    shape = integrity.sample_shape(merged).first()
    assert (shape["samples"], shape["samplings"], shape["samples_with_feature"], shape["samplings_with_sampler"], shape["observations_about_a_sample"]) == (2, 2, 2, 2, 4)


def test_missing_results_are_reported(spark, rows):
    s = "http://example.org/obs/d/f/c/0"
    one = rows("s string, p string, o string, o_kind string, o_datatype string, o_lang string", (s, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", SOSA + "Observation", "iri", None, None), (s, SOSA + "madeBySensor", "x:1", "iri", None, None), (s, SOSA + "madeBySensor", "x:2", "iri", None, None))
    got = {r["required"]: r["violations"] for r in integrity.cardinality(one).collect()}
    assert got == {"resultTime": 1, "madeBySensor": 1, "observedProperty": 1, "hasFeatureOfInterest": 1, "hasResult|hasSimpleResult": 1}
    assert {r["predicate"]: r["n"] for r in integrity.dangling(one).collect()} == {"madeBySensor": 2}


def test_merge_equals_set_union(datasets, merged):
    parts = [t for d in datasets for t in build.dataset_graph(*d)]
    plain = graph.merge(*parts)
    assert merged.exceptAll(plain).count() == 0 and plain.exceptAll(merged).count() == 0
    # the shared concept is declared once
    assert merged.where((F.col("s") == CONCEPT) & (F.col("p").endswith("label"))).count() == 1


def test_questions(spark, datasets, merged):
    shared = compete.shared_properties(merged).collect()
    assert [(r["property_uri"], r["datasets"], r["observations"], r["which"]) for r in shared] == [(CONCEPT, 2, 14, "one, two")]
    units = spark.createDataFrame([(UNIT + "M", 1.0), (UNIT + "MilliM", 0.001), (UNIT + "K", 1.0)], "unit_uri string, multiplier double")
    used = compete.units_in_use(merged, units)
    got = compete.converted_range(graph.add(merged, graph.multipliers(used)), CONCEPT).collect()
    assert [(r["dataset"], r["n"], r["min_value"], r["max_value"]) for r in got] == [("one", 9, 1.0, 11.0), ("two", 2, -0.0205, pytest.approx(1.5005))]
    sensors = compete.sensors(merged, CONCEPT).collect()
    assert [(r["dataset"], r["label"], r["n"]) for r in sensors] == [("one", "Probe", 12), ("two", "Station", 2)]
    obs = graph.add(*[build.observations(*d).select("dataset", "property_uri", "unit_uri", "value_num", "sensor_uri") for d in datasets])
    assert compete.shared_properties_of_observations(obs).collect() == shared
    assert compete.converted_range_of_observations(obs, units, CONCEPT).collect() == got


def test_text_column_is_a_simple_result(merged):
    got = merged.where(F.col("p") == SOSA + "hasSimpleResult").where(F.col("s").contains("/two/")).select("o", "o_datatype").orderBy("o").collect()
    assert [tuple(r) for r in got] == [("x", "http://www.w3.org/2001/XMLSchema#string"), ("y", "http://www.w3.org/2001/XMLSchema#string")]


def test_times(merged):
    got = merged.where((F.col("p") == SOSA + "resultTime") & F.col("s").endswith("/0")).select("s", "o").distinct().collect()
    assert {r["s"].split("/")[4]: r["o"] for r in got if "/obs/" in r["s"] and "lab" not in r["s"]} == {"one": "2020-01-01T00:00:00+01:00", "two": "2020-01-01T00:00:00"}


def test_reconcile(datasets):
    found, resolved = datasets[0]
    data, declared = build.dataset_graph(found, resolved)
    row = integrity.reconcile(integrity.expected_counts(build.observations(found, resolved)), integrity.census(graph.add(data, declared))).first()
    assert row["observations_match"] and row["values_match"]


def test_row_cap(datasets):
    assert build.observations(*datasets[0], max_rows=1).count() == 4


def test_ntriples_round_trip(spark, merged, tmp_path):
    odd = spark.createDataFrame([("x:s", "x:p", 'a "b" \\ c\nd', "literal", None, "en")], merged.schema)
    both = graph.add(merged, odd)
    sinks.write_ntriples(both, str(tmp_path / "nt"))
    back = tables.ntriples(spark, str(tmp_path / "nt"))
    assert back.exceptAll(both).count() == 0 and both.exceptAll(back).count() == 0


def test_normalized_sink(spark, datasets, tmp_path):
    sinks.write_normalized(build.normalized(datasets[0][0]), str(tmp_path / "n"))
    back = spark.read.parquet(str(tmp_path / "n"))
    assert back.where("file_id = 'lab-data-samples' and value_col = 'COD2'").count() == 2


def test_evidence(spark, datasets, tmp_path):
    chunks = {r["source"]: r["text"] for r in build.evidence_chunks(spark, str(tmp_path), datasets[0][0], documentation=False).collect()}
    assert chunks["structure:lab data/samples.csv"].splitlines() == [
        "file: lab data/samples.csv", "folder: lab data", "  - column_key: lab data/samples.csv::COD1", "    name=COD1  observation=?  unit=?  samples=[5, 7]",
        "  - column_key: lab data/samples.csv::COD2", "    name=COD2  observation=?  unit=?  samples=[6.0]",
    ]


def test_retrieval_queries(spark, datasets):
    phrases = spark.createDataFrame([("inflow.csv::flow", " volume flow "), ("inflow.csv::extra", " "), ("other", "x")], "column_key string, phrase string")
    contexts = spark.createDataFrame([("water_level", "level in metres")], "column string, context string")
    got = {r["query_id"].split("::")[1]: r["text"] for r in build.retrieval_queries(datasets[0][0], phrases, contexts).collect()}
    assert got == {"water_level": "water level inflow level in metres", "flow": "volume flow", "extra": "extra inflow", "COD1": "COD1 samples", "COD2": "COD2 samples"}


def test_menus_from_a_folder_with_its_own_texts(spark, rows, tmp_path):
    (tmp_path / "d.csv").write_text("time,h1,q1\n2020-01-01T00:00:00Z,1,2\n")
    (tmp_path / "a.md").write_text("about\nh1 is the water level\nin metres\n\nend")
    (tmp_path / "b.txt").write_text("q1: discharge of the river")
    found = build.profile_folder(spark, str(tmp_path), "d")
    contexts = {r["column"]: r["context"] for r in build.metadata_contexts(spark, str(tmp_path), found).collect()}
    assert contexts == {"h1": "h1 is the water level in metres", "q1": "q1: discharge of the river"}
    other = rows("dataset_id string, column string, context string", ("d", "h1", "mine"), ("e", "h1", "of another dataset"))
    phrases = rows("column_key string, phrase string", ("none", "x"))
    assert {r["text"] for r in build.retrieval_queries(found, phrases, other).collect()} == {"h1 d mine", "q1 d"}
    corpus = rows(
        "source string, uri string, label string, tokens array<string>, embedding array<float>", ("v", "u1", "level", ["water", "level"], None),
        ("v", "u2", "discharge", ["discharge"], None), ("v", "u3", "other", ["nothing"], None), ("v", "u4", "more", ["else"], None), ("v", "u5", "rest", ["rest"], None))
    got = {(r["column_key"], r["rank"]): (r["uri"], r["label"]) for r in build.folder_menus(spark, str(tmp_path), found, phrases, corpus, 2).collect()}
    assert len(got) == 4 and got["d.csv::h1", 1] == ("u1", "level") and got["d.csv::q1", 1] == ("u2", "discharge")


def test_slug_collisions(rows):
    cols = rows("dataset_id string, file_id string, value_col string", ("d", "f", "a b"), ("d", "f", "a-b"), ("d", "g", "a b"))
    assert [r["slug"] for r in reshape.slug_collisions(cols).collect()] == ["a-b"]


def test_equal_slugs_share_one_observation(spark, tmp_path):
    (tmp_path / "f.csv").write_text("time,a b,a-b\n2020-01-01 10:00:00,1,1\n")
    found = build.profile_folder(spark, str(tmp_path), "d")
    none = lambda schema: spark.createDataFrame([], schema)
    given = build.Decisions(
        spark.createDataFrame([(f"f.csv::{c}", "s", "MINT", "x", None, None, None) for c in ("a b", "a-b")], build.DECISION), none(build.ENTITY), none(build.FEATURE), none(build.ENTITY),
        none(build.SAMPLED), none(build.MENU), none("key string, unit_uri string"),
    )
    data, _ = build.dataset_graph(found, build.decide_columns(found, given))
    assert data.count() == 5


def test_files_with_one_id_are_refused(spark, tmp_path):
    for name in ("a b.csv", "a-b.csv"):
        (tmp_path / name).write_text("time,v\n2020-01-01 10:00:00,1\n")
    found = build.profile_folder(spark, str(tmp_path), "d")
    none = lambda schema: spark.createDataFrame([], schema)
    given = build.Decisions(
        spark.createDataFrame([(f"{f}::v", "s", "MINT", "x", None, None, None) for f in ("a b.csv", "a-b.csv")], build.DECISION), none(build.ENTITY), none(build.FEATURE), none(build.ENTITY),
        none(build.SAMPLED), none(build.MENU), none("key string, unit_uri string"),
    )
    with pytest.raises(ValueError, match="a-b"):
        build.decide_columns(found, given)
