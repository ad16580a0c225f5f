import pytest
from pyspark.sql import functions as F

from obsweave.functions import fixed, naming, text, values


def value(spark, column, *cells):
    """The expression over literal cells, evaluated per row."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_slug(spark):
    assert value(spark, naming.slug, "Level (MSL)[m]", "pH[]", " -a  b- ", "[µg/L]", "[g/L]") == ["level-msl-m", "ph", "a-b", "g-l", "g-l"]


def test_file_id_drops_suffix_only(spark):
    assert value(spark, naming.file_id, "lab data/samples.v2.csv", "a.b/c", "x.tsv") == ["lab-data-samples-v2", "a-b-c", "x"]


def test_scoped_uri(spark):
    ds = F.lit("Data Set")
    assert value(spark, lambda c: naming.scoped_uri("sensor", ds, c), "S 1", None) == ["http://example.org/sensor/data-set/s-1", None]


def test_token(spark):
    got = value(
        spark, naming.token, "http://qudt.org/vocab/quantitykind/Velocity", "http://qudt.org/vocab/unit/M/", "http://www.eionet.europa.eu/gemet/concept/9190",
        "http://data.gwsw.nl/1.6/totaal/Put", "http://example.org/property/x-y", "ex:property/x", "gemet:1", "", None,
    )
    assert got == ["qudt:Velocity", "unit:M", "gemet:9190", "gwsw:Put", "mint:x-y", "mint:x", "gemet:1", None, None]


def test_unit_token_merges_one_pair(spark):
    assert value(spark, naming.unit_token, "unit:MicroS-PER-CentiM", "http://qudt.org/vocab/unit/MicroS-PER-CM") == ["unit:MicroS-PER-CM"] * 2


def test_dataset_of(spark):
    assert value(spark, naming.dataset_of, "http://example.org/obs/lab/f/c/0", "other") == ["lab", "other"]


def test_clean_term(spark):
    got = value(spark, text.clean_term, "COD2", "flow_rate", "waterTemp", "0033900601", "Lvl-12/3", "NH4")
    # the digit of NH4 is cut before the abbreviation is looked up
    assert got == ["chemical oxygen demand", "flow rate", "water temperature", "", "level", "NH"]


def test_tokens_split_at_any_space(spark):
    assert value(spark, text.tokens, " A_b C\td ") == [["a", "b", "c", "d"]]


def test_query_text_phrase_replaces_name_and_stem(spark):
    no = F.lit(None).cast("string")
    q = lambda phrase, context: lambda c: text.query_text(c, F.lit("in-flow_1"), phrase, context)
    assert value(spark, q(no, no), "flow_rate") == ["flow rate in flow 1"]
    assert value(spark, q(F.lit("volume flow"), F.lit("ctx")), "flow_rate") == ["volume flow ctx"]


def test_escape_and_truncate(spark):
    assert value(spark, text.escape, 'a"b\\c\nd\re') == ['a\\"b\\\\c\\nd\\re']
    assert value(spark, lambda c: text.truncate(c, 3), "abcd", "abc") == ["abc" + fixed.TRUNCATED, "abc"]


def test_fold_unit(spark):
    assert value(spark, text.fold_unit, " µS /cm ", "m³·s", "m m") == ["uS/cm", "m3.s", "mm"]
    assert value(spark, text.unit_alias, "deg C", "LPS", "x") == ["Cel", "L/s", None]


def test_number_gate(spark):
    got = value(spark, values.number, "1.5", "+5", ".5", "5.", "1e3", " 5 ", "1d", "0x1", "OL", "", None)
    assert got == [1.5, 5.0, 0.5, 5.0, 1000.0, 5.0, None, None, None, None, None]


@pytest.mark.parametrize("fmt,cell,want", [
    ("%Y-%m-%dT%H:%M:%S%z", "2008-08-28T14:21:00+01:00", "2008-08-28T14:21:00+01:00"),
    ("%Y-%m-%dT%H:%M:%S%z", "2008-08-28T14:21:00+0200", "2008-08-28T14:21:00+02:00"),
    ("%Y-%m-%dT%H:%M:%S%z", "2008-08-28T14:21:00Z", "2008-08-28T14:21:00+00:00"),
    ("%Y-%m-%dT%H:%M:%S%z", "2008-08-28T14:21:00", None),
    ("%d.%m.%Y %H:%M", "1.2.2020 3:04", "2020-02-01T03:04:00"),
    ("%d/%m/%Y %H:%M:%S", "31/02/2020 00:00:00", None),
    ("%Y-%m-%d", "2020-01-02", "2020-01-02T00:00:00"),
    ("AMBIGUOUS", "03-04-2020 10:00", "2020-04-03T10:00:00"),
    ("AMBIGUOUS", "2024-01-01T00:00:07.179575", "2024-01-01T00:00:07.179575"),
    ("%Y-%m-%d", "n/a", None),
])
def test_times_keep_their_offset(spark, fmt, cell, want):
    df = spark.createDataFrame([(cell, fmt)], "c string, f string").withColumn("t", values.local_time(F.col("c"), F.col("f")))
    assert df.select(values.with_offset(F.col("t"), F.col("c"), F.col("f"))).first()[0] == want


def test_duration_text(spark):
    df = spark.createDataFrame([(300_000_000,), (-3_300_000_000,), (86_400_000_001,)], "m long")
    assert [r[0] for r in df.select(values.duration_text(F.col("m"))).collect()] == ["0 days 00:05:00", "-1 days +23:05:00", "1 days 00:00:00.000001"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert df.select(values.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2 ** -0.5)
