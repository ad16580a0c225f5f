"""What the physical plans must look like, and every registered query against its SQL form."""

import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry
from check import TABLES, compare
from obsweave.operators import graph, profile
from obsweave.plans import catalog, given, relating
from obsweave.streaming import append

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    line = compare(spark, con, SMALL, name, catalog.queries()[name], catalog.oracles()[name])
    assert " ok " in line and "CROSS" not in line, line


def test_entry(spark):
    assert entry(spark).count() > 0


def test_triples_need_no_shuffle(spark):
    text = plan(graph.observation_triples(given.observations(spark, SMALL, "events")))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    # one scan for all value columns and predicates, of the needed columns only
    assert text.count("FileScan") == 1 and "event_type" not in text


def test_scan_gets_filters_and_columns(spark):
    text = plan(relating.time_window_scan(spark, SMALL))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text and "props" not in text


def test_head_of_columns_is_cut_before_the_shuffle(spark):
    rows = profile.as_rows(spark.range(10).selectExpr("id", "cast(id as string) as v"), "f", F.col("id"), ["v"])
    assert "WindowGroupLimit" in plan(profile.first_values(profile.cells(rows), 5))


def test_mapping_is_not_broadcast_beyond_its_bound(spark):
    from obsweave.session import join_small

    big, small = spark.range(100), spark.range(50).repartition(3)
    assert "BroadcastHashJoin" in plan(join_small(big, small, "id", "inner", limit=50))
    assert join_small(big, small, "id", "inner", limit=49).count() == 50
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan(join_small(big, small, "id", "inner", limit=49))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream_equals_batch(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    parts = given.long(spark, SMALL, "orders").repartition(3)
    parts.write.parquet(str(source))
    stream = append.read_stream(spark, str(source), parts.schema)
    triples = append.stream_triples(stream, given.mapping(spark))
    name = f"orders-{uuid.uuid4().hex}"  # the shared folder keeps what earlier sessions read
    for _ in range(2):  # the second run finds nothing new
        append.write_stream(triples, str(sink), name).awaitTermination()
    want = graph.observation_triples(given.observations(spark, SMALL, "orders"))
    got = spark.read.parquet(str(sink))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_spellings_are_dealt_out_before_they_are_sorted(spark):
    from obsweave.operators import vocab

    units = spark.createDataFrame([(f"u{i % 50:02}", ["m²"], [f"x{i}"]) for i in range(200)], "uri string, ucum_codes array<string>, symbols array<string>")
    found = vocab.units_index(units)
    lowest = plan(found).splitlines()
    aggregates = [i for i, line in enumerate(lowest) if "Aggregate" in line]
    assert "_salt" in " ".join(line for line in lowest[aggregates[-1]:] if "Exchange hashpartitioning" in line)
    got = {r["key"]: r["unit_uri"] for r in found.collect()}
    assert got["m²"] == got["m2"] == "u00" and got["x149"] == "u49" and len(got) == 202
