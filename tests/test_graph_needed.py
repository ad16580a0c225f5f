"""Graph queries build only the triples they look at."""

from obsweave.functions.fixed import RDF_TYPE
from obsweave.operators import graph, integrity
from obsweave.plans import given

SMOKE = "/root/testdata/sf0.001"


def test_names_are_those_of_the_triples(spark):
    names = lambda df: {r["o"] if r["p"] == RDF_TYPE else r["p"] for r in df.select("p", "o").where(f"p <> '{RDF_TYPE}' or o like 'http%'").groupBy("p", "o").count().collect()}
    samples = given.sample_rows(spark, SMOKE).limit(20)
    for name in graph.SAMPLE_NAMES:
        assert names(graph.sample_triples(samples, [name])) == {name}
    parts = given.observations(spark, SMOKE, "part").limit(20)
    for name in ("Observation", "madeBySensor", "observedProperty"):
        name = next(n for n in graph.OBSERVATION_NAMES if n.endswith("/" + name))
        assert names(graph.observation_triples(parts, [name])) == {name}
    assert graph.sample_triples(samples, []).count() == 0


def test_needed_triples_give_the_same_answer(spark):
    for name in ("unused", "sample_shape", "completeness"):
        part, whole = given.whole_graph(spark, SMOKE, integrity.NEEDED[name]), given.whole_graph(spark, SMOKE)
        check = getattr(integrity, name)
        assert sorted(map(str, check(part).collect())) == sorted(map(str, check(whole).collect()))


def test_a_question_does_not_build_other_predicates(spark):
    plan = integrity.unused(given.whole_graph(spark, SMOKE, integrity.NEEDED["unused"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "numericValue" not in plan
