import pytest
from pyspark.sql import functions as F

from netquill.operators import boolnet, components
from netquill.plans.catalogue import feedback

# Golden rows: transfer, gate, stimulus, rows, attractor length, last row, areas.
GOLDEN = [
    ("identity", "min", 0.1, 5, 1, (0.1, 0.1, 0.1, 0.1), (0.4, 0.35, 0.25, 0.15)),
    ("identity", "min", 0.6, 9, 4, (0.6, 0.6, 0.4, 0.6), (4.8, 4.5, 3.4, 2.9)),
    ("identity", "min", 1.0, 9, 4, (1, 1, 0, 1), (8.0, 7.5, 4.0, 3.5)),
    ("identity", "prod", 0.1, 15, 1, (0.1, 0.1, 0.090909, 0.090909), (1.4, 1.35, 1.152893, 1.061984)),
    ("identity", "prod", 0.7, 79, 1, (0.7, 0.7, 0.411765, 0.411764), (54.6, 54.25, 31.8391, 31.427335)),
    ("identity", "prod", 0.8, 102, 0, (0.8, 0.8, 0.444438, 0.444438), (80.8, 80.4, 44.617281, 44.172843)),
    ("hill", "min", 0.3, 5, 1, (0.3, 0.162664, 0.029373, 0.000177), (1.2, 0.569324, 0.073431, 0.000266)),
    ("hill", "min", 0.8, 9, 4, (0.8, 0.880168, 0.013296, 0.970397), (6.4, 6.601257, 3.783311, 3.396423)),
    ("hill", "prod", 0.5, 57, 4, (0.5, 0.500025, 0.256182, 0.492842), (28.0, 27.751375, 20.666766, 16.333603)),
]


def stimulus(rows, *values):
    return rows([(f"a{v}", 0, v, None, None, None) for v in values], "scenario_id string, var_id long, stim double, act double, inh double, init double")


@pytest.mark.parametrize(("transfer", "gate", "a", "n", "cycle", "last", "areas"), GOLDEN)
def test_golden_tracks(spark, rows, transfer, gate, a, n, cycle, last, areas):
    v, i = feedback(spark)
    v = v.withColumn("identical", F.lit(transfer == "identity"))
    track = boolnet.simulate(v, i, stimulus(rows, a), transfer=transfer, gate=gate).cache()
    assert track.agg(F.max("t")).first()[0] + 1 == n
    assert track.where("in_attractor").select("t").distinct().count() == cycle
    assert track.select("reached").distinct().first()[0] is (cycle > 0)
    end = [r["value"] for r in track.where(f"t = {n - 1}").orderBy("var_id").collect()]
    assert end == pytest.approx(list(last), abs=2e-6)
    assert [r["auc"] for r in boolnet.area(track).orderBy("var_id").collect()] == pytest.approx(list(areas), abs=5e-5)


@pytest.mark.parametrize(("transfer", "length", "want"), [("identity", 9, (-0.14285714, -0.14285714, -0.04225352, -0.04918033)), ("identity", 100, (-0.14285714, -0.14285714, -0.0030581, -0.00103413)), ("hill", 100, (-0.14285714, -0.14402089, -0.06454209, -0.07757023))])
def test_golden_changes(spark, rows, transfer, length, want):
    v, i = feedback(spark)
    v = v.withColumn("identical", F.lit(False))
    run = lambda a: boolnet.simulate(v, i, stimulus(rows, a), transfer=transfer)
    got = boolnet.compared(run(0.8), run(0.6), length).orderBy("key").collect()
    assert [r["change"] for r in got] == pytest.approx(list(want), abs=1e-7)


@pytest.mark.parametrize("keep_larger", [False, True])
def test_table_steps_equal_kernel(spark, rows, keep_larger):
    """Tracks, attractors and whether they are reached, of scenarios that end at different times."""
    v, i = feedback(spark)
    sc = stimulus(rows, 0.1, 0.8).union(rows([("b", 1, 0.4, None, 0.2, None), ("b", 0, None, 0.3, None, 0.5)], "scenario_id string, var_id long, stim double, act double, inh double, init double"))
    options = {"transfer": "identity", "keep_larger": keep_larger}
    key = lambda d: sorted((r["scenario_id"], r["t"], r["var_id"], round(r["value"], 9), r["in_attractor"], r["reached"]) for r in d.collect())
    assert key(boolnet.simulate_table(v, i, sc, **options)) == key(boolnet.simulate(v, i, sc, **options))


def test_table_without_attractor(spark, rows):
    v, i = feedback(spark)
    t = boolnet.simulate_table(v, i, stimulus(rows, 0.8), transfer="identity", gate="prod", rounds=4)
    assert t.agg(F.max("t")).first()[0] == 5 and not t.where("in_attractor OR reached").count()


def test_modified_inputs_and_unknown_names(spark, rows):
    v, i = feedback(spark)
    sc = rows([("x", 0, None, None, 0.5, 0.8), ("x", 77, 1.0, None, None, None)], "scenario_id string, var_id long, stim double, act double, inh double, init double")
    t = boolnet.simulate(v, i, sc, transfer="identity")
    assert t.where("t = 0 AND var_id = 0").first()["value"] == pytest.approx(0.4)
    names = rows([(0, "A"), (1, "B"), (2, "B")], "var_id long, name string")
    assert boolnet.named_stimuli(names, rows([("s", "A", 1.0), ("s", "Z", 1.0)], "scenario_id string, name string, stim double")).count() == 1
    with pytest.raises(Exception, match="several variables"):
        boolnet.named_stimuli(names, rows([("s", "B", 1.0)], "scenario_id string, name string, stim double")).collect()


def test_not_reached_gives_null(spark, rows):
    v, i = feedback(spark)
    run = lambda a: boolnet.simulate(v, i, stimulus(rows, a), transfer="identity", gate="prod")
    assert all(r["change"] is None for r in boolnet.compared(run(0.8), run(0.1), 10).collect())


def test_cycles_and_components(spark, rows):
    e = rows([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (7, 8), (8, 7), (5, 7), (None, 3)], "a long, b long")
    assert sorted(r["node"] for r in components.on_cycles(e).collect()) == [1, 2, 3, 6, 7, 8]
    c = {r["node"]: r["root"] for r in components.components(rows([(5, 6), (6, 7), (1, 9), (9, 3), (2, 2)], "a long, b long")).collect()}
    assert c == {5: 5, 6: 5, 7: 5, 1: 1, 9: 1, 3: 1}
    link = components.linked_into_one(rows([(k,) for k in (1, 2, 3, 5, 6, 7, 9)], "node long"), rows([(5, 6), (6, 7), (1, 9), (9, 3)], "a long, b long"))
    assert sorted(map(tuple, link.collect())) == [(1, 2), (1, 5)]
    assert components.components(rows([], "a long, b long")).count() == 0
    initial = boolnet.initial_values(rows([(0, 10), (1, 11), (2, None), (3, 13)], "var_id long, source_id long"), rows([(0, 1), (1, 2), (2, 1), (1, 3)], "input_var long, output_var long"), 1.0)
    assert {r["var_id"]: r["init"] for r in initial.collect()} == {0: 1.0, 1: 1.0, 2: 0.0, 3: 0.0}


def test_many_inputs_of_few_variables_stay_where_they_are(spark, rows):
    """Inputs aren't shuffled by their variable, which would make a task of each."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        inputs = spark.range(300).selectExpr("id AS rel_id", "id + 1000 AS output_var", "id % 3 AS input_var", "id % 2 = 0 AS negated")
        state = spark.range(2000).selectExpr("1 AS scenario_id", "id AS var_id", "(id % 3) / 4D AS value")
        r = boolnet.relation_values(state, inputs, state.selectExpr("var_id", "true AS identical"))
        assert "BroadcastHashJoin" in r._jdf.queryExecution().toString()
        got = {x["rel_id"]: x["value"] for x in r.collect()}
        assert got == {k: 1 - k % 3 / 4 if k % 2 == 0 else k % 3 / 4 for k in range(300)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
