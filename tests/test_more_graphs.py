import pytest
from pyspark.sql import functions as F

from netquill.operators import factor_graph, kernel
from netquill.sources import config, readers, writers
from tests.test_factor_graph import AB, EX, beliefs, tables, vectors


def test_marginals_of_a_factor(spark, rows):
    f, li = tables(rows, AB)
    got = {(r["var_id"], r["state"]): r["val"] for r in factor_graph.marginal(f, li).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (1, 0): pytest.approx(1.4), (1, 1): pytest.approx(0.6)}
    top = {(r["var_id"], r["state"]): r["val"] for r in factor_graph.marginal(f, li, maximise=True).collect()}
    assert top[(0, 0)] == 0.8 and top[(1, 1)] == 0.4
    s = factor_graph.cell_states(f, li).where("var_id = 1")
    m = rows([("ab", 0, 2.0), ("ab", 1, 0.5)], "factor_id string, state int, p double")
    out = {r["idx"]: r["val"] for r in factor_graph.multiplied(factor_graph.cells(f), m, s.select("factor_id", "idx", "state")).collect()}
    assert out == {0: pytest.approx(1.6), 1: pytest.approx(1.2), 2: pytest.approx(0.1), 3: pytest.approx(0.2)}


def test_continuous_evidence(spark, rows):
    """A Gaussian mixture on B, observed at 0: golden numbers."""
    f, li = tables(rows, AB)
    from netquill.functions.scalar import mixture_marginal

    seen = rows([("c", 1, 0.0)], "factor_id string, var_id long, x double").select("factor_id", "var_id", mixture_marginal(F.col("x"), [(0, 0.5, 0.0, 1.0), (1, 0.5, 2.0, 1.0)]).alias("marginal"))
    ef, el = factor_graph.effective_factors(f, li, seen)
    v = el.groupBy("factor_id").agg(F.array_sort(F.collect_list(F.struct("pos", "var_id", "states"))).alias("x")).join(ef, "factor_id")
    g = v.select(F.lit(1).alias("graph_id"), "factor_id", F.transform("x", lambda x: x["var_id"]).alias("var_ids"), F.transform("x", lambda x: x["states"]).alias("states"), "values")
    m = kernel.marginals(g)
    assert beliefs(m)[0] == pytest.approx([0.55837591, 0.44162409], abs=1e-6)
    assert beliefs(m)[1] == pytest.approx([0.94517884, 0.05482116], abs=1e-6)
    assert m.first()["log_z"] == pytest.approx(0.26592535, abs=1e-6)


def test_factor_components_and_outputs(spark, rows):
    _, li = tables(rows, {"a": ([(0, 2), (1, 2)], [1] * 4), "b": ([(1, 2), (2, 2)], [1] * 4), "c": ([(7, 2)], [1] * 2)})
    c = {r["factor_id"]: r["root"] for r in factor_graph.factor_components(li).collect()}
    assert c["a"] == c["b"] != c["c"]
    assert factor_graph.outputs(rows([(1, {"output": "true"}), (2, {}), (3, None)], "var_id long, props map<string,string>")).count() == 1


def test_templates_evaluate_distinct_evidence(spark, rows):
    ev = rows([(s, g, 1, k % 2) for k, (s, g) in enumerate([("s1", "g"), ("s2", "g"), ("s3", "g"), ("s4", "h")])], "sample_id string, gene string, var_id long, state int")
    got = {(r["sample_id"], r["gene"]): r["belief"] for r in kernel.template_beliefs(vectors(rows, EX), ev, 0).collect()}
    assert got[("s1", "g")] == got[("s3", "g")] == pytest.approx([0.04 / 0.37, 0.33 / 0.37])
    assert got[("s2", "g")] == got[("s4", "h")] == pytest.approx([0.36 / 0.63, 0.27 / 0.63])


def test_boolean_network_and_graph_files(spark, rows, tmp_path):
    v, i = rows([(0, True), (1, False)], "var_id long, identical boolean"), rows([(1, 1, 0, True)], "rel_id long, output_var long, input_var long, negated boolean")
    writers.boolean_network(v, i, f"file://{tmp_path}/bn")
    v2, i2 = readers.boolean_network(spark, f"file://{tmp_path}/bn")
    assert sorted(map(tuple, v2.collect())) == [(0, True), (1, False)] and [tuple(r) for r in i2.collect()] == [(1, 1, 0, True)]
    f, li = tables(rows, AB)
    writers.factor_graph(f, li, f"file://{tmp_path}/fg", "xml")
    f2, li2 = readers.factor_graph(spark, f"file://{tmp_path}/fg", "xml")
    assert [tuple(r) for r in f2.collect()] == [("ab", [0.8, 0.6, 0.2, 0.4])] and li2.count() == 2
    writers.factor_graphs(vectors(rows, AB).union(vectors(rows, EX, 2)), f"file://{tmp_path}/many")
    many = readers.factor_graphs(spark, f"file://{tmp_path}/many")
    assert many.select("graph_id").distinct().count() == 2
    assert beliefs(kernel.marginals(many.where("graph_id = '2'")))[1] == pytest.approx([0.37, 0.63])


def test_handlers():
    c = config.parse('<c><dataFiles><dataFile type="CNV" handler="mixture" states="3">f</dataFile><dataFile type="Mutation" handler="mutation">g</dataFile></dataFiles></c>')
    assert [f.handler for f in c.files] == ["mixture", "mutation"]


def test_not_converged_is_a_row(spark, rows):
    m = kernel.marginals(vectors(rows, EX), rounds=1).collect()
    assert [(r["var_id"], r["p"], r["converged"]) for r in m] == [(None, None, False)]
    b = kernel.most_probable(vectors(rows, EX), rounds=1).collect()
    assert [(r["state"], r["converged"]) for r in b] == [(None, False)]


def test_impossible_evidence(spark, rows):
    g = vectors(rows, EX).union(vectors(rows, {"e": ([(0, 2)], [1.0, 0.0]), "f": ([(0, 2)], [0.0, 1.0])}))
    assert kernel.marginals(g).first()["log_z"] == float("-inf")


def test_config():
    c = config.parse('<c><thresholds><threshold type="CNV">-1,1</threshold></thresholds><dataFiles><dataFile type="CNV" handler="empirical" sep="x">f.txt</dataFile></dataFiles><learnParameters>true</learnParameters><propagation tolerance="1e-5"/><gibbs draws="9"/><properties><property name="a">b</property></properties></c>')
    assert c.thresholds["CNV"] == [-1.0, 1.0] and c.files[0].options == {"sep": "x"} and c.learn and c.tolerance == 1e-5 and c.gibbs_draws == 9 and c.properties == {"a": "b"}
    with pytest.raises(ValueError):
        config.parse('<c><dataFiles><dataFile type="CNV" handler="none">f</dataFile></dataFiles></c>')
