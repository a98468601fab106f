import pytest
from pyspark.sql import functions as F

from netquill.operators import boolnet, drug, network, pathway

PART = "reaction_id string, entity_id string, role string, ord int"


def test_values(spark):
    v = {r["idx"]: r["val"] for r in pathway.factor_values(spark, ["INPUT", "INHIBITOR"]).collect()}
    assert v[1 + 3 * 1 + 9 * 1] == 0.999 and v[2 + 3 * 2 + 9 * 2] == 0.0005 and v[0 + 3 * 2 + 9 * 2] == 0.999
    m = {r["idx"]: r["val"] for r in pathway.factor_values(spark, ["MEMBER", "MEMBER"]).collect()}
    assert m[2 + 3 * 0 + 9 * 2] == 0.999
    with pytest.raises(ValueError):
        pathway.expected_state([F.lit(0), F.lit(1)], ["MEMBER", "INPUT"])
    p = {r["idx"]: r["val"] for r in pathway.perturbation_values(spark, ["INPUT", "INPUT", "INPUT", "INPUT"]).collect()}
    assert p[1] == pytest.approx(4.5e-6) and p[0] == pytest.approx(0.9999955)
    assert p[1 + 2] == pytest.approx(0.917915, abs=1e-6) and p[2] == pytest.approx(0.082085, abs=1e-6)
    assert p[31] == pytest.approx(0.9999546, abs=1e-7) and p[30] == pytest.approx(4.53999e-5, abs=1e-9)


def test_fan_in(spark, rows):
    e = rows([("t", f"p{k:02d}", "INPUT") for k in range(10)] + [("u", "x", "MEMBER")], "target string, parent string, label string")
    s = pathway.split_fan_in(e)
    assert s.groupBy("target").count().agg(F.max("count")).first()[0] <= 3
    assert s.where("parent LIKE 'p%'").select("parent").distinct().count() == 10
    assert s.where("target = 'u'").count() == 1
    below = {r["parent"]: r["target"] for r in s.collect()}
    for k in range(10):
        at = f"p{k:02d}"
        while at in below:
            at = below[at]
        assert at == "t"


def test_reaction_edges(spark, rows):
    p = rows([("r", "a", "INPUT", 1), ("r", "c1", "CATALYST", 2), ("r", "c2", "CATALYST", 3), ("r", "i1", "INHIBITOR", 4), ("r", "i2", "INHIBITOR", 5), ("r", "o", "OUTPUT", 6), ("q", "a", "INPUT", 1)], PART)
    got = sorted(map(tuple, pathway.reaction_edges(p).collect()))
    assert got == sorted([("r_OUTPUT", "a", "INPUT"), ("r_OUTPUT", "c1", "CATALYST"), ("r_OUTPUT", "r_INHIBITOR", "INHIBITOR"), ("r_INHIBITOR", "i1", "MEMBER"), ("r_INHIBITOR", "i2", "MEMBER"), ("o", "r_OUTPUT", "MEMBER")])


def test_reverse_edges(spark, rows):
    p = rows([("r", "a", "INPUT", 1), ("r", "w", "INPUT", 2), ("r", "c1", "CATALYST", 3), ("r", "c2", "CATALYST", 4), ("q", "a", "INPUT", 1), ("s", "c1", "CATALYST", 1)], PART)
    names = rows([("a", ["a"]), ("w", ["H2O"]), ("c1", None), ("c2", None)], "entity_id string, names array<string>")
    assert sorted(map(tuple, pathway.reverse_edges(p, names).collect())) == [("a", "reverse_input_r", "INPUT"), ("reverse_input_r", "c1", "INPUT")]


def test_boolean_network(spark, rows):
    p = rows([("r", "a", "INPUT", 1), ("r", "i", "INHIBITOR", 2), ("r", "o1", "OUTPUT", 3), ("r", "o2", "OUTPUT", 4), ("s", "x", "OUTPUT", 1), ("u", "k1", "ACTIVATOR", 1), ("u", "k2", "ACTIVATOR", 2), ("u", "z", "OUTPUT", 3)], PART)
    got = sorted(map(tuple, pathway.boolean_network(p).collect()))
    assert got == sorted([("r", "a", False, "r_output"), ("r", "i", True, "r_output"), ("r_output_o1", "r_output", False, "o1"), ("r_output_o2", "r_output", False, "o2"), ("u", "u_activator", False, "z"), ("u_activator_k1", "k1", False, "u_activator"), ("u_activator_k2", "k2", False, "u_activator")])


def test_entities(spark, rows):
    parts = rows([("c", "s", "component"), ("c", "p", "component"), ("s", "m1", "member"), ("s", "m2", "candidate"), ("m2", "c", "component")], "parent_id string, child_id string, kind string")
    start = rows([("c",)], "entity_id string")
    e = sorted(map(tuple, pathway.entity_edges(start, parts).collect()))
    assert e == sorted([("c", "s", "COMPLEX"), ("c", "p", "COMPLEX"), ("s", "m1", "MEMBER"), ("s", "m2", "MEMBER"), ("m2", "c", "COMPLEX")])
    rel = {(r["rel"], r["input"]) for r in pathway.entity_relations(start, parts).collect()}
    assert ("c_parts", "s") in rel and ("s_m1", "m1") in rel
    assert pathway.entity_edges(start, parts, rows([("s",)], "entity_id string")).count() == 2
    mem = rows([("s", "m1", "G1"), ("s", "m2", "G2"), ("t", "m3", "G3")], "parent_id string, child_id string, gene string")
    assert sorted(r["child_id"] for r in pathway.focused_members(mem, rows([("G2",)], "gene string")).collect()) == ["m2", "m3"]
    reg = rows([("b", "x", "ACTIVATOR", 1), ("b", "y", "OUTPUT", 2), ("n", "x", "INPUT", 1), ("n", "y", "OUTPUT", 2)], PART)
    assert [r[0] for r in pathway.gene_regulatory(reg, rows([("b", True), ("n", True)], "reaction_id string, is_black_box boolean")).collect()] == ["b"]


def test_drug_impact_end_to_end(spark, rows):
    inter = rows([(1, "d", "GA", "inhibitor"), (2, "d", "GZ", "agonist"), (3, "e", "GA", "agonist")], "interaction_id long, drug string, target string, type string")
    ev = rows([(1, "IC50", 100.0, "m"), (1, "IC50", 5.0, ""), (2, "KD", 1e8, "m"), (3, None, 1.0, "m")], "interaction_id long, assay_type string, assay_value double, assay_median string")
    mod = drug.target_modifications(inter, ev)
    assert sorted(map(tuple, mod.collect())) == [("d", "GA", "Inhibition", pytest.approx(0.794)), ("d", "GZ", "Activation", 0.0)]
    assert drug.target_network(inter, ev).count() == 1
    variables = rows([(0, "GA", 10, False), (1, "GA", 11, True), (2, None, 12, True), (3, None, 13, True)], "var_id long, gene string, source_id long, driven boolean")
    inputs = rows([(1, 1, 0, False), (2, 2, 1, False), (3, 3, 2, False)], "rel_id long, output_var long, input_var long, negated boolean")
    inj = drug.injected(variables, inputs.select("input_var", "output_var"), mod)
    assert [(r["drug"], r["var_id"]) for r in inj.collect()] == [("d", 0)]
    v = variables.select("var_id", F.lit(True).alias("identical"))
    none = rows([("base", 0, None, None, None, None)], "scenario_id string, var_id long, stim double, act double, inh double, init double")
    base = boolnet.simulate(v, inputs, none, default=1.0, transfer="identity", rounds=500)
    hit = boolnet.simulate(v, inputs, drug.as_scenarios(inj), default=1.0, transfer="identity", rounds=500)
    changes, horizon = boolnet.converged_changes(base, hit, key=variables.select("var_id", F.col("source_id").alias("key")))
    got = drug.impacts(changes, rows([(13,)], "key long")).first()
    assert got["scenario_id"] == "d" and 0.4 < got["sum_impact"] < 0.7 and got["sum_impact"] == got["mean_impact"]
    assert horizon <= 1000


def test_clusterings(spark, rows):
    a = rows([(f"m{k}", k // 3) for k in range(9)], "member string, cluster int")
    b = rows([(k, f"m{j}", (j // 3 if k == 2 else j % 3)) for k in (2, 3) for j in range(9)], "k int, member string, cluster int")
    g = {r["k"]: r["ari"] for r in drug.compare_grid(a, b).collect()}
    assert g[2] == 1.0 and g[3] < 0
    assert drug.compare_clusterings(a, a).first()["ari"] == 1.0
    n = drug.permutation_null(a.join(a.withColumnRenamed("cluster", "c2"), "member"), "cluster", "c2", times=30, seed=2)
    assert n.count() == 30 and abs(n.agg(F.avg("ari")).first()[0]) < 0.3
    e = rows([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0), ("c", "x", 0.05)], "a string, b string, weight double")
    c = {r["member"]: r["cluster"] for r in drug.markov_clusters(e).collect()}
    assert c["a"] == c["b"] == c["c"] != c["x"] == c["y"]


def test_scores(spark, rows):
    s = network.scores(rows([(1, 0.2)], "var_id long, p double"), rows([("s", 1, 0.5)], "sample_id string, var_id long, p double"))
    assert s.first()["score"] == pytest.approx(0.60205999)
    assert network.summed(s.union(s)).first()["score"] == pytest.approx(1.20411998)
    t = network.template_values(rows([("g", [0.975, 0.025])], "gene string, values array<double>"), rows([("s", "g", [0.2, 0.8])], "sample_id string, gene string, belief array<double>"))
    assert sum(t.first()["values"]) == pytest.approx(1.0)
    i = rows([("a", "b", "ENCODE", "x co-expression"), ("b", "c", "ENCODE", "co-expression"), ("p", "q", "ENCODE", "co-expression"), ("a", "z", "other", "co-expression")], "gene1 string, gene2 string, source string, definition string")
    assert sorted(map(tuple, network.targets_of(i).collect())) == [("a", "b"), ("b", "c")]
