import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquill.operators import belief, factor_graph, kernel, learning, network

def tables(rows, factors):
    """factors: {name: ([(var, states)...], values)}."""
    f = rows([(k, [float(x) for x in v]) for k, (_, v) in factors.items()], "factor_id string, values array<double>")
    li = rows([(k, p, v, n) for k, (vs, _) in factors.items() for p, (v, n) in enumerate(vs)], "factor_id string, pos int, var_id long, states int")
    return f, li


def vectors(rows, factors, graph=1):
    return rows([(graph, k, [v for v, _ in vs], [n for _, n in vs], [float(x) for x in val]) for k, (vs, val) in factors.items()], "graph_id int, factor_id string, var_ids array<long>, states array<int>, values array<double>")


def exact(factors):
    states = {v: n for vs, _ in factors.values() for v, n in vs}
    order = sorted(states)
    p = {v: np.zeros(states[v]) for v in order}
    z = 0.0
    for x in itertools.product(*(range(states[v]) for v in order)):
        at = dict(zip(order, x, strict=True))
        w = 1.0
        for vs, val in factors.values():
            i, s = 0, 1
            for v, n in vs:
                i, s = i + at[v] * s, s * n
            w *= val[i]
        z += w
        for v in order:
            p[v][at[v]] += w
    return {v: p[v] / z for v in order}, np.log(z)


AB = {"ab": ([(0, 2), (1, 2)], [0.8, 0.6, 0.2, 0.4])}
EX = {"a": ([(0, 2)], [0.4, 0.6]), "ab": ([(0, 2), (1, 2)], [0.1, 0.55, 0.9, 0.45])}


def two_sided(d):
    """2 (1 - Phi(d))."""
    return math.erfc(d / math.sqrt(2))


def competing(x, a, b):
    """[x, a, b]: the target is expected at the geometric mean of its parents."""
    val = [two_sided(abs(k + 1 - math.sqrt((i + 1) * (j + 1)))) for j in range(3) for i in range(3) for k in range(3)]
    return [(x, 3), (a, 3), (b, 3)], val


def arrow(a, b, inhibits=False):
    """[b, a]: the target is expected at its parent's state or, inhibited, at the opposite one."""
    return [(b, 3), (a, 3)], [two_sided(abs((2 - i if inhibits else i) - j)) for i in range(3) for j in range(3)]


COMPETITIVE = {"x": competing(3, 0, 1), "y": competing(4, 0, 2)}  # A=0 B=1 C=2 X=3 Y=4


def beliefs(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["var_id"], {})[r["state"]] = r["p"]
    return {v: [x[k] for k in sorted(x)] for v, x in out.items()}


@pytest.mark.parametrize("graph", [AB, EX, COMPETITIVE])
def test_table_propagation_is_exact_on_trees(spark, rows, graph):
    f, li = tables(rows, graph)
    b, c, sweeps = belief.propagate(f, li)
    want, logz = exact(graph)
    got = beliefs(b)
    for v in want:
        assert got[v] == pytest.approx(list(want[v]), abs=1e-6)
    assert factor_graph.bethe_log_z(f, li, b, c).first()[0] == pytest.approx(logz, abs=1e-5)
    assert sweeps < 10


def test_golden_numbers(spark, rows):
    m = kernel.marginals(vectors(rows, COMPETITIVE)).collect()
    assert m[0]["log_z"] == pytest.approx(3.99116034, abs=1e-6)
    got = {(r["var_id"], r["state"]): r["p"] for r in m}
    assert [got[0, k] for k in range(3)] == pytest.approx([0.32132084, 0.35229541, 0.32638375], abs=1e-7)
    m = kernel.marginals(vectors(rows, AB)).collect()
    assert m[0]["log_z"] == pytest.approx(0.69314718, abs=1e-7)
    assert {(r["var_id"], r["state"]): round(r["p"], 6) for r in m} == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.7, (1, 1): 0.3}


def test_evidence(spark, rows):
    f, li = tables(rows, COMPETITIVE)
    ef, el = factor_graph.evidence_factors(rows([(1, 2.0), (99, 1.0)], "var_id long, value double"), li)  # B=2; 99 is unknown
    ef, el = ef.withColumn("factor_id", F.col("factor_id").cast("string")), el.withColumn("factor_id", F.col("factor_id").cast("string"))
    b, _, _ = belief.propagate(f.union(ef), li.union(el))
    assert beliefs(b)[3] == pytest.approx([0.15522305, 0.41892151, 0.42585544], abs=1e-6)
    soft = factor_graph.evidence_factors(rows([(0, 0.3)], "var_id long, value double"), tables(rows, AB)[1])[0].first()["values"]
    assert soft == pytest.approx([0.7, 0.3])


def test_loopy_fixed_point_and_failure(spark, rows):
    loop = {"b": arrow(0, 1), "c": arrow(1, 2), "a": arrow(2, 0, inhibits=True)}
    got = kernel.marginals(vectors(rows, loop)).where("var_id = 0").orderBy("state").collect()
    assert [r["p"] for r in got] == pytest.approx([0.262658, 0.474684, 0.262658], abs=1e-4)
    f, li = tables(rows, loop)
    assert not factor_graph.is_tree(li)
    assert factor_graph.is_tree(tables(rows, COMPETITIVE)[1])


def test_map(spark, rows):
    got = {r["var_id"]: r["state"] for r in kernel.most_probable(vectors(rows, EX)).collect()}
    assert got == {0: 0, 1: 1}
    assert {r["var_id"]: r["state"] for r in belief.decoded(belief.propagate(*tables(rows, EX), maximise=True)[0]).collect()} == got


def test_log_likelihood_and_slice(spark, rows):
    f, li = tables(rows, EX)
    a = rows([("s", 0, 1), ("s", 1, 0)], "sample_id string, var_id long, state int")
    assert factor_graph.log_likelihood(f, li, a).first()["loglik"] == pytest.approx(np.log(0.6 * 0.55))
    s = factor_graph.sliced(f, li, rows([(1, 1)], "var_id long, state int"))
    assert sorted((r["factor_id"], r["idx"]) for r in s.collect()) == [("a", 0), ("a", 1), ("ab", 2), ("ab", 3)]
    with pytest.raises(Exception, match="lacks a variable"):
        factor_graph.log_likelihood(f, li, a.where("var_id = 0")).collect()


def test_invalid_and_linked(spark, rows):
    f, li = tables(rows, {"bad": ([(0, 2), (1, 2)], [1.0, 2.0, 3.0]), **COMPETITIVE})
    assert [r[0] for r in factor_graph.invalid_factors(f, li).collect()] == ["bad"]
    n = {r["var_id"]: r["n_linked"] for r in factor_graph.linked_variables(tables(rows, COMPETITIVE)[1]).collect()}
    assert n == {0: 4, 1: 2, 2: 2, 3: 2, 4: 2}


def test_gibbs(spark, rows):
    s = kernel.gibbs_samples(vectors(rows, EX), draws=4000, burn_in=50, restarts=2, seed=7)
    p = kernel.gibbs_marginals(s, rows([(1, 0, 2), (1, 1, 2)], "graph_id int, var_id long, states int"))
    got = beliefs(p)
    assert got[0] == pytest.approx([0.4, 0.6], abs=0.02)
    assert got[1] == pytest.approx([0.37, 0.63], abs=0.02)
    assert s.agg(F.sum("state")).first() == kernel.gibbs_samples(vectors(rows, EX), draws=4000, burn_in=50, restarts=2, seed=7).agg(F.sum("state")).first()
    assert all(r["r_hat"] < 1.2 for r in kernel.potential_scale(s).collect())


def test_em_improves(spark, rows):
    f = rows([("prior", None, [0], [2], [0.5, 0.5]), ("x", 1, [1, 0], [2, 2], [0.6, 0.4, 0.3, 0.7]), ("y", 1, [2, 0], [2, 2], [0.6, 0.4, 0.3, 0.7])], "factor_id string, group_id long, var_ids array<long>, states array<int>, values array<double>")
    ev = rows([(f"s{k}", v, float(k % 3 == 0)) for k in range(6) for v in (1, 2)], "sample_id string, var_id long, value double")
    got, last, course = learning.learn(f, ev, rounds=6, tolerance=1e-6)
    assert all(b >= a - 0.3 for a, b in zip(course, course[1:], strict=False)) and last == course[-1]
    tied = {r["factor_id"]: r["values"] for r in got.collect()}
    assert tied["x"] == tied["y"] and tied["x"][0] + tied["x"][1] == pytest.approx(1)
    assert tied["prior"] == [0.5, 0.5]


def test_weights_count_as_repeated_samples(spark, rows):
    f = rows([("prior", None, [0], [2], [0.5, 0.5]), ("x", 1, [1, 0], [2, 2], [0.6, 0.4, 0.3, 0.7]), ("y", 2, [2, 0], [2, 2], [0.2, 0.8, 0.7, 0.3])], "factor_id string, group_id long, var_ids array<long>, states array<int>, values array<double>")
    times = {(0, 0): 5, (0, 1): 1, (1, 1): 3}
    every = rows([(f"{c}/{k}", v, float(c[v - 1])) for c, n in times.items() for k in range(n) for v in (1, 2)], "sample_id string, var_id long, value double")
    once = rows([(str(c), v, float(c[v - 1]), n) for c, n in times.items() for v in (1, 2)], "sample_id string, var_id long, value double, weight long")
    (a, ll_a), (b, ll_b) = learning.expected(f, every), learning.expected(f, once)
    cells = lambda d: [r["n"] for r in d.orderBy("group_id", "idx").collect()]
    assert cells(a) == pytest.approx(cells(b)) and ll_a == pytest.approx(ll_b)
    assert sum(cells(b)) == pytest.approx(2 * (9 + 4))


def test_annealed_learning(spark, rows):
    f = rows([("prior", None, [0], [2], [0.5, 0.5]), ("x", 1, [1, 0], [2, 2], [0.6, 0.4, 0.3, 0.7])], "factor_id string, group_id long, var_ids array<long>, states array<int>, values array<double>")
    ev = rows([(f"s{k}", 1, float(k % 3 == 0)) for k in range(6)], "sample_id string, var_id long, value double")
    got, last = learning.learn_annealed(f, ev, betas=(0.01, 1.0), rounds=2)
    x = {r["factor_id"]: r["values"] for r in got.collect()}["x"]
    assert np.isfinite(last) and x[0] + x[1] == pytest.approx(1) and x[2] + x[3] == pytest.approx(1)
    with pytest.raises(ValueError):
        learning.learn_annealed(f, ev, betas=(1.0, 0.5))


def test_network_models(spark, rows):
    toy = [("A", "B"), ("B", "C"), ("B", "F"), ("C", "D"), ("F", "C")] + [(h, f"{h}{k}") for h in "BCF" for k in range(100)]
    p = rows(toy, "gene1 string, gene2 string")
    from netquill.operators.relational import degrees

    d = {r["gene"]: r["degree"] for r in degrees(p).collect()}
    assert (len(d), d["A"], d["B"], d["C"], d["D"], d["F"]) == (305, 1, 103, 103, 1, 102)
    v = network.pair_factors(p, "degree").where("gene1 = 'A'").first()["values"]
    assert v == pytest.approx([1.98, 1.01 - 0.99, 1.01 - 0.99 / 103, 0.99 * (1 + 1 / 103)])
    genes = rows([(g, k) for k, g in enumerate(sorted(d))], "gene string, var_id long")
    f, li = network.factor_graph(p, genes)
    assert (f.count(), li.count()) == (305 + 305, 2 * 305 + 305)
    with pytest.raises(ValueError):
        network.pair_factors(p, "other")
