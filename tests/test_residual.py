"""Propagation of many samples over tables, residual schedules and learning: against enumeration and the kernels."""

import random

import pytest
from pyspark.sql import functions as F

from netquill.operators import belief, learning, residual
from netquill.operators.kernel import Graph
from tests.test_factor_graph import AB, COMPETITIVE, EX, arrow, exact, tables, vectors

RND = random.Random(4)
#: Four variables that all repel each other, the kind of graph on which sending everything at once swings.
REPELLING = {f"{a}~{b}": ([(a, 2), (b, 2)], [0.3, 1.0, 1.0, 0.3]) for a in range(4) for b in range(a)} | {str(a): ([(a, 2)], [1.0, 1.0 + a / 2]) for a in range(4)}
LOOP = {"ab": arrow(0, 1), "bc": arrow(1, 2), "ca": arrow(2, 0, inhibits=True)}


def by_sample(b):
    out = {}
    for r in b.variables.collect():
        out.setdefault((r["sample_id"], r["var_id"]), {})[r["state"]] = r["p"]
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("graph", [AB, EX, COMPETITIVE])
@pytest.mark.parametrize("seed", [None, 3])
def test_trees_are_exact(spark, rows, graph, seed):
    b = residual.propagate(*tables(rows, graph), tolerance=1e-9, seed=seed)
    want, z = exact(graph)
    for (_, v), p in by_sample(b).items():
        assert p == pytest.approx(want[v], abs=1e-6)
    assert residual.log_z(*tables(rows, graph), b).first()["log_z"] == pytest.approx(z, abs=1e-6)
    assert b.messages >= len(graph)


def test_samples_at_once(spark, rows):
    """Each sample's beliefs are those of its own graph; one has nothing, one two observations of a variable, one contradicts itself."""
    told = {"none": {}, "b0": {1: [1.0, 0.0, 0.0]}, "soft": {1: [0.2, 0.3, 0.5], 4: [0.1, 0.1, 0.8]}, "a1b2": {0: [0.0, 1.0, 0.0], 1: [0.0, 0.0, 1.0]}}
    ev = [(s, v, x) for s, e in told.items() for v, x in (e.items() or [(None, None)])] + [("soft", 1, [1.0, 1.0, 0.5]), ("odd", 0, [1.0, 0.0, 0.0]), ("odd", 0, [0.0, 1.0, 0.0]), ("b0", 77, [1.0])]
    evidence = rows(ev, "sample_id string, var_id long, values array<double>")
    b = residual.propagate(*tables(rows, COMPETITIVE), evidence, tolerance=1e-9)
    got, z = by_sample(b), {r["sample_id"]: r["log_z"] for r in residual.log_z(*tables(rows, COMPETITIVE), b, evidence.where("var_id IS NULL OR var_id < 70")).collect()}
    for s, e in told.items():
        graph = COMPETITIVE | {f"e{k}": ([(v, 3)], x) for k, (v, x) in enumerate([*e.items(), *([(1, [1.0, 1.0, 0.5])] if s == "soft" else [])])}
        want, total = exact(graph)
        for v in range(5):
            assert got[s, v] == pytest.approx(want[v], abs=1e-6)
        assert z[s] == pytest.approx(total, abs=1e-6)
    assert got["odd", 0] == [0.0, 0.0, 0.0] and z["odd"] == float("-inf")


def test_what_swings_settles_with_a_seed(spark, rows):
    f, li = tables(rows, REPELLING)
    with pytest.raises(belief.NotConverged):
        residual.propagate(f, li, rounds=6, tolerance=1e-2)
    b = residual.propagate(f, li, seed=1, tolerance=1e-2, rounds=100)
    got = by_sample(b)
    g = Graph([(k, [v for v, _ in vs], [n for _, n in vs], val) for k, (vs, val) in REPELLING.items()])
    assert g.propagate()
    for (_, v), p in got.items():
        assert p == pytest.approx(list(g.belief(v)), abs=5e-2)


def test_only_what_changed_is_sent(spark, rows):
    """A loop settles; on a chain far fewer messages are sent than all of them in every round."""
    chain = {f"f{k}": ([(k, 2), (k + 1, 2)], [0.7, 0.3, 0.4, 0.6]) for k in range(6)} | {"end": ([(0, 2)], [0.9, 0.1])}
    b = residual.propagate(*tables(rows, chain), tolerance=1e-9)
    assert b.rounds > 6 and b.messages < 13 * b.rounds / 2  # 13 messages to variables
    loop = residual.propagate(*tables(rows, LOOP), tolerance=1e-2, seed=2)
    assert by_sample(loop)[0, 0] == pytest.approx([0.262658, 0.474684, 0.262658], abs=3e-2)


def test_learning_on_tables(spark, rows):
    """The same course and values as with a small graph for each sample, tied tables and hidden variables included."""
    graph = {"p": ([(0, 2)], [0.6, 0.4]), "f": ([(1, 2), (0, 2)], [0.7, 0.3, 0.4, 0.6]), "g": ([(2, 2), (1, 2)], [0.7, 0.3, 0.4, 0.6])}
    f, li = tables(rows, graph)
    f = f.withColumn("group_id", F.when(F.col("factor_id") != "p", 7).cast("long"))
    seen = [(f"s{k}", v, float(RND.random() < 0.7)) for k in range(12) for v in (0, 2)]
    evidence = rows(seen, "sample_id string, var_id long, value double").withColumn("values", F.array(1 - F.col("value"), F.col("value")))
    small = vectors(rows, graph).drop("graph_id").join(f.select("factor_id", "group_id"), "factor_id")
    want, ll, course = learning.learn(small, evidence.drop("values"), rounds=2, tolerance=0.0)
    got, ll2, course2 = learning.learn_on_tables(f, li, evidence, rounds=2, tolerance=0.0)
    assert course2 == pytest.approx(course, abs=1e-4) and ll2 == pytest.approx(ll, abs=1e-4)
    values = lambda t: {r["factor_id"]: list(r["values"]) for r in t.collect()}
    for k, v in values(want).items():
        assert values(got)[k] == pytest.approx(v, abs=1e-4)
