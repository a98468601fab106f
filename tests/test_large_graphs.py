"""What works on graphs beyond a task: batches of samples, colourings and draws, sets of neighbours, permutations of rows."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netquill.operators import factor_graph, kernel, permutation, sampling, tiles
from tests.test_factor_graph import COMPETITIVE, EX, exact, tables, vectors


def test_batches_of_samples(spark, rows, monkeypatch):
    """Each sample's beliefs are those of its own graph, whatever batch it is in."""
    graphs = {1: EX, 2: COMPETITIVE}
    f = vectors(rows, EX, 1).union(vectors(rows, COMPETITIVE, 2))
    rnd, told = random.Random(1), []
    for k in range(30):
        told += [(f"s{k}", 2, v, [rnd.random() for _ in range(3)]) for v in rnd.sample(range(5), rnd.randrange(1, 4))]
        told += [(f"s{k}", 1, 1, [1.0, 0.0] if k % 2 else [0.3, 0.7])] * (1 + k % 3 // 2)
    evidence = rows(told, "sample_id string, graph_id int, var_id long, values array<double>")
    results = []
    for most in (40, 10**6):
        monkeypatch.setattr(kernel, "NUMBERS_A_BATCH", most)
        got = kernel.prior_and_posterior(f, evidence, tolerance=1e-9)
        results.append({(int(r["graph_id"]), r["sample_id"], r["var_id"], r["state"]): (r["prior"], r["posterior"]) for r in got.collect()})
        assert got.where("NOT converged").count() == 0
    assert results[0].keys() == results[1].keys() and all(results[0][k] == pytest.approx(v, abs=1e-8) for k, v in results[1].items())
    for k, g in itertools.product(range(30), graphs):
        own = [(v, m) for s, gid, v, m in told if s == f"s{k}" and gid == g]
        states = {v: n for vs, _ in graphs[g].values() for v, n in vs}
        want, _ = exact(graphs[g] | {f"e{i}": ([(v, states[v])], m) for i, (v, m) in enumerate(own)})
        before, _ = exact(graphs[g])
        for v in want:
            for s in range(states[v]):
                assert results[0][g, f"s{k}", v, s] == pytest.approx((before[v][s], want[v][s]), abs=1e-5)


def test_a_sample_that_swings_falls_back(spark, rows):
    f = vectors(rows, EX)
    evidence = rows([("a", 1, 1, [1.0, 0.0])], "sample_id string, graph_id int, var_id long, values array<double>")
    got = kernel.prior_and_posterior(f, evidence, rounds=1, fall_back=4000)
    p = {(r["var_id"], r["state"]): r["posterior"] for r in got.collect()}
    assert got.where("converged").count() == 0 and p[0, 0] == pytest.approx(0.04 / 0.37, abs=0.03)


def test_colouring(spark, rows):
    rnd = random.Random(5)
    places = sorted({(f, v) for f in range(60) for v in rnd.sample(range(40), rnd.randrange(1, 5))} | {(99, v) for v in range(25)})
    links = rows(places, "factor_id long, var_id long")
    by_factor = {}
    for f, v in places:
        by_factor.setdefault(f, []).append(v)
    for seed in (1, None):
        c = {r["var_id"]: r["colour"] for r in sampling.coloured(links.repartition(3), seed).collect()}
        assert set(c) == {v for _, v in places}
        assert all(len({c[v] for v in vs}) == len(vs) for vs in by_factor.values())
    greedy = {}
    for v in sorted(c):
        near = {greedy[u] for vs in by_factor.values() if v in vs for u in vs if u in greedy}
        greedy[v] = min(set(range(len(near) + 1)) - near)
    assert c == greedy


def test_rounds_of_a_colouring_stay_few(spark):
    """Every vertex of one side meets all of the other side: a path of falling hashes goes through nearly all of them."""
    pairs = spark.range(60).crossJoin(spark.range(100, 160).withColumnRenamed("id", "to"))
    links = pairs.select((F.col("id") * 1000 + F.col("to")).alias("factor_id"), F.explode(F.array("id", "to")).alias("var_id"))
    c = {r["var_id"]: r["colour"] for r in sampling.coloured(links, 1, rounds=8).collect()}
    assert len(c) == 120 and {c[v] for v in range(60)}.isdisjoint({c[v] for v in range(100, 160)}) and set(c.values()) == {0, 1}


def test_draws_come_near_to_the_marginals(spark, rows):
    f, li = tables(rows, EX)
    a, b = (sorted(map(tuple, sampling.gibbs(f.repartition(k), li, chains=1500, sweeps=4, burn_in=3, seed=2).collect())) for k in (1, 3))
    assert a == b and {r[1] for r in a} == {3}
    want, _ = exact(EX)
    for v in (0, 1):
        assert np.mean([s for _, _, x, s in a if x == v]) == pytest.approx(want[v][1], abs=0.05)


@pytest.mark.parametrize("most", [0, 3, 64])
def test_linked_variables(spark, rows, most, monkeypatch):
    monkeypatch.setattr(factor_graph, "MOST_PAIRED", most)
    rnd = random.Random(2)
    places = sorted({(f, v) for f in range(25) for v in rnd.sample(range(60), rnd.randrange(1, 9))} | {(99, v) for v in range(40)} | {(100, 77)})
    want = {}
    for f, v in places:
        want.setdefault(v, set()).update(u for g, u in places if g == f and u != v)
    got = {r["var_id"]: r["n_linked"] for r in factor_graph.linked_variables(rows([*places, places[0]], "factor_id long, var_id long")).collect()}
    assert got == {v: len(u) for v, u in want.items() if u}


def test_linked_pairs_are_written_once(spark, monkeypatch):
    """Forty factors with the same thirty variables: a row for each pair in one direction, not for each factor that has it."""
    written, plain = {}, factor_graph.cut
    monkeypatch.setattr(factor_graph, "cut", lambda d, name: written.setdefault(name, plain(d, name)))
    links = spark.range(40).withColumnRenamed("id", "factor_id").crossJoin(spark.range(30).withColumnRenamed("id", "var_id"))
    assert {tuple(r) for r in factor_graph.linked_variables(links).collect()} == {(v, 29) for v in range(30)}
    assert written["linked"].count() == 30 * 29 // 2


def shuffled_bytes(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_linked_pairs_take_little_room(spark):
    """Factors without common pairs: a pair takes a byte or two, not a row."""
    links = spark.range(3000).select(F.col("id").alias("factor_id"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k")).select("factor_id", F.pmod(F.xxhash64("factor_id", "k"), F.lit(3000)).alias("var_id"))
    before = shuffled_bytes(spark)
    got = {r["var_id"]: r["n_linked"] for r in factor_graph.linked_variables(links).collect()}
    assert shuffled_bytes(spark) - before < 8 << 20
    p = links.distinct().toPandas()
    at = np.zeros((3000, 3000), np.float32)
    at[p["factor_id"], p["var_id"]] = 1
    both = at.T @ at > 0
    assert got == {v: int(n) - 1 for v, n in enumerate(both.sum(axis=0)) if n > 1} and sum(got.values()) > 3_000_000


@pytest.mark.parametrize("most, of_factor, held", [(64, 100_000, 8_000_000), (3, 100_000, 50), (0, 20, 50), (64, 20, 300)])
def test_linked_variables_by_tile(spark, rows, most, of_factor, held, monkeypatch):
    """Pairs of small factors, lists of large ones and of those with very many rows meet in one tile; rows repeat, some lack a name."""
    for module, name, value in ((factor_graph, "MOST_ROWS", 0), (factor_graph, "MOST_PAIRED", most), (factor_graph, "MOST_ROWS_OF_FACTOR", of_factor), (tiles, "PAIRS_HELD", held)):
        monkeypatch.setattr(module, name, value)
    rnd = random.Random(8)
    places = {(f"f{f}", f"v{v}") for f in range(60) for v in rnd.sample(range(300), rnd.randrange(1, 12))} | {("hub", f"v{v}") for v in range(50, 250)} | {("mid", f"v{v}") for v in range(0, 300, 9)} | {("one", "v1000")}
    want = {}
    for f, v in places:
        want.setdefault(v, set()).update(u for g, u in places if g == f and u != v)
    several = sorted(places) * 2 + [(None, "v1"), (None, "v299"), ("f1", None)]
    got = {r["var_id"]: r["n_linked"] for r in factor_graph.linked_variables(rows(several, "factor_id string, var_id string")).collect()}
    assert got == {v: len(u) for v, u in want.items() if u}


@pytest.mark.parametrize("sparse", [0, 40, 10**6])
def test_tiles_count_pairs_once(sparse, monkeypatch):
    monkeypatch.setattr(tiles, "SPARSE", sparse)
    rng, side = np.random.default_rng(3), 32
    for same in (False, True):
        t, want = tiles._Tile(side), np.zeros((side, side), bool)
        for _ in range(6):
            codes = np.unique(rng.integers(0, side * side, 50))
            codes = codes[codes // side < codes % side] if same else codes
            t.add(tiles._unsqueezed(*(lambda c, w: (c, len(codes), w))(*tiles._squeezed(codes))))
            want.reshape(-1)[codes] = True
            x, y = np.sort(rng.permutation(side)[:9]), np.sort(rng.permutation(side)[:11])
            y = x if same else y
            t.pair(x, y, same)
            want[np.ix_(x, y)] |= np.less.outer(x, y) if same else True
        rows, columns = t.counts()
        assert (rows == want.sum(axis=1)).all() and (columns == want.sum(axis=0)).all()


def test_permutations_are_bijections(spark):
    for n in (1, 2, 7, 1000, 4097):
        d = spark.range(n).select("id", permutation.permuted(F.col("id"), F.lit(n), 5).alias("to"))
        got = {r["id"]: r["to"] for r in d.repartition(3).collect()}
        assert sorted(got.values()) == list(range(n))
        assert got == dict(duckdb.sql(f"SELECT i, {permutation.permuted_sql('i', str(n), 5)} FROM range({n}) AS r(i)").fetchall())
    a = spark.range(2000).select(permutation.permuted(F.col("id"), F.lit(2000), 9).alias("to")).toPandas()["to"]
    assert abs(np.corrcoef(np.arange(2000), a)[0, 1]) < 0.08 and (a != got).sum() > 1900
    far = (1 << 31) * 5 + 3
    one = spark.range(1).select(*(permutation.permuted(F.lit(far - k), F.lit(far), 1).alias(f"x{k}") for k in (1, 2, 3))).first()
    assert len(set(one)) == 3 and all(0 <= x < far for x in one)


def test_shuffled_rows_keep_their_margins(spark, rows):
    d = rows([(k, f"g{k % 3}", f"h{k % 5}", k) for k in range(60)], "id long, a string, b string, c long")
    got = permutation.shuffled(d, ["id"], ["b", "c"], seed=3, times=2).toPandas()
    for rep in (0, 1):
        r = got[got["rep"] == rep]
        assert sorted(r["id"]) == list(range(60)) and sorted(r["c"]) == list(range(60)) and (r["b"] == ["h%d" % (c % 5) for c in r["c"]]).all()
        assert (r["a"] == ["g%d" % (i % 3) for i in r["id"]]).all() and (r["id"] != r["c"]).sum() > 40
    assert sorted(zip(got["rep"], got["id"], got["c"])) == sorted(map(tuple, permutation.shuffled(d.repartition(5), ["id"], ["b", "c"], seed=3, times=2).select("rep", "id", "c").collect()))
