"""Inference on many small factor graphs: one numpy kernel for each graph, applied to groups of a table.

A graph is one group, so it must fit in a task; a large graph belongs in :mod:`netquill.operators.belief`. Input rows
are factors: graph_id, factor_id, var_ids ARRAY<LONG>, states ARRAY<INT>, values ARRAY<DOUBLE>, the first variable
fastest. Evidence comes as further unary factors.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.plans.checkpoint import cut


class Graph:
    def __init__(self, rows):
        self.factors: list[tuple[object, tuple[int, ...], np.ndarray]] = []
        self.states: dict[int, int] = {}
        for fid, var_ids, states, values in rows:
            if len(values) != int(np.prod(states)):
                raise ValueError(f"factor {fid}: {len(values)} values for {list(states)} states")
            self.factors.append((fid, tuple(int(v) for v in var_ids), np.asarray(values, float).reshape(tuple(int(s) for s in states), order="F")))
            self.states.update({int(v): int(s) for v, s in zip(var_ids, states, strict=True)})
        self.factors.sort(key=lambda f: str(f[0]))
        self.by_var: dict[int, list[int]] = {v: [] for v in sorted(self.states)}
        for i, (_, vs, _) in enumerate(self.factors):
            for v in vs:
                self.by_var[v].append(i)

    # belief propagation, asynchronous over the variables in order
    def propagate(self, tolerance: float = 1e-6, rounds: int = 10_000, maximise: bool = False, damping: float = 0.0) -> bool:
        norm = lambda m: m / s if (s := m.sum()) > 0 else np.full_like(m, 1 / len(m))
        self.to_var = {(i, v): np.ones(self.states[v]) / self.states[v] for v, fs in self.by_var.items() for i in fs}
        self.to_factor = dict(self.to_var)
        past: list[float] = []
        for _ in range(rounds):
            change = 0.0
            for v, fs in self.by_var.items():
                for i in fs:
                    _, vs, t = self.factors[i]
                    full = t
                    for axis, u in enumerate(vs):
                        if u != v:
                            shape = [1] * len(vs)
                            shape[axis] = -1
                            full = full * self.to_factor[i, u].reshape(shape)
                    axes = tuple(a for a, u in enumerate(vs) if u != v)
                    new = norm(full.max(axes) if maximise else full.sum(axes)) if axes else norm(full)
                    new = (1 - damping) * new + damping * self.to_var[i, v]
                    change = max(change, float(np.abs(new - self.to_var[i, v]).max()))
                    self.to_var[i, v] = new
                for i in fs:
                    self.to_factor[i, v] = norm(np.prod([self.to_var[j, v] for j in fs if j != i] or [np.ones(self.states[v])], axis=0))
            past.append(change)
            if change <= tolerance:
                return True
            if len(past) >= 50 and sum(b > a for a, b in zip(past, past[1:], strict=False)) >= 10:
                return False
        return False

    def belief(self, v: int) -> np.ndarray:
        b = np.prod([self.to_var[i, v] for i in self.by_var[v]], axis=0)
        return b / s if (s := b.sum()) > 0 else b

    def factor_belief(self, i: int) -> np.ndarray:
        _, vs, t = self.factors[i]
        for axis, u in enumerate(vs):
            shape = [1] * len(vs)
            shape[axis] = -1
            t = t * self.to_factor[i, u].reshape(shape)
        return t / s if (s := t.sum()) > 0 else t

    def log_z(self) -> float:
        out = 0.0
        for v, fs in self.by_var.items():
            b = self.belief(v)
            b = b[b > 0]
            out += (len(fs) - 1) * float((b * np.log(b)).sum())
        for i, (_, _, t) in enumerate(self.factors):
            b = self.factor_belief(i)
            if not b.any():
                return float("-inf")  # the evidence is impossible
            ok = (b > 0) & (t > 0)
            out += float((b[ok] * (np.log(t[ok]) - np.log(b[ok]))).sum())
        return out

    def best(self, tie: float = 1e-9) -> dict[int, int]:
        """Most probable states of max-product beliefs; tied variables follow the best cells that agree with what is set."""
        out = {}
        for v in self.by_var:
            b = self.belief(v)
            if (b >= b.max() - tie).sum() == 1:
                out[v] = int(b.argmax())
        for i, (_, vs, _) in enumerate(self.factors):
            if all(v in out for v in vs):
                continue
            b = self.factor_belief(i)
            cells = np.argwhere(b >= b.max() - tie)
            cell = max(cells, key=lambda c: (sum(out.get(v) == s for v, s in zip(vs, c, strict=True)), [-x for x in c]))
            for v, s in zip(vs, cell, strict=True):
                out.setdefault(v, int(s))
        return {v: out.get(v, 0) for v in self.by_var}

    # Gibbs sampling
    def start(self, rng: np.random.Generator) -> dict[int, int]:
        """An assignment that is possible factor by factor where there is one."""
        x: dict[int, int] = {}
        for _, vs, t in self.factors:
            free = [v for v in vs if v not in x]
            if free:
                given = t[tuple(x[v] if v in x else slice(None) for v in vs)]
                cells = np.argwhere(given > 1e-12)
                cell = cells[rng.integers(len(cells))] if len(cells) else [0] * len(free)
                x.update({v: int(s) for v, s in zip(free, cell, strict=True)})
        return x

    def sample(self, rng: np.random.Generator, draws: int, burn_in: int = 0) -> np.ndarray:
        """Draws x variables (sorted by id), one full sweep for each draw."""
        order, x = list(self.by_var), self.start(rng)
        out = np.zeros((draws, len(order)), np.int64)
        for n in range(-burn_in, draws):
            for v in order:
                p = np.ones(self.states[v])
                for i in self.by_var[v]:
                    _, vs, t = self.factors[i]
                    p = p * t[tuple(slice(None) if u == v else x[u] for u in vs)]
                if (s := p.sum()) > 0:
                    x[v] = int(min(np.searchsorted(np.cumsum(p / s), rng.random()), len(p) - 1))
            if n >= 0:
                out[n] = [x[v] for v in order]
        return out


def _graph(pdf: pd.DataFrame) -> Graph:
    return Graph(zip(pdf["factor_id"], pdf["var_ids"], pdf["states"], pdf["values"], strict=True))


def _seed(seed: int, key) -> int:
    return zlib.crc32(f"{seed}:{key}".encode())


def marginals(factors: DataFrame, tolerance: float = 1e-6, rounds: int = 10_000, maximise: bool = False, damping: float = 0.0, fall_back: int = 0, seed: int = 1) -> DataFrame:
    """(graph_id, var_id, state, p, log_z, converged). Where propagation doesn't converge and ``fall_back`` is positive, so many
    Gibbs draws give the marginals and log_z is null; without it the graph has one row with only its identifier and converged
    false."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, gid, rows = _graph(pdf), pdf["graph_id"].iloc[0], []
        if g.propagate(tolerance, rounds, maximise, damping):
            z = g.log_z()
            rows = [(gid, v, s, float(p), z, True) for v in g.by_var for s, p in enumerate(g.belief(v))]
        elif fall_back and not maximise:
            draws = g.sample(np.random.default_rng(_seed(seed, gid)), fall_back)
            rows = [(gid, v, s, float((draws[:, k] == s).mean()), None, False) for k, v in enumerate(g.by_var) for s in range(g.states[v])]
        else:
            rows = [(gid, None, None, None, None, False)]
        return pd.DataFrame(rows, columns=["graph_id", "var_id", "state", "p", "log_z", "converged"]).astype({"var_id": "Int64", "state": "Int32"})

    kind = factors.schema["graph_id"].dataType.simpleString()
    return factors.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, var_id long, state int, p double, log_z double, converged boolean")


def most_probable(factors: DataFrame, tolerance: float = 1e-6, rounds: int = 10_000) -> DataFrame:
    """(graph_id, var_id, state, converged) of the max-product assignment; a graph that doesn't converge has one row without
    assignment and converged false."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, gid = _graph(pdf), pdf["graph_id"].iloc[0]
        ok = g.propagate(tolerance, rounds, maximise=True)
        rows = [(gid, v, s, True) for v, s in g.best().items()] if ok else [(gid, None, None, False)]
        return pd.DataFrame(rows, columns=["graph_id", "var_id", "state", "converged"]).astype({"var_id": "Int64", "state": "Int32"})

    kind = factors.schema["graph_id"].dataType.simpleString()
    return factors.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, var_id long, state int, converged boolean")


def _scaled(m: np.ndarray, empty: float) -> np.ndarray:
    """Rows scaled to a sum of one; ``empty`` everywhere in a row of zeros."""
    s = m.sum(1, keepdims=True)
    return np.divide(m, s, out=np.full_like(m, empty), where=s > 0)


class Batch(Graph):
    """One graph and many samples: messages are arrays with a row for each sample, so the graph is there once."""

    def __init__(self, rows, told: dict[int, np.ndarray]):
        super().__init__(rows)
        self.told = told  # of a variable: samples x states

    def propagate_all(self, n: int, tolerance: float = 1e-6, rounds: int = 10_000) -> np.ndarray:
        """Messages of ``n`` samples as :meth:`Graph.propagate` sends them, the evidence being one more factor of its variables;
        a sample that has settled (or keeps swinging) keeps its messages. Returns which ones converged."""
        scaled = lambda m: _scaled(m, 1 / m.shape[1])
        even = {v: np.full((n, k), 1 / k) for v, k in self.states.items()}
        self.to_var = {(i, v): even[v].copy() for v, fs in self.by_var.items() for i in fs}
        self.to_factor = {key: m.copy() for key, m in self.to_var.items()}
        self.told = {v: _scaled(m, 0.0) for v, m in self.told.items()}
        left, ok = np.arange(n), np.zeros(n, bool)
        past: list[np.ndarray] = []
        rises = np.zeros(n, int)
        for number in range(rounds):
            change = np.zeros(len(left))
            for v, fs in self.by_var.items():
                for i in fs:
                    _, vs, t = self.factors[i]
                    full = t[None]
                    for axis, u in enumerate(vs):
                        if u != v:
                            shape = [len(left)] + [1] * len(vs)
                            shape[axis + 1] = -1
                            full = full * self.to_factor[i, u][left].reshape(shape)
                    axes = tuple(a + 1 for a, u in enumerate(vs) if u != v)
                    new = scaled(np.broadcast_to(full.sum(axes) if axes else full, (len(left), self.states[v])).astype(float))
                    change = np.maximum(change, np.abs(new - self.to_var[i, v][left]).max(1))
                    self.to_var[i, v][left] = new
                told = self.told[v][left] if v in self.told else None
                before = [np.ones((len(left), self.states[v])) if told is None else told]  # products of all messages before and after each
                for i in fs[:-1]:
                    before.append(scaled(before[-1] * self.to_var[i, v][left]))
                after = np.ones((len(left), self.states[v]))
                for i, b in zip(reversed(fs), reversed(before), strict=True):
                    self.to_factor[i, v][left] = scaled(b * after)
                    after = scaled(after * self.to_var[i, v][left])
            if past:
                rises[left] += change > past[-1]
            settled = change <= tolerance
            ok[left[settled]] = True
            stop = settled | (rises[left] >= 10) if number + 1 >= 50 else settled
            left, past = left[~stop], [change[~stop]]
            if not len(left):
                break
        return ok

    def beliefs(self, v: int, n: int) -> np.ndarray:
        """Samples x states; all zero where the evidence is impossible."""
        b = self.told.get(v, np.ones((n, self.states[v]))).copy()
        for i in self.by_var[v]:
            b = _scaled(b * self.to_var[i, v], 0.0)
        return _scaled(b, 0.0)

    def alone(self, k: int) -> Graph:
        """The graph of one sample, its evidence as factors."""
        told = [(f"evidence{v}", (v,), (self.states[v],), m[k]) for v, m in self.told.items()]
        return Graph([(f, vs, t.shape, t.reshape(-1, order="F")) for f, vs, t in self.factors] + told)


NUMBERS_A_BATCH = 4_000_000  # of the messages that a task holds for its samples


def prior_and_posterior(factors: DataFrame, evidence: DataFrame, base: DataFrame | None = None, fall_back: int = 500, tolerance: float = 1e-6, rounds: int = 10_000, seed: int = 1) -> DataFrame:
    """(graph_id, sample_id, var_id, state, prior, posterior, converged): the marginals of every graph without evidence (or under
    that of ``base``) and under each sample's. What doesn't converge falls back to Gibbs draws.

    The samples of a graph are dealt out in batches, by what the graph's messages cost: a batch is one task's array, and the
    graph is shipped once a batch, not once a sample. So what is shuffled are factors times batches, and the evidence.

    evidence: sample_id, graph_id, var_id, values (of the variable's states); base: the same without sample_id."""
    g = F.col("graph_id").cast("string").alias("g")
    keyed = factors.select(g, F.col("factor_id").cast("string").alias("factor_id"), "var_ids", "states", "values")
    told = evidence.select(g, F.col("sample_id").cast("string").alias("s"), F.col("var_id").cast("long").alias("var_id"), F.col("values").cast("array<double>").alias("told"))
    cost = keyed.groupBy("g").agg(F.sum(F.aggregate("states", F.lit(0).cast("long"), lambda a, b: a + b)).alias("cost"))
    batches = told.groupBy("g").agg(F.count_distinct("s").alias("n")).join(cost, "g").select("g", F.ceil(F.col("n") * F.col("cost") / NUMBERS_A_BATCH).cast("int").alias("batches"))
    batches = cut(batches, "batches")  # a row a graph
    each = keyed.join(batches, "g").withColumn("batch", F.explode(F.sequence(F.lit(1), "batches"))).drop("batches")
    sides = told.join(batches, "g").withColumn("batch", (F.pmod(F.xxhash64("s"), F.col("batches")) + 1).cast("int")).drop("batches")
    alone = keyed.withColumn("batch", F.lit(0))
    seen = base.select(g, F.lit(None).cast("string").alias("s"), F.col("var_id").cast("long").alias("var_id"), F.col("values").cast("array<double>").alias("told"), F.lit(0).alias("batch")) if base is not None else sides.select("g", "s", "var_id", "told", "batch").limit(0)

    def run(key, graph: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["g", "s", "var_id", "state", "p", "converged"]
        if graph.empty:
            return pd.DataFrame(columns=columns)
        samples = sorted(told["s"].dropna().unique()) if key[1] else [None]
        if not samples:
            return pd.DataFrame(columns=columns)
        number = {s: k for k, s in enumerate(samples)}
        states = {v: n for vs, ns in zip(graph["var_ids"], graph["states"], strict=True) for v, n in zip(vs, ns, strict=True)}
        said: dict[int, np.ndarray] = {}
        for s, v, m in zip(told["s"], told["var_id"], told["told"], strict=True):
            if v in states:
                if v not in said:
                    said[v] = np.ones((len(samples), states[v]))
                said[v][number[s if key[1] else None]] *= m
        b = Batch(zip(graph["factor_id"], graph["var_ids"], graph["states"], graph["values"], strict=True), said)
        ok = b.propagate_all(len(samples), tolerance, rounds)
        draws = {k: b.alone(k).sample(np.random.default_rng(_seed(seed, (key[0], samples[k]))), fall_back) for k in np.flatnonzero(~ok).tolist()} if fall_back else {}
        parts = []
        for at, v in enumerate(b.by_var):
            p = b.beliefs(v, len(samples))
            for k, d in draws.items():
                p[k] = np.bincount(d[:, at], minlength=b.states[v]) / len(d)
            n = b.states[v]
            parts.append(pd.DataFrame({"g": key[0], "s": np.repeat(np.array(samples, object), n), "var_id": v, "state": np.tile(np.arange(n), len(samples)), "p": p.reshape(-1), "converged": np.repeat(ok, n)}))
        return pd.concat(parts)[columns]

    schema = "g string, s string, var_id long, state int, p double, converged boolean"
    m = each.union(alone.select(*each.columns)).groupBy("g", "batch").cogroup(sides.select("g", "s", "var_id", "told", "batch").union(seen).groupBy("g", "batch")).applyInPandas(run, schema)
    m = cut(m, "beliefs")
    prior = m.where("s IS NULL").select("g", "var_id", "state", F.col("p").alias("prior"))
    return m.where("s IS NOT NULL").join(prior, ["g", "var_id", "state"]).select(F.col("g").alias("graph_id"), F.col("s").alias("sample_id"), "var_id", "state", "prior", F.col("p").alias("posterior"), "converged")


def gibbs_samples(factors: DataFrame, draws: int = 500, burn_in: int = 0, restarts: int = 1, seed: int = 1) -> DataFrame:
    """(graph_id, chain, draw, var_id, state): chains are separate tasks, seeded by graph and chain."""
    chains = factors.crossJoin(factors.sparkSession.range(restarts).withColumnRenamed("id", "chain"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, gid, chain = _graph(pdf), pdf["graph_id"].iloc[0], int(pdf["chain"].iloc[0])
        got, vs = g.sample(np.random.default_rng(_seed(seed, (gid, chain))), draws, burn_in), list(g.by_var)
        return pd.DataFrame({"graph_id": gid, "chain": chain, "draw": np.repeat(np.arange(draws), len(vs)), "var_id": np.tile(vs, draws), "state": got.reshape(-1)})

    kind = factors.schema["graph_id"].dataType.simpleString()
    return chains.groupBy("graph_id", "chain").applyInPandas(run, f"graph_id {kind}, chain long, draw long, var_id long, state int")


def gibbs_marginals(samples: DataFrame, states: DataFrame) -> DataFrame:
    """(graph_id, var_id, state, p): a state that was never drawn counts as drawn once, then the shares are scaled to one.
    ``states``: graph_id, var_id, states."""
    n = samples.groupBy("graph_id", "var_id", "state").agg(F.count(F.lit(1)).alias("n"))
    grid = states.select("graph_id", "var_id", F.explode(F.sequence(F.lit(0), F.col("states") - 1)).alias("state"))
    full = grid.join(n, ["graph_id", "var_id", "state"], "left").select("graph_id", "var_id", "state", F.coalesce("n", F.lit(1)).alias("n"))
    total = full.groupBy("graph_id", "var_id").agg(F.sum("n").alias("t"))
    return full.join(total, ["graph_id", "var_id"]).select("graph_id", "var_id", "state", (F.col("n") / F.col("t")).alias("p"))


def potential_scale(samples: DataFrame, state: int = 0, block: int = 100) -> DataFrame:
    """(graph_id, var_id, r_hat): the Gelman-Rubin statistic of the share of ``state`` over blocks of draws in each chain; null
    with fewer than two chains or blocks, or without variance."""
    means = samples.groupBy("graph_id", "var_id", "chain", F.floor(F.col("draw") / block).alias("b")).agg(F.avg((F.col("state") == state).cast("double")).alias("x"))
    chain = means.groupBy("graph_id", "var_id", "chain").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.count(F.lit(1)).alias("n"))
    g = chain.groupBy("graph_id", "var_id").agg(F.var_samp("m").alias("between"), F.avg("v").alias("within"), F.min("n").alias("n"))
    return g.select("graph_id", "var_id", F.sqrt(F.try_divide((F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between"), F.col("within"))).alias("r_hat"))


def template_beliefs(template: DataFrame, evidence: DataFrame, target: int) -> DataFrame:
    """(sample_id, gene, belief): belief of one variable of a small template graph for each sample and gene.

    template: kernel rows without evidence; evidence: sample_id, gene, var_id, state. Each *distinct* combination of
    evidence is evaluated once and joined back, so the work grows with the combinations, not with the samples."""
    key = F.array_join(F.array_sort(F.transform(F.collect_list(F.struct("var_id", "state")), lambda x: F.concat_ws("=", x["var_id"].cast("string"), x["state"].cast("string")))), ";")
    keyed = evidence.groupBy("sample_id", "gene").agg(key.alias("graph_id"))
    seen = keyed.select("graph_id").distinct()
    states = template.select(F.explode(F.arrays_zip("var_ids", "states")).alias("x")).select(F.col("x.var_ids").alias("var_id"), F.col("x.states").alias("n")).distinct()
    part = seen.select("graph_id", F.explode(F.split("graph_id", ";")).alias("p")).select("graph_id", F.split("p", "=")[0].cast("long").alias("var_id"), F.split("p", "=")[1].cast("int").alias("state")).join(states, "var_id")
    unary = part.select("graph_id", F.concat(F.lit("evidence"), F.col("var_id").cast("string")).alias("factor_id"), F.array("var_id").alias("var_ids"), F.array("n").alias("states"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i == F.col("state"), 1.0).otherwise(0.0)).alias("values"))
    graphs = template.drop("graph_id").crossJoin(seen).select("graph_id", F.col("factor_id").cast("string").alias("factor_id"), "var_ids", "states", "values").unionByName(unary)
    b = marginals(graphs).where(F.col("var_id") == target).groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "p"))), lambda x: x["p"]).alias("belief"))
    return keyed.join(b, "graph_id").select("sample_id", "gene", "belief")
