"""Expectation-maximisation for conditional tables with tied parameters.

Each evidence row makes one small graph; the expectation step runs the kernel on all of them and sums cell beliefs by
parameter group, the maximisation step divides counts by their parent state's total.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.operators import residual
from netquill.operators.kernel import _graph
from netquill.plans.checkpoint import cut, free


def maximised(counts: DataFrame, group: str = "group_id", parent: str = "parent_state", child: str = "child_state", n: str = "n") -> DataFrame:
    """(group, parent, child, value): counts over the total of their parent state."""
    total = F.sum(n).over(W.partitionBy(group, parent))
    return counts.select(group, parent, child, F.try_divide(F.col(n), total).alias("value"))


def expected(factors: DataFrame, evidence: DataFrame, background: float | None = None, beta: float = 1.0) -> tuple[DataFrame, float]:
    """(group_id, idx, n) with a prior count of one, and the log likelihood, each evidence against the graph without. Beliefs are
    counted to the power ``beta``.

    factors: factor_id, group_id (null: fixed), var_ids, states, values; evidence: sample_id, var_id, value and, if equal samples
    are one, weight: how many."""
    states = factors.select(F.explode(F.arrays_zip("var_ids", "states")).alias("x")).select(F.col("x.var_ids").alias("var_id"), F.col("x.states").alias("states")).distinct()
    unary = evidence.join(states, "var_id").select(
        F.col("sample_id").cast("string").alias("graph_id"), F.concat(F.lit("evidence"), F.col("var_id").cast("string")).alias("factor_id"), F.lit(None).cast("long").alias("group_id"),
        F.array("var_id").alias("var_ids"), F.array("states").alias("states"),
        F.when(F.col("states") == 2, F.array(1.0 - F.col("value"), F.col("value"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("states") - 1), lambda i: F.when(i == F.col("value").cast("int"), 1.0).otherwise(0.0))).cast("array<double>").alias("values"),
    )
    base = factors.select(F.col("factor_id").cast("string").alias("factor_id"), F.col("group_id").cast("long").alias("group_id"), "var_ids", "states", "values")
    weight = F.col("weight") if "weight" in evidence.columns else F.lit(1)
    per = base.crossJoin(evidence.groupBy(F.col("sample_id").cast("string").alias("graph_id")).agg(F.max(weight.cast("double")).alias("weight")))
    graphs = per.unionByName(unary.withColumn("weight", F.lit(None).cast("double")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _graph(pdf)
        ok = g.propagate()
        of = dict(zip(pdf["factor_id"], pdf["group_id"], strict=True))
        w = float(pdf["weight"].max())
        rows = [(int(of[f]), i, w * float(x) ** beta, 0.0) for k, (f, _, _) in enumerate(g.factors) if ok and not pd.isna(of[f]) for i, x in enumerate(g.factor_belief(k).reshape(-1, order="F"))]
        rows.append((None, None, w, w * g.log_z() if ok else float("nan")))
        return pd.DataFrame(rows, columns=["group_id", "idx", "n", "ll"]).astype({"group_id": "Int64", "idx": "Int64"})

    got = cut(graphs.groupBy("graph_id").applyInPandas(run, "group_id long, idx long, n double, ll double"), "em")
    if background is None:
        g = _graph(base.toPandas())  # the parameters of one graph
        g.propagate()
        background = g.log_z()
    ll, n = got.where("group_id IS NULL").agg(F.sum("ll"), F.sum("n")).first()
    counts = got.where("group_id IS NOT NULL").groupBy("group_id", "idx").agg((F.sum("n") + 1.0).alias("n"))
    return counts, float(ll or 0.0) - (n or 0.0) * background


def learn(factors: DataFrame, evidence: DataFrame, rounds: int = 50, tolerance: float = 1e-3, beta: float = 1.0) -> tuple[DataFrame, float, list[float]]:
    """(factors with learned values, last log likelihood, its course). Learnable factors have two variables, [child, parent].
    Stops when the likelihood changes by at most ``tolerance`` of itself; if a round fails, the last good values stay."""
    course: list[float] = []
    now = cut(factors, "em-factors")
    child = factors.where("group_id IS NOT NULL").groupBy("group_id").agg(F.first(F.element_at("states", 1)).alias("n_child"))
    for _ in range(rounds):
        counts, ll = expected(now, evidence, beta=beta)
        if not np.isfinite(ll):
            break
        course.append(ll)
        if len(course) > 1 and abs(course[-1] - course[-2]) <= tolerance * abs(course[-2]):
            break
        cells = counts.join(child, "group_id").select("group_id", (F.col("idx") % F.col("n_child")).alias("child_state"), F.floor(F.col("idx") / F.col("n_child")).alias("parent_state"), "idx", "n")
        value = F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy("group_id", "parent_state")))
        new = cells.select("group_id", F.struct("idx", value.alias("v")).alias("c")).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["v"]).alias("new"))
        now = cut(now.join(new, "group_id", "left").select(*(F.coalesce("new", "values").alias("values") if c == "values" else F.col(c) for c in factors.columns)), "em-factors")
    return now, (course[-1] if course else float("nan")), course


def expected_on_tables(factors: DataFrame, links: DataFrame, evidence: DataFrame, **options) -> tuple[DataFrame, float]:
    """:func:`expected` for a graph of any size, all samples at once as one fixpoint over tables: (group_id, idx, n) with a prior
    count of one, and the log likelihood, each sample against the graph without evidence.

    factors: factor_id, group_id (null: fixed), values; links: factor_id, pos, var_id, states; evidence: sample_id, var_id, values
    and, if equal samples are one, weight."""
    weight = F.col("weight") if "weight" in evidence.columns else F.lit(1)
    of = F.concat(F.lit("="), F.col("sample_id").cast("string")).alias("sample_id")  # the sample without evidence is ''
    told = evidence.select(of, "var_id", "values", weight.cast("double").alias("weight"))
    weights = told.groupBy("sample_id").agg(F.max("weight").alias("weight"))
    alone = factors.sparkSession.range(1).select(F.lit("").alias("sample_id"), F.lit(None).cast(told.schema["var_id"].dataType).alias("var_id"), F.lit(None).cast("array<double>").alias("values"))
    all_ = cut(told.select("sample_id", "var_id", "values").union(alone), "evidence")
    b = residual.propagate(factors, links, all_, **options)
    grouped = factors.where("group_id IS NOT NULL").select("factor_id", "group_id")
    counts = b.cells.join(grouped, "factor_id").join(weights, "sample_id").groupBy("group_id", "idx").agg((F.sum(F.col("weight") * F.col("p")) + 1.0).alias("n"))
    z = residual.log_z(factors, links, b, all_).join(weights, "sample_id", "left")
    ll, n, background = z.agg(F.sum(F.when(F.col("sample_id") != "", F.col("weight") * F.col("log_z"))), F.sum("weight"), F.max(F.when(F.col("sample_id") == "", F.col("log_z")))).first()
    return counts, float(ll or 0.0) - (n or 0.0) * background


def learn_on_tables(factors: DataFrame, links: DataFrame, evidence: DataFrame, rounds: int = 50, tolerance: float = 1e-3, **options) -> tuple[DataFrame, float, list[float]]:
    """:func:`learn` for a graph of any size: (factors with learned values, last log likelihood, its course). Tables as in
    :func:`expected_on_tables`; learnable factors have two variables, [child, parent]."""
    child = links.where("pos = 0").join(factors.where("group_id IS NOT NULL"), "factor_id").groupBy("group_id").agg(F.first("states").alias("n_child"))
    course: list[float] = []
    now = cut(factors.select("factor_id", "group_id", "values"), "em-factors")
    for _ in range(rounds):
        try:
            counts, ll = expected_on_tables(now, links, evidence, **options)
        except residual.NotConverged:
            break
        if not np.isfinite(ll):
            break
        course.append(ll)
        if len(course) > 1 and abs(course[-1] - course[-2]) <= tolerance * abs(course[-2]):
            break
        parts = counts.join(child, "group_id").withColumn("parent", F.floor(F.col("idx") / F.col("n_child")))
        value = F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy("group_id", "parent")))
        new = parts.select("group_id", F.struct("idx", value.alias("v")).alias("c")).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["v"]).alias("new"))
        before, now = now, cut(now.join(new, "group_id", "left").select("factor_id", "group_id", F.coalesce("new", "values").alias("values")), "em-factors")
        free(before)
    return now, (course[-1] if course else float("nan")), course


def randomised(factors: DataFrame, seed: int) -> DataFrame:
    """Learnable values replaced by seeded random ones, each parent state's scaled to one."""
    n = F.element_at("states", 1)
    draw = F.transform(F.sequence(F.lit(0), F.size("values") - 1), lambda i: (F.pmod(F.xxhash64(F.col("group_id"), i, F.lit(seed)), F.lit(1_000_003)) + 1) / 1_000_003.0)
    total = lambda d, i: F.aggregate(F.slice(d, (F.floor(i / n) * n + 1).cast("int"), n), F.lit(0.0), lambda a, b: a + b)
    return factors.withColumn("__d", draw).withColumn("values", F.when(F.col("group_id").isNull(), F.col("values")).otherwise(F.transform(F.col("__d"), lambda d, i: d / total(F.col("__d"), i)))).drop("__d")


def learn_restarted(factors: DataFrame, evidence: DataFrame, restarts: int = 10, seed: int = 1, **options) -> tuple[DataFrame, float]:
    """The best of several runs from random tables."""
    runs = [learn(randomised(factors, seed + k), evidence, **options)[:2] for k in range(restarts)]
    return max(runs, key=lambda r: r[1] if np.isfinite(r[1]) else -np.inf)


#: The course of annealing; it must end with 1.
ANNEALING = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 0.75, 1.0)


def learn_annealed(factors: DataFrame, evidence: DataFrame, betas: tuple[float, ...] = ANNEALING, **options) -> tuple[DataFrame, float]:
    """Learning at growing powers of the beliefs, each from where the last one ended: flat counts first, true ones at last."""
    if betas[-1] != 1.0:
        raise ValueError("annealing must end with 1")
    last = float("nan")
    for beta in betas:
        factors, last, _ = learn(factors, evidence, beta=beta, **options)
    return factors, last
