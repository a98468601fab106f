"""Drug impact: targets and strengths, impacts on outputs, matrices, comparison of clusterings and permutation tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.functions.scalar import affinity_strength, modification_type
from netquill.operators.components import components
from netquill.operators.relational import adjusted_rand, impact_summary, least_affinity
from netquill.plans.checkpoint import cut, free


def target_modifications(interactions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(drug, gene, modification, strength) of interactions with an affinity. interactions: interaction_id, drug, target, type;
    evidence: interaction_id, assay_type, assay_value, assay_median."""
    a = least_affinity(evidence, ["interaction_id"], "assay_value", "assay_median", "assay_type").where("affinity IS NOT NULL")
    return interactions.join(a, "interaction_id").select("drug", F.col("target").alias("gene"), modification_type(F.col("type")).alias("modification"), affinity_strength(F.col("affinity")).alias("strength"))


def target_network(interactions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(drug, target, weight) with a positive strength."""
    return target_modifications(interactions, evidence).where("strength > 0").groupBy("drug", F.col("gene").alias("target")).agg(F.max("strength").alias("weight"))


def injected(variables: DataFrame, edges: DataFrame, modifications: DataFrame) -> DataFrame:
    """(drug, var_id, modification, strength): of a gene's variables one in each connected part of the network gets the drug's
    effect, first one without relation into it, then that of the smallest number. variables: var_id, gene, source_id, driven."""
    c = components(edges).select(F.col("node").alias("var_id"), F.col("root").alias("part"))
    v = variables.where("gene IS NOT NULL").join(c, "var_id", "left").withColumn("part", F.coalesce("part", "var_id"))
    best = v.groupBy("gene", "part").agg(F.min_by("var_id", F.struct("driven", F.coalesce("source_id", F.lit(0)), "var_id")).alias("var_id"))
    m = modifications.join(best, "gene")
    return m.groupBy("drug", "var_id").agg(F.min_by("modification", F.struct("gene", "modification")).alias("modification"), F.min_by("strength", F.struct("gene", "modification")).alias("strength"))


def as_scenarios(injections: DataFrame) -> DataFrame:
    """Scenario rows of a simulation: scenario_id is the drug."""
    none = F.lit(None).cast("double")
    return injections.select(F.col("drug").alias("scenario_id"), "var_id", none.alias("stim"), F.when(F.col("modification") == "Activation", F.col("strength")).alias("act"), F.when(F.col("modification") == "Inhibition", F.col("strength")).alias("inh"), none.alias("init"))


def impacts(changes: DataFrame, outputs: DataFrame) -> DataFrame:
    """(scenario_id, sum_impact, mean_impact) over output keys."""
    return impact_summary(changes.join(outputs.select("key").distinct(), "key", "left_semi"), ["scenario_id"])


def hits(targets: DataFrame, genes: DataFrame) -> DataFrame:
    """(drug, pathway, targets): which of a drug's targets a pathway has. targets: drug, gene; genes: pathway, gene."""
    return targets.join(genes, "gene").groupBy("drug", "pathway").agg(F.array_sort(F.collect_set("gene")).alias("targets"))


def stability(changes_by_horizon: DataFrame, horizons: list[int]) -> DataFrame:
    """Changes of each key with a column for each horizon. changes_by_horizon: key, horizon, change."""
    return changes_by_horizon.groupBy("key").pivot("horizon", horizons).agg(F.first("change"))


def compare_clusterings(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n shared members and their adjusted Rand index. Both: member, cluster."""
    return adjusted_rand(a.select("member", F.col("cluster").alias("__a")).join(b.select("member", F.col("cluster").alias("__b")), "member"), "__a", "__b")


def compare_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """(k, n, n_clusters, ari) of one clustering (member, cluster) against many (k, member, cluster)."""
    both = a.select("member", F.col("cluster").alias("x")).join(b.select("k", "member", F.col("cluster").alias("y")), "member")
    two = lambda c: c * (c - 1) / 2.0
    cell = both.groupBy("k", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    s = cell.groupBy("k").agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"), F.count_distinct("y").alias("n_clusters"))
    sx = cell.groupBy("k", "x").agg(F.sum("n").alias("m")).groupBy("k").agg(F.sum(two(F.col("m"))).alias("sx"))
    sy = cell.groupBy("k", "y").agg(F.sum("n").alias("m")).groupBy("k").agg(F.sum(two(F.col("m"))).alias("sy"))
    e = F.try_divide(F.col("sx") * F.col("sy"), two(F.col("n")))
    return s.join(sx, "k").join(sy, "k").select("k", "n", "n_clusters", F.try_divide(F.col("s") - e, (F.col("sx") + F.col("sy")) / 2 - e).alias("ari"))


MOST_EXACT = 10**9  # rows up to which draws are exact; of more, normal ones with the same mean and variance


def _hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of ``n`` drawn without replacement are among the ``good``."""
    total = good + bad
    if total.max(initial=0) < MOST_EXACT:
        return rng.hypergeometric(good, bad, n)
    mean = n * good / np.maximum(total, 1)
    var = mean * (bad / np.maximum(total, 1)) * np.maximum(total - n, 0) / np.maximum(total - 1, 1)
    return np.clip(np.rint(rng.normal(mean, np.sqrt(var))), np.maximum(0, n - bad), np.minimum(n, good)).astype(np.int64)


def permutation_null(df: DataFrame, a: str, b: str, times: int = 10_000, seed: int = 1) -> DataFrame:
    """(rep, ari): the index with labels ``b`` dealt anew in each repetition. Only the labels' counts matter, so no row is dealt:
    each repetition draws a contingency table with the same margins, cell by cell. What is broadcast are the two margins."""
    ka = np.array([r[0] for r in df.groupBy(a).agg(F.count(F.lit(1)).alias("n")).orderBy(a).select("n").collect()], np.int64)  # a row a label
    kb = np.array([r[0] for r in df.groupBy(b).agg(F.count(F.lit(1)).alias("n")).orderBy(b).select("n").collect()], np.int64)
    two = lambda x: x * (x - 1) / 2.0
    sa, sb, n = two(ka.astype(float)).sum(), two(kb.astype(float)).sum(), float(ka.sum())
    expected, most = (sa * sb / two(n) if n > 1 else 0.0), (sa + sb) / 2
    held = df.sparkSession.sparkContext.broadcast((ka, kb))

    def run(batches):
        for pdf in batches:
            ka, kb = held.value
            reps = pdf["id"].to_numpy()
            for at in range(0, len(reps), 500):  # one generator for each block of repetitions, so any partitioning draws the same
                for block in np.unique(reps[at : at + 500] // 500):
                    rng = np.random.default_rng([seed, int(block)])
                    left = np.tile(kb, (500, 1))
                    s = np.zeros(500)
                    for size in ka:
                        want, rest = np.full(500, size), left.sum(1)
                        for j in range(len(kb)):
                            rest = rest - left[:, j]
                            got = _hypergeometric(rng, left[:, j], rest, want)
                            s += two(got.astype(float))
                            left[:, j] -= got
                            want = want - got
                    mine = reps[at : at + 500][reps[at : at + 500] // 500 == block]
                    value = (s - expected) / (most - expected) if most != expected else np.full(500, np.nan)
                    yield pd.DataFrame({"rep": mine, "ari": value[mine % 500]})

    out = df.sparkSession.range(times).mapInPandas(run, "rep long, ari double")
    return out.select("rep", F.when(~F.isnan("ari"), F.col("ari")).alias("ari"))


def markov_clusters(edges: DataFrame, inflation: float = 2.0, rounds: int = 30, least: float = 1e-5, most: int = 500) -> DataFrame:
    """(member, cluster) by expansion and inflation of a column-stochastic matrix. edges: a, b, weight; undirected. After each
    round a column keeps its ``most`` largest entries of at least ``least`` and is scaled to one again, which bounds what the next
    expansion makes of it to ``most`` squared."""
    sym = edges.select("a", "b", "weight").union(edges.select("b", "a", "weight"))
    nodes = sym.select("a").distinct()
    m = sym.groupBy("a", "b").agg(F.max("weight").alias("w")).union(nodes.select("a", F.col("a").alias("b"), F.lit(1.0)))
    share = F.col("w") / F.sum("w").over(W.partitionBy("b"))

    def scaled(d: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("b").orderBy(F.desc("w"), "a"))
        return d.withColumn("w", share).where(F.col("w") >= least).withColumn("rank", rank).where(F.col("rank") <= most).drop("rank").withColumn("w", share)

    m = cut(scaled(m), "mcl")
    before = None
    for _ in range(rounds):
        sq = m.alias("x").join(m.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("v")), "b").groupBy("a", "c").agg(F.sum(F.col("w") * F.col("v")).alias("w"))
        old, m = m, cut(scaled(sq.select("a", F.col("c").alias("b"), F.pow("w", F.lit(inflation)).alias("w"))), "mcl")
        free(old)
        now = m.agg(F.count(F.lit(1)), F.round(F.sum(F.pow("w", F.lit(2.0))), 6)).first()
        if now == before:
            break
        before = now
    return m.groupBy(F.col("b").alias("member")).agg(F.min_by("a", F.struct(-F.round("w", 6), "a")).alias("cluster"))
