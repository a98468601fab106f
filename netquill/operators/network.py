"""Pairwise random fields over an interaction network and the scores of its genes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.functions.scalar import log_ratio
from netquill.operators.relational import with_degrees


# Pair values of the models that don't depend on degrees.
PAIR_VALUES = {"mrf": (0.31, 0.19, 0.19, 0.31), "ising": (0.99, 0.01, 0.01, 0.99)}


def pair_values(model: str, gamma: float = 0.01, tau: float = 0.21) -> Column:
    """Values of a pair's factor; of the models degree and neighbour from the columns d1 and d2."""
    if model in PAIR_VALUES:
        return F.array(*map(F.lit, PAIR_VALUES[model]))
    if model == "degree":
        g, h = gamma, 1 - gamma
        return F.array(F.lit(2.0 * h), 1 + g - h / F.col("d1"), 1 + g - h / F.col("d2"), h * (1 / F.col("d1") + 1 / F.col("d2")))
    if model == "neighbour":
        e = F.exp(tau * (F.sqrt("d1") + F.sqrt("d2")))
        return F.array(e, F.lit(1.0), F.lit(1.0), e)
    raise ValueError(f"unknown model {model}")


def pair_factors(pairs: DataFrame, model: str = "mrf", gamma: float = 0.01, tau: float = 0.21) -> DataFrame:
    """(gene1, gene2, values) of binary genes, the first varying fastest. Models: mrf, ising, degree, neighbour."""
    d = pairs if model in PAIR_VALUES else with_degrees(pairs)
    return d.select("gene1", "gene2", pair_values(model, gamma, tau).alias("values"))


def gene_values(model: str = "mrf") -> tuple[float, float] | None:
    """Values of a gene's own factor, if the model has one."""
    return {"mrf": (0.975, 0.025), "neighbour": (1.0, math.exp(-4.6))}.get(model)


def factor_graph(pairs: DataFrame, genes: DataFrame, model: str = "mrf") -> tuple[DataFrame, DataFrame]:
    """(factors, links) of the network. ``genes``: gene, var_id."""
    v = pair_factors(pairs, model)
    a, b = genes.select(F.col("gene").alias("gene1"), F.col("var_id").alias("v1")), genes.select(F.col("gene").alias("gene2"), F.col("var_id").alias("v2"))
    e = v.join(a, "gene1").join(b, "gene2").withColumn("factor_id", F.concat_ws("~", "v1", "v2"))
    factors = e.select("factor_id", "values")
    links = e.select("factor_id", F.posexplode(F.array("v1", "v2")).alias("pos", "var_id")).withColumn("states", F.lit(2))
    if own := gene_values(model):
        one = genes.select(F.col("var_id").cast("string").alias("factor_id"), "var_id")
        factors = factors.union(one.select("factor_id", F.array(*map(F.lit, own))))
        links = links.union(one.select("factor_id", F.lit(0), "var_id", F.lit(2)))
    return factors, links


def scores(prior: DataFrame, posterior: DataFrame) -> DataFrame:
    """(sample_id, var_id, score): log odds ratio of state 1. prior: var_id, p; posterior: sample_id, var_id, p."""
    return posterior.join(prior.withColumnRenamed("p", "p0"), "var_id").select("sample_id", "var_id", log_ratio(F.col("p0"), F.col("p")).alias("score"))


def summed(scores_by_type: DataFrame) -> DataFrame:
    """Scores added over data types: sample_id, var_id, score."""
    return scores_by_type.groupBy("sample_id", "var_id").agg(F.sum("score").alias("score"))


def template_values(gene_factor: DataFrame, protein_belief: DataFrame) -> DataFrame:
    """Per sample: the gene's factor times its protein's belief, scaled to one. gene_factor: gene, values; protein_belief:
    sample_id, gene, belief. Distinct evidence should be evaluated once and joined back before this."""
    both = protein_belief.join(gene_factor, "gene")
    raw = F.zip_with("values", "belief", lambda a, b: a * b)
    total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
    return both.select("sample_id", "gene", F.transform(raw, lambda v: F.try_divide(v, total)).alias("values"))


def targets_of(interactions: DataFrame, source: str = "ENCODE", evidence: str = "co-expression") -> DataFrame:
    """(gene1, gene2) of one source with the evidence in its definition, within the largest component."""
    from netquill.operators.components import components
    from netquill.plans.checkpoint import cut

    e = cut(interactions.where((F.col("source") == source) & F.col("definition").contains(evidence)).select("gene1", "gene2").distinct(), "targets")
    c = cut(components(e), "targets")
    main = c.groupBy("root").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("root", F.struct(-F.col("n"), "root")).alias("root"))
    return e.join(c.join(main, "root", "left_semi").select(F.col("node").alias("gene1")), "gene1", "left_semi")
