"""Evidence from observations: distributions, expansion along the central dogma, base values and randomisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.functions import scalar
from netquill.operators.relational import ecdf, medians, shared_in_all
from netquill.plans.checkpoint import cut, row_numbers, running_totals

# The layer that a data type is evidence of, and whether both tails of its distribution are unusual.
ANCHOR = {"CNV": "DNA", "Methylation": "DNA", "mRNA_EXP": "mRNA", "miRNA": "mRNA", "Mutation": "protein"}
TWO_SIDED = {"CNV": True, "mRNA_EXP": True, "Methylation": True, "miRNA": True, "Mutation": False}
# Default thresholds of data types.
THRESHOLDS = {"CNV": [-0.5, 0.5], "mRNA_EXP": [-1.0, 1.0], "Methylation": [0.5], "miRNA": [-1.0, 1.0], "Mutation": [2.0]}


def anchors(obs: DataFrame) -> DataFrame:
    """Adds anchor, the layer's variable name of each observation."""
    layer = F.create_map(*[F.lit(x) for kv in ANCHOR.items() for x in kv])
    return obs.withColumn("anchor", F.concat_ws("_", "gene", layer[F.col("data_type")]))


def discretized(obs: DataFrame, thresholds: dict[str, list[float]] | None = None, states: int | None = None) -> DataFrame:
    """Adds state by the data type's thresholds; types without have null."""
    out = F.lit(None).cast("int")
    for kind, t in (thresholds or THRESHOLDS).items():
        out = F.when(F.col("data_type") == kind, scalar.discretize(F.col("value"), t, states)).otherwise(out)
    return obs.withColumn("state", out)


def empirical(obs: DataFrame, genes: DataFrame | None = None, states: int = 3, whole_matrix: bool = True) -> DataFrame:
    """Adds marginal: state probabilities from the data type's distribution. ``genes`` keeps rows; the distribution is over the
    whole matrix or (``whole_matrix`` false) over the kept rows."""
    keep = (lambda d: d) if genes is None else (lambda d: d.join(genes.select("gene").distinct(), "gene", "left_semi"))
    with_cdf = keep(ecdf(obs, "data_type")) if whole_matrix else ecdf(keep(obs), "data_type")
    one = F.col("data_type").isin(*[k for k, two in TWO_SIDED.items() if not two])
    return with_cdf.withColumn("marginal", F.when(one, scalar.empirical_marginal(F.col("cpd"), 2, False)).otherwise(scalar.empirical_marginal(F.col("cpd"), states, True)))


def mixture(obs: DataFrame, thresholds: dict[str, list[float]] | None = None, states: int = 3) -> DataFrame:
    """Adds marginal: state probabilities under the Gaussian mixture that the data type's thresholds make; null for types without."""
    out = F.lit(None).cast("array<double>")
    for kind, t in (thresholds or THRESHOLDS).items():
        size = 2 * len(t) - 1
        if size == states or (size, states) == (3, 2):
            out = F.when(F.col("data_type") == kind, scalar.mixture_marginal(F.col("value"), scalar.mixture_components(t, states))).otherwise(out)
    return obs.withColumn("marginal", out)


def scored_mutations(obs: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds marginal of mutation scores: one-sided, against the distribution of ``scores`` (column score), which are those of all
    distinct mutations and not the samples' means."""
    total = scores.where("score IS NOT NULL").agg(F.count(F.lit(1)).alias("total"))
    points = scores.where("score IS NOT NULL").groupBy(F.col("score").alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn("asked", F.lit(0))
    asked = obs.where("value IS NOT NULL").select(F.col("value").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked")).distinct()
    both = points.unionByName(asked).groupBy("at").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")).withColumn("all", F.lit(1))
    cum = running_totals(both, ["all"], "at", "n", "c").where("asked = 1").crossJoin(total).select(F.col("at").alias("value"), F.try_divide(F.col("c"), F.col("total")).alias("cpd"))
    return obs.join(cum, "value", "left").withColumn("marginal", scalar.empirical_marginal(F.col("cpd"), 2, False)).select(*obs.columns, "cpd", "marginal")


# Chance of an observation given its anchor's state, the observation varying fastest.
OBSERVED = {2: [0.9, 0.1, 0.1, 0.9], 3: [0.9, 0.05, 0.05, 0.05, 0.9, 0.05, 0.05, 0.05, 0.9]}


def observation_factors(obs: DataFrame, states: int = 3, values: dict[str, list[float]] | None = None) -> DataFrame:
    """(factor_id, group_id, child, parent, data_type, states, values): one learnable table [observation, anchor] for each gene and
    data type that is observed; all factors of a data type share one group. ``values`` replaces a type's table."""
    table = F.array(*map(F.lit, OBSERVED[states]))
    for kind, v in (values or {}).items():
        if len(v) != states**2:
            raise ValueError(f"{kind}: {len(v)} values for {states} states")
        table = F.when(F.col("data_type") == kind, F.array(*(F.lit(float(x)) for x in v))).otherwise(table)
    group = F.create_map(*[F.lit(x) for i, k in enumerate(ANCHOR) for x in (k, i)])
    pairs = anchors(obs.select("gene", "data_type").distinct()).where(F.col("data_type").isin(*ANCHOR))
    child = F.concat_ws("_", "gene", "data_type")
    return pairs.select(F.concat_ws("~", child, "anchor").alias("factor_id"), group[F.col("data_type")].cast("long").alias("group_id"), child.alias("child"), F.col("anchor").alias("parent"), "data_type", F.array(F.lit(states), F.lit(states)).alias("states"), table.alias("values"))


def dogma_factors(genes: DataFrame, down_to: str = "DNA") -> DataFrame:
    """(factor_id, child, parent, states, values): the table [child, parent] of each edge of :func:`dogma`, three states, in which
    the child most probably has its parent's state."""
    from netquill.operators.pathway import factor_values

    t = factor_values(genes.sparkSession, ["INPUT"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "val"))), lambda c: c["val"]).alias("values"))
    e = dogma(genes, down_to)
    return e.crossJoin(t).select(F.concat_ws("~", "child", "parent").alias("factor_id"), "child", "parent", F.array(F.lit(3), F.lit(3)).alias("states"), "values")


def dogma(genes: DataFrame, down_to: str = "DNA") -> DataFrame:
    """(parent, child) of the chain DNA, mRNA, protein, target of each gene and target (columns gene, target); a protein that is
    there only gets the new target."""
    chain = ["DNA", "mRNA", "protein"]
    layers = chain[chain.index(down_to) :]
    g = genes.select("gene").distinct()
    name = lambda k: F.concat_ws("_", "gene", F.lit(k))
    out = genes.select(name("protein").alias("parent"), F.col("target").alias("child")).distinct()
    for a, b in zip(layers, layers[1:], strict=False):
        out = out.union(g.select(name(a).alias("parent"), name(b).alias("child")))
    return out


def base_values(obs: DataFrame) -> DataFrame:
    """(data_type, value): median of two-sided types, minimum of one-sided ones."""
    one = F.col("data_type").isin(*[k for k, two in TWO_SIDED.items() if not two])
    low = obs.groupBy("data_type").agg(F.min("value").alias("low"))
    return low.join(medians(obs.where(~one), "data_type"), "data_type", "left").select("data_type", F.when(one, F.col("low")).otherwise(F.col("median")).alias("value"))


def randomised(obs: DataFrame, n: int = 1000, seed: int = 1) -> DataFrame:
    """(sample_id, gene, data_type, value) of ``n`` made-up samples: each gene draws one (sample, shared gene) and takes all its
    data types together. Draws are hashes of (sample, gene), so any partitioning gives the same."""
    shared = shared_in_all(obs, "gene", "data_type")
    pool = cut(row_numbers(obs.join(shared, "gene", "left_semi").select("sample_id", "gene").distinct(), "sample_id", "gene"), "pool")
    size = pool.agg(F.count(F.lit(1)).alias("size"))
    fake = obs.sparkSession.range(n).select(F.concat(F.lit("random"), F.col("id")).alias("fake"))
    draws = fake.crossJoin(shared.select(F.col("gene").alias("to"))).crossJoin(size).withColumn("rn", F.pmod(F.xxhash64("fake", "to", F.lit(seed)), F.col("size")) + 1)
    drawn = draws.join(pool, "rn").select("fake", "to", "sample_id", "gene")
    return drawn.join(obs, ["sample_id", "gene"]).select(F.col("fake").alias("sample_id"), F.col("to").alias("gene"), "data_type", "value")


def as_states(obs: DataFrame) -> DataFrame:
    """Values truncated toward zero; names stay."""
    return obs.withColumn("value", F.col("value").cast("int"))
