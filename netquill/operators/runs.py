"""Whole runs, from tables of observations, reactions and interactions to scores: what the engine is for, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.functions import scalar
from netquill.operators import boolnet, drug, kernel, network, observations, pathway
from netquill.operators.relational import dense_index, impact_summary, without_currency
from netquill.plans.checkpoint import cut

BETA = 0.01  # fixed value: chance that a layer of the central dogma doesn't follow the one before
# Steps of the central dogma from a layer to the gene's node.
STEPS = {"DNA": 3, "mRNA": 2, "protein": 1}


def kernel_rows(factors: DataFrame, links: DataFrame) -> DataFrame:
    """(factor_id, var_ids, states, values) of factors and links."""
    v = links.groupBy("factor_id").agg(F.array_sort(F.collect_list(F.struct("pos", "var_id", "states"))).alias("x"))
    return v.join(factors, "factor_id").select(F.col("factor_id").cast("string").alias("factor_id"), F.transform("x", lambda x: x["var_id"].cast("long")).alias("var_ids"), F.transform("x", lambda x: x["states"].cast("int")).alias("states"), "values")


def _evidence(obs: DataFrame, thresholds: dict[str, list[float]] | None) -> DataFrame:
    """Adds values: what an observation says of its gene's two states, carried along the central dogma from the observed layer.
    The layers between are a chain of one symmetric table, whose power is known."""
    seen = observations.discretized(obs, thresholds, 2).where("state IS NOT NULL")
    table = observations.OBSERVED[2]
    of = lambda g: F.when(F.col("state") == 0, table[2 * g]).otherwise(table[2 * g + 1])
    steps = F.create_map(*[F.lit(x) for k, layer in observations.ANCHOR.items() for x in (k, STEPS[layer])])[F.col("data_type")]
    kept = (1 + F.pow(F.lit(1 - 2 * BETA), steps)) / 2
    return seen.withColumn("values", F.array(kept * of(0) + (1 - kept) * of(1), (1 - kept) * of(0) + kept * of(1)))


def network_scores(pairs: DataFrame, obs: DataFrame, model: str = "mrf", thresholds: dict[str, list[float]] | None = None, **options) -> DataFrame:
    """(sample_id, gene, score): how much each sample's observations change the odds of each gene of an interaction network, in
    powers of ten, summed over data types.

    The prior of a data type is the network's belief given the type's base observation of every observed gene; the posterior that
    given the sample's. pairs: gene1, gene2; obs: sample_id, gene, data_type, value. Each sample and type is one graph in a task."""
    genes = cut(dense_index(pairs.select(F.col("gene1").alias("gene")).union(pairs.select("gene2")), "gene", "var_id"), "genes")
    rows = kernel_rows(*network.factor_graph(pairs, genes, model))
    types = obs.select(F.col("data_type").alias("graph_id")).distinct()
    base = obs.select("gene", "data_type").distinct().join(observations.base_values(obs), "data_type")
    known = lambda d: _evidence(d, thresholds).join(genes, "gene")
    evidence = known(obs).select("sample_id", F.col("data_type").alias("graph_id"), "var_id", "values")
    both = kernel.prior_and_posterior(rows.crossJoin(types), evidence, known(base).select(F.col("data_type").alias("graph_id"), "var_id", "values"), **options)
    each = both.where("state = 1").select("sample_id", "var_id", scalar.log_ratio(F.col("prior"), F.col("posterior")).alias("score"))
    return network.summed(each).join(genes, "var_id").select("sample_id", "gene", "score")


def pathway_activities(participants: DataFrame, entities: DataFrame, evidence: DataFrame, **options) -> DataFrame:
    """(pathway_id, sample_id, entity_id, ipa) of every entity of every pathway for every sample: pathways become three-state factor
    graphs, whose prior and posterior marginals are compared.

    participants: pathway_id, reaction_id, entity_id, role, ord; entities: entity_id, names; evidence: sample_id, entity_id, state.
    All pairs of pathway and sample are graphs of one distributed inference."""
    k = cut(dense_index(participants, "pathway_id", "k"), "pathways")
    kept = without_currency(entities).select("entity_id")
    p = participants.join(kept, "entity_id", "left_semi").join(F.broadcast(k), "pathway_id")  # a row a pathway
    inside = lambda c: F.concat_ws(":", "k", c)
    named = cut(p.select("k", "pathway_id", "entity_id", inside("reaction_id").alias("reaction"), inside("entity_id").alias("name"), "role", "ord"), "participants")
    edges = pathway.split_fan_in(pathway.reaction_edges(named.select(F.col("reaction").alias("reaction_id"), F.col("name").alias("entity_id"), "role", "ord")))
    factors = cut(pathway.edge_factors(edges), "factors")
    numbers = cut(dense_index(factors.select(F.explode("names").alias("name")), "name", "var_id"), "names")
    places = factors.select("factor_id", F.posexplode("names").alias("pos", "name")).join(numbers, "name")
    rows = kernel_rows(factors.select("factor_id", "values"), places.select("factor_id", "pos", "var_id", F.lit(3).alias("states")))
    rows = rows.withColumn("graph_id", F.substring_index("factor_id", ":", 1))
    nodes = cut(named.select("k", "pathway_id", "entity_id", "name").distinct().join(numbers, "name"), "nodes")
    hot = F.transform(F.array(*map(F.lit, range(3))), lambda i: F.when(i == F.col("state"), 1.0).otherwise(0.0))
    seen = evidence.join(nodes, "entity_id").select("sample_id", F.col("k").cast("string").alias("graph_id"), "var_id", hot.alias("values"))
    m = kernel.prior_and_posterior(rows, seen, **options)
    arrays = m.groupBy("graph_id", "sample_id", "var_id").agg(F.array_sort(F.collect_list(F.struct("state", "prior", "posterior"))).alias("x"))
    at = lambda f: [F.get(F.transform("x", lambda x: x[f]), F.lit(i)) for i in range(3)]
    return arrays.join(nodes, "var_id").select("pathway_id", "sample_id", "entity_id", scalar.ipa(at("prior"), at("posterior")).alias("ipa"))


def drug_impacts(participants: DataFrame, entities: DataFrame, interactions: DataFrame, evidence: DataFrame, parts: DataFrame | None = None, rounds: int = 500, increase: int = 20, threshold: float = 1e-3, most: int = 1000) -> DataFrame:
    """(drug, pathway_id, sum_impact, mean_impact, targets): how much each drug changes the outputs of each pathway.

    Pathways become one fuzzy Boolean network, a part for each; each drug's effects are put on one variable of a gene in each
    connected part; the network is run without and with them, and the areas under its tracks are compared over longer and longer
    horizons until no change moves. participants: pathway_id, reaction_id, entity_id, role, ord; entities: entity_id, gene;
    interactions: interaction_id, drug, target, type; evidence: interaction_id, assay_type, assay_value, assay_median; parts:
    parent_id, child_id, kind of complexes and sets. Drugs without an effect on a pathway have no row for it."""
    k = cut(dense_index(participants, "pathway_id", "k"), "pathways")
    named = participants.join(F.broadcast(k), "pathway_id")  # a row a pathway
    inside = lambda c: F.concat_ws(":", F.col("k"), F.col(c))
    p = cut(named.select("pathway_id", "k", inside("reaction_id").alias("reaction_id"), F.col("entity_id").alias("source"), inside("entity_id").alias("entity_id"), "role", "ord"), "participants")
    relations = pathway.boolean_network(p)
    members = p.select("k", "pathway_id", "source").distinct()
    if parts is not None:
        more = pathway.closure(members.select(F.col("source").alias("entity_id")), parts)
        # Each pathway has its own copy of what its entities are made of.
        inner = cut(members.join(more, F.col("source") == F.col("parent_id")).select("k", "pathway_id", "parent_id", "child_id", "kind").distinct(), "parts")
        front = inner
        while not front.isEmpty():
            front = cut(front.select("k", "pathway_id", F.col("child_id").alias("parent_id")).distinct().join(more, "parent_id").select("k", "pathway_id", "parent_id", "child_id", "kind").distinct().exceptAll(inner), "parts")
            inner = cut(inner.union(front).distinct(), "parts")
        own = inner.select(inside("parent_id").alias("parent_id"), inside("child_id").alias("child_id"), "kind")
        relations = relations.union(pathway.entity_relations(own.select(F.col("parent_id").alias("entity_id")), own))
        members = members.union(inner.select("k", "pathway_id", "child_id")).distinct()
    known = members.join(entities.select(F.col("entity_id").alias("source"), *[c for c in ("gene", "class") if c in entities.columns]), "source").withColumn("entity_id", inside("source"))
    variables, inputs = pathway.network(relations, p, known.drop("k", "pathway_id", "source"))
    changed = drug.target_modifications(interactions, evidence)
    put = cut(drug.injected(variables.select("var_id", "gene", F.lit(None).cast("long").alias("source_id"), "driven"), inputs.select("input_var", "output_var"), changed), "injected")
    start = cut(boolnet.initial_values(variables, inputs, 1.0).where("init != 1.0"), "initial")
    none = F.lit(None).cast("double")
    plain = start.select(F.lit("").alias("scenario_id"), "var_id", none.alias("stim"), none.alias("act"), none.alias("inh"), "init")
    if start.isEmpty():  # a scenario needs a row
        plain = variables.agg(F.min("var_id").alias("var_id")).select(F.lit("").alias("scenario_id"), "var_id", *(none.alias(c) for c in ("stim", "act", "inh", "init")))
    effects = drug.as_scenarios(put).drop("init")
    each = effects.select("scenario_id").distinct().crossJoin(start).join(effects, ["scenario_id", "var_id"], "full").select("scenario_id", "var_id", "stim", "act", "inh", "init")
    run = lambda d: cut(boolnet.simulate(variables, inputs, d, default=1.0, transfer="identity", rounds=rounds), "tracks")
    changes, _ = boolnet.converged_changes(run(plain), run(each), increase, threshold, most, variables.where("source_id IS NOT NULL").select("var_id", F.col("name").alias("key")))
    outputs = variables.where("output").select(F.col("name").alias("key")).join(known.select(F.col("entity_id").alias("key"), "pathway_id"), "key")
    touched = put.join(variables.select("var_id", "gene", F.col("name").alias("key")), "var_id").join(known.select(F.col("entity_id").alias("key"), "pathway_id"), "key")
    targets = touched.groupBy(F.col("drug").alias("scenario_id"), "pathway_id").agg(F.array_sort(F.collect_set("gene")).alias("targets"))
    sums = impact_summary(changes.join(outputs, "key"), ["scenario_id", "pathway_id"])
    return sums.join(targets, ["scenario_id", "pathway_id"]).select(F.col("scenario_id").alias("drug"), "pathway_id", "sum_impact", "mean_impact", "targets")
