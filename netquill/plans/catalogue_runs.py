"""Registered queries of whole runs; their SQL enumerates the joint distributions, or follows each chain, step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquill.operators import runs
from netquill.plans.checkpoint import cut
from netquill.plans.registry import constants, query, r6, structs, t

GENES = ("click", "error", "purchase", "signup", "view")  # a network that is a chain of all event types
AT = [f"x{k}" for k in range(len(GENES))]


def chain_sql() -> str:
    """Marginals of every sample and type by enumeration of all states of the chain."""
    states = ", ".join(f"{x}.i AS {x}" for x in AT), ", ".join(f"range(2) AS {x}(i)" for x in AT)
    pairs = " * ".join(f"CASE WHEN {a} = {b} THEN 0.31 ELSE 0.19 END::DOUBLE" for a, b in zip(AT, AT[1:], strict=False))
    own = f"pow(0.975::DOUBLE, {len(AT)} - ({' + '.join(AT)})) * pow(0.025::DOUBLE, {' + '.join(AT)})"
    told = " * ".join(f"coalesce(CASE {x} WHEN 0 THEN e{x}.m0 ELSE e{x}.m1 END, 1)" for x in AT)
    joins = " ".join(f"LEFT JOIN x e{x} ON e{x}.sample = s.sample AND e{x}.k = s.k AND e{x}.gene = '{g}'" for x, g in zip(AT, GENES, strict=True))
    beliefs = " UNION ALL ".join(f"SELECT sample, k, '{g}' AS gene, sum(w) FILTER ({x} = 1) / sum(w) AS b FROM j GROUP BY ALL" for x, g in zip(AT, GENES, strict=True))
    return f"""WITH o AS (SELECT user_id, event_type AS gene, 'CNV' AS k, (avg(value) - 100) / 40 AS v FROM events GROUP BY ALL
  UNION ALL SELECT user_id, event_type, 'Mutation', count(*) / 8.0::DOUBLE FROM events GROUP BY ALL),
base AS (SELECT k, CASE WHEN k = 'CNV' THEN percentile_cont(0.5) WITHIN GROUP (ORDER BY v) ELSE min(v) END AS v FROM o GROUP BY k),
e AS (SELECT user_id::VARCHAR AS sample, gene, k, v FROM o UNION ALL SELECT 'base', g.gene, base.k, base.v FROM (SELECT DISTINCT gene, k FROM o) g JOIN base ON base.k = g.k),
m AS (SELECT sample, gene, k, (k = 'CNV' AND (v < -0.5 OR v >= 0.5)) OR (k = 'Mutation' AND v >= 2) AS odd, (1 + pow(0.98::DOUBLE, CASE k WHEN 'CNV' THEN 3 ELSE 1 END)) / 2 AS w FROM e),
x AS (SELECT sample, gene, k, w * CASE WHEN odd THEN 0.1 ELSE 0.9 END::DOUBLE + (1 - w) * CASE WHEN odd THEN 0.9 ELSE 0.1 END::DOUBLE AS m0, (1 - w) * CASE WHEN odd THEN 0.1 ELSE 0.9 END::DOUBLE + w * CASE WHEN odd THEN 0.9 ELSE 0.1 END::DOUBLE AS m1 FROM m),
s AS (SELECT DISTINCT sample, k FROM x), g AS (SELECT {states[0]} FROM {states[1]}),
j AS (SELECT s.sample, s.k, {", ".join(AT)}, {pairs} * {own} * {told} AS w FROM s CROSS JOIN g {joins}),
l AS ({beliefs})
SELECT l.sample AS user_id, l.gene, round(sum(log10(l.b * (1 - q.b) / ((1 - l.b) * q.b))), 5) AS score FROM l JOIN l q ON q.sample = 'base' AND q.k = l.k AND q.gene = l.gene WHERE l.sample <> 'base' GROUP BY ALL"""


@query(chain_sql())
def run_network_scores(spark, sf):
    """Samples scored on a network of all event types with two types of observations: mean values and numbers of events."""
    e = t(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("gene")).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    e = cut(e.select(F.col("user_id").alias("sample_id"), "gene", F.explode(F.create_map(F.lit("CNV"), (F.col("m") - 100) / 40, F.lit("Mutation"), F.col("n") / 8.0)).alias("data_type", "value")), "obs")
    return runs.network_scores(constants(spark, "gene1 gene2", *zip(GENES, GENES[1:], strict=False)), e).select(F.col("sample_id").alias("user_id"), "gene", r6("score", 5).alias("score"))


@query("""WITH c AS (SELECT c_mktsegment AS sample, c_nationkey AS nk, avg(c_acctbal) AS a FROM customer GROUP BY ALL),
ev AS (SELECT sample, nk, CASE WHEN a < 4000 THEN 0 ELSE 2 END AS st FROM c WHERE a < 4000 OR a >= 5000),
n AS (SELECT n_nationkey AS nk, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey::VARCHAR) AS rn FROM nation),
sr AS (SELECT DISTINCT sample, r FROM ev JOIN n USING (nk) UNION ALL SELECT '', r_regionkey FROM region),
w AS (SELECT sr.sample, n.r, n.rn, st.i, CASE WHEN ev.st IS NULL OR ev.st = st.i THEN 1 ELSE 0 END::DOUBLE AS w FROM sr JOIN n ON n.r = sr.r CROSS JOIN range(3) AS st(i) LEFT JOIN ev ON ev.sample = sr.sample AND ev.nk = n.nk),
a AS (SELECT x.sample, x.r, q.i, sum(x.w * y.w * z.w * CASE WHEN q.i = least(x.i, y.i, z.i) THEN 0.999 ELSE 0.0005 END::DOUBLE) AS w FROM w x JOIN w y ON y.sample = x.sample AND y.r = x.r AND y.rn = 2 JOIN w z ON z.sample = x.sample AND z.r = x.r AND z.rn = 3 CROSS JOIN range(3) AS q(i) WHERE x.rn = 1 GROUP BY ALL),
b AS (SELECT a.sample, a.r, q.i, sum(a.w * y.w * z.w * CASE WHEN q.i = least(a.i, y.i, z.i) THEN 0.999 ELSE 0.0005 END::DOUBLE) AS w FROM a JOIN w y ON y.sample = a.sample AND y.r = a.r AND y.rn = 4 JOIN w z ON z.sample = a.sample AND z.r = a.r AND z.rn = 5 CROSS JOIN range(3) AS q(i) GROUP BY ALL),
o AS (SELECT b.sample, b.r, q.i, sum(b.w * CASE WHEN q.i = b.i THEN 0.999 ELSE 0.0005 END::DOUBLE) AS w FROM b CROSS JOIN range(3) AS q(i) GROUP BY ALL),
p AS (SELECT sample, r, i, w / sum(w) OVER (PARTITION BY sample, r) AS p FROM o),
l AS (SELECT p.sample, p.r, p.i, log10(p.p * (1 - q.p) / ((1 - p.p) * q.p)) AS l FROM p JOIN p q ON q.sample = '' AND q.r = p.r AND q.i = p.i WHERE p.sample <> ''),
v AS (SELECT sample, r, max(l) FILTER (i = 0) AS d, max(l) FILTER (i = 1) AS n, max(l) FILTER (i = 2) AS u FROM l GROUP BY ALL)
SELECT r_name AS pathway, sample, round(CASE WHEN u > d AND u > n THEN u WHEN d > u AND d > n THEN -d ELSE 0 END, 5) AS ipa FROM v JOIN region ON r_regionkey = r""")
def run_pathway_activities(spark, sf):
    """A pathway a region, whose reaction takes its nations, split into threes, and gives one product; segments as samples."""
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda e, role, o: F.struct(F.col("r_name").alias("pathway_id"), F.col("r_regionkey").cast("string").alias("reaction_id"), e.alias("entity_id"), F.lit(role).alias("role"), o.alias("ord"))
    nation, product = F.col("n_nationkey").cast("string"), F.concat(F.lit("R"), F.col("r_regionkey"))
    p = n.select(row(nation, "INPUT", F.col("n_nationkey")).alias("x")).union(n.select(row(product, "OUTPUT", F.lit(1000)))).select("x.*").distinct()
    entities = p.select("entity_id", F.array("entity_id").alias("names")).distinct()
    a = t(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("sample_id"), F.col("c_nationkey").cast("string").alias("entity_id")).agg(F.avg("c_acctbal").alias("a"))
    evidence = cut(a.where("a < 4000 OR a >= 5000").select("sample_id", "entity_id", F.when(F.col("a") < 4000, 0).otherwise(2).alias("state")), "evidence")
    got = runs.pathway_activities(cut(p, "participants"), entities, evidence)
    return got.where("entity_id LIKE 'R%'").select(F.col("pathway_id").alias("pathway"), F.col("sample_id").alias("sample"), r6("ipa", 5).alias("ipa"))


@query("""WITH RECURSIVE n AS (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation),
x AS (SELECT c_mktsegment AS drug, n_regionkey, rn, min(o_totalprice) AS a, avg(c_acctbal) AS m FROM customer JOIN orders ON o_custkey = c_custkey JOIN n ON n_nationkey = c_nationkey GROUP BY ALL),
f AS (SELECT drug, n_regionkey, rn, CASE WHEN m >= 4500 THEN 1 ELSE -1 END * CASE WHEN a < 1 THEN 0.999 WHEN a < 10 THEN 0.99 WHEN a <= 1e7 THEN -0.196 * (log10(a) - 1) + 0.99 ELSE 0 END AS s FROM x),
d AS (SELECT drug, n_regionkey, count(*) AS n_targets FROM f GROUP BY ALL),
p AS (SELECT d.drug, d.n_regionkey, 1 AS rn, least(1 + coalesce(f.s, 0), 1)::DOUBLE AS v FROM d LEFT JOIN f ON f.drug = d.drug AND f.n_regionkey = d.n_regionkey AND f.rn = 1
  UNION ALL SELECT p.drug, p.n_regionkey, p.rn + 1, least(p.v * (1 + coalesce(f.s, 0)), 1)::DOUBLE FROM p LEFT JOIN f ON f.drug = p.drug AND f.n_regionkey = p.n_regionkey AND f.rn = p.rn + 1 WHERE p.rn < 5)
SELECT p.drug, r_name AS pathway, round(sum(abs((v - 1) / (v + 1))), 5) AS sum_impact, round(avg(abs((v - 1) / (v + 1))), 5) AS mean_impact, max(n_targets) AS n_targets
FROM p JOIN d ON d.drug = p.drug AND d.n_regionkey = p.n_regionkey JOIN region ON r_regionkey = p.n_regionkey WHERE p.rn > 1 GROUP BY ALL""")
def run_drug_impacts(spark, sf):
    """A cascade of nations a region as pathways; segments as drugs, whose strengths come from their cheapest orders."""
    n = cut(t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "n_regionkey", "r_name"), "nations")
    nxt = n.select(F.col("n_regionkey").alias("r2"), F.col("n_nationkey").alias("to"))
    step = n.join(nxt, (F.col("r2") == F.col("n_regionkey")) & (F.col("to") > F.col("n_nationkey"))).groupBy("r_name", "n_nationkey").agg(F.min("to").alias("to"))
    sides = structs("entity_id role ord", (F.col("n_nationkey"), "INPUT", 1), (F.col("to"), "OUTPUT", 2))
    p = cut(step.select(F.col("r_name").alias("pathway_id"), F.col("n_nationkey").alias("reaction_id"), F.inline(sides)), "participants")
    j = t(spark, sf, "customer").join(t(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    j = cut(j.groupBy(F.col("c_mktsegment").alias("drug"), F.col("n_name").alias("target")).agg(F.min("o_totalprice").alias("a"), F.avg("c_acctbal").alias("m")).withColumn("interaction_id", F.concat_ws("/", "drug", "target")), "interactions")
    interactions = j.select("interaction_id", "drug", "target", F.when(F.col("m") >= 4500, "agonist").otherwise("blocker").alias("type"))
    evidence = j.select("interaction_id", F.lit("Ki").alias("assay_type"), F.col("a").alias("assay_value"), F.lit("m").alias("assay_median"))
    got = runs.drug_impacts(p, n.select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("gene")), interactions, evidence)
    return got.select("drug", F.col("pathway_id").alias("pathway"), r6("sum_impact", 5).alias("sum_impact"), r6("mean_impact", 5).alias("mean_impact"), F.size("targets").cast("long").alias("n_targets"))
