"""The registered queries of the engine's operators over the driver's tables, and DuckDB SQL for the same rows.

The tables aren't biological, so each operator runs on tables of the same shape: samples are users or customers, genes
brands or event types, data types event types, network pairs (supplier, part) or nations, tracks a user's events in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.functions import scalar
from netquill.operators import belief, boolnet, components, drug, factor_graph, kernel, learning, network, observations, pathway
from netquill.operators import relational as rel
from netquill.plans.checkpoint import cut
from netquill.plans.registry import CHAIN, FI, ORACLE_SQL, QUERIES, chain, fi, fi_lines, obs, query, r6, t, vectors
from netquill.sources import readers

__all__ = ["ORACLE_SQL", "QUERIES"]

TYPES = ["click", "error", "purchase", "signup", "view"]


# --- scans, projections, filters


@query("SELECT l_orderkey, l_linenumber, d.k AS data_type, d.v AS value FROM lineitem, unnest([{'k': 'quantity', 'v': l_quantity}, {'k': 'discount', 'v': l_discount}, {'k': 'tax', 'v': l_tax}]) AS u(d)")
def obs_unpivot(spark, sf):
    wide = t(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("line"), *(F.col(f"l_{c}").cast("string").alias(c) for c in ("quantity", "discount", "tax")))
    keys = F.split("gene", "/")
    return readers.cells_of(wide, "number").select(F.get(keys, F.lit(0)).cast("long").alias("l_orderkey"), F.get(keys, F.lit(1)).cast("int").alias("l_linenumber"), F.col("sample_id").alias("data_type"), "value")


@query("SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value >= 20 AND value < 100 THEN 0 ELSE 1 END AS state2, CASE WHEN value < 20 THEN 0 WHEN value < 100 THEN 1 ELSE 2 END AS state3 FROM events")
def obs_discretize(spark, sf):
    v = F.col("value")
    return t(spark, sf, "events").select("event_id", scalar.discretize(v, [20.0, 100.0], 2).alias("state2"), scalar.discretize(v, [20.0, 100.0]).alias("state3"))


@query("SELECT user_id, round(avg(value), 6) AS score FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def maf_mean_score(spark, sf):
    m = obs(spark, sf).where("data_type = 'purchase'").select("sample_id", F.col("data_type").alias("gene"), F.col("value").alias("score"))
    return readers.mean_scores(m).select(F.col("sample_id").alias("user_id"), r6("score").alias("score"))


@query("WITH m AS (SELECT user_id, event_type, avg(value) AS s FROM events GROUP BY ALL) SELECT u.user_id, g.event_type, round(coalesce(m.s, (SELECT min(s) FROM m)), 6) AS score FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) g LEFT JOIN m ON m.user_id = u.user_id AND m.event_type = g.event_type")
def maf_background_fill(spark, sf):
    e = t(spark, sf, "events")
    m = e.groupBy("user_id", "event_type").agg(F.avg("value").alias("score"))
    return rel.background_fill(m, e.select("user_id"), e.select("event_type")).select("user_id", "event_type", r6("score").alias("score"))


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def maf_dedup_first(spark, sf):
    li = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rel.first_of(li, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("WITH n AS (SELECT count(DISTINCT event_type) AS n FROM events) SELECT user_id, count(*) AS n_rows FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT n FROM n)) GROUP BY user_id")
def shared_samples(spark, sf):
    return rel.with_all_types(t(spark, sf, "events"), "user_id", "event_type").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment HAVING count(DISTINCT c_nationkey) = (SELECT count(DISTINCT c_nationkey) FROM customer)")
def shared_genes(spark, sf):
    return rel.shared_in_all(t(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@query("WITH e AS (SELECT *, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id) AS a, min((event_type = 'purchase')::INT) OVER (PARTITION BY user_id) AS b FROM events) SELECT user_id || '_' || event_type AS observation, CASE WHEN a = b THEN 'all' WHEN event_type = 'purchase' THEN 'mutation' ELSE 'other' END AS part, count(*) AS n FROM e GROUP BY ALL")
def split_by_type(spark, sf):
    return rel.split_mutations(rel.split_by_type(obs(spark, sf)), "purchase").groupBy("observation", "part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, CASE WHEN upper(o_orderpriority) IN ('ACTIVATOR', 'AGONIST', 'FULL AGONIST', 'PARTIAL AGONIST', 'POSITIVE ALLOSTERIC MODULATOR', 'POSITIVE MODULATOR', 'SUBSTRATE') THEN 'Activation' ELSE 'Inhibition' END AS modification, count(*) AS n FROM orders GROUP BY ALL")
def interaction_type(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderpriority", scalar.modification_type(F.col("o_orderpriority")).alias("modification")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN replace(p_name, ' ', '_') END AS gene, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN p_type END AS data_type FROM part")
def name_suffix_split(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "_"), F.lit("_"), "p_type").alias("name"))
    return rel.split_names(p, "name", ["ECONOMY", "STANDARD"]).select("p_partkey", "gene", "data_type")


# --- networks


@query("SELECT count(*) AS n_pairs, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def fi_pairs_distinct(spark, sf):
    li = t(spark, sf, "lineitem")
    p = readers.distinct_pairs(li.where("l_quantity <= 25").select("l_suppkey", "l_partkey"), li.where("l_quantity > 20").select("l_suppkey", "l_partkey"))
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("gene1").alias("n_suppliers"), F.count_distinct("gene2").alias("n_parts"))


@query(f"WITH {FI} SELECT gene, d AS degree FROM deg")
def fi_degree(spark, sf):
    return rel.degrees(fi(spark, sf))


@query(f"WITH {FI} SELECT gene1, gene2, round(2 * 0.99::DOUBLE, 6) AS v0, round(1 + 0.01 - 0.99 / x.d, 6) AS v1, round(1 + 0.01 - 0.99 / y.d, 6) AS v2, round(0.99 * (1.0::DOUBLE / x.d + 1.0::DOUBLE / y.d), 6) AS v3, round(exp(0.21 * (sqrt(x.d) + sqrt(y.d))), 4) AS nng FROM fi JOIN deg x ON x.gene = gene1 JOIN deg y ON y.gene = gene2")
def fi_degree_factor(spark, sf):
    """Both models that depend on degrees, which are joined once."""
    d = rel.with_degrees(fi(spark, sf)).select("gene1", "gene2", network.pair_values("degree").alias("v"), network.pair_values("neighbour").alias("w"))
    return d.select("gene1", "gene2", *(r6(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(4)), r6(F.get("w", F.lit(0)), 4).alias("nng"))


@query("SELECT DISTINCT 's' || l_suppkey AS gene1, 'p' || l_partkey AS gene2, 0.99::DOUBLE AS same, 0.01::DOUBLE AS different FROM lineitem")
def fi_ising_factor(spark, sf):
    v = network.pair_factors(fi(spark, sf), "ising")
    return v.select("gene1", "gene2", F.get("values", F.lit(0)).alias("same"), F.get("values", F.lit(1)).alias("different"))


# --- factor graphs: order status -> priority -> return flag, a chain of two pairwise factors


MARGINALS = """SELECT 1 AS var_id, a AS label, round(sum(v) / (SELECT sum(v) FROM j), 6) AS p FROM j GROUP BY a
UNION ALL SELECT 2, b, round(sum(v) / (SELECT sum(v) FROM j), 6) FROM j GROUP BY b UNION ALL SELECT 3, c, round(sum(v) / (SELECT sum(v) FROM j), 6) FROM j GROUP BY c"""


@query(f"WITH {CHAIN} {MARGINALS}")
def pgm_pair_marginal(spark, sf):
    """Exact marginals of the chain: each factor is multiplied with what the other sends through the variable they share."""
    factors, links, names = chain(spark, sf)
    sides = factor_graph.marginal(factors, links).where("var_id = 2")  # each factor summed to the shared variable
    message = sides.select((3 - F.col("factor_id")).alias("factor_id"), "state", F.col("val").alias("p"))
    states = factor_graph.cell_states(factors, links).where("var_id = 2").select("factor_id", "idx", "state")
    joint = factor_graph.multiplied(factor_graph.cells(factors), message, states)
    whole = joint.groupBy("factor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "val"))), lambda c: c["val"]).alias("values"))
    each = factor_graph.marginal(whole, links).where("factor_id = 1 OR var_id = 3")
    return rel.normalised(each, ["var_id"], "val").join(names, ["var_id", "state"]).select("var_id", "label", r6("p").alias("p"))


@query(f"WITH {CHAIN} {MARGINALS}")
def pgm_bp_df(spark, sf):
    factors, links, names = chain(spark, sf)
    b, _, _ = belief.propagate(factors, links)
    return b.join(names, ["var_id", "state"]).select("var_id", "label", r6("p").alias("p"))


@query(f"WITH {CHAIN} {MARGINALS}")
def pgm_kernel(spark, sf):
    factors, links, names = chain(spark, sf)
    m = kernel.marginals(vectors(factors, links))
    return m.join(names, ["var_id", "state"]).select(F.col("var_id").cast("int").alias("var_id"), "label", r6("p").alias("p"))


@query(f"WITH {CHAIN} SELECT a AS status, round(sum(v) / (SELECT sum(v) FROM j WHERE c = (SELECT min(c) FROM j)), 6) AS p FROM j WHERE c = (SELECT min(c) FROM j) GROUP BY a")
def pgm_chain_evidence(spark, sf):
    """The last variable is known to have its first state."""
    factors, links, names = chain(spark, sf)
    seen = names.where("var_id = 3 AND state = 0").select("var_id", F.col("state").cast("double").alias("value"))
    ef, el = factor_graph.evidence_factors(seen, links)
    b, _, _ = belief.propagate(factors.union(ef), links.union(el))
    return b.where("var_id = 1").join(names, ["var_id", "state"]).select(F.col("label").alias("status"), r6("p").alias("p"))


@query(f"WITH {CHAIN} SELECT round(ln(sum(v)), 6) AS log_z FROM j")
def pgm_logz(spark, sf):
    factors, links, _ = chain(spark, sf)
    b, c, _ = belief.propagate(factors, links)
    return factor_graph.bethe_log_z(factors, links, b, c).select(r6("log_z").alias("log_z"))


@query(f"WITH {CHAIN}, best AS (SELECT a, b, c FROM j ORDER BY v DESC, a, b, c LIMIT 1) SELECT 1 AS var_id, a AS label FROM best UNION ALL SELECT 2, b FROM best UNION ALL SELECT 3, c FROM best")
def pgm_map(spark, sf):
    factors, links, names = chain(spark, sf)
    m = kernel.most_probable(vectors(factors, links))
    return m.join(names, ["var_id", "state"]).select(F.col("var_id").cast("int").alias("var_id"), "label")


@query(f"WITH {CHAIN} SELECT DISTINCT o_orderkey || l_returnflag AS sample_id, round(ln(f1.v) + ln(f2.v), 6) AS loglik FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN f1 ON f1.a = o_orderstatus AND f1.b = o_orderpriority JOIN f2 ON f2.b = o_orderpriority AND f2.c = l_returnflag")
def pgm_loglik(spark, sf):
    factors, links, names = chain(spark, sf)
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    seen = o.join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", "o_orderstatus", "o_orderpriority", "l_returnflag").distinct()
    rows = seen.select(F.concat("o_orderkey", "l_returnflag").alias("sample_id"), F.explode(F.array(*(F.struct(F.lit(k + 1).alias("var_id"), F.col(c).alias("label")) for k, c in enumerate(("o_orderstatus", "o_orderpriority", "l_returnflag"))))).alias("x"))
    given = rows.select("sample_id", "x.var_id", "x.label").join(names, ["var_id", "label"]).select("sample_id", "var_id", "state")
    return factor_graph.log_likelihood(factors, links, given).select("sample_id", r6("loglik").alias("loglik"))


@query(f"WITH {CHAIN} SELECT 'f1' AS factor, a AS x, b AS y, v FROM f1 WHERE b = (SELECT min(b) FROM f1) UNION ALL SELECT 'f2', b, c, v FROM f2 WHERE b = (SELECT min(b) FROM f1)")
def pgm_slice(spark, sf):
    factors, links, names = chain(spark, sf)
    s = factor_graph.sliced(factors, links, names.where("var_id = 2 AND state = 0").select("var_id", "state"))
    n = links.where("pos = 0").select("factor_id", F.col("states").alias("n0"))
    lab = lambda k, at: names.select((F.col("var_id") - k).alias("factor_id"), F.col("state").alias(f"s{at}"), F.col("label").alias(at))
    c = s.join(n, "factor_id").select("factor_id", (F.col("idx") % F.col("n0")).alias("sx"), F.floor(F.col("idx") / F.col("n0")).alias("sy"), F.col("val").alias("v")).where("v > 0")
    return c.join(lab(0, "x"), ["factor_id", "sx"]).join(lab(1, "y"), ["factor_id", "sy"]).select(F.concat(F.lit("f"), "factor_id").alias("factor"), "x", "y", "v")


@query("SELECT 2 AS n_factors, 3 AS n_variables, 4 AS n_links, true AS tree, 0 AS n_invalid")
def pgm_validate(spark, sf):
    factors, links, _ = chain(spark, sf)
    from netquill.sources.writers import summary

    bad = factor_graph.invalid_factors(factors, links).count()
    return summary(factors, links).select(F.col("n_factors").cast("int").alias("n_factors"), F.col("n_variables").cast("int").alias("n_variables"), F.col("n_links").cast("int").alias("n_links"), F.lit(factor_graph.is_tree(links)).alias("tree"), F.lit(bad).alias("n_invalid"))


@query(f"WITH {FI}, l AS (SELECT x.gene1 AS a, y.gene1 AS b FROM fi x JOIN fi y ON x.gene2 = y.gene2 WHERE x.gene1 <> y.gene1) SELECT a AS var_id, count(DISTINCT b) AS n_linked FROM l GROUP BY a")
def linked_variables(spark, sf):
    p = fi_lines(spark, sf)  # repeated rows make no difference
    return factor_graph.linked_variables(p.select(F.col("gene2").alias("factor_id"), F.col("gene1").alias("var_id")))


# --- scores and evidence


@query("WITH e AS (SELECT user_id, (0.01 + 0.98 * avg((event_type = 'view')::INT::DOUBLE)) AS post, 0.2::DOUBLE AS prior FROM events GROUP BY user_id) SELECT user_id, round(log10(least(greatest(post / (1 - post) * (1 - prior) / prior, -1022), 1023)), 6) AS score FROM e")
def log_ratio(spark, sf):
    e = t(spark, sf, "events").groupBy("user_id").agg((0.01 + 0.98 * F.avg((F.col("event_type") == "view").cast("double"))).alias("post"))
    return e.select("user_id", r6(scalar.log_ratio(F.lit(0.2), F.col("post"))).alias("score"))


@query("""WITH s AS (SELECT c_custkey, 0.05 + 0.85 * avg((o_orderstatus = 'F')::INT::DOUBLE) AS p0, 0.05 + 0.85 * avg((o_orderstatus = 'O')::INT::DOUBLE) AS p1, 0.05 + 0.85 * avg((o_orderstatus = 'P')::INT::DOUBLE) AS p2 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT c_custkey, log10(p0 / (1 - p0) * 2) AS d, log10(p1 / (1 - p1) * 2) AS n, log10(p2 / (1 - p2) * 2) AS u FROM s)
SELECT c_custkey, round(CASE WHEN u > d AND u > n THEN u WHEN d > u AND d > n THEN -d ELSE 0 END, 6) AS ipa FROM r""")
def ipa(spark, sf):
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    s = o.join(c.select("c_custkey"), o.o_custkey == c.c_custkey).groupBy("c_custkey").agg(*((0.05 + 0.85 * F.avg((F.col("o_orderstatus") == k).cast("double"))).alias(f"p{i}") for i, k in enumerate("FOP")))
    return s.select("c_custkey", r6(scalar.ipa([F.lit(1.0) / 3] * 3, [F.col(f"p{i}") for i in range(3)])).alias("ipa"))


@query("""WITH c AS (SELECT event_id, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS c FROM events)
SELECT event_id, round(CASE WHEN c > 0.5 THEN 2 * (1 - c) ELSE 2 * c END, 6) AS two0, round(CASE WHEN c < 0.5 THEN 1 - 2 * c ELSE 0 END, 6) AS three0,
  round(CASE WHEN c < 0.5 THEN 2 * c WHEN c > 0.5 THEN 2 * (1 - c) ELSE 1 END, 6) AS three1, round(CASE WHEN c > 0.5 THEN 1 - 2 * (1 - c) ELSE 0 END, 6) AS three2, round(1 - c, 6) AS one0 FROM c""")
def ecdf_marginal(spark, sf):
    e = rel.ecdf(t(spark, sf, "events").select("event_id", "event_type", "value"), "event_type")
    c, at = F.col("cpd"), lambda a, k: r6(F.get(a, F.lit(k)))
    two, three, one = scalar.empirical_marginal(c, 2, True), scalar.empirical_marginal(c, 3, True), scalar.empirical_marginal(c, 2, False)
    return e.select("event_id", at(two, 0).alias("two0"), at(three, 0).alias("three0"), at(three, 1).alias("three1"), at(three, 2).alias("three2"), at(one, 0).alias("one0"))


@query("WITH g AS (SELECT event_id, exp(-pow(value / 100 - 0, 2) / 2) AS a, exp(-pow(value / 100 - 1, 2) / 2) AS b, exp(-pow(value / 100 - 2, 2) / 2) AS c FROM events) SELECT event_id, round(b / (a + b + c), 6) AS p0, round((a + c) / (a + b + c), 6) AS p1 FROM g")
def clg_marginal(spark, sf):
    m = scalar.mixture_marginal(F.col("value") / 100, scalar.mixture_components([0.0, 2.0], 2))
    return t(spark, sf, "events").select("event_id", r6(F.get(m, F.lit(0))).alias("p0"), r6(F.get(m, F.lit(1))).alias("p1"))


@query("SELECT event_type AS data_type, round(CASE WHEN event_type = 'purchase' THEN min(value) ELSE percentile_cont(0.5) WITHIN GROUP (ORDER BY value) END, 6) AS value FROM events GROUP BY event_type")
def base_observation(spark, sf):
    o = obs(spark, sf).withColumn("data_type", F.when(F.col("data_type") == "purchase", "Mutation").otherwise(F.col("data_type")))
    return observations.base_values(o).select(F.when(F.col("data_type") == "Mutation", "purchase").otherwise(F.col("data_type")).alias("data_type"), r6("value").alias("value"))


@query("WITH g AS (SELECT b.p_brand, s.p_size FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_size FROM part) s), c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), f AS (SELECT p_brand, p_size, coalesce(n, 1) AS n FROM g LEFT JOIN c USING (p_brand, p_size)) SELECT p_brand, p_size, round(n / sum(n) OVER (PARTITION BY p_brand), 6) AS p FROM f")
def gibbs_smooth(spark, sf):
    p = t(spark, sf, "part")
    n = p.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    full = p.select("p_brand").distinct().crossJoin(p.select("p_size").distinct()).join(n, ["p_brand", "p_size"], "left").fillna(1, ["n"])
    return rel.normalised(full, ["p_brand"], "n").select("p_brand", "p_size", r6("p").alias("p"))


@query("WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) + 1.0::DOUBLE AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, o_orderpriority, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS value FROM c")
def em_mstep(spark, sf):
    c = t(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg((F.count(F.lit(1)) + 1.0).alias("n"))
    m = learning.maximised(c.withColumn("g", F.lit(1)), "g", "o_orderstatus", "o_orderpriority")
    return m.select("o_orderstatus", "o_orderpriority", r6("value").alias("value"))


@query("SELECT l_orderkey, l_linenumber, round((1 + pow(0.5503, 3)) * pow(l_discount * 10, 3) / (pow(l_discount * 10, 3) + pow(0.5503, 3)), 6) AS hill, l_discount * 10 AS plain, round(pow(2, -(l_tax * 10)), 6) AS weight FROM lineitem")
def hill(spark, sf):
    x = F.col("l_discount") * 10
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(scalar.hill(x)).alias("hill"), scalar.identity(x).alias("plain"), r6(scalar.ic50_weight(F.col("l_tax") * 10)).alias("weight"))


# --- Boolean networks


@query("""WITH r AS (SELECT o_custkey, o_orderkey, min(CASE WHEN l_returnflag = 'R' THEN 1 - l_discount * 10 ELSE l_discount * 10 END) AS v, count(*) = 1 AND min(l_returnflag) = 'R' AS damper FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_custkey, round(coalesce(max(v) FILTER (NOT damper), 0.5) * coalesce(min(v) FILTER (damper), 1.0), 6) AS value FROM r GROUP BY o_custkey""")
def fuzzy_and_or(spark, sf):
    """A customer is the OR of their orders, an order the AND of its lines; returned lines are negated, and an order of one
    returned line damps. A customer without any other order keeps 0.5."""
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = li.select("l_orderkey", (F.col("l_discount") * 10).alias("v"), (F.col("l_returnflag") == "R").alias("negated"))
    lines = rows.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    inputs = lines.select(F.col("l_orderkey").alias("rel_id"), F.col("o_custkey").alias("output_var"), (-1 - F.round(F.col("v") * 100)).cast("long").alias("input_var"), "negated")
    levels = inputs.select(F.col("input_var").alias("var_id")).distinct().withColumn("value", (-1 - F.col("var_id")) / 100.0)
    state = levels.select(F.lit(1).alias("scenario_id"), "var_id", "value").union(o.select(F.lit(1), "o_custkey", F.lit(0.5)).distinct())
    variables = state.select("var_id", F.lit(True).alias("identical"))
    none = F.lit(None).cast("double")
    scenarios = spark.range(0).select(F.lit(1).alias("scenario_id"), F.col("id").alias("var_id"), *(none.alias(c) for c in ("stim", "act", "inh", "init")))
    customers = lines.select(F.col("o_custkey").alias("var_id")).distinct()
    new = boolnet.step(state, inputs, variables, scenarios, "identity", "min").join(customers, "var_id", "left_semi")
    return new.select(F.col("var_id").alias("o_custkey"), r6("value").alias("value"))


@query("SELECT l_orderkey, round(product(CASE WHEN l_returnflag = 'R' THEN 1 - l_discount ELSE 1 - l_tax END) + 1.2345678e-9, 6) AS value FROM lineitem GROUP BY l_orderkey")
def fuzzy_prod(spark, sf):
    """Products of decimals often lie half-way between two rounded values; a small offset keeps the order of multiplication from
    deciding."""
    li = t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("negated"), F.when(F.col("l_returnflag") == "R", F.col("l_discount")).otherwise(1 - F.col("l_tax")).alias("v"))
    inputs = li.select(F.col("l_orderkey").alias("rel_id"), F.col("l_orderkey").alias("output_var"), F.round(F.col("v") * 100).cast("long").alias("input_var"), "negated")
    state = inputs.select("input_var").distinct().select(F.lit(1).alias("scenario_id"), F.col("input_var").alias("var_id"), (F.col("input_var") / 100.0).alias("value"))
    r = boolnet.relation_values(state, inputs, state.select("var_id", F.lit(True).alias("identical")), "identity", "prod")
    return r.select(F.col("rel_id").alias("l_orderkey"), r6(F.col("value") + 1.2345678e-9).alias("value"))


def feedback(spark) -> tuple[DataFrame, DataFrame]:
    """A -> B, (B and not D) -> C, C -> D as variables 0 to 3."""
    v = spark.range(4).select(F.col("id").alias("var_id"), F.lit(True).alias("identical"))
    rows = [(0, 1, 0, False), (1, 2, 1, False), (1, 2, 3, True), (2, 3, 2, False)]
    return v, spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("rel_id"), F.lit(o).cast("long").alias("output_var"), F.lit(i).cast("long").alias("input_var"), F.lit(n).alias("negated")) for r, o, i, n in rows))))


def doses(spark, sf) -> DataFrame:
    """A scenario for each customer segment, stimulating A at its share of orders, rounded to a tenth."""
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    n = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.round(0.3 + F.avg((F.col("o_orderstatus") == "F").cast("double")), 1).alias("stim"))
    none = F.lit(None).cast("double")
    return n.select(F.col("c_mktsegment").alias("scenario_id"), F.lit(0).cast("long").alias("var_id"), "stim", none.alias("act"), none.alias("inh"), none.alias("init"))


SIM = """WITH RECURSIVE d AS (SELECT c_mktsegment AS scenario_id, round(0.3 + avg((o_orderstatus = 'F')::INT::DOUBLE), 1) AS a FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
s AS (SELECT scenario_id, 0 AS t, a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM d UNION ALL SELECT scenario_id, t + 1, a, a, least(b, 1 - d), c FROM s WHERE t < 19)"""


@query(SIM + " SELECT scenario_id, t, v.var_id, round(v.value, 6) AS value FROM s, unnest([{'var_id': 0, 'value': a}, {'var_id': 1, 'value': b}, {'var_id': 2, 'value': c}, {'var_id': 3, 'value': d}]) AS u(v)")
def bn_feedback_sim(spark, sf):
    """Tracks to their attractor, continued to 20 rows."""
    v, i = feedback(spark)
    track = boolnet.expanded(boolnet.simulate(v, i, doses(spark, sf), transfer="identity"), 20).where("t < 20")
    return track.select("scenario_id", "t", F.col("var_id").cast("int").alias("var_id"), r6("value").alias("value"))


@query(SIM + " SELECT scenario_id, t, v.var_id, round(v.value, 6) AS value FROM s, unnest([{'var_id': 0, 'value': a}, {'var_id': 1, 'value': b}, {'var_id': 2, 'value': c}, {'var_id': 3, 'value': d}]) AS u(v) WHERE t <= 8")
def bn_table_sim(spark, sf):
    """The same steps as tables, for networks too large for one task."""
    v, i = feedback(spark)
    track = boolnet.expanded(boolnet.simulate_table(v, i, doses(spark, sf), transfer="identity"), 9).where("t <= 8")
    return track.select("scenario_id", "t", F.col("var_id").cast("int").alias("var_id"), r6("value").alias("value"))


@query("WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(sum(CASE WHEN i = 1 OR i = n THEN value / 2 ELSE value END), 6) AS auc FROM e GROUP BY user_id")
def auc_trapezoid(spark, sf):
    return rel.auc(t(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", r6("auc").alias("auc"))


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
a AS (SELECT user_id, event_type, sum(CASE WHEN i = 1 OR i = n THEN value / 2 ELSE value END) AS auc FROM e GROUP BY ALL)
SELECT v.user_id, round((p.auc - v.auc) / (p.auc + v.auc), 6) AS change FROM (SELECT * FROM a WHERE event_type = 'view') v JOIN (SELECT * FROM a WHERE event_type = 'purchase') p USING (user_id)""")
def auc_rel_change(spark, sf):
    a = rel.auc(t(spark, sf, "events").where("event_type IN ('view', 'purchase')"), ["user_id", "event_type"], ["ts", "event_id"])
    return rel.relative_changes(a.where("event_type = 'view'"), a.where("event_type = 'purchase'"), "user_id").select("user_id", r6("change").alias("change"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT max(n) AS m FROM n) SELECT user_id, event_type, count(*) AS n_rows, sum(k % n)::BIGINT AS check_sum FROM n, m, unnest(range(0, m)) AS u(k) GROUP BY ALL")
def track_expand(spark, sf):
    """Short series repeated cyclically to the length of the longest: attractors that are whole tracks."""
    e = t(spark, sf, "events").select(F.to_json(F.struct("user_id", "event_type")).alias("scenario_id"), "event_id", "user_id", "event_type")
    place = F.row_number().over(W.partitionBy("scenario_id").orderBy("event_id")) - 1
    track = e.select("scenario_id", F.lit(0).alias("var_id"), place.alias("t"), "user_id", "event_type").withColumn("value", F.col("t")).withColumn("in_attractor", F.lit(True))
    track = cut(track, "tracks")
    longest = track.agg(F.max("t") + 1).first()[0] or 0
    long_ = boolnet.expanded(track, longest)
    return long_.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("value").cast("long")).alias("check_sum"))


# --- drugs


@query("SELECT l_suppkey, l_partkey, round(CASE WHEN a < 1 THEN 0.999 WHEN a < 10 THEN 0.99 WHEN a <= 1e7 THEN -0.196 * (log10(a) - 1) + 0.99 ELSE 0 END, 6) AS strength FROM (SELECT l_suppkey, l_partkey, min(l_extendedprice) AS a FROM lineitem GROUP BY ALL)")
def affinity_strength(spark, sf):
    a = rel.least_affinity(t(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"], "l_extendedprice")
    return a.select("l_suppkey", "l_partkey", r6(scalar.affinity_strength(F.col("affinity"))).alias("strength"))


@query("SELECT n_name, round(sum(abs(s_acctbal)), 2) AS sum_impact, round(avg(abs(s_acctbal)), 4) AS mean_impact FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0.01 GROUP BY n_name")
def impact_summary(spark, sf):
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    j = rel.strong_impacts(s, 0.01, "s_acctbal").join(n, s.s_nationkey == n.n_nationkey)
    return rel.impact_summary(j, ["n_name"], "s_acctbal").select("n_name", r6("sum_impact", 2).alias("sum_impact"), r6("mean_impact", 4).alias("mean_impact"))


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT n_name, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 0), 2) AS \"{p}\"" for p in PRIORITIES) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def drug_pathway_matrix(spark, sf):
    o, c, n = t(spark, sf, "orders"), t(spark, sf, "customer"), t(spark, sf, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    m = rel.matrix(j, "n_name", "o_orderpriority", "o_totalprice", PRIORITIES)
    return m.select("n_name", *(r6(F.col(f"`{p}`"), 2).alias(p) for p in PRIORITIES))


@query("SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{k}'), 0), 4) AS {k}" for k in TYPES) + ", round(sum(value) FILTER (event_type IN ('" + "', '".join(TYPES) + "')), 4) AS total FROM events GROUP BY user_id")
def matrix_row_sum(spark, sf):
    m = rel.matrix(t(spark, sf, "events"), "user_id", "event_type", "value", TYPES, total="total")
    return m.select("user_id", *(r6(k, 4).alias(k) for k in [*TYPES, "total"]))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_anti_filter(spark, sf):
    c, o = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    urgent = o.where("o_orderpriority = '1-URGENT'").select("c_custkey")
    a = rel.among(rel.among(c, o.where("o_orderstatus = 'P'"), "c_custkey"), urgent, "c_custkey").withColumn("urgent", F.lit(True))
    return a.union(rel.not_among(c, urgent, "c_custkey").withColumn("urgent", F.lit(False)))


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49")
def anti_compare(spark, sf):
    li = t(spark, sf, "lineitem")
    return rel.only_in(li.where("l_returnflag = 'R' AND l_quantity > 45").select("l_suppkey"), li.where("l_returnflag = 'A' AND l_quantity > 49").select("l_suppkey"))


@query("SELECT s_nationkey AS drug, min_by(s_name, s_suppkey) AS cluster FROM supplier GROUP BY s_nationkey")
def min_by_tiebreak(spark, sf):
    s = t(spark, sf, "supplier")
    return rel.map_through_least(s.select(F.col("s_suppkey").alias("external_id"), F.col("s_name").alias("cluster")), s.select(F.col("s_suppkey").alias("external_id"), F.col("s_nationkey").alias("drug")))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def contingency(spark, sf):
    return rel.contingency(t(spark, sf, "documents"), "lang", "source")


@query("""WITH c AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c),
a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT lang, sum(n) AS n FROM c GROUP BY lang)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT source, sum(n) AS n FROM c GROUP BY source))
SELECT n::BIGINT AS n, round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM s, a, b""")
def ari_lang_source(spark, sf):
    return rel.adjusted_rand(t(spark, sf, "documents"), "lang", "source").select("n", r6("ari").alias("ari"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n, round(min(l_extendedprice), 2) AS least FROM lineitem")
def pearson(spark, sf):
    return rel.correlation(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(r6("r").alias("r"), "n", r6("least_b", 2).alias("least"))


@query("SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS idx FROM (SELECT DISTINCT p_brand FROM part)")
def dense_index(spark, sf):
    return rel.dense_index(t(spark, sf, "part"), "p_brand")


@query("SELECT n_name FROM nation WHERE n_regionkey IN (0, 2) UNION SELECT n_name FROM nation WHERE n_regionkey IN (2, 3)")
def set_union(spark, sf):
    n = t(spark, sf, "nation")
    return rel.union_of(n.where("n_regionkey IN (0, 2)").select("n_name"), n.where("n_regionkey IN (2, 3)").select("n_name"))


# --- iterative


@query("""WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS root FROM x UNION SELECT x.b, r.root FROM r JOIN x ON x.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def connected_components(spark, sf):
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    e = s.select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return components.components(e)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation WHERE n_regionkey <> 1 UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_regionkey = 2),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT DISTINCT a AS node FROM r WHERE a = b""")
def cycle_vars(spark, sf):
    n = t(spark, sf, "nation")
    k = F.col("n_nationkey")
    e = n.where("n_regionkey != 1").select(k.alias("a"), ((k * 7 + 3) % 25).alias("b")).union(n.where("n_regionkey = 2").select(k, (k + 5) % 25))
    return components.on_cycles(e)


@query()
def permutation_ari(spark, sf):
    """10,000 random dealings of the sources."""
    return drug.permutation_null(t(spark, sf, "documents"), "lang", "source")


@query()
def randomize_tuples(spark, sf):
    o = obs(spark, sf).groupBy("sample_id", "data_type").agg(F.avg("value").alias("value")).withColumn("gene", F.concat(F.lit("g"), (F.col("sample_id") % 7).cast("string")))
    return observations.randomised(o.select("sample_id", "gene", "data_type", "value"), 1000)


@query()
def gibbs_marginals(spark, sf):
    factors, links, names = chain(spark, sf)
    s = kernel.gibbs_samples(vectors(factors, links), draws=500, burn_in=50, restarts=4)
    states = links.select(F.lit(1).alias("graph_id"), F.col("var_id").cast("long").alias("var_id"), "states").distinct()
    return kernel.gibbs_marginals(s, states).join(names, ["var_id", "state"]).select("var_id", "label", "p")


@query()
def em_learning(spark, sf):
    """A hidden segment with two states behind status and priority of all orders, whose combinations weigh as much as they occur."""
    o = t(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("weight"))
    code = lambda c, name: rel.dense_index(o, c, name)
    s = o.join(code("o_orderstatus", "s"), "o_orderstatus").join(code("o_orderpriority", "p"), "o_orderpriority")
    ev = s.select(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("sample_id"), "weight", F.explode(F.array(F.struct(F.lit(1).alias("var_id"), F.col("s").cast("double").alias("value")), F.struct(F.lit(2).alias("var_id"), F.col("p").cast("double").alias("value")))).alias("x")).select("sample_id", "weight", "x.var_id", "x.value")
    n = s.agg((F.max("s") + 1).cast("int").alias("ns"), (F.max("p") + 1).cast("int").alias("np"))

    def factor(fid: int, group: int | None, var_ids: list[int], states: list, values) -> Column:
        fields = {"factor_id": F.lit(fid), "group_id": F.lit(group).cast("long"), "var_ids": F.array(*map(F.lit, var_ids)), "states": F.array(*states), "values": values}
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    hidden, half = F.lit(2), F.lit(0.5)
    f = n.select(F.inline(F.array(factor(0, None, [0], [hidden], F.array(half, half)), factor(1, 1, [1, 0], [F.col("ns"), hidden], F.array_repeat(half, F.col("ns") * 2)), factor(2, 2, [2, 0], [F.col("np"), hidden], F.array_repeat(half, F.col("np") * 2)))))
    learned, _, _ = learning.learn(learning.randomised(f, 3), ev)
    return learned.select("factor_id", F.posexplode("values").alias("idx", "value"))


@query("SELECT i AS idx, CASE WHEN i % 3 = least(2 - (i // 9) % 3, (i // 3) % 3) THEN 0.999::DOUBLE ELSE 0.0005::DOUBLE END AS val FROM range(27) AS r(i)")
def reaction_factor_values(spark, sf):
    """A three-state reaction with one input and one inhibitor."""
    return pathway.factor_values(spark, ["INPUT", "INHIBITOR"])


@query("SELECT 'supplier' || l_suppkey AS parent, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY l_suppkey")
def fan_in_split(spark, sf):
    """Suppliers as targets of their parts: after splitting no node has more than three parents, and every part still leads to its
    supplier: the number of leaves below each supplier."""
    li = t(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    e = cut(pathway.split_fan_in(li.select(F.concat(F.lit("supplier"), "l_suppkey").alias("target"), F.concat(F.lit("part"), "l_partkey").alias("parent"), F.lit("MEMBER").alias("label"))), "fan-in")
    over = e.groupBy("target", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    leaves = e.where("parent LIKE 'part%'").groupBy(F.regexp_extract("target", "^supplier[0-9]+", 0).alias("parent")).agg(F.count(F.lit(1)).alias("n"))
    return leaves.join(over.select(F.col("target").alias("parent")), "parent", "left_anti")


@query("SELECT DISTINCT n_name AS drug, r_name AS pathway, count(*) OVER (PARTITION BY n_name, r_name) AS n_targets FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def drug_hits(spark, sf):
    n, r, s = t(spark, sf, "nation"), t(spark, sf, "region"), t(spark, sf, "supplier")
    targets = n.join(s, n.n_nationkey == s.s_nationkey).select(F.col("n_name").alias("drug"), F.col("s_name").alias("gene"))
    genes = s.join(n, n.n_nationkey == s.s_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("pathway"), F.col("s_name").alias("gene"))
    return drug.hits(targets, genes).select("drug", "pathway", F.size("targets").cast("long").alias("n_targets"))


@query("SELECT o_custkey, o_orderkey, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_per_group(spark, sf):
    return rel.top_of(t(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3, "place").select("o_custkey", "o_orderkey", "place")


@query("SELECT user_id, count(*) FILTER (value >= 50) AS n_high, count(*) FILTER (value > 190) AS n_top FROM events GROUP BY user_id")
def count_thresholds(spark, sf):
    v = F.col("value")
    return rel.counted_if(t(spark, sf, "events"), ["user_id"], {"n_high": v >= 50, "n_top": v > 190})


@query("SELECT round(corr(a.m, p_retailprice), 6) AS r, count(*) AS n FROM part JOIN (SELECT l_partkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1) a ON l_partkey = p_partkey")
def correlation_join(spark, sf):
    """A score averaged by gene against a property of the gene."""
    scores = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_extendedprice").alias("score"))
    lengths = t(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("length"))
    return rel.correlation(rel.with_property(scores, lengths, "gene", "score"), "score", "length").select(r6("r").alias("r"), "n")


GRID = """WITH x AS (SELECT k, c_mktsegment AS x, c_custkey % k AS y, count(*)::DOUBLE AS n FROM customer, range(2, 7) AS g(k) GROUP BY ALL),
s AS (SELECT k, sum(n * (n - 1) / 2) AS s, sum(n) AS n, count(DISTINCT y) AS n_clusters FROM x GROUP BY k),
a AS (SELECT k, sum(m * (m - 1) / 2) AS a FROM (SELECT k, x, sum(n) AS m FROM x GROUP BY ALL) GROUP BY k), b AS (SELECT k, sum(m * (m - 1) / 2) AS b FROM (SELECT k, y, sum(n) AS m FROM x GROUP BY ALL) GROUP BY k)
SELECT s.k, n::BIGINT AS n, n_clusters, round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM s JOIN a ON a.k = s.k JOIN b ON b.k = s.k"""


@query(GRID)
def cluster_grid(spark, sf):
    """Market segments against clusterings of the customers into 2 to 6 parts."""
    c = t(spark, sf, "customer")
    one = c.select(F.col("c_custkey").alias("member"), F.col("c_mktsegment").alias("cluster"))
    many = c.crossJoin(spark.range(2, 7).withColumnRenamed("id", "k")).select("k", F.col("c_custkey").alias("member"), (F.col("c_custkey") % F.col("k")).alias("cluster"))
    return drug.compare_grid(one, many).select("k", "n", "n_clusters", r6("ari").alias("ari"))


@query("WITH h AS (SELECT user_id, k, sum(value) AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), unnest([10, 20, 40]) AS u(k) WHERE i <= k GROUP BY ALL) SELECT user_id AS key, round(max(s) FILTER (k = 10), 6) AS h10, round(max(s) FILTER (k = 20), 6) AS h20, round(max(s) FILTER (k = 40), 6) AS h40 FROM h GROUP BY user_id")
def score_stability(spark, sf):
    """Running sums over growing horizons, a column for each."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(spark, sf, "events").withColumn("i", F.row_number().over(w)).withColumn("horizon", F.explode(F.array(F.lit(10), F.lit(20), F.lit(40)))).where("i <= horizon")
    sums = e.groupBy(F.col("user_id").alias("key"), "horizon").agg(F.sum("value").alias("change"))
    return drug.stability(sums, [10, 20, 40]).select("key", *(r6(F.col(f"`{k}`")).alias(f"h{k}") for k in (10, 20, 40)))


@query("SELECT least(lang, source) || chr(9) || greatest(lang, source) AS pair, coalesce(nullif(source, ''), lang) AS named, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL")
def string_functions(spark, sf):
    """Names of unordered pairs, and the first name that there is."""
    d = t(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    return d.groupBy(scalar.pair_name(F.col("lang"), F.col("source")).alias("pair"), scalar.first_named(F.col("source"), F.col("lang")).alias("named")).agg(F.count(F.lit(1)).alias("n"))


# The other modules register theirs.
from netquill.plans import catalogue_files, catalogue_graphs, catalogue_large, catalogue_runs  # noqa: E402, F401
