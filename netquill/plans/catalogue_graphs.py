"""Registered queries of observations, factor graphs, learning, converters, simulation and drugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.functions import scalar
from netquill.operators import belief, boolnet, components, drug, factor_graph, kernel, learning, network, observations, pathway
from netquill.operators import relational as rel
from netquill.plans.checkpoint import cut
from netquill.plans.registry import CHAIN, FI, chain, constants, fi, folder, query, r6, structs, t, vectors
from netquill.sources import config, readers, writers
from netquill.streaming.incremental import score_arrivals, window_means

KINDS = {"click": "CNV", "error": "Methylation", "purchase": "Mutation", "signup": "miRNA", "view": "mRNA_EXP"}
BIO = "bio AS (SELECT event_id, user_id, 'G' || floor(value / 100)::INT AS gene, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END AS data_type, (value - 100) / 100 AS value FROM events)"


def bio(spark, sf) -> DataFrame:
    """Events as observations: sample_id, gene, data_type, value, event_id."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    v = F.col("value")
    return t(spark, sf, "events").select("event_id", F.col("user_id").alias("sample_id"), F.concat(F.lit("G"), F.floor(v / 100).cast("string")).alias("gene"), kind[F.col("event_type")].alias("data_type"), ((v - 100) / 100).alias("value"))


def at(array: Column | str, k: int, name: str) -> Column:
    return r6(F.get(array, F.lit(k))).alias(name)


# --- observations


@query(f"WITH {BIO} SELECT gene || '_' || CASE data_type WHEN 'CNV' THEN 'DNA' WHEN 'Methylation' THEN 'DNA' WHEN 'Mutation' THEN 'protein' ELSE 'mRNA' END AS anchor, count(*) AS n FROM bio GROUP BY ALL")
def obs_anchors(spark, sf):
    return observations.anchors(bio(spark, sf)).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))


def empirical_sql(over: str) -> str:
    """State probabilities of the kept genes' rows, whose distribution is over the rows of ``over``."""
    return f"""WITH {BIO}, kept AS (SELECT * FROM bio WHERE gene IN ('G0', 'G2', 'G4')), c AS (SELECT *, cume_dist() OVER (PARTITION BY data_type ORDER BY value) AS c FROM {over})
SELECT event_id, round(c, 6) AS cpd, round(CASE WHEN data_type = 'Mutation' THEN 1 - c WHEN c < 0.5 THEN 1 - 2 * c ELSE 0 END, 6) AS p0, round(CASE WHEN data_type = 'Mutation' THEN c WHEN c < 0.5 THEN 2 * c WHEN c > 0.5 THEN 2 * (1 - c) ELSE 1 END, 6) AS p1 FROM c WHERE gene IN ('G0', 'G2', 'G4')"""


def empirical(spark, sf, whole: bool) -> DataFrame:
    keep = constants(spark, "gene", ("G0",), ("G2",), ("G4",))
    e = config.evidence(config.DataFile("", "", "empirical"), bio(spark, sf), config.Config(), genes=keep, whole_matrix=whole)
    return e.select("event_id", r6("cpd").alias("cpd"), at("marginal", 0, "p0"), at("marginal", 1, "p1"))


@query(empirical_sql("bio"))
def obs_empirical(spark, sf):
    """The distribution is that of the whole matrix, also of genes that aren't kept."""
    return empirical(spark, sf, True)


@query(empirical_sql("kept"))
def obs_empirical_kept(spark, sf):
    """The distribution is that of the kept genes only."""
    return empirical(spark, sf, False)


@query(f"WITH {BIO}, g AS (SELECT event_id, CASE data_type WHEN 'CNV' THEN 0.5 ELSE 1 END::DOUBLE AS w, value FROM bio WHERE data_type IN ('CNV', 'miRNA', 'mRNA_EXP')), d AS (SELECT event_id, exp(-pow(value + w, 2) / 2) AS a, exp(-pow(value, 2) / 2) AS b, exp(-pow(value - w, 2) / 2) AS c FROM g) SELECT event_id, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM d")
def obs_mixture(spark, sf):
    """The handler of Gaussian mixtures, set up by a configuration."""
    c = config.parse('<c><dataFiles><dataFile type="CNV" handler="mixture" states="3">x</dataFile></dataFiles></c>')
    e = config.evidence(c.files[0], bio(spark, sf), c).where("marginal IS NOT NULL")
    return e.select("event_id", at("marginal", 0, "p0"), at("marginal", 1, "p1"), at("marginal", 2, "p2"))


@query("WITH s AS (SELECT l_extendedprice AS s FROM lineitem), n AS (SELECT count(*) AS n FROM s), p AS (SELECT p_partkey, p_retailprice * 40 AS v FROM part) SELECT p_partkey, round((SELECT count(*) FROM s WHERE s.s <= p.v) / n.n, 6) AS p1 FROM p, n")
def obs_mutation_scores(spark, sf):
    """Scores of parts against the distribution of all mutations' scores."""
    scores = t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("score"))
    o = t(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") * 40).alias("value"))
    e = config.evidence(config.DataFile("", "Mutation", "mutation"), o, config.Config(), scores=scores)
    return e.select("p_partkey", at("marginal", 1, "p1"))


@query(f"WITH {BIO} SELECT DISTINCT gene || '_' || data_type AS child, i AS idx, CASE WHEN i % 3 = i // 3 THEN 0.9 ELSE 0.05 END::DOUBLE AS val FROM bio, range(9) AS r(i)")
def obs_factors(spark, sf):
    """The learnable table of each observed variable given its anchor."""
    return observations.observation_factors(bio(spark, sf)).select("child", F.posexplode("values").alias("idx", "val")).select("child", F.col("idx").cast("long").alias("idx"), "val")


DOGMA = "e AS (SELECT DISTINCT p_brand || '_protein' AS parent, p_type AS child FROM part UNION SELECT p_brand || '_DNA', p_brand || '_mRNA' FROM part UNION SELECT p_brand || '_mRNA', p_brand || '_protein' FROM part)"


@query(f"WITH {DOGMA} SELECT * FROM e")
def dogma_edges(spark, sf):
    return observations.dogma(t(spark, sf, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("target")))


@query(f"WITH {DOGMA} SELECT child, parent, i AS idx, CASE WHEN i % 3 = i // 3 THEN 0.999 ELSE 0.0005 END::DOUBLE AS val FROM e, range(9) AS r(i)")
def dogma_factors(spark, sf):
    f = observations.dogma_factors(t(spark, sf, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("target")))
    return f.select("child", "parent", F.posexplode("values").alias("idx", "val")).select("child", "parent", F.col("idx").cast("long").alias("idx"), "val")


@query("SELECT s_nationkey, trunc(s_acctbal / 1000)::INT AS state, count(*) AS n FROM supplier GROUP BY ALL")
def obs_states(spark, sf):
    s = observations.as_states(t(spark, sf, "supplier").select("s_nationkey", (F.col("s_acctbal") / 1000).alias("value")))
    return s.groupBy("s_nationkey", F.col("value").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BIO}, o AS (SELECT user_id, gene, data_type, avg(value) AS v FROM bio GROUP BY ALL), s AS (SELECT gene FROM o GROUP BY gene HAVING count(DISTINCT data_type) = (SELECT count(DISTINCT data_type) FROM o)) SELECT 200 * count(*) AS n_tuples, 0 AS n_foreign, 0 AS n_torn FROM s")
def randomized_tuples(spark, sf):
    """What must hold of made-up samples whatever is drawn: each gene that all types share has one tuple a sample, every value is that
    of some sample, and all types of a tuple come from the same one."""
    o = cut(bio(spark, sf).groupBy("sample_id", "gene", "data_type").agg(F.avg("value").alias("value")), "obs")
    fake = cut(observations.randomised(o, 200), "fake")
    tuples = fake.groupBy("sample_id", "gene").agg(F.count(F.lit(1)).alias("n"))
    real = o.select("data_type", "value", F.struct(F.col("sample_id").alias("s"), F.col("gene").alias("g")).alias("source"))
    traced = fake.join(real, ["data_type", "value"], "left").groupBy("sample_id", "gene", "source").agg(F.count_distinct("data_type").alias("k"))
    torn = traced.join(tuples, ["sample_id", "gene"]).groupBy("sample_id", "gene", "n").agg(F.max("k").alias("k")).where("k < n")
    foreign = fake.join(real, ["data_type", "value"], "left_anti")
    return tuples.agg(F.count(F.lit(1)).alias("n_tuples")).select("n_tuples", F.lit(foreign.count()).cast("int").alias("n_foreign"), F.lit(torn.count()).cast("int").alias("n_torn"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN (value - 100) / 100 < -0.5 THEN 0 WHEN (value - 100) / 100 < 0.5 THEN 1 ELSE 2 END ELSE CASE WHEN (value - 100) / 100 < 2 THEN 0 ELSE 1 END END AS state FROM events WHERE event_type IN ('click', 'purchase')")
def streamed_states(spark, sf):
    """Observations that arrive as files, scored as a stream."""
    new, out, at_ = folder(spark), folder(spark), folder(spark)
    rows = bio(spark, sf).where("data_type IN ('CNV', 'Mutation')")
    rows.write.parquet(new)
    score_arrivals(spark, new, rows.schema, out, at_).awaitTermination()
    return spark.read.parquet(out).select("event_id", "state")


def windowed(spark, sf, **kind) -> DataFrame:
    new, out = folder(spark), folder(spark)
    e = t(spark, sf, "events").select(F.col("event_type").alias("data_type"), F.col("ts").cast("timestamp").alias("ts"), "value")
    middle = F.lit("2024-01-15").cast("timestamp")
    stale = e.where(F.col("ts") >= middle).groupBy("data_type").agg(F.lit("2024-01-01").cast("timestamp").alias("ts"), F.max("value").alias("value"))
    e.where(F.col("ts") < middle).coalesce(1).write.parquet(new)  # a file is a batch
    e.where(F.col("ts") >= middle).coalesce(1).write.mode("append").parquet(new)
    stale.coalesce(1).write.mode("append").parquet(new)  # a row of each type comes weeks late, when its window is written
    window_means(spark, new, e.schema, out, folder(spark), files=1, **kind).awaitTermination()
    total = (F.col("mean") * F.col("n")).alias("total")  # a sum of cents has no ties to be rounded
    return spark.read.parquet(out).select("data_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round(total, 2).alias("total"))


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"SELECT event_type AS data_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 6 HOUR, min(ts), TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR <= {CLOSED}")
def streamed_windows(spark, sf):
    """Counts and sums in windows of six hours; the last ones aren't final yet, and what comes weeks late is left out."""
    return windowed(spark, sf, width="6 hours")


@query(f"""WITH e AS (SELECT event_type, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT event_type AS data_type, min(ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY event_type, k HAVING max(ts) + INTERVAL 10 MINUTE <= {CLOSED}""")
def streamed_sessions(spark, sf):
    """Counts and sums of sessions, which end after ten minutes without an event of the type."""
    return windowed(spark, sf, gap="10 minutes")


# --- networks


@query(f"WITH {FI} SELECT 'pair' AS kind, count(*) AS n, round(count(*) * 1.0::DOUBLE, 4) AS total FROM fi UNION ALL SELECT 'gene', count(*), round(count(*) * 1.0::DOUBLE, 4) FROM deg")
def network_factors(spark, sf):
    """The random field of a network: a factor for each pair and each gene, whose values sum to one."""
    p = fi(spark, sf)
    genes = cut(rel.dense_index(p.select(F.col("gene1").alias("gene")).union(p.select("gene2")), "gene", "var_id"), "genes")
    f, links = network.factor_graph(p, genes)
    size = links.groupBy("factor_id").agg(F.count(F.lit(1)).alias("k"))
    kind = F.when(F.col("k") == 2, "pair").otherwise("gene").alias("kind")
    return f.join(size, "factor_id").groupBy(kind).agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.aggregate("values", F.lit(0.0), lambda a, b: a + b)), 4).alias("total"))


@query("WITH q AS (SELECT c_nationkey AS k, 0.1 + 0.8 * avg((c_acctbal > 4500)::INT) AS p FROM customer GROUP BY 1), s AS (SELECT c_mktsegment, c_nationkey AS k, 0.1 + 0.8 * avg((c_acctbal > 4500)::INT) AS p FROM customer GROUP BY ALL) SELECT c_mktsegment AS sample_id, s.k AS var_id, round(log10(s.p * (1 - q.p) / ((1 - s.p) * q.p)), 6) AS score FROM s JOIN q ON q.k = s.k")
def network_odds(spark, sf):
    """Log odds ratios of samples' beliefs and their prior."""
    rich = lambda *by: t(spark, sf, "customer").groupBy(*by).agg((0.1 + 0.8 * F.avg((F.col("c_acctbal") > 4500).cast("int"))).alias("p"))
    k, s = F.col("c_nationkey").alias("var_id"), F.col("c_mktsegment").alias("sample_id")
    return network.scores(rich(k), rich(s, k)).select("sample_id", "var_id", r6("score").alias("score"))


TEMPLATE = """WITH e AS (SELECT user_id, event_type, CASE WHEN avg(value) >= 100 THEN 1 ELSE 0 END AS b FROM events GROUP BY ALL),
w AS (SELECT user_id, event_type, 0.4::DOUBLE * CASE b WHEN 0 THEN 0.1 ELSE 0.9 END::DOUBLE AS x, 0.6::DOUBLE * CASE b WHEN 0 THEN 0.55 ELSE 0.45 END::DOUBLE AS y FROM e)"""


@query(TEMPLATE + " SELECT user_id, event_type, round(0.975 * x / (0.975 * x + 0.025 * y), 6) AS p0 FROM w")
def network_templates(spark, sf):
    """Genes' factors times the belief of a small template graph, which is worked out once for each distinct evidence."""
    template = constants(spark, "graph_id factor_id var_ids states values", (1, "a", F.array(F.lit(0).cast("long")), F.array(F.lit(2)), F.array(F.lit(0.4), F.lit(0.6))), (1, "ab", F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), F.array(F.lit(2), F.lit(2)), F.array(*map(F.lit, (0.1, 0.55, 0.9, 0.45)))))
    e = t(spark, sf, "events").groupBy(F.col("user_id").alias("sample_id"), F.col("event_type").alias("gene")).agg((F.avg("value") >= 100).cast("int").alias("state"))
    b = kernel.template_beliefs(template, e.withColumn("var_id", F.lit(1).cast("long")), 0)
    own = e.select("gene").distinct().withColumn("values", F.array(F.lit(0.975), F.lit(0.025)))
    return network.template_values(own, b).select(F.col("sample_id").alias("user_id"), F.col("gene").alias("event_type"), at("values", 0, "p0"))


@query("""WITH e AS (SELECT s_name AS a, n_name AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0), c AS (SELECT b, count(*) AS n, least(b, min(a)) AS root FROM e GROUP BY b), m AS (SELECT b FROM c ORDER BY n DESC, root LIMIT 1)
SELECT a AS gene1, b AS gene2 FROM e WHERE b IN (SELECT b FROM m)""")
def network_targets(spark, sf):
    """Interactions of one source with evidence, in their largest component."""
    j = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    e = j.select(F.col("s_name").alias("gene1"), F.col("n_name").alias("gene2"), F.when(F.col("s_acctbal") > 0, "ENCODE").otherwise("other").alias("source"), F.lit("by co-expression").alias("definition"))
    return network.targets_of(e)


# --- factor graphs


@query("SELECT true AS chain, false AS ring, false AS apart")
def graph_trees(spark, sf):
    _, links, _ = chain(spark, sf)
    ring = links.select("factor_id", "pos", "var_id", "states").union(constants(spark, "factor_id pos var_id states", (3, 0, 1, 2), (3, 1, 3, 2)))
    apart = links.select("factor_id", "pos", "var_id", "states").union(constants(spark, "factor_id pos var_id states", (3, 0, 9, 2)))
    return spark.range(1).select(*(F.lit(factor_graph.is_tree(x)).alias(n) for n, x in (("chain", links), ("ring", ring), ("apart", apart))))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1 OR bool_or(o_orderpriority = '1-URGENT')")
def graph_uninferable(spark, sf):
    """Customers as continuous variables, their orders' statuses as factors, urgent ones discrete."""
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("var_id"), F.col("o_orderstatus").alias("factor_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "discrete").otherwise("continuous").alias("factor_kind"), F.lit(2).alias("n_vars"), F.lit(1).alias("n_continuous"))
    return factor_graph.uninferable(o).select(F.col("var_id").alias("o_custkey"))


@query(f"WITH {CHAIN}, w AS (SELECT c, dense_rank() OVER (ORDER BY c) / 10 AS w FROM (SELECT DISTINCT c FROM f2)), x AS (SELECT a, v * w AS v FROM j JOIN w USING (c)) SELECT a AS status, round(sum(v) / (SELECT sum(v) FROM x), 6) AS p FROM x GROUP BY a")
def graph_continuous_evidence(spark, sf):
    """A continuous observation of the chain's end, as the unary factor that it makes."""
    factors, links, names = chain(spark, sf)
    marginal = F.transform(F.sequence(F.lit(1), F.col("states")), lambda k: k / 10.0)
    seen = links.where("var_id = 3").select(F.lit(9).alias("factor_id"), "var_id", marginal.alias("marginal"))
    ef, el = factor_graph.effective_factors(factors, links, seen)
    m = kernel.marginals(vectors(ef, el)).where("var_id = 1")
    return m.join(names, ["var_id", "state"]).select(F.col("label").alias("status"), r6("p").alias("p"))


PARTS = "e AS (SELECT 'n' || s_nationkey AS a, 's' || s_suppkey AS b FROM supplier WHERE s_acctbal > 5000), v AS (SELECT 'n' || n_nationkey AS node FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier), hub AS (SELECT a, least(a, min(b)) AS root, count(*) + 1 AS n FROM e GROUP BY a), c AS (SELECT root, n FROM hub UNION ALL SELECT node, 1 FROM v WHERE node NOT IN (SELECT a FROM e UNION SELECT b FROM e))"


@query(f"WITH {PARTS}, main AS (SELECT root FROM c ORDER BY n DESC, root LIMIT 1) SELECT main.root AS a, c.root AS b FROM c, main WHERE c.root <> main.root")
def graph_linked(spark, sf):
    """Links that make one component of nations, suppliers and the rich suppliers' edges."""
    n, s = t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node")), t(spark, sf, "supplier")
    v = n.union(s.select(F.concat(F.lit("s"), "s_suppkey")))
    e = s.where("s_acctbal > 5000").select(F.concat(F.lit("n"), "s_nationkey").alias("a"), F.concat(F.lit("s"), "s_suppkey").alias("b"))
    return components.linked_into_one(v, e)


@query("WITH c AS (SELECT s_nationkey, count(*) AS n_factors FROM supplier GROUP BY 1) SELECT row_number() OVER (ORDER BY n_factors DESC) AS place, n_factors FROM c QUALIFY place <= 5")
def graph_largest_components(spark, sf):
    """Suppliers as factors that share their nation: the five largest components."""
    links = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("factor_id"), F.col("s_nationkey").alias("var_id"))
    c = factor_graph.factor_components(links).groupBy("root").agg(F.count(F.lit(1)).alias("n_factors"))
    return rel.top_of(c.withColumn("all", F.lit(1)), ["all"], [F.desc("n_factors"), "root"], 5).select("place", "n_factors")


@query("SELECT doc_id FROM labels WHERE quality = 1")
def graph_outputs(spark, sf):
    v = t(spark, sf, "labels").select("doc_id", F.create_map(F.lit("output"), F.when(F.col("quality") == 1, "true").otherwise("false")).alias("props"))
    return factor_graph.outputs(v).select("doc_id")


MARGINALS = """SELECT 1 AS var_id, a AS label, round(sum(v) / (SELECT sum(v) FROM j), 4) AS p FROM j GROUP BY a
UNION ALL SELECT 2, b, round(sum(v) / (SELECT sum(v) FROM j), 4) FROM j GROUP BY b UNION ALL SELECT 3, c, round(sum(v) / (SELECT sum(v) FROM j), 4) FROM j GROUP BY c"""


@query(f"WITH {CHAIN} {MARGINALS}")
def bp_damped(spark, sf):
    """Damped messages end in the same beliefs."""
    factors, links, names = chain(spark, sf)
    b, _, _ = belief.propagate(factors, links, tolerance=1e-8, damping=0.3)
    return b.join(names, ["var_id", "state"]).select("var_id", "label", r6("p", 4).alias("p"))


@query(f"WITH {CHAIN}, best AS (SELECT a, b, c FROM j ORDER BY v DESC, a, b, c LIMIT 1) SELECT 1 AS var_id, a AS label, false AS ambiguous FROM best UNION ALL SELECT 2, b, false FROM best UNION ALL SELECT 3, c, false FROM best")
def bp_decoded(spark, sf):
    """The most probable states by maxima sent over tables."""
    factors, links, names = chain(spark, sf)
    b, _, _ = belief.propagate(factors, links, maximise=True)
    return belief.decoded(b).join(names, ["var_id", "state"]).select("var_id", "label", "ambiguous")


@query("SELECT * FROM (VALUES ('enough', true), ('best', true), ('too few', false), ('best, too few', false)) AS v(rounds, converged)")
def bp_convergence(spark, sf):
    """A graph that doesn't converge is reported, in sums and in maxima."""
    rows = vectors(*chain(spark, sf)[:2])
    got = [kernel.marginals(rows).select(F.lit("enough"), "converged"), kernel.most_probable(rows).select(F.lit("best"), "converged"), kernel.marginals(rows, rounds=1).select(F.lit("too few"), "converged"), kernel.most_probable(rows, rounds=1).select(F.lit("best, too few"), "converged")]
    return rel.union_of(*(g.toDF("rounds", "converged") for g in got))


EXACT = f"WITH {CHAIN}, m AS ({MARGINALS}) SELECT var_id, label, true AS close FROM m"


def closeness(spark, sf, m: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """Whether marginals of the chain are within ``least`` of those of belief propagation, which are exact on a tree."""
    exact = kernel.marginals(vectors(*chain(spark, sf)[:2])).select("var_id", "state", F.col("p").alias("want"))
    both = m.select("var_id", "state", "p").join(exact, ["var_id", "state"]).join(names, ["var_id", "state"])
    return both.select(F.col("var_id").cast("int").alias("var_id"), "label", (F.abs(F.col("p") - F.col("want")) < least).alias("close"))


@query(EXACT)
def bp_fallback(spark, sf):
    """Where propagation doesn't converge Gibbs draws take its place."""
    factors, links, names = chain(spark, sf)
    return closeness(spark, sf, kernel.marginals(vectors(factors, links), rounds=1, fall_back=4000), names, 0.1)


@query(EXACT)
def gibbs_close(spark, sf):
    """Marginals of draws against the exact ones."""
    factors, links, names = chain(spark, sf)
    s = kernel.gibbs_samples(vectors(factors, links), draws=2000, burn_in=50, restarts=4)
    states = links.select(F.lit(1).alias("graph_id"), F.col("var_id").cast("long").alias("var_id"), "states").distinct()
    return closeness(spark, sf, kernel.gibbs_marginals(s, states), names, 0.06)


@query("SELECT v AS var_id, true AS settled FROM range(1, 4) AS r(v)")
def gibbs_scale(spark, sf):
    """The potential scale reduction of four chains."""
    factors, links, _ = chain(spark, sf)
    s = kernel.gibbs_samples(vectors(factors, links), draws=2000, burn_in=50, restarts=4)
    return kernel.potential_scale(s).select("var_id", F.coalesce(F.col("r_hat") < 1.2, F.lit(True)).alias("settled"))


# --- learning: both variables of a table are seen, so its maximum is known


EM = "SELECT i.idx, round((n.n + 1) / (sum(n.n + 1) OVER (PARTITION BY i.p)), 6) AS value FROM (SELECT s.s + p.p * (SELECT count(DISTINCT o_orderpriority) FROM orders) AS idx, s.s, p.p FROM (SELECT dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS s, o_orderpriority AS l FROM orders GROUP BY 2) s, (SELECT dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS p, o_orderstatus AS l FROM orders GROUP BY 2) p) i JOIN c n ON n.s = i.s AND n.p = i.p"
EM_SQL = f"""WITH d AS (SELECT dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS s, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS p FROM orders),
c AS (SELECT s.s, p.p, (SELECT count(*) FROM d WHERE d.s = s.s AND d.p = p.p) AS n FROM (SELECT DISTINCT s FROM d) s, (SELECT DISTINCT p FROM d) p) {EM}"""


def seen_pairs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(factors, evidence) of priority given status, both observed, equal orders weighted."""
    o = t(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("weight"))
    s = cut(o.join(rel.dense_index(o, "o_orderpriority", "s"), "o_orderpriority").join(rel.dense_index(o, "o_orderstatus", "p"), "o_orderstatus"), "pairs")
    ev = s.select(F.concat_ws("/", "s", "p").alias("sample_id"), "weight", F.explode(structs("var_id value", (1, F.col("s").cast("double")), (2, F.col("p").cast("double")))).alias("x")).select("sample_id", "weight", "x.var_id", "x.value")
    n = s.agg((F.max("s") + 1).cast("int").alias("ns"), (F.max("p") + 1).cast("int").alias("np"))
    f = n.select(F.inline(structs("factor_id group_id var_ids states values", (1, F.lit(1).cast("long"), F.array(F.lit(1), F.lit(2)), F.array("ns", "np"), F.array_repeat(1.0 / F.col("ns"), F.col("ns") * F.col("np"))))))
    return cut(f, "factors"), cut(ev, "evidence")


def table_of(learned: DataFrame) -> DataFrame:
    return learned.select(F.posexplode("values").alias("idx", "value")).select(F.col("idx").cast("long").alias("idx"), r6("value").alias("value"))


@query(EM_SQL)
def em_observed(spark, sf):
    return table_of(learning.learn(*seen_pairs(spark, sf))[0])


@query(EM_SQL)
def em_restarted(spark, sf):
    return table_of(learning.learn_restarted(*seen_pairs(spark, sf), restarts=2)[0])


@query(EM_SQL)
def em_annealed(spark, sf):
    return table_of(learning.learn_annealed(*seen_pairs(spark, sf), betas=(0.1, 1.0))[0])


@query("SELECT c_mktsegment AS segment, avg((c_acctbal > 0)::INT) AS share, 0.5::DOUBLE AS value, 1 AS n_rounds FROM customer GROUP BY 1 HAVING share > 0")
def em_failing(spark, sf):
    """A round whose likelihood isn't a number leaves the last good values: the segments' shares of customers in credit contradict a
    fixed factor that rules credit out, so no round succeeds."""
    f = constants(spark, "factor_id group_id var_ids states values", (1, F.lit(1).cast("long"), F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(2)), F.array_repeat(F.lit(0.5), 4)), (2, F.lit(None).cast("long"), F.array(F.lit(1)), F.array(F.lit(2)), F.array(F.lit(1.0), F.lit(0.0))))
    credit = t(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("sample_id")).agg(F.avg((F.col("c_acctbal") > 0).cast("int")).alias("share")).where("share > 0")
    ev = cut(credit.select("sample_id", "share", F.lit(1).alias("var_id"), F.lit(1.0).alias("value")), "evidence")
    learned, _, course = learning.learn(cut(f, "factors"), ev.select("sample_id", "var_id", "value"))
    last = learned.where("factor_id = 1").select(F.get("values", F.lit(0)).alias("value"), F.lit(len(course) + 1).alias("n_rounds"))
    return ev.select(F.col("sample_id").alias("segment"), "share").crossJoin(last)  # one row of values


# --- converters: nations as reactions, suppliers as what takes part by their balance, regions and rich nations' products as outputs


PART = """p AS (SELECT s_nationkey AS r, 'S' || s_suppkey AS e, CASE WHEN s_acctbal < 0 THEN 'INHIBITOR' WHEN s_acctbal < 2500 THEN 'ACTIVATOR' WHEN s_acctbal < 5000 THEN 'CATALYST' ELSE 'INPUT' END AS role, s_suppkey AS ord FROM supplier),
q AS (SELECT n_nationkey AS r, 'R' || n_regionkey AS e FROM nation WHERE n_nationkey IN (SELECT r FROM p) OR n_nationkey < 12 UNION ALL SELECT n_nationkey, 'X' || n_nationkey FROM nation WHERE n_nationkey >= 12 AND n_nationkey IN (SELECT r FROM p)),
k AS (SELECT *, row_number() OVER (PARTITION BY r, role ORDER BY ord) AS rn, count(*) OVER (PARTITION BY r, role) AS n FROM p)"""


def participants(spark, sf) -> DataFrame:
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    b = F.col("s_acctbal")
    role = F.when(b < 0, "INHIBITOR").when(b < 2500, "ACTIVATOR").when(b < 5000, "CATALYST").otherwise("INPUT")
    p = s.select(F.col("s_nationkey").alias("reaction_id"), F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), role.alias("role"), F.col("s_suppkey").cast("int").alias("ord"))
    has = s.select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("has", F.lit(True))
    n = n.join(has, "n_nationkey", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    out = n.where("has OR n_nationkey < 12").select("n_nationkey", F.concat(F.lit("R"), "n_regionkey").alias("e")).union(n.where("has AND n_nationkey >= 12").select("n_nationkey", F.concat(F.lit("X"), "n_nationkey")))
    return cut(p.union(out.select("n_nationkey", "e", F.lit("OUTPUT"), F.lit(10**6))), "participants")


@query(f"""WITH {PART} SELECT r || '_OUTPUT' AS target, CASE WHEN role IN ('ACTIVATOR', 'INHIBITOR') AND n > 1 THEN r || '_' || role ELSE e END AS parent, role AS label FROM k WHERE (role <> 'CATALYST' OR rn = 1) AND (role NOT IN ('ACTIVATOR', 'INHIBITOR') OR n = 1 OR rn = 1)
UNION ALL SELECT r || '_' || role, e, 'MEMBER' FROM k WHERE role IN ('ACTIVATOR', 'INHIBITOR') AND n > 1 UNION ALL SELECT e, r || '_OUTPUT', 'MEMBER' FROM q""")
def reaction_edges(spark, sf):
    return pathway.reaction_edges(participants(spark, sf))


RELATIONS = f"""{PART}, o AS (SELECT r, count(*) AS n, min(e) AS e FROM q GROUP BY r), z AS (SELECT r, CASE WHEN n > 1 THEN r || '_output' ELSE e END AS output FROM o WHERE r IN (SELECT r FROM p)),
rels AS (SELECT k.r::VARCHAR AS rel, CASE WHEN role IN ('ACTIVATOR', 'INHIBITOR') AND n > 1 THEN k.r || '_' || lower(role) ELSE e END AS input, role = 'INHIBITOR' AS negated, output FROM k JOIN z ON z.r = k.r WHERE role NOT IN ('ACTIVATOR', 'INHIBITOR') OR n = 1 OR rn = 1
UNION ALL SELECT r || '_' || lower(role) || '_' || e, e, false, r || '_' || lower(role) FROM k WHERE role IN ('ACTIVATOR', 'INHIBITOR') AND n > 1
UNION ALL SELECT q.r || '_output_' || q.e, q.r || '_output', false, q.e FROM q JOIN o ON o.r = q.r WHERE o.n > 1 AND q.r IN (SELECT r FROM p))"""


@query(f"WITH {RELATIONS} SELECT * FROM rels")
def boolean_relations(spark, sf):
    return pathway.boolean_network(participants(spark, sf))


def named_entities(spark, sf) -> DataFrame:
    """Suppliers are proteins, whose genes are their nations; outputs are others."""
    p = participants(spark, sf).select("entity_id", "reaction_id").distinct().groupBy("entity_id").agg(F.min("reaction_id").alias("r"))
    return p.select("entity_id", F.concat(F.lit("N"), "r").alias("gene"), F.when(F.col("entity_id").startswith("S"), "protein").otherwise("complex").alias("class"))


@query(f"""WITH {RELATIONS}, n AS (SELECT input AS name FROM rels UNION SELECT output FROM rels) SELECT name, CASE WHEN name LIKE 'S%' THEN 'N' || (SELECT r FROM p WHERE p.e = name) END AS gene, NOT regexp_matches(name, '^[SRX]') AS identical, name IN (SELECT e FROM q) AS output, name IN (SELECT output FROM rels) AS driven FROM n""")
def boolean_variables(spark, sf):
    """Attributes of a converted network's variables."""
    p = participants(spark, sf)
    v, _ = pathway.network(pathway.boolean_network(p), p, named_entities(spark, sf))
    return v.select("name", "gene", "identical", "output", "driven")


@query(f"""WITH {RELATIONS} SELECT count(*) AS n_inputs, count(*) FILTER (negated) AS n_negated, count(DISTINCT rel) AS n_relations FROM rels""")
def boolean_inputs(spark, sf):
    p = participants(spark, sf)
    _, i = pathway.network(pathway.boolean_network(p), p, named_entities(spark, sf))
    return i.agg(F.count(F.lit(1)).alias("n_inputs"), F.count_if("negated").alias("n_negated"), F.count_distinct("rel_id").alias("n_relations"))


TREE = "SELECT 'R' || n_regionkey AS target, 'N' || n_nationkey AS parent, 'COMPLEX' AS label FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'MEMBER' FROM supplier"


def parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    n, s = t(spark, sf, "nation"), t(spark, sf, "supplier")
    p = n.select(F.concat(F.lit("R"), "n_regionkey").alias("parent_id"), F.concat(F.lit("N"), "n_nationkey").alias("child_id"), F.lit("component").alias("kind"))
    p = p.union(s.select(F.concat(F.lit("N"), "s_nationkey"), F.concat(F.lit("S"), "s_suppkey"), F.when(F.col("s_acctbal") > 0, "member").otherwise("candidate")))
    return n.select(F.concat(F.lit("R"), "n_regionkey").alias("entity_id")), p


@query(TREE)
def entity_edges(spark, sf):
    """Regions are complexes of nations, nations sets of suppliers."""
    return pathway.entity_edges(*parts(spark, sf))


@query(f"SELECT CASE label WHEN 'COMPLEX' THEN target || '_parts' ELSE target || '_' || parent END AS rel, parent AS input, false AS negated, target AS output FROM ({TREE})")
def entity_relations(spark, sf):
    return pathway.entity_relations(*parts(spark, sf))


@query("WITH m AS (SELECT s_nationkey, s_suppkey, floor(s_acctbal / 1000)::INT AS g FROM supplier), h AS (SELECT *, max((g = 9)::INT) OVER (PARTITION BY s_nationkey) AS any_hit FROM m) SELECT s_nationkey AS parent_id, s_suppkey AS child_id, g AS gene FROM h WHERE g = 9 OR any_hit = 0")
def focused_members(spark, sf):
    """Of a nation's suppliers those in focus, or all where none is."""
    m = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("parent_id"), F.col("s_suppkey").alias("child_id"), F.floor(F.col("s_acctbal") / 1000).cast("int").alias("gene"))
    return pathway.focused_members(m, constants(spark, "gene", (9,)))


@query(f"WITH {PART}, a AS (SELECT r, role FROM p UNION ALL SELECT r, 'OUTPUT' FROM q) SELECT r AS reaction_id FROM a GROUP BY r HAVING count(*) FILTER (role = 'INPUT') < 1 AND count(*) FILTER (role = 'OUTPUT') = 1 AND count(*) FILTER (role IN ('ACTIVATOR', 'INHIBITOR')) > 0 AND r <> 7")
def gene_regulatory(spark, sf):
    black = t(spark, sf, "nation").select(F.col("n_nationkey").alias("reaction_id"), (F.col("n_nationkey") != 7).alias("is_black_box"))
    return pathway.gene_regulatory(participants(spark, sf), black)


@query(f"WITH {PART}, c AS (SELECT r, e FROM k WHERE role = 'CATALYST' AND rn = 1), i AS (SELECT r, e FROM k WHERE role = 'INPUT' AND r IN (SELECT r FROM c)) SELECT DISTINCT 'reverse_input_' || c.r AS target, c.e AS parent, 'INPUT' AS label FROM c JOIN i ON i.r = c.r UNION ALL SELECT e, 'reverse_input_' || r, 'INPUT' FROM i")
def reverse_edges(spark, sf):
    return pathway.reverse_edges(participants(spark, sf))


@query("SELECT c_nationkey AS entity_id, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS roles FROM customer GROUP BY 1")
def entity_roles(spark, sf):
    return pathway.roles(t(spark, sf, "customer").select(F.col("c_nationkey").alias("entity_id"), F.col("c_mktsegment").alias("role")))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL), e AS (SELECT l_orderkey AS target, count(*) AS n, bool_and(flag = 'R') AS members FROM l GROUP BY 1),
g AS (SELECT target, n, i, i % 2 AS o, CASE WHEN members THEN (i // 2 = (1 << n::INT) - 1)::INT ELSE bit_count((i // 2)::BIGINT) / n END::DOUBLE AS m FROM e, range(2048) AS r(i) WHERE i < (2 << n::INT))
SELECT target, n AS n_parents, count(*) AS n_cells, round(sum((i % 7) * least(greatest(CASE o WHEN 1 THEN 1 - exp(-10 * m) ELSE exp(-10 * m) END, 4.5e-6), 1 - 4.5e-6)), 7) AS total FROM g GROUP BY ALL""")
def perturbation_values(spark, sf):
    """Orders as targets of their line numbers, members if all were returned: the cells of each factor, weighted by their number."""
    label = F.when(F.max("l_returnflag") == "R", "MEMBER").otherwise("INPUT")
    f = pathway.perturbation_factors(t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("parent")).agg(label.alias("label")))
    total = F.aggregate(F.transform("values", lambda v, i: (i % 7) * v), F.lit(0.0), lambda a, b: a + b)
    return f.select("target", F.size("parents").cast("long").alias("n_parents"), F.size("values").cast("long").alias("n_cells"), r6(total, 7).alias("total"))


@query("WITH e AS (SELECT s_nationkey AS n, p_name FROM supplier, part WHERE p_partkey = s_suppkey) SELECT p_partkey FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')")
def without_currency(spark, sf):
    """Parts of two types bear the name of a currency molecule."""
    name = F.when(F.col("p_type") == "ECONOMY", "ATP").when(F.col("p_type") == "PROMO", "H2O").otherwise(F.col("p_type"))
    return rel.without_currency(t(spark, sf, "part").select("p_partkey", F.array("p_name", name).alias("names"))).select("p_partkey")


# --- simulation


@query("""WITH RECURSIVE e AS (SELECT s_nationkey AS a, s_nationkey + 100 AS b FROM supplier WHERE s_acctbal > 0 UNION SELECT s_nationkey + 100, s_nationkey FROM supplier WHERE s_acctbal > 9000 UNION SELECT n_nationkey + 100, n_nationkey + 200 FROM nation),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), v AS (SELECT a AS v FROM e UNION SELECT b FROM e)
SELECT v.v AS var_id, CASE WHEN v.v NOT IN (SELECT b FROM e) OR (v.v < 100 AND EXISTS (SELECT 1 FROM r WHERE r.a = v.v AND r.b = v.v)) THEN 1 ELSE 0 END::DOUBLE AS init FROM v""")
def initial_values(spark, sf):
    """Nations act on a second layer, some back; only nations are entities."""
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    k = F.col("s_nationkey")
    e = cut(s.where("s_acctbal > 0").select(k.alias("input_var"), (k + 100).alias("output_var")).union(s.where("s_acctbal > 9000").select(k + 100, k)).union(n.select(F.col("n_nationkey") + 100, F.col("n_nationkey") + 200)).distinct(), "edges")
    v = e.select(F.col("input_var").alias("var_id")).union(e.select("output_var")).distinct().withColumn("source_id", F.when(F.col("var_id") < 100, F.col("var_id")))
    return boolnet.initial_values(v, e, 1.0)


@query("SELECT c_mktsegment AS scenario_id, n_nationkey::BIGINT AS var_id, round(avg(c_acctbal), 4) AS stim FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def named_stimuli(spark, sf):
    """Stimuli by the names of nations; other names are ignored."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("var_id"), F.col("n_name").alias("name"))
    c = t(spark, sf, "customer").withColumn("name", F.concat(F.lit("NATION_"), "c_nationkey"))
    s = c.groupBy(F.col("c_mktsegment").alias("scenario_id"), "name").agg(F.avg("c_acctbal").alias("stim"))
    s = s.union(s.select("scenario_id", F.lit("nobody"), F.lit(1.0)))
    return boolnet.named_stimuli(n, s).select("scenario_id", "var_id", r6("stim", 4).alias("stim"))


@query("WITH f AS (SELECT c_nationkey AS k, c_mktsegment = 'BUILDING' AS b, round(avg(c_acctbal), 2) AS v FROM customer GROUP BY ALL) SELECT n_name AS name, round(p.v / q.v, 6) AS ratio FROM f p JOIN f q ON q.k = p.k AND p.b AND NOT q.b JOIN nation ON n_nationkey = p.k WHERE n_regionkey <> 0 AND abs(p.v / q.v - 1) >= 1e-6")
def attractor_ratios(spark, sf):
    """Two states of nations as attractors; the first region's are accessory outputs."""
    c = t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("var_id"), (F.col("c_mktsegment") == "BUILDING").alias("b")).agg(F.round(F.avg("c_acctbal"), 2).alias("value"))
    track = cut(c.select("var_id", "b", "value", F.lit(0).alias("t"), F.lit(True).alias("in_attractor")), "tracks")
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("var_id"), F.when(F.col("n_regionkey") == 0, F.concat("n_name", F.lit("_output"))).otherwise(F.col("n_name")).alias("name"))
    return boolnet.attractor_ratios(track.where("NOT b"), track.where("b"), n).select("name", r6("ratio").alias("ratio"))


@query("""WITH RECURSIVE s AS (SELECT k, 0 AS t, a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM (VALUES (0, 0.8::DOUBLE), (1, 0.6::DOUBLE)) AS v(k, a) UNION ALL SELECT k, t + 1, a, a, least(b, 1 - d), c FROM s WHERE t < 1000),
v AS (SELECT k, t, u.v.var_id AS var_id, u.v.x AS x FROM s, unnest([{'var_id': 0, 'x': a}, {'var_id': 1, 'x': b}, {'var_id': 2, 'x': c}, {'var_id': 3, 'x': d}]) AS u(v)),
g AS (SELECT *, sum(x) OVER (PARTITION BY k, var_id ORDER BY t) - x / 2 - first(x) OVER (PARTITION BY k, var_id ORDER BY t) / 2 AS auc, t + 1 AS h FROM v),
c AS (SELECT p.h, p.var_id, (p.auc - q.auc) / (p.auc + q.auc) AS change FROM g p JOIN g q ON q.h = p.h AND q.var_id = p.var_id AND q.k = 0 AND p.k = 1 WHERE p.h >= 9 AND (p.h - 9) % 20 = 0),
m AS (SELECT *, max(abs(change - old)) OVER (PARTITION BY h) AS moved FROM (SELECT *, lag(change) OVER (PARTITION BY var_id ORDER BY h) AS old FROM c))
SELECT var_id::BIGINT AS var_id, round(change, 6) AS change FROM m WHERE h = (SELECT min(h) FROM m WHERE moved < 1e-3)""")
def converged_changes(spark, sf):
    """A feedback network at two stimuli, compared over longer horizons until nothing moves."""
    v = spark.range(4).select(F.col("id").alias("var_id"), F.lit(True).alias("identical"))
    long_ = lambda *x: tuple(F.lit(y).cast("long") if isinstance(y, int) else y for y in x)
    i = constants(spark, "rel_id output_var input_var negated", long_(0, 1, 0, F.lit(False)), long_(1, 2, 1, F.lit(False)), long_(1, 2, 3, F.lit(True)), long_(2, 3, 2, F.lit(False)))
    none = F.lit(None).cast("double")
    run = lambda a: cut(boolnet.simulate(v, i, constants(spark, "scenario_id var_id stim act inh init", (str(a), F.lit(0).cast("long"), a, none, none, none)), transfer="identity"), "tracks")
    changes, _ = boolnet.converged_changes(run(0.8), run(0.6))
    return changes.select(F.col("key").alias("var_id"), r6("change").alias("change"))


# --- drugs


ACTIONS = "a AS (SELECT o_orderkey, o_custkey, o_orderstatus AS target, CASE o_orderpriority WHEN '1-URGENT' THEN 'Agonist' ELSE 'blocker' END AS type, (SELECT min(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R') AS a FROM orders), m AS (SELECT o_custkey, target, CASE type WHEN 'Agonist' THEN 'Activation' ELSE 'Inhibition' END AS modification, CASE WHEN a < 1 THEN 0.999 WHEN a < 10 THEN 0.99 WHEN a <= 1e7 THEN -0.196 * (log10(a) - 1) + 0.99 ELSE 0 END AS s FROM a WHERE a IS NOT NULL)"


def interactions(spark, sf) -> tuple[DataFrame, DataFrame]:
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    i = o.select(F.col("o_orderkey").alias("interaction_id"), F.col("o_custkey").alias("drug"), F.col("o_orderstatus").alias("target"), F.when(F.col("o_orderpriority") == "1-URGENT", "Agonist").otherwise("blocker").alias("type"))
    return i, li.select(F.col("l_orderkey").alias("interaction_id"), F.when(F.col("l_returnflag") != "R", "Ki").alias("assay_type"), F.col("l_extendedprice").alias("assay_value"), F.lit("m").alias("assay_median"))


@query(f"WITH {ACTIONS} SELECT modification, count(*) AS n, round(sum(s), 4) AS total FROM m GROUP BY ALL")
def drug_actions(spark, sf):
    m = drug.target_modifications(*interactions(spark, sf))
    return m.groupBy("modification").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("strength"), 4).alias("total"))


@query(f"WITH {ACTIONS} SELECT o_custkey AS drug, target, round(max(s), 6) AS weight FROM m WHERE s > 0 GROUP BY ALL")
def drug_target_network(spark, sf):
    return drug.target_network(*interactions(spark, sf)).select("drug", "target", r6("weight").alias("weight"))


@query("WITH c AS (SELECT c_mktsegment AS s, c_nationkey AS k, avg(c_acctbal) / 10000 - 0.45 AS c FROM customer GROUP BY ALL) SELECT s AS scenario_id, round(sum(abs(c)), 6) AS sum_impact, round(avg(abs(c)), 6) AS mean_impact FROM c WHERE k < 10 GROUP BY s")
def drug_impact_sums(spark, sf):
    """Changes summed over output variables only."""
    c = t(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("scenario_id"), F.col("c_nationkey").alias("key")).agg((F.avg("c_acctbal") / 10000 - 0.45).alias("change"))
    out = t(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("key"))
    return drug.impacts(c, out).select("scenario_id", r6("sum_impact").alias("sum_impact"), r6("mean_impact").alias("mean_impact"))


@query("WITH v AS (SELECT s_suppkey, s_nationkey, floor(s_acctbal / 2000)::INT AS gene, s_acctbal < 3000 AS driven FROM supplier), b AS (SELECT s_suppkey, gene FROM v QUALIFY row_number() OVER (PARTITION BY s_nationkey, gene ORDER BY driven, s_suppkey) = 1) SELECT d.drug, s_suppkey AS var_id, 'Inhibition' AS modification, 0.5::DOUBLE AS strength FROM b, (VALUES ('x', 0), ('x', 2), ('y', 2), ('y', 4)) AS d(drug, gene) WHERE d.gene = b.gene")
def drug_injected(spark, sf):
    """Suppliers as variables, connected through their nations; of a gene one variable in each part, an undriven one first."""
    s = t(spark, sf, "supplier")
    v = s.select(F.col("s_suppkey").alias("var_id"), F.floor(F.col("s_acctbal") / 2000).cast("int").alias("gene"), F.lit(None).cast("long").alias("source_id"), (F.col("s_acctbal") < 3000).alias("driven"))
    edges = s.select(F.col("s_suppkey").alias("a"), (-1 - F.col("s_nationkey")).cast("long").alias("b"))
    m = constants(spark, "drug gene modification strength", *((d, g, "Inhibition", 0.5) for d, g in (("x", 0), ("x", 2), ("y", 2), ("y", 4))))
    return drug.injected(v, edges, m)


@query("SELECT n_name AS member, min(n_name) OVER (PARTITION BY n_regionkey) AS cluster FROM nation")
def markov_modules(spark, sf):
    """Nations linked within their regions fall into these; clusters are named by their smallest member."""
    n = t(spark, sf, "nation")
    e = n.alias("x").join(n.alias("y"), (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_name") < F.col("y.n_name"))).select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"), F.lit(1.0).alias("weight"))
    c = drug.markov_clusters(cut(e, "edges"))
    low = c.groupBy("cluster").agg(F.min("member").alias("low"))
    return c.join(low, "cluster").select("member", F.col("low").alias("cluster"))


@query("""WITH c AS (SELECT c_mktsegment AS x, c_nationkey AS y, count(*)::DOUBLE AS n FROM customer GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT x, sum(n) AS n FROM c GROUP BY x)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT y, sum(n) AS n FROM c GROUP BY y))
SELECT n::BIGINT AS n, round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM s, a, b""")
def compared_clusterings(spark, sf):
    c = t(spark, sf, "customer")
    one = lambda k: c.select(F.col("c_custkey").alias("member"), F.col(k).alias("cluster"))
    return drug.compare_clusterings(one("c_mktsegment"), one("c_nationkey")).select("n", r6("ari").alias("ari"))


@query("SELECT true AS near_zero, true AS bounded, 10000 AS n")
def permuted_clusterings(spark, sf):
    """What must hold of the null distribution of a large table: it is around zero, and no index exceeds one."""
    c = t(spark, sf, "customer").select("c_mktsegment", "c_nationkey")
    d = drug.permutation_null(c, "c_mktsegment", "c_nationkey").agg(F.avg("ari").alias("m"), F.max("ari").alias("x"), F.count("ari").alias("n"))
    return d.select((F.abs("m") < 0.005).alias("near_zero"), (F.col("x") < 1).alias("bounded"), F.col("n").cast("int").alias("n"))


# --- further relational operators


@query("SELECT DISTINCT 'x' || p_brand AS gene FROM part WHERE p_size > 20")
def target_genes(spark, sf):
    name = F.concat(F.lit("x"), "p_brand", F.when(F.col("p_size") > 20, "_protein").otherwise("_mRNA"))
    return rel.target_genes(t(spark, sf, "part").select(name.alias("name")))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 4000 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def hits_or_strong(spark, sf):
    """A network with a least value, and one of all hits."""
    s = t(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return rel.hits_or_strong(s, 4000, "s_acctbal").union(rel.hits_or_strong(s, None, "s_acctbal"))


@query("SELECT c_custkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def subset_columns(spark, sf):
    return rel.subset_columns(t(spark, sf, "customer"), {"c_acctbal": "balance", "c_mktsegment": "segment", "c_none": "none"})


NINE = "v AS (SELECT l_suppkey, [" + ", ".join(f"count(*) FILTER (least(floor((l_quantity - 1) / 50 * 9), 8) = {k}) / count(*)" for k in range(9)) + "] AS x FROM lineitem GROUP BY 1)"


def nine(spark, sf) -> DataFrame:
    k = F.least(F.floor((F.col("l_quantity") - 1) / 50 * 9), F.lit(8))
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array(*(F.count_if(k == i) / F.count(F.lit(1)) for i in range(9))).alias("values"))


@query(f"WITH {NINE} SELECT l_suppkey FROM v WHERE abs(x[1] - x[4]) >= 0.01 AND abs(x[1] - x[7]) >= 0.01 AND abs(x[4] - x[7]) >= 0.01 AND x[1] > x[7]")
def good_parameters(spark, sf):
    return rel.good_parameters(nine(spark, sf), "values", 0.01).select("l_suppkey")


@query(f"WITH {NINE}, m AS (SELECT i AS pos, avg(x[i + 1]) AS v FROM v, range(9) AS r(i) GROUP BY i) SELECT pos::INT AS pos, round(v / sum(v) OVER (PARTITION BY pos // 3), 6) AS value FROM m")
def averaged_triples(spark, sf):
    return rel.averaged_triples(nine(spark, sf)).select("pos", r6("value").alias("value"))


@query("WITH l AS (SELECT value > lag(value) OVER (ORDER BY event_id) AS up FROM events) SELECT count(*) FILTER (up) AS n_rises FROM l")
def rising_steps(spark, sf):
    return rel.rising_steps(t(spark, sf, "events"), "event_id", "value")


@query("WITH g AS (SELECT c_mktsegment AS g, c_nationkey AS s, count(*) AS n FROM customer GROUP BY ALL), p AS (SELECT g, s, sum(n) OVER (PARTITION BY g ORDER BY s) / sum(n) OVER (PARTITION BY g) AS c FROM g), u AS (SELECT c_mktsegment AS g, (avg(c_acctbal) + 1000) / 11000 AS u FROM customer GROUP BY 1) SELECT p.g AS segment, min(s) AS state FROM p JOIN u ON u.g = p.g AND u.u <= p.c GROUP BY 1")
def drawn_states(spark, sf):
    """The state that a number draws: the first whose cumulative probability reaches it."""
    c = t(spark, sf, "customer")
    p = rel.normalised(c.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n")), ["c_mktsegment"], "n")
    u = c.groupBy("c_mktsegment").agg(((F.avg("c_acctbal") + 1000) / 11000).alias("u"))
    return rel.drawn(p.join(u, "c_mktsegment"), ["c_mktsegment"], "c_nationkey", "p", "u").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("state"))


@query("SELECT n_name FROM nation ORDER BY split_part(n_name, '_', 2)::INT LIMIT 11")
def numeric_order(spark, sf):
    return rel.by_numeric_suffix(t(spark, sf, "nation").select("n_name"), "n_name").limit(11)


@query("SELECT 50 AS n, 50 AS n_distinct, 0 AS n_foreign")
def sampled_rows(spark, sf):
    """A seeded sample is of the table's own rows."""
    c = t(spark, sf, "customer").select("c_custkey")
    s = rel.sampled(c, "c_custkey", 50, 7)
    return s.join(c.withColumn("own", F.lit(True)), "c_custkey", "left").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("c_custkey").cast("int").alias("n_distinct"), F.count_if(F.col("own").isNull()).cast("int").alias("n_foreign"))


@query("SELECT p_partkey, p_size % 3 + 1 + 10 * (p_size // 3 % 3 + 1) + 1000 * CASE WHEN p_size > 25 THEN 0 ELSE 2 END AS key, p_size % 3 + 3 * (p_size // 3 % 3) AS idx, p_size % 3 AS s0, p_size // 3 % 3 AS s1 FROM part")
def observation_keys(spark, sf):
    """Decimal keys, and assignments to indices and back."""
    a, b = F.col("p_size") % 3, F.floor(F.col("p_size") / 3).cast("int") % 3
    i = scalar.assignment_index([a, b], [3, 3])
    back = scalar.assignment_states(i, [3, 3])
    key = scalar.observation_key({"CNV": a, "mRNA_EXP": b, "miRNA": F.when(F.col("p_size") <= 25, 1)})
    return t(spark, sf, "part").select("p_partkey", key.alias("key"), i.alias("idx"), back[0].alias("s0"), back[1].alias("s1"))


@query("WITH c AS (SELECT c_mktsegment, n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) SELECT c_mktsegment AS segment, r::INT AS pos, round(n / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS p FROM c")
def log_probabilities(spark, sf):
    """Logarithms far below zero as probabilities."""
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("c_mktsegment", "n_regionkey").agg((F.log(F.count(F.lit(1))) - 2000).alias("l"))
    a = c.groupBy("c_mktsegment").agg(F.array_sort(F.collect_list(F.struct("n_regionkey", "l"))).alias("x"))
    p = scalar.log_to_probability(F.transform("x", lambda x: x["l"]))
    return a.select(F.col("c_mktsegment").alias("segment"), F.inline(F.arrays_zip(F.transform("x", lambda x: x["n_regionkey"]).alias("pos"), p.alias("p")))).select("segment", "pos", r6("p").alias("p"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(CASE WHEN l_returnflag = 'R' THEN l_discount * 10 * (1 - l_tax * 10) WHEN l_returnflag = 'A' THEN l_discount * 10 * (1 + l_tax * 10) ELSE l_discount * 10 END, 1), 6) AS value FROM lineitem")
def modified_values(spark, sf):
    tax, flag = F.col("l_tax") * 10, F.col("l_returnflag")
    v = scalar.modified(F.col("l_discount") * 10, F.when(flag == "R", tax), F.when(flag.isin("A", "R"), tax))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(v).alias("value"))


@query("WITH d AS (SELECT s_suppkey, abs(s_acctbal) / 4000 AS d FROM supplier), x AS (SELECT *, 1 / (1 + 0.2316419 * d) AS t FROM d) SELECT s_suppkey, round(2 * exp(-d * d / 2) / sqrt(2 * pi()) * (0.319381530 * t - 0.356563782 * t ** 2 + 1.781477937 * t ** 3 - 1.821255978 * t ** 4 + 1.330274429 * t ** 5), 6) AS p FROM x")
def normal_tails(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", r6(scalar.normal_tail(F.abs("s_acctbal") / 4000)).alias("p"))


@query("SELECT n_name AS name, n_nationkey AS pathway_id FROM nation WHERE n_regionkey = 2 AND n_nationkey IN (SELECT s_nationkey FROM supplier) AND n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey <> 7 AND n_nationkey <> 12")
def selected_pathways(spark, sf):
    """Nations as pathways: suppliers are diagrams, customers drawn reactions."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("pathway_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("species_id"), (F.col("n_nationkey") == 7).alias("is_shell"), F.when(F.col("n_nationkey") == 12, True).alias("is_disease"))
    return readers.pathways(t(spark, sf, "supplier").select(F.col("s_nationkey").alias("pathway_id")), n, t(spark, sf, "customer").select(F.col("c_nationkey").alias("pathway_id")), 2).select("name", "pathway_id")


@query("SELECT r_name AS line FROM region WHERE false UNION ALL SELECT n_regionkey || chr(9) || 'x' || chr(9) || count(*) || chr(9) || round(avg(n_nationkey), 1) || chr(9) || string_agg(n_name, ',' ORDER BY n_name) FROM nation GROUP BY n_regionkey")
def result_lines(spark, sf):
    """Lines of impact results."""
    n = t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("db_id")).agg(F.lit("x").alias("name"), F.count(F.lit(1)).alias("sum"), F.round(F.avg("n_nationkey"), 1).alias("average"), F.array_sort(F.collect_list("n_name")).alias("targets"))
    return writers.result_text(n)
