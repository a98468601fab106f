"""Registered queries of sources and sinks: tables are written in a format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.operators import kernel, network
from netquill.plans.checkpoint import cut
from netquill.plans.registry import CHAIN, chain, constants, folder, query, r6, t
from netquill.sources import readers, writers


def lines(spark: SparkSession, rows: DataFrame, *order: str | Column) -> str:
    """Write the column value of ``rows`` as text in order, over as many files as it takes; the folder."""
    path = folder(spark)
    rows.orderBy(*order).select("value").write.text(path)
    return path


def table(spark: SparkSession, rows: DataFrame, header: bool = True) -> str:
    path = folder(spark)
    writers.tsv(rows, path, header)
    return path


def regions(spark, sf) -> DataFrame:
    return t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


# --- matrices


@query("""WITH m AS (SELECT c_mktsegment AS gene, n_name AS sample_id, sum(c_acctbal) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL)
SELECT gene, sample_id, round(v, 2) AS value FROM m UNION ALL SELECT gene, 'SUM', round(sum(v), 2) FROM m GROUP BY gene""")
def io_matrix(spark, sf):
    """A gene by sample matrix with its sums, of which two genes are read."""
    n = t(spark, sf, "nation")
    scores = t(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("c_mktsegment").alias("gene"), F.col("n_name").alias("sample_id")).agg(F.sum("c_acctbal").alias("score"))
    names = [r[0] for r in n.select("n_name").orderBy("n_name").collect()]  # the matrix's columns
    path = table(spark, writers.sample_matrix(scores, names))
    got = readers.matrix(spark, path, "CNV", constants(spark, "gene", ("BUILDING",), ("MACHINERY",)))
    return got.select("gene", "sample_id", r6("value", 2).alias("value"))


@query("SELECT c_mktsegment AS sample_id, n_name AS variable, count(*)::DOUBLE AS value FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 2 GROUP BY ALL")
def io_observation_table(spark, sf):
    """A sample by variable table; what wasn't observed is na and isn't read."""
    n = t(spark, sf, "nation").where("n_regionkey < 2")
    obs = t(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("c_mktsegment").alias("sample_id"), F.col("n_name").alias("variable")).agg(F.count(F.lit(1)).alias("value"))
    path = table(spark, writers.observation_table(obs, [*(r[0] for r in n.select("n_name").collect()), "NOBODY"]))
    return readers.matrix(spark, path, "x").select(F.col("gene").alias("sample_id"), F.col("sample_id").alias("variable"), "value")


@query("SELECT c_mktsegment AS sample_id, round(avg(c_acctbal) FILTER (c_nationkey = 3), 4) AS a, round(avg(c_acctbal) FILTER (c_nationkey = 4), 4) AS b FROM customer WHERE c_nationkey IN (3, 4) GROUP BY 1")
def io_beliefs(spark, sf):
    """A row of beliefs for each sample."""
    c = t(spark, sf, "customer").where("c_nationkey IN (3, 4)").groupBy(F.col("c_mktsegment").alias("sample_id"), F.when(F.col("c_nationkey") == 3, "a").otherwise("b").alias("name")).agg(F.avg("c_acctbal").alias("value"))
    back = spark.read.csv(table(spark, writers.sample_rows(c, ["a", "b"])), sep="\t", header=True, schema="sample_id string, a double, b double")
    return back.select("sample_id", r6("a", 4).alias("a"), r6("b", 4).alias("b"))


@query("SELECT c_mktsegment AS drug, " + ", ".join(f"round(coalesce(sum(c_acctbal) FILTER (r_name = '{r}'), 0), 2) AS \"{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE")) + " FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') GROUP BY 1")
def io_drug_matrix(spark, sf):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
    j = t(spark, sf, "customer").join(regions(spark, sf), F.col("n_nationkey") == F.col("c_nationkey")).where(F.col("r_name").isin(*names))
    m = writers.drug_matrix(j.select(F.col("c_mktsegment").alias("drug"), F.col("r_name").alias("pathway"), F.col("c_acctbal").alias("value")), names[::-1])
    back = spark.read.csv(table(spark, m), sep="\t", header=True, schema="drug string, " + ", ".join(f"{n} double" for n in names))
    return back.select("drug", *(r6(n, 2).alias(n) for n in names))


@query("SELECT c_mktsegment AS sample_id, 'Drug_' || n_regionkey || '_IC50' AS drug, round(pow(2, -ln(count(*))), 6) AS weight FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def io_ic50(spark, sf):
    """A matrix of logarithms as weights."""
    j = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    m = j.groupBy("c_mktsegment").pivot("n_regionkey", list(range(5))).agg(F.log(F.count(F.lit(1))))
    path = folder(spark)
    m.toDF("sample", *(f"Drug_{k}_IC50" for k in range(5))).write.csv(path, header=True)
    return readers.ic50(spark, path).select("sample_id", "drug", r6("weight").alias("weight"))


# --- mutations


MAF = "m AS (SELECT 'G' || l_linenumber AS gene, 'S' || l_suppkey AS sample_id, l_extendedprice AS score FROM lineitem WHERE l_returnflag = 'N' AND l_suppkey <> 3 AND l_tax > 0), a AS (SELECT sample_id, gene, avg(score) AS score FROM m GROUP BY ALL)"


def maf(spark, sf) -> DataFrame:
    """Mutations as a file has them; some are silent, of unknown samples or without score."""
    li = t(spark, sf, "lineitem")
    rows = li.select(
        F.concat(F.lit("G"), "l_linenumber").alias("Hugo_Symbol"), F.when(F.col("l_suppkey") == 3, "Unknown").otherwise(F.concat(F.lit("S"), "l_suppkey")).alias("Tumor_Sample_Barcode"),
        F.when(F.col("l_returnflag") == "N", "Missense_Mutation").otherwise("Silent").alias("Variant_Classification"), F.when(F.col("l_tax") > 0, F.col("l_extendedprice").cast("string")).otherwise("").alias("MA_score"),
    )
    return readers.mutations(spark, table(spark, rows), "MA_score")


@query(f"WITH {MAF} SELECT sample_id, gene, round(score, 4) AS score FROM a")
def io_mutations(spark, sf):
    return readers.mean_scores(maf(spark, sf)).select("sample_id", "gene", r6("score", 4).alias("score"))


@query(f"WITH {MAF}, g AS (SELECT DISTINCT 'G' || l_linenumber AS gene FROM lineitem UNION SELECT 'none'), s AS (SELECT DISTINCT sample_id FROM m) SELECT s.sample_id, g.gene, round(coalesce(a.score, (SELECT min(score) FROM a)), 4) AS score FROM s CROSS JOIN g LEFT JOIN a ON a.sample_id = s.sample_id AND a.gene = g.gene")
def io_mutations_filled(spark, sf):
    """Every sample and gene; without a mutation the smallest score."""
    genes = t(spark, sf, "lineitem").select(F.concat(F.lit("G"), "l_linenumber").alias("gene")).union(constants(spark, "gene", ("none",)))
    return readers.filled_scores(maf(spark, sf), genes).select("sample_id", "gene", r6("score", 4).alias("score"))


@query("SELECT round(l_extendedprice, 4) AS score FROM lineitem WHERE l_tax > 0 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag ORDER BY l_orderkey, l_partkey, l_extendedprice) = 1")
def io_mutation_scores(spark, sf):
    """Of rows that name one mutation the first in the file counts; those without score don't."""
    o = ["l_orderkey", "l_partkey", "l_extendedprice"]
    li = t(spark, sf, "lineitem").select(*o, F.concat_ws("\t", F.lit("g"), "l_suppkey", "l_linenumber", F.lit("e"), F.lit("x"), F.lit("y"), "l_returnflag", F.lit("T"), F.when(F.col("l_tax") > 0, F.col("l_extendedprice").cast("string")).otherwise("")).alias("value"))
    head = constants(spark, " ".join([*o, "value"]), (-1, -1, -1.0, "\t".join(["gene", "chr", "start", "end", "a", "b", "ref", "alt", "score"])))
    return readers.mutation_scores(spark, lines(spark, li.union(head), *o), "score").select(r6("score", 4).alias("score"))


@query("SELECT count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier")
def io_scores(spark, sf):
    s = t(spark, sf, "supplier").select(F.concat(F.lit(" "), F.col("s_acctbal").cast("string")).alias("value")).union(constants(spark, "value", ("score",), ("",)))
    return readers.scores(spark, lines(spark, s, "value")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score"), 2).alias("total"))


# --- networks and graphs


@query("SELECT DISTINCT 's' || l_suppkey AS gene1, 'p' || l_partkey AS gene2 FROM lineitem")
def io_pairs(spark, sf):
    """Two files of pairs that overlap."""
    pair = t(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), "l_quantity")
    one, two = (table(spark, pair.where(c).select("a", "b"), False) for c in ("l_quantity <= 30", "l_quantity > 20"))
    return readers.pairs(spark, one, two)


@query(f"WITH {CHAIN} SELECT '1' AS factor_id, (count(DISTINCT a) * count(DISTINCT b))::BIGINT AS n_cells, sum(v) AS total, 2 AS n_vars FROM f1 UNION ALL SELECT '2', (count(DISTINCT b) * count(DISTINCT c))::BIGINT, sum(v), 2 FROM f2")
def io_factor_graph(spark, sf):
    """A factor graph as XML."""
    path = folder(spark)
    factors, links, _ = chain(spark, sf)
    writers.factor_graph(factors, links, path, "xml")
    f, li = readers.factor_graph(spark, path, "xml")
    n = li.groupBy("factor_id").agg(F.count(F.lit(1)).cast("int").alias("n_vars"))
    return f.join(n, "factor_id").select("factor_id", F.size("values").cast("long").alias("n_cells"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total"), "n_vars")


@query("SELECT n_regionkey::VARCHAR AS graph_id, n_nationkey::BIGINT AS var_id, round(count(s_suppkey) / (count(s_suppkey) + 1), 6) AS p FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def io_factor_graphs(spark, sf):
    """Many graphs in one file, and what is inferred from it."""
    n = t(spark, sf, "nation").join(t(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey", "n_nationkey").agg(F.count("s_suppkey").cast("double").alias("k"))
    rows = n.select(F.col("n_regionkey").alias("graph_id"), F.concat(F.lit("f"), "n_nationkey").alias("factor_id"), F.array(F.col("n_nationkey").cast("long")).alias("var_ids"), F.array(F.lit(2)).alias("states"), F.array(F.col("k"), F.lit(1.0)).alias("values"))
    path = folder(spark)
    writers.factor_graphs(rows, path, 1)
    return kernel.marginals(readers.factor_graphs(spark, path)).where("state = 0").select("graph_id", "var_id", r6("p").alias("p"))


@query("SELECT n_nationkey::BIGINT AS rel_id, (n_nationkey + 1)::BIGINT AS output_var, n_nationkey::BIGINT AS input_var, n_regionkey = 1 AS negated, n_regionkey = 0 AS identical FROM nation")
def io_boolean_network(spark, sf):
    path = folder(spark)
    n, k = t(spark, sf, "nation"), F.col("n_nationkey").cast("long")
    writers.boolean_network(n.select(k.alias("var_id"), (F.col("n_regionkey") == 0).alias("identical")), n.select(k.alias("rel_id"), (k + 1).alias("output_var"), k.alias("input_var"), (F.col("n_regionkey") == 1).alias("negated")), path)
    v, i = readers.boolean_network(spark, path)
    return i.join(v.withColumnRenamed("var_id", "input_var"), "input_var").select("rel_id", "output_var", "input_var", "negated", "identical")


@query("SELECT n_name AS input, n_regionkey = 1 AS negated, r_name AS output FROM nation JOIN region ON r_regionkey = n_regionkey")
def io_toy_network(spark, sf):
    """Lines of influences, and others that are none."""
    n = regions(spark, sf).select(F.concat(F.when(F.col("n_regionkey") == 1, "!").otherwise(""), "n_name", F.lit("="), "r_name").alias("value"))
    return readers.toy_network(spark, lines(spark, n.union(constants(spark, "value", ("a remark",), ("",))), "value"))


@query("WITH e AS (SELECT s_name AS a, n_name AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey), c AS (SELECT b, count(*) AS n, least(b, min(a)) AS root FROM e GROUP BY b), m AS (SELECT b FROM c ORDER BY n DESC, root LIMIT 1) SELECT a AS gene1, b AS gene2 FROM e WHERE b IN (SELECT b FROM m)")
def io_largest_component(spark, sf):
    """The interactions of the largest component, written and read."""
    j = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    e = j.select(F.col("s_name").alias("gene1"), F.col("n_name").alias("gene2"), F.lit("ENCODE").alias("source"), F.lit("co-expression").alias("definition"))
    return readers.pairs(spark, table(spark, network.targets_of(e), False))


# --- lists and clusterings


@query("SELECT s_suppkey AS id FROM supplier")
def io_ids(spark, sf):
    s = t(spark, sf, "supplier").select(F.concat_ws("\t", "s_suppkey", "s_name").alias("value")).union(constants(spark, "value", ("id\tname",)))
    return readers.ids(spark, lines(spark, s, "value"))


@query("SELECT r_regionkey, r_name FROM region")
def io_entities(spark, sf):
    return readers.entities(spark, f"{sf}/region.parquet")


@query("SELECT n_regionkey + 1 AS cluster, n_name AS member FROM nation WHERE n_nationkey > 4")
def io_cluster_lines(spark, sf):
    """A line a cluster; members that aren't kept are left out."""
    n = t(spark, sf, "nation")
    rows = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\t").alias("value"))
    got = readers.cluster_lines(spark, lines(spark, rows, "n_regionkey"), n.where("n_nationkey > 4").select(F.col("n_name").alias("member")))
    return got.select(F.col("cluster").cast("int").alias("cluster"), "member")


@query("SELECT c_name AS member, c_nationkey AS cluster FROM customer")
def io_consensus_clusters(spark, sf):
    path = folder(spark)
    t(spark, sf, "customer").select("c_name", "c_nationkey").write.csv(path, quoteAll=True)
    return readers.consensus_clusters(spark, path)


@query("SELECT c_name AS member, c_nationkey AS cluster FROM customer WHERE c_acctbal > 0")
def io_node_clusters(spark, sf):
    """An attribute file as a clustering."""
    c = t(spark, sf, "customer")
    path = table(spark, writers.attributes(c.select(F.col("c_name").alias("member"), F.col("c_nationkey").alias("cluster"))), False)
    return readers.node_clusters(spark, path, c.where("c_acctbal > 0").select(F.col("c_name").alias("member"))).select("member", "cluster")


@query("SELECT n_regionkey AS cluster, n_name AS member FROM nation")
def io_modules(spark, sf):
    """Module text, in which a line names the module of the lines after it."""
    n = t(spark, sf, "nation")
    body = n.select("n_regionkey", (F.col("n_nationkey") + 3).alias("at"), F.col("n_name").alias("value"))
    r = n.select("n_regionkey").distinct()
    head = r.select("n_regionkey", F.lit(0).alias("at"), F.concat(F.lit("Nr of module: "), "n_regionkey").alias("value"))
    rest = r.select("n_regionkey", F.lit(1).alias("at"), F.lit("Rownames 5").alias("value")).union(r.select("n_regionkey", F.lit(99), F.lit("")))
    return readers.module_clusters(spark, lines(spark, head.union(rest).union(body), "n_regionkey", "at")).select("cluster", "member")


# --- drugs


@query("SELECT 'Drug_' || s_suppkey || '_IC50' AS key, s_name AS name FROM supplier WHERE s_acctbal > 0")
def io_drug_names(spark, sf):
    """Rows of four fields after the header."""
    s = t(spark, sf, "supplier").select("s_suppkey", F.concat_ws("\t", "s_suppkey", F.lit("x"), F.lit("y"), F.when(F.col("s_acctbal") > 0, F.col("s_name"))).alias("value"))
    return readers.drug_names(spark, lines(spark, s.union(constants(spark, "s_suppkey value", (F.lit(-1).cast("long"), "id\ta\tb\tname"))), "s_suppkey"))


@query("SELECT n_name AS drug, s_name AS target, round(s_acctbal, 2) AS weight FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def io_drug_targets(spark, sf):
    j = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return readers.drug_targets(spark, table(spark, j.select("n_name", "s_name", "s_acctbal"), False)).select("drug", "target", r6("weight", 2).alias("weight"))


@query("SELECT n_name AS drug, r_name AS pathway, round(n_nationkey / 7, 4) AS value FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey / 7 > 0.5")
def io_impact_results(spark, sf):
    """Impact results with their averages, as an edge list of the strong ones."""
    n = regions(spark, sf).select("n_name", "r_regionkey", "r_name", F.lit(1.0).alias("sum"), (F.col("n_nationkey") / 7).alias("average"), F.lit("a,b").alias("targets"))
    return writers.edge_list(readers.impact_results(spark, table(spark, n)), 0.5).select("drug", "pathway", r6("value", 4).alias("value"))


@query("SELECT DISTINCT c_mktsegment AS drug FROM customer")
def io_allowed_drugs(spark, sf):
    return readers.first_column(spark, table(spark, t(spark, sf, "customer").select("c_mktsegment", "c_custkey"), False))


# --- samples and logs


STATES = "s AS (SELECT c_nationkey AS k, c_mktsegment, CASE WHEN avg(c_acctbal) < 3500 THEN 0 WHEN avg(c_acctbal) < 5500 THEN 1 ELSE 2 END AS state FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL)"


def sampled(spark, sf) -> DataFrame:
    """Two variables of nations written with a third and their likelihoods, and read back."""
    name = F.when(F.col("c_mktsegment") == "BUILDING", "b_mRNA").otherwise("m_CNV")
    c = t(spark, sf, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").groupBy(F.col("c_nationkey").alias("sample_id"), name.alias("variable")).agg(F.avg("c_acctbal").alias("a"))
    c = cut(c.select("sample_id", "variable", F.when(F.col("a") < 3500, 0).when(F.col("a") < 5500, 1).otherwise(2).alias("state")), "states")
    likely = c.groupBy("sample_id").agg((-F.sum("state")).cast("double").alias("loglikelihood"))
    return readers.sampled_states(spark, table(spark, writers.sampled_states(c, likely, ["a_other", "b_mRNA", "m_CNV"])))


@query(f"WITH {STATES} SELECT k::VARCHAR AS sample_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'b_mRNA' ELSE 'm_CNV' END AS variable, state FROM s")
def io_sampled_states(spark, sf):
    return sampled(spark, sf).select("sample_id", "variable", "state")


@query(f"WITH {STATES} SELECT k::VARCHAR AS sample_id, min(state) AS type FROM s GROUP BY k HAVING count(*) = 2 AND min(state) = max(state) AND min(state) <> 1")
def io_sample_types(spark, sf):
    """Samples of which both variables are down, or both up."""
    return readers.sample_types(sampled(spark, sf), ["b_mRNA", "m_CNV"])


@query("SELECT n_name AS name, n_nationkey * 1.5::DOUBLE AS seconds FROM nation WHERE n_nationkey > 0 ORDER BY seconds DESC")
def io_log_seconds(spark, sf):
    n = t(spark, sf, "nation").where("n_nationkey > 0").select(F.concat("n_name", F.lit(": "), (F.col("n_nationkey") * 1.5).cast("string"), F.lit(" seconds")).alias("value"))
    return readers.log_seconds(spark, lines(spark, n.union(constants(spark, "value", ("started",))), "value")).select("name", F.col("seconds"))


@query("SELECT n_name AS name, round(n_nationkey / 8 + n_regionkey / 4, 4) AS total FROM nation")
def io_log_parameters(spark, sf):
    n = t(spark, sf, "nation").select(F.concat("n_name", F.lit(": ["), (F.col("n_nationkey") / 8).cast("string"), F.lit(", "), (F.col("n_regionkey") / 4).cast("string"), F.lit("]")).alias("value"))
    got = readers.log_parameters(spark, lines(spark, n.union(constants(spark, "value", ("started",))), "value"))
    return got.select("name", r6(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("SELECT r_name AS sample_id, n_name AS gene, n_nationkey::DOUBLE AS value FROM nation JOIN region ON r_regionkey = n_regionkey")
def io_sample_blocks(spark, sf):
    """Blocks of a sample's name, a header and rows."""
    n = regions(spark, sf)
    r = n.select("r_regionkey", "r_name").distinct()
    head = r.select("r_regionkey", F.lit(-2).alias("at"), F.concat(F.lit("Sample:"), "r_name").alias("value")).union(r.select("r_regionkey", F.lit(-1), F.lit("Genes\tx\tScore")))
    body = n.select("r_regionkey", "n_nationkey", F.concat_ws("\t", "n_name", F.lit("x"), "n_nationkey"))
    return readers.sample_blocks(spark, lines(spark, head.union(body), "r_regionkey", "at"), 2)


@query("SELECT s_nationkey::VARCHAR AS scenario_id, s_suppkey || chr(9) || s_nationkey || chr(9) || (s_nationkey + 1) AS line FROM supplier")
def io_attractors(spark, sf):
    """Lines of the attractor values of each variable."""
    s = t(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("scenario_id"), F.col("s_suppkey").alias("var_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t"), "s_nationkey")
    return writers.attractor_text(s.select("scenario_id", "var_id", "t", (F.col("s_nationkey") + F.col("t") - 1).alias("value"), (F.col("t") > 0).alias("in_attractor")))
