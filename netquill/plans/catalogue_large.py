"""Registered queries of what works on graphs beyond a task."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquill.operators import belief, learning, permutation, residual, sampling
from netquill.operators import relational as rel
from netquill.plans.catalogue_graphs import EM_SQL, EXACT, MARGINALS, table_of
from netquill.plans.checkpoint import cut
from netquill.plans.registry import CHAIN, FI, chain, constants, fi, query, r6, structs, t


def one_hot(state, states):
    return F.transform(F.sequence(F.lit(0), states - 1), lambda i: F.when(i == state, 1.0).otherwise(0.0))


@query(f"WITH {CHAIN} {MARGINALS}")
def residual_beliefs(spark, sf):
    """Beliefs of the chain when only messages that changed are sent, half of them at once."""
    factors, links, names = chain(spark, sf)
    b = residual.propagate(factors, links, tolerance=1e-8, seed=5)
    return b.variables.join(names, ["var_id", "state"]).select("var_id", "label", r6("p", 4).alias("p"))


@query(f"""WITH {CHAIN}, s AS (SELECT a AS sample, a AS sa, NULL AS sc FROM f1 GROUP BY a UNION ALL SELECT c, NULL, c FROM f2 GROUP BY c UNION ALL SELECT x.a || y.c, x.a, y.c FROM (SELECT DISTINCT a FROM f1) x, (SELECT DISTINCT c FROM f2) y),
w AS (SELECT sample, b, sum(v) AS v FROM s JOIN j ON (sa IS NULL OR j.a = sa) AND (sc IS NULL OR j.c = sc) GROUP BY ALL HAVING sum(v) > 0)
SELECT sample, b AS label, round(v / sum(v) OVER (PARTITION BY sample), 4) AS p FROM w""")
def residual_samples(spark, sf):
    """The priorities' beliefs for each status, each flag and each pair of both, all at once on one copy of the chain."""
    factors, links, names = chain(spark, sf)
    n = links.select("var_id", "states").distinct()
    hot = names.join(n, "var_id").select("var_id", "label", one_hot(F.col("state"), F.col("states")).alias("values"))
    first, last = hot.where("var_id = 1"), hot.where("var_id = 3")
    both = first.select(F.col("label").alias("x")).crossJoin(last.select(F.col("label").alias("y")))  # labels of two variables
    both = both.join(first, F.col("x") == F.col("label")).select("x", "y", "var_id", "values").union(both.join(last, F.col("y") == F.col("label")).select("x", "y", "var_id", "values"))
    evidence = first.union(last).select(F.col("label").alias("sample_id"), "var_id", "values").union(both.select(F.concat("x", "y"), "var_id", "values"))
    b = residual.propagate(factors, links, cut(evidence, "evidence"), tolerance=1e-8)
    return b.variables.where("var_id = 2 AND p > 0").join(names, ["var_id", "state"]).select(F.col("sample_id").alias("sample"), "label", r6("p", 4).alias("p"))


@query(EM_SQL)
def em_on_tables(spark, sf):
    """The table of priority given status from hundreds of samples on one graph, in a fixpoint over tables: the orders of each month,
    status and priority are a sample, with their number as its weight."""
    o = t(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("weight"))
    o = cut(o, "samples")
    s = cut(o.join(rel.dense_index(o, "o_orderpriority", "s"), "o_orderpriority").join(rel.dense_index(o, "o_orderstatus", "p"), "o_orderstatus"), "samples")
    n = s.agg((F.max("s") + 1).cast("int").alias("ns"), (F.max("p") + 1).cast("int").alias("np")).first()
    told = structs("var_id values", (F.lit(1).cast("long"), one_hot(F.col("s"), F.lit(n["ns"]))), (F.lit(2).cast("long"), one_hot(F.col("p"), F.lit(n["np"]))))
    evidence = cut(s.select(F.concat_ws("/", "month", "s", "p").alias("sample_id"), F.col("weight"), F.inline(told)), "evidence")
    factors = constants(spark, "factor_id group_id values", (1, F.lit(1).cast("long"), F.array_repeat(F.lit(1.0 / n["ns"]), n["ns"] * n["np"])))
    links = constants(spark, "factor_id pos var_id states", (1, 0, F.lit(1).cast("long"), n["ns"]), (1, 1, F.lit(2).cast("long"), n["np"]))
    return table_of(learning.learn_on_tables(cut(factors, "factors"), cut(links, "links"), evidence)[0])


@query(f"WITH {FI} SELECT gene1 AS gene, 0 AS colour FROM fi GROUP BY 1 UNION ALL SELECT gene2, 1 FROM fi GROUP BY 1")
def graph_colours(spark, sf):
    """Colours of suppliers and parts that share an edge, suppliers first."""
    e = cut(fi(spark, sf), "pairs")
    one, two = (cut(rel.dense_index(e.select(F.col(c).alias("gene")), "gene", "at"), "genes") for c in ("gene1", "gene2"))
    first = one.count()
    ends = e.join(one, F.col("gene1") == F.col("gene")).select("gene2", F.col("at").alias("x")).join(two, F.col("gene2") == F.col("gene")).select("x", (F.col("at") + first).alias("y"))
    links = ends.select((F.col("x") + F.col("y") * first).alias("factor_id"), F.explode(F.array("x", "y")).alias("var_id"))
    genes = one.select("gene", F.col("at").alias("var_id")).union(two.select("gene", F.col("at") + first))
    return sampling.coloured(links, seed=None).join(genes, "var_id").select("gene", "colour")


@query(f"WITH {FI} SELECT count(*) AS n_genes, count(*) AS n_coloured, 0 AS n_clashes FROM deg")
def graph_colours_seeded(spark, sf):
    """Colours by priorities that are hashes: all genes have one, and no edge has the same at both ends."""
    e = cut(fi(spark, sf), "pairs")
    genes = cut(rel.dense_index(e.select(F.col("gene1").alias("gene")).union(e.select("gene2")), "gene", "var_id"), "genes")
    ends = e.join(genes, F.col("gene1") == F.col("gene")).select("gene2", F.col("var_id").alias("x")).join(genes, F.col("gene2") == F.col("gene")).select("x", F.col("var_id").alias("y"))
    ends = cut(ends.withColumn("factor_id", F.col("x") * genes.count() + F.col("y")), "ends")
    c = cut(sampling.coloured(ends.select("factor_id", F.col("x").alias("var_id")).union(ends.select("factor_id", "y"))), "colours")
    clashes = ends.join(c.select(F.col("var_id").alias("x"), F.col("colour").alias("cx")), "x").join(c.select(F.col("var_id").alias("y"), F.col("colour").alias("cy")), "y").where("cx = cy")
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return n(genes, "n_genes").crossJoin(n(c, "n_coloured")).crossJoin(n(clashes, "n_clashes"))  # three single rows


@query(EXACT)
def gibbs_on_tables(spark, sf):
    """Marginals of draws from many chains over tables, all variables of a colour at once, against exact ones."""
    factors, links, names = chain(spark, sf)
    drawn = sampling.gibbs(factors, links, chains=3000, sweeps=5, burn_in=3)
    share = drawn.groupBy("var_id", "state").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / 6000.0)
    exact, _, _ = belief.propagate(factors, links)
    both = exact.select("var_id", "state", F.col("p").alias("want")).join(share, ["var_id", "state"], "left").join(names, ["var_id", "state"])
    return both.select("var_id", "label", (F.abs(F.coalesce("p", F.lit(0.0)) - F.col("want")) < 0.06).alias("close"))


@query(f"""WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
p AS (SELECT k.rep, c_custkey, c_nationkey, CASE k.rep WHEN 0 THEN {permutation.permuted_sql('c.i', 'c.n', 11)} ELSE {permutation.permuted_sql('c.i', 'c.n', 12)} END AS i FROM c, (VALUES (0), (1)) AS k(rep))
SELECT p.rep, p.c_custkey, c.c_mktsegment, p.c_nationkey FROM p JOIN c ON c.i = p.i""")
def shuffled_rows(spark, sf):
    """Customers with the segment of another one, twice; nations stay."""
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return permutation.shuffled(c, ["c_custkey"], ["c_mktsegment"], seed=11, times=2)
