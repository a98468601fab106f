"""The registry of the engine's queries over the driver's tables, and the tables that several of them use.

The tables aren't biological, so each operator runs on tables of the same shape: samples are users or customers, genes
brands or event types, data types event types, network pairs (supplier, part) or nations, tracks a user's events in time.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.plans.checkpoint import cut, shared_root
from netquill.session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL for the same rows where there is some."""

    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return f(spark, sf)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    spread(spark, path)
    return spark.read.parquet(path)


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("data_type"), "value", "ts", "event_id")


def r6(c, n: int = 6):
    return F.round(c, n)


def structs(names: str, *rows: tuple):
    """An array of structs with the given field names; values are columns or constants."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.array(*(F.struct(*(col(v).alias(n) for n, v in zip(names.split(), r, strict=True))) for r in rows))


def constants(spark: SparkSession, names: str, *rows: tuple) -> DataFrame:
    """A small fixed table."""
    return spark.range(1).select(F.inline(structs(names, *rows)))


def folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder, for files that are written and read back."""
    return f"{shared_root(spark)}/netquill-files-{uuid.uuid4().hex}"


def fi_lines(spark, sf) -> DataFrame:
    """The pairs of :func:`fi`, which may repeat."""
    li = t(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("gene1"), F.concat(F.lit("p"), "l_partkey").alias("gene2"))


def fi(spark, sf) -> DataFrame:
    return fi_lines(spark, sf).distinct()


FI = "fi AS (SELECT DISTINCT 's' || l_suppkey AS gene1, 'p' || l_partkey AS gene2 FROM lineitem), b AS (SELECT gene1 AS gene, gene2 AS other FROM fi UNION SELECT gene2, gene1 FROM fi), deg AS (SELECT gene, count(DISTINCT other) AS d FROM b GROUP BY gene)"


# --- a factor graph: order status -> priority -> return flag, a chain of two pairwise factors


CHAIN = """f1 AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS v FROM orders GROUP BY ALL),
f2 AS (SELECT o_orderpriority AS b, l_returnflag AS c, count(*)::DOUBLE AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
j AS (SELECT a, f1.b, c, f1.v * f2.v AS v FROM f1 JOIN f2 ON f1.b = f2.b)"""


def chain(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(factors, links, names) of the chain; names: var_id, state, label."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    f1 = o.groupBy(F.col("o_orderstatus").alias("x"), F.col("o_orderpriority").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    f2 = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_orderpriority").alias("x"), F.col("l_returnflag").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    counts = cut(f1.select(F.lit(1).alias("factor_id"), "x", "y", "v").union(f2.select(F.lit(2), "x", "y", "v")), "chain")
    label = counts.where("factor_id = 1").select(F.lit(1).alias("var_id"), F.col("x").alias("label")).union(counts.select(F.lit(2), F.when(F.col("factor_id") == 1, F.col("y")).otherwise(F.col("x")))).union(counts.where("factor_id = 2").select(F.lit(3), "y"))
    names = cut(label.distinct().withColumn("state", F.dense_rank().over(W.partitionBy("var_id").orderBy("label")) - 1), "chain")
    n = names.groupBy("var_id").agg(F.count(F.lit(1)).cast("int").alias("states"))
    links = cut(n.where("var_id < 3").select(F.col("var_id").alias("factor_id"), F.lit(0).alias("pos"), "var_id", "states").union(n.where("var_id > 1").select(F.col("var_id") - 1, F.lit(1), "var_id", "states")), "chain")
    sides = counts.join(names.select((F.col("var_id")).alias("factor_id"), F.col("label").alias("x"), F.col("state").alias("sx")), ["factor_id", "x"]).join(names.select((F.col("var_id") - 1).alias("factor_id"), F.col("label").alias("y"), F.col("state").alias("sy")), ["factor_id", "y"])
    size = links.groupBy("factor_id").agg(F.max(F.when(F.col("pos") == 0, F.col("states"))).alias("n0"), F.product("states").cast("int").alias("size"))
    grid = size.select("factor_id", "n0", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("idx"))
    cells = grid.join(sides, (grid.factor_id == sides.factor_id) & (F.col("idx") == F.col("sx") + F.col("sy") * F.col("n0")), "left").select(grid.factor_id, "idx", F.coalesce("v", F.lit(0.0)).alias("v"))
    factors = cells.groupBy("factor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda c: c["v"]).alias("values"))
    return cut(factors, "chain"), links, names


def vectors(factors: DataFrame, links: DataFrame, graph=1) -> DataFrame:
    """Kernel rows (graph_id, factor_id, var_ids, states, values)."""
    v = links.groupBy("factor_id").agg(F.array_sort(F.collect_list(F.struct("pos", "var_id", "states"))).alias("x"))
    return v.join(factors, "factor_id").select(F.lit(graph).alias("graph_id"), F.col("factor_id").cast("string").alias("factor_id"), F.transform("x", lambda x: x["var_id"].cast("long")).alias("var_ids"), F.transform("x", lambda x: x["states"].cast("int")).alias("states"), "values")
