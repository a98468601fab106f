"""Connected components, cycles and closure over edge tables, as distributed fixpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.plans.checkpoint import cut, free


BROADCAST_EDGES = 100_000


def _state(e: DataFrame) -> tuple:
    return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*e.columns))).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root: the smallest node of its component.

    Alternating large-star and small-star contractions (Kiveris et al., 2014), as aggregates and joins. Self-loops,
    repeated edges and null ends are ignored.
    """
    a, b = edges.columns
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        now = _state(e)
        if not now[0] or now == before:
            break
        before = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        small_table = now[0] <= BROADCAST_EDGES  # then the edges of a hub needn't meet; beyond it the join splits hot keys
        large = both.where("v > u").join(F.broadcast(least) if small_table else least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        free(old)
    else:
        raise RuntimeError(f"no fixpoint within {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def linked_into_one(variables: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b) that join every component to the largest one (the smallest root on ties), through their smallest nodes.
    ``variables``: column node; nodes without an edge are components of their own."""
    c = components(edges)
    roots = variables.select("node").join(c, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    size = cut(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    main = F.lit(size.agg(F.min_by("root", F.struct(-F.col("n"), "root"))).first()[0]).cast(size.schema["root"].dataType)
    return size.where(F.col("root") != main).select(main.alias("a"), F.col("root").alias("b"))


def on_cycles(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node) of the vertices on a directed cycle, a self-loop included.

    Vertices without a way in or out are trimmed; then the smallest label that reaches a vertex colours it forward, and
    of each colour what also reaches its root backward is a strongly connected component, which is taken out. No
    quadratic closure is built.
    """
    a, b = edges.columns
    e = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("s"), F.col(b).alias("t")).distinct(), "cycles")
    found = e.where("s = t").select(F.col("s").alias("node"))
    e = cut(e.where("s != t"), "cycles")
    for _ in range(rounds):
        while True:  # trim
            n = e.count()
            old, e = e, cut(e.join(e.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(e.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t"), "cycles")
            free(old)
            if e.count() == n:
                break
        if not n:
            return found.distinct()
        color = cut(e.select(F.col("s").alias("node")).union(e.select("t")).distinct().withColumn("c", F.col("node")), "colors")
        before = None
        while before != (now := _state(color)):
            before = now
            got = e.join(color, e.s == color.node).groupBy(F.col("t").alias("node")).agg(F.min("c").alias("m"))
            old, color = color, cut(color.join(got, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c")), "colors")
            free(old)
        same = cut(e.join(color.select(F.col("node").alias("s"), F.col("c").alias("cs")), "s").join(color.select(F.col("node").alias("t"), F.col("c").alias("ct")), "t").where("cs = ct").select("s", "t", F.col("cs").alias("c")), "colors")
        back = cut(color.where("node = c").select("node"), "back")
        n_back = -1
        while n_back != (n_now := back.count()):
            n_back = n_now
            old, back = back, cut(back.union(same.join(back.select(F.col("node").alias("t")), "t", "left_semi").select(F.col("s").alias("node"))).distinct(), "back")
            free(old)
        scc = back.join(color, "node").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        in_cycle = back.join(color, "node").join(scc.where("n > 1"), "c").select("node")
        found = cut(found.union(in_cycle).distinct(), "found")
        e = cut(e.join(back.select(F.col("node").alias("s")), "s", "left_anti").join(back.select(F.col("node").alias("t")), "t", "left_anti").select("s", "t"), "cycles")
    raise RuntimeError(f"no fixpoint within {rounds} rounds")
