"""Loopy belief propagation on one large factor graph, as a fixpoint over tables.

Flooding schedule: in each sweep all variables send, then all factors. Products are sums of logarithms with the zeros
counted apart, so dividing out a message is exact. Each sweep is written to the shared folder. On a tree the result is
exact after as many sweeps as the tree is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.operators.factor_graph import cell_states
from netquill.plans.checkpoint import cut, free


class NotConverged(RuntimeError):
    """The messages keep rising instead of settling."""


def _log(p: Column) -> Column:
    return F.when(p > 0, F.log(F.when(p > 0, p))).otherwise(0.0)


def _normal(df: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """Rows (keys, state, z, l) -> p: exp(l) where nothing is zero, scaled to a sum of one for each key. A key has a few states,
    so its rows are one small window."""
    w = W.partitionBy(*keys)
    live = F.when(F.col("z") == 0, F.col("l"))
    e = df.withColumn("top", F.max(live).over(w)).withColumn("e", F.coalesce(F.exp(live - F.col("top")), F.lit(0.0)))
    return e.select(*keys, state, F.coalesce(F.try_divide("e", F.sum("e").over(w)), F.lit(0.0)).alias("p"))


def propagate(factors: DataFrame, links: DataFrame, tolerance: float = 1e-6, sweeps: int = 10_000, maximise: bool = False, damping: float = 0.0) -> tuple[DataFrame, DataFrame, int]:
    """(variable beliefs: var_id, state, p; cell beliefs: factor_id, idx, p; number of sweeps)."""
    cs = cut(cell_states(factors, links), "cells")
    edge = cut(cs.select("factor_id", "var_id", "state").distinct(), "edges")
    f2v = edge.withColumn("p", F.lit(1.0))
    differences: list[float] = []
    v2f, kept = f2v, []  # the last two sweeps' messages: beliefs of cells come from those before the last
    for sweep in range(1, sweeps + 1):
        m = f2v.select("factor_id", "var_id", "state", (F.col("p") <= 0).cast("int").alias("z"), _log(F.col("p")).alias("l"))
        total = m.groupBy("var_id", "state").agg(F.sum("z").alias("tz"), F.sum("l").alias("tl"))
        others = m.join(total, ["var_id", "state"]).select("factor_id", "var_id", "state", (F.col("tz") - F.col("z")).alias("z"), (F.col("tl") - F.col("l")).alias("l"))
        v2f = _normal(others, ["factor_id", "var_id"])
        into = cs.join(v2f, ["factor_id", "var_id", "state"]).select("factor_id", "idx", "var_id", "state", "val", (F.col("p") <= 0).cast("int").alias("z"), _log(F.col("p")).alias("l"))
        whole = into.groupBy("factor_id", "idx").agg(F.sum("z").alias("tz"), F.sum("l").alias("tl"))
        w = into.join(whole, ["factor_id", "idx"]).where("val > 0 AND tz - z = 0").select("factor_id", "var_id", "state", (F.log("val") + F.col("tl") - F.col("l")).alias("w"))
        gather, message = (F.max if maximise else F.sum), W.partitionBy("factor_id", "var_id")
        sums = w.withColumn("top", F.max("w").over(message)).groupBy("factor_id", "var_id", "state").agg(gather(F.exp(F.col("w") - F.col("top"))).alias("s"))
        sums = sums.withColumn("t", F.sum("s").over(message))
        sent = edge.join(sums, ["factor_id", "var_id", "state"], "left").select("factor_id", "var_id", "state", F.coalesce(F.try_divide("s", "t"), F.lit(0.0)).alias("p"))
        old = f2v.withColumnRenamed("p", "old")
        seen = Observation()  # the largest change is seen while the messages are written; a task that runs again can't change it
        changed = sent.join(old, ["factor_id", "var_id", "state"]).select("factor_id", "var_id", "state", (F.col("p") * (1 - damping) + F.col("old") * damping).alias("p"), F.abs(F.col("p") - F.col("old")).alias("change"))
        new = cut(changed.observe(seen, F.max("change").alias("most")).drop("change"), "f2v")
        differences.append(seen.get["most"] or 0.0)
        f2v = new
        kept.append(new)
        free(*kept[:-2])
        if differences[-1] <= tolerance:
            break
        if sweep >= 50 and sum(b > a for a, b in zip(differences, differences[1:], strict=False)) >= 10:
            raise NotConverged(f"the largest change rose 10 times within {sweep} sweeps")
    belief = f2v.groupBy("var_id", "state").agg(F.sum((F.col("p") <= 0).cast("int")).alias("z"), F.sum(_log(F.col("p"))).alias("l"))
    var_beliefs = cut(_normal(belief, ["var_id"]), "beliefs")
    into = cs.join(v2f, ["factor_id", "var_id", "state"]).groupBy("factor_id", "idx", "val").agg(F.sum((F.col("p") <= 0).cast("int")).alias("z"), F.sum(_log(F.col("p"))).alias("l"))
    joint = into.select("factor_id", "idx", (F.col("z") + (F.col("val") <= 0).cast("int")).alias("z"), (F.col("l") + _log(F.col("val"))).alias("l"))
    return var_beliefs, cut(_normal(joint, ["factor_id"], "idx"), "beliefs"), len(differences)


def decoded(var_beliefs: DataFrame, tie: float = 1e-9) -> DataFrame:
    """(var_id, state, ambiguous): the most probable state, the smallest on a tie, which is flagged."""
    best = var_beliefs.groupBy("var_id").agg(F.max("p").alias("top"))
    near = var_beliefs.join(best, "var_id").where(F.col("p") >= F.col("top") - tie)
    return near.groupBy("var_id").agg(F.min("state").alias("state"), (F.count(F.lit(1)) > 1).alias("ambiguous"))
