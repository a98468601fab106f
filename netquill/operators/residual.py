"""Belief propagation over tables for many samples of one large graph, sending only what changed.

A sample has its own evidence and its own messages; the graph is one table that isn't copied. The state is a table of the
messages to variables and one of their sums at each variable, so a round touches only the factors that heard of a change:

1. The affected (sample, factor) pairs' messages are worked out anew from the sums, each without the receiver's own share.
2. A message whose change exceeds the tolerance is pending. All pending ones are sent, or with a ``seed`` half of those
   that come near to their sample's largest change, chosen by a hash of the message and the round: so neighbours seldom
   move at once and what swings when everything is sent together settles.
3. What is sent is a delta table: it is merged into the messages, its logarithms are added to the sums, and the other
   factors of its variables are affected next. Samples without pending messages are settled and leave the state.

Products are sums of logarithms with zeros counted apart. A round is written to the shared folder. The cells of a factor
and sample are one group (its table is a value of one row, so it is bounded); a variable's messages are only ever summed
by partial aggregates. Messages are samples times links by nature; nothing else is.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.operators.belief import NotConverged, _log, _normal
from netquill.operators.factor_graph import cell_states
from netquill.plans.checkpoint import cut, free

BROADCAST_ROWS = 200_000  # of a side that is counted first
EDGE = ["sample_id", "factor_id", "var_id"]


def _small(t: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(t) if rows <= BROADCAST_ROWS else t


def _shared(t: DataFrame) -> DataFrame:
    return _small(t, t.count())


def _seen(t: DataFrame, name: str, *what: Column) -> tuple[DataFrame, list]:
    """``t`` written, and aggregates of its rows seen meanwhile; a task that runs again can't change a maximum, and counts come
    from the tasks that count."""
    seen = Observation()
    out = cut(t.observe(seen, *(w.alias(f"x{k}") for k, w in enumerate(what))), name)
    return out, [seen.get[f"x{k}"] for k in range(len(what))]


@dataclasses.dataclass
class Beliefs:
    variables: DataFrame  # sample_id, var_id, state, p
    cells: DataFrame  # sample_id, factor_id, idx, p
    sums: DataFrame  # sample_id, var_id, state, z, l: evidence and messages of each variable
    rounds: int
    messages: int  # sent, of all rounds and samples


def _zero(p: Column | str) -> Column:
    return (F.col(p) <= 0 if isinstance(p, str) else p <= 0).cast("int")


def _heard(messages: DataFrame, sums: DataFrame, cells: DataFrame) -> DataFrame:
    """(sample, factor, idx, val, var, state, z, l, old): what each variable tells a factor about each of its cells."""
    told = messages.join(sums, ["sample_id", "var_id", "state"]).select("sample_id", "factor_id", "var_id", "state", (F.col("z") - _zero("p")).alias("z"), (F.col("l") - _log(F.col("p"))).alias("l"), F.col("p").alias("old"))
    return told.join(cells, ["factor_id", "var_id", "state"])


def _answers(heard: DataFrame, maximise: bool) -> DataFrame:
    """(sample, factor, var, state, p, old, change): the messages of factors, dealt by sample and factor once."""
    whole, to = W.partitionBy("sample_id", "factor_id", "idx"), W.partitionBy(*EDGE)
    h = heard.repartition("sample_id", "factor_id").withColumn("tz", F.sum("z").over(whole)).withColumn("tl", F.sum("l").over(whole))
    w = F.when((F.col("val") > 0) & (F.col("tz") == F.col("z")), _log(F.col("val")) + F.col("tl") - F.col("l"))
    h = h.withColumn("w", w).withColumn("top", F.max("w").over(to))
    gather = F.max if maximise else F.sum
    s = h.groupBy(*EDGE, "state").agg(F.coalesce(gather(F.exp(F.col("w") - F.col("top"))), F.lit(0.0)).alias("s"), F.first("old").alias("old"))
    p = s.withColumn("p", F.coalesce(F.try_divide("s", F.sum("s").over(to)), F.lit(0.0)))
    return p.select(*EDGE, "state", "p", "old", F.max(F.abs(F.col("p") - F.col("old"))).over(to).alias("change"))


def propagate(factors: DataFrame, links: DataFrame, evidence: DataFrame | None = None, tolerance: float = 1e-6, rounds: int = 10_000, maximise: bool = False, seed: int | None = None) -> Beliefs:
    """The beliefs of every sample. ``evidence``: sample_id, var_id, values ARRAY<DOUBLE> of the variable's states, which may have
    several rows for a variable; a sample with null var_id has none. Without evidence there is one sample, 0. Unknown variables
    are ignored; contradictory evidence leaves a variable without belief (all 0). Raises :class:`NotConverged` when pending
    changes keep rising or ``rounds`` are over."""
    cells = cut(cell_states(factors, links), "cells")
    edges = cells.select("factor_id", "var_id", "state").distinct()
    edges = cut(edges.withColumn("p", 1.0 / F.count(F.lit(1)).over(W.partitionBy("factor_id", "var_id"))), "edges")
    where = edges.select("factor_id", "var_id").distinct()
    if evidence is None:
        evidence = factors.sparkSession.range(1).select(F.col("id").alias("sample_id"), F.lit(None).cast("long").alias("var_id"), F.lit(None).cast("array<double>").alias("values"))
    samples = cut(evidence.select("sample_id").distinct(), "samples")
    said = evidence.where("var_id IS NOT NULL").select("sample_id", "var_id", F.posexplode("values").alias("state", "p"))
    said = said.select("sample_id", "var_id", "state", _zero("p").alias("z"), _log(F.col("p")).alias("l"))
    states = edges.select("var_id", "state").distinct().crossJoin(samples)  # samples times the graph: the size of the beliefs themselves
    sums = cut(states.select("sample_id", "var_id", "state", F.lit(0).alias("z"), F.lit(0.0).alias("l")).union(said.join(edges.select("var_id", "state").distinct(), ["var_id", "state"], "left_semi").select("sample_id", "var_id", "state", "z", "l")).groupBy("sample_id", "var_id", "state").agg(F.sum("z").alias("z"), F.sum("l").alias("l")), "sums")
    messages = cut(edges.crossJoin(samples).select(*EDGE, "state", "p"), "messages")
    few_cells, n_samples = _shared(cells), samples.count()
    affected = pending = None
    n_affected = 0
    done: list[tuple[DataFrame, DataFrame]] = []
    sent_total, changes = 0, []
    for number in range(1, rounds + 1):
        asked = messages if affected is None else messages.join(_small(affected, n_affected), ["sample_id", "factor_id"], "left_semi")
        answers = _answers(_heard(asked, sums, few_cells), maximise).where(F.col("change") > tolerance)
        if pending is not None:
            answers = pending.join(_small(affected, n_affected), ["sample_id", "factor_id"], "left_anti").unionByName(answers)
        fresh, (most, n_sent, n_rows) = _seen(answers, "pending", F.max("change"), F.count_if(F.col("state") == 0), F.count(F.lit(1)))
        changes.append(most or 0.0)
        free(pending, affected)
        if not n_rows:
            done.append((messages, sums))
            break
        if seed is None:
            if number >= 50 and sum(b > a for a, b in zip(changes, changes[1:], strict=False)) >= 10:
                raise NotConverged(f"the largest change rose 10 times within {number} rounds")
            sent, pending = fresh, None
        else:
            top = fresh.groupBy("sample_id").agg(F.max("change").alias("most"))
            coin = F.pmod(F.xxhash64(*EDGE, F.lit(number), F.lit(seed)), F.lit(2)) == 0
            sent, (n_sent, n_rows) = _seen(fresh.join(top, "sample_id").where(coin & (F.col("change") * 2 >= F.col("most"))).drop("most"), "sent", F.count_if(F.col("state") == 0), F.count(F.lit(1)))
            pending = cut(fresh.join(_small(sent.select(*EDGE, "state"), n_rows), [*EDGE, "state"], "left_anti"), "pending")
            free(fresh)
        sent_total += n_sent
        if n_samples > 1:  # samples without anything pending are settled
            live = sent.select("sample_id") if pending is None else sent.select("sample_id").union(pending.select("sample_id"))
            live, (n_live,) = _seen(live.distinct(), "live", F.count(F.lit(1)))
            if n_live < n_samples:
                some, n_samples = _small(live, n_live), n_live
                done.append((cut(messages.join(some, "sample_id", "left_anti"), "settled"), cut(sums.join(some, "sample_id", "left_anti"), "settled")))
                before, messages, sums = (messages, sums), cut(messages.join(some, "sample_id", "left_semi"), "messages"), cut(sums.join(some, "sample_id", "left_semi"), "sums")
                free(*before)
            free(live)
        told = sent.where("state = 0").groupBy("sample_id", "var_id").agg(F.count(F.lit(1)).alias("n"), F.min("factor_id").alias("only"))
        affected, (n_affected,) = _seen(told.join(where, "var_id").where((F.col("n") > 1) | (F.col("factor_id") != F.col("only"))).select("sample_id", "factor_id").distinct(), "affected", F.count(F.lit(1)))
        before = (messages, sums)
        delta = _small(sent.select(*EDGE, "state", F.col("p").alias("new")), n_rows)
        messages = cut(messages.join(delta, [*EDGE, "state"], "left").select(*EDGE, "state", F.coalesce("new", "p").alias("p")), "messages")
        gained = sent.groupBy("sample_id", "var_id", "state").agg(F.sum(_zero("p") - _zero("old")).alias("dz"), F.sum(_log(F.col("p")) - _log(F.col("old"))).alias("dl"))
        sums = cut(sums.join(_small(gained, n_rows), ["sample_id", "var_id", "state"], "left").select("sample_id", "var_id", "state", (F.col("z") + F.coalesce("dz", F.lit(0))).alias("z"), (F.col("l") + F.coalesce("dl", F.lit(0.0))).alias("l")), "sums")
        free(*before, sent)
    else:
        raise NotConverged(f"changes are pending after {rounds} rounds")
    messages, sums = done[0]
    for m, s in done[1:]:
        messages, sums = messages.unionByName(m), sums.unionByName(s)
    into = _heard(messages, sums, few_cells).groupBy("sample_id", "factor_id", "idx", "val").agg(F.sum("z").alias("z"), F.sum("l").alias("l"))
    joint = into.select("sample_id", "factor_id", "idx", (F.col("z") + _zero("val")).alias("z"), (F.col("l") + _log(F.col("val"))).alias("l"))
    of_cells = cut(_normal(joint, ["sample_id", "factor_id"], "idx"), "beliefs")
    return Beliefs(cut(_normal(sums, ["sample_id", "var_id"]), "beliefs"), of_cells, sums, number, sent_total)


def log_z(factors: DataFrame, links: DataFrame, beliefs: Beliefs, evidence: DataFrame | None = None) -> DataFrame:
    """(sample_id, log_z): the Bethe value, evidence included; minus infinity for impossible evidence, exact on a tree."""
    degree = links.groupBy("var_id").agg(F.count_distinct("factor_id").alias("d"))
    entropy = beliefs.variables.join(degree, "var_id").where("p > 0").select("sample_id", ((F.col("d") - 1) * F.col("p") * F.log("p")).alias("x"))
    energy = beliefs.cells.join(factors.select("factor_id", F.posexplode("values").alias("idx", "val")), ["factor_id", "idx"]).where("p > 0 AND val > 0").select("sample_id", (F.col("p") * (F.log("val") - F.log("p"))).alias("x"))
    parts = entropy.union(energy)
    if evidence is not None:
        said = evidence.where("var_id IS NOT NULL").select("sample_id", "var_id", F.posexplode("values").alias("state", "v"))
        parts = parts.union(said.join(beliefs.variables, ["sample_id", "var_id", "state"]).where("p > 0 AND v > 0").select("sample_id", (F.col("p") * F.log("v")).alias("x")))
    none = beliefs.cells.groupBy("sample_id", "factor_id").agg(F.sum("p").alias("t")).where("t = 0").select("sample_id").distinct()
    impossible = none.select("sample_id", F.lit(float("-inf")).alias("x"))
    return parts.union(impossible).groupBy("sample_id").agg(F.sum("x").alias("log_z"))
