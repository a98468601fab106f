"""Gibbs sampling on graphs beyond a task: a colouring, then all variables of a colour are drawn at once.

Variables that share no factor are independent given the rest, so a colour is one step for all chains. Every draw is a hash of
seed, chain, sweep and variable: the same in any partitioning and after any lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.operators.belief import _log
from netquill.operators.factor_graph import with_strides
from netquill.plans.checkpoint import cut, free


def _first(left: DataFrame, variables: DataFrame, rank: Column, *by: str) -> DataFrame:
    """``variables`` (var_id, n: their factors) whose rank is the largest in all their factors (of those with the same ``by``): those
    that lead as many factors as they have."""
    led = left.groupBy("factor_id", *by).agg(F.max(rank).alias("top")).groupBy(F.col("top.var_id").alias("var_id")).agg(F.count(F.lit(1)).alias("led"))
    return led.join(variables, "var_id").where(F.col("led") == F.col("n")).select("var_id", *by)


def _free(variables: DataFrame, taken: DataFrame | None, nth: Column | int = 0) -> DataFrame:
    """``variables`` with a colour: of each variable's colours that aren't taken the one with ``nth`` before it."""
    nth = nth if isinstance(nth, Column) else F.lit(nth)
    if taken is None:
        return variables.select("*", nth.cast("int").alias("colour"))
    at = variables.join(taken.groupBy("var_id").agg(F.collect_set("colour").alias("seen")), "var_id", "left")
    seen = F.coalesce("seen", F.array().cast("array<int>"))
    return at.select(*variables.columns, F.get(F.array_except(F.sequence(F.lit(0), F.size(seen) + nth.cast("int")), seen), nth.cast("int")).alias("colour"))


def coloured(links: DataFrame, seed: int | None = 1, rounds: int = 1000) -> DataFrame:
    """(var_id, colour): variables of one factor have different colours. With a ``seed`` each variable tries a free colour, and of those
    that try the same one that comes first in all its factors takes it (compare Luby, 1986): by the powers of two in the number of
    factors, then by a hash that is new in each round. The colour tried is one of the first half of as many as a factor has variables
    left (of a pair: the first), so colours are at most one more than a variable's neighbours, and rounds are few whatever the degrees.
    Without a ``seed`` smaller identifiers come first (Jones and Plassmann, 1993), which gives the colours of going through them in
    order. Each round's colours are told to the uncoloured variables of their factors, once: only the largest rank and the colours of a
    factor are looked at, never pairs of its variables."""
    places = cut(links.select("factor_id", "var_id").distinct(), "places")
    sizes = lambda d: d.groupBy("factor_id").agg(F.count(F.lit(1)).alias("size"))
    pairs = seed is None or (sizes(places).agg(F.max("size")).first()[0] or 0) < 3
    left, done, taken, tried = places, None, None, None
    for k in range(rounds):
        variables = left.groupBy("var_id").agg(F.count(F.lit(1)).alias("n"))
        if seed is None:
            new = _free(_first(left, variables, F.struct(-F.col("var_id"), "var_id")), taken)
        else:
            if pairs:
                tried = _free(variables, taken)
            else:
                variables = left.join(sizes(left), "factor_id").groupBy("var_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
                tried = _free(variables, taken, F.pmod(F.xxhash64(F.lit(k), "var_id", F.lit(seed)), F.ceil(F.col("size") / 2)))
            tried = cut(tried.select("var_id", "n", "colour"), "tried")
            rank = F.struct(F.floor(F.log2("n")), F.xxhash64("var_id", F.lit(seed), F.lit(k)), "var_id")
            new = _first(left.join(tried, "var_id"), tried, rank, "colour")
        new = cut(new, "colours")
        rest = cut(left.join(new, "var_id", "left_anti"), "places")
        before, done = done, new if done is None else cut(done.union(new), "colours")
        if rest.isEmpty():
            return done
        told = rest.join(left.join(new, "var_id").select("factor_id", "colour"), "factor_id").select("var_id", "colour")
        told = (told if taken is None else told.union(taken.join(new, "var_id", "left_anti"))).distinct()
        old, taken = taken, cut(told, "taken")
        free(before, old, left, new if new is not done else None, tried)
        left = rest
    raise RuntimeError(f"variables without colour after {rounds} rounds")


def _unit(*what: Column) -> Column:
    """A hash between 0 and 1."""
    return (F.pmod(F.xxhash64(*what), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def gibbs(factors: DataFrame, links: DataFrame, chains: int = 100, sweeps: int = 20, burn_in: int = 10, seed: int = 1) -> DataFrame:
    """(chain, sweep, var_id, state) of the sweeps after ``burn_in``. A variable whose states are all impossible given the others
    keeps its state. Chains start with states drawn evenly."""
    places = cut(with_strides(links).select("factor_id", "var_id", "states", "stride"), "places")
    colours = cut(places.select("var_id", "states").distinct().join(coloured(links, seed), "var_id"), "colours")
    used = sorted(r[0] for r in colours.select("colour").distinct().collect())  # as many as a factor's neighbours, not as variables
    all_chains = factors.sparkSession.range(chains).select(F.col("id").alias("chain"))
    state = cut(colours.crossJoin(all_chains).select("chain", "var_id", F.floor(_unit(F.lit(seed), F.lit(-1), F.col("chain"), F.col("var_id")) * F.col("states")).cast("int").alias("state")), "states")
    kept = []
    for sweep in range(sweeps):
        for colour in used:
            mine = colours.where(F.col("colour") == colour).select("var_id")
            at = places.join(state, "var_id")
            others = at.groupBy("chain", "factor_id").agg(F.sum(F.col("state") * F.col("stride")).alias("all"))
            own = at.join(mine, "var_id", "left_semi").join(others, ["chain", "factor_id"])
            given = own.join(factors, "factor_id").select("chain", "var_id", "states", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("states") - 1), lambda s: F.get("values", (F.col("all") + (s - F.col("state")) * F.col("stride")).cast("int")))).alias("s", "val"))
            w = given.groupBy("chain", "var_id", "s").agg(F.sum((F.col("val") <= 0).cast("int")).alias("z"), F.sum(_log(F.col("val"))).alias("l"))
            cells = w.groupBy("chain", "var_id").agg(F.array_sort(F.collect_list(F.struct("s", F.when(F.col("z") == 0, F.col("l")).alias("l")))).alias("x"))  # a variable's states
            top = F.array_max(F.transform("x", lambda c: c["l"]))
            e = F.transform("x", lambda c: F.coalesce(F.exp(c["l"] - top), F.lit(0.0)))
            total = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
            aim = _unit(F.lit(seed), F.lit(sweep), F.col("chain"), F.col("var_id")) * total
            step = F.aggregate("e", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")), lambda a, b: F.struct((a["sum"] + b).alias("sum"), (a["at"] + (a["sum"] + b <= F.col("aim")).cast("int")).alias("at")))
            drawn = cells.withColumn("e", e).withColumn("aim", aim).where(total > 0).select("chain", "var_id", step["at"].alias("new"))
            new = cut(state.join(drawn, ["chain", "var_id"], "left").select("chain", "var_id", F.coalesce("new", "state").alias("state")), "states")
            if state not in kept:
                free(state)
            state = new
        if sweep >= burn_in:
            kept.append(state)
    out = None
    for k, s in enumerate(kept):
        one = s.select("chain", F.lit(burn_in + k).alias("sweep"), "var_id", "state")
        out = one if out is None else out.union(one)
    return out
