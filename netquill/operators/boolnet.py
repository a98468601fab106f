"""Fuzzy Boolean networks: synchronous simulation, attractors, tracks and their comparison.

``variables``: var_id, identical BOOLEAN (use the identity instead of the transfer); ``inputs``: rel_id, output_var,
input_var, negated. ``scenarios``: scenario_id, var_id, stim, act, inh, init (nulls: not set). Values are kept between
0 and 1 by the update, not by clamping below.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.functions import scalar
from netquill.operators.components import on_cycles
from netquill.plans.checkpoint import cut

TOLERANCE = 1e-6
MOST_SENT = 200_000  # values that are sent to all inputs
MAX_INPUTS = 2_000_000  # of a network that is simulated in one task a scenario


def _hill(x: np.ndarray, n: float = 3.0, k: float = 0.5503, g: float = 1.0) -> np.ndarray:
    xn = x**n
    return g * (1 + k**n) * xn / (xn + k**n)


class Network:
    """Arrays of one network, for the kernel."""

    def __init__(self, variables: pd.DataFrame, inputs: pd.DataFrame):
        self.ids = np.sort(variables["var_id"].to_numpy(np.int64))
        self.identical = variables.sort_values("var_id")["identical"].fillna(False).to_numpy(bool)
        i = inputs.sort_values(["rel_id", "input_var"])
        self.rel, at = np.unique(i["rel_id"].to_numpy(np.int64), return_index=True)
        self.starts = at
        self.input = np.searchsorted(self.ids, i["input_var"].to_numpy(np.int64))
        self.negated = i["negated"].to_numpy(bool)
        self.output = np.searchsorted(self.ids, i["output_var"].to_numpy(np.int64)[at])
        size = np.diff(np.append(at, len(i)))
        self.damper = (size == 1) & self.negated[at] if len(i) else np.zeros(0, bool)
        self.driven = np.zeros(len(self.ids), bool)
        self.driven[self.output] = True

    def relations(self, x: np.ndarray, transfer: str, gate: str) -> np.ndarray:
        t = np.where(self.identical, x, _hill(x)) if transfer == "hill" else x
        v = t[self.input]
        v = np.where(self.negated, 1 - v, v)
        return (np.minimum if gate == "min" else np.multiply).reduceat(v, self.starts) if len(self.starts) else np.zeros(0)

    def simulate(self, stim, act, inh, init, default: float = 0.0, transfer: str = "hill", gate: str = "min", rounds: int = 100, keep_larger: bool = False) -> tuple[np.ndarray, int]:
        """(rows x variables, length of the attractor or 0 if none was reached). NaN: not set."""
        set_ = lambda a: ~np.isnan(a)

        def modify(x: np.ndarray, where: np.ndarray) -> np.ndarray:
            y = np.where(set_(inh), x * (1 - np.nan_to_num(inh)), np.where(set_(act), x * (1 + np.nan_to_num(act)), x))
            return np.where(where, np.minimum(y, 1.0), x)

        x = np.where(set_(stim), stim, np.where(set_(init), init, default))
        x = modify(x, ~self.driven)
        rows, most = [x], max(rounds, int(1.2 * len(self.ids)))
        for _ in range(most + 1):
            r = self.relations(x, transfer, gate)
            up = np.full(len(x), -np.inf)
            np.maximum.at(up, self.output[~self.damper], r[~self.damper])
            low = np.full(len(x), np.inf)
            np.minimum.at(low, self.output[self.damper], r[self.damper])
            y = np.where(np.isinf(up), x, up) * np.where(np.isinf(low), 1.0, low)
            y = np.where(self.driven, modify(y, self.driven), x)
            y = np.where(set_(stim), np.maximum(y, stim) if keep_larger else stim, y)
            rows.append(y)
            n = len(rows)
            same = np.abs(rows[-1] - rows[-2]).max(initial=0) <= TOLERANCE
            if same or (n % 2 and np.abs(rows[n // 2] - rows[-1]).max(initial=0) <= TOLERANCE):
                back = next(k for k in range(1, n) if np.abs(rows[-1 - k] - rows[-1]).max(initial=0) <= TOLERANCE)
                return np.array(rows), back
            x = y
        return np.array(rows), 0


def simulate(variables: DataFrame, inputs: DataFrame, scenarios: DataFrame, default: float = 0.0, transfer: str = "hill", gate: str = "min", rounds: int = 100, keep_larger: bool = False) -> DataFrame:
    """(scenario_id, var_id, t, value, in_attractor, reached): a track for each scenario, each in a task of its own group."""
    n = inputs.count()
    if n > MAX_INPUTS:
        raise ValueError(f"{n} inputs; simulate_table steps larger networks as tables")
    net = Network(variables.toPandas(), inputs.toPandas())  # MAX_INPUTS bounds it
    shared = scenarios.sparkSession.sparkContext.broadcast(net)
    kind = scenarios.schema["scenario_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        net = shared.value
        at = np.searchsorted(net.ids, pdf["var_id"].to_numpy(np.int64))
        ok = (at < len(net.ids)) & (net.ids[np.minimum(at, len(net.ids) - 1)] == pdf["var_id"].to_numpy(np.int64))  # unknown variables are ignored
        given = {}
        for c in ("stim", "act", "inh", "init"):
            given[c] = np.full(len(net.ids), np.nan)
            given[c][at[ok]] = pdf[c].to_numpy(float)[ok]
        rows, cycle = net.simulate(**given, default=default, transfer=transfer, gate=gate, rounds=rounds, keep_larger=keep_larger)
        t = np.repeat(np.arange(len(rows)), len(net.ids))
        return pd.DataFrame({"scenario_id": pdf["scenario_id"].iloc[0], "var_id": np.tile(net.ids, len(rows)), "t": t.astype(np.int32), "value": rows.reshape(-1), "in_attractor": t >= len(rows) - cycle, "reached": cycle > 0})

    return scenarios.groupBy("scenario_id").applyInPandas(run, f"scenario_id {kind}, var_id long, t int, value double, in_attractor boolean, reached boolean")


def relation_values(state: DataFrame, inputs: DataFrame, variables: DataFrame, transfer: str = "hill", gate: str = "min") -> DataFrame:
    """(scenario_id, rel_id, output_var, value, is_damper) of one step. state: scenario_id, var_id, value. Values of few variables go to
    where their inputs are, which may be any number."""
    x = F.col("value").cast("double")
    t = F.when(F.coalesce("identical", F.lit(False)), x).otherwise(scalar.hill(x)) if transfer == "hill" else x
    moved = state.join(variables.select("var_id", "identical"), "var_id").select("scenario_id", F.col("var_id").alias("input_var"), t.alias("t"))
    moved = cut(moved.join(inputs.select("input_var").distinct(), "input_var", "left_semi"), "inputs")
    moved = F.broadcast(moved) if moved.count() <= MOST_SENT else moved
    v = F.when(F.col("negated"), 1 - F.col("t")).otherwise(F.col("t"))
    merged = inputs.join(moved, "input_var").where("t IS NOT NULL").groupBy("scenario_id", "rel_id", "output_var")
    return merged.agg((F.min(v) if gate == "min" else F.product(v)).alias("value"), ((F.count(F.lit(1)) == 1) & F.bool_and("negated")).alias("is_damper"))


def step(state: DataFrame, inputs: DataFrame, variables: DataFrame, scenarios: DataFrame, transfer: str = "hill", gate: str = "min", keep_larger: bool = False) -> DataFrame:
    """The state after one synchronous step, as tables. A stimulus holds its variable, or with ``keep_larger`` is its least value."""
    r = relation_values(state, inputs, variables, transfer, gate)
    up = r.groupBy("scenario_id", F.col("output_var").alias("var_id")).agg(F.max(F.when(~F.col("is_damper"), F.col("value"))).alias("up"), F.min(F.when(F.col("is_damper"), F.col("value"))).alias("low"))
    s = state.join(up, ["scenario_id", "var_id"], "left").join(scenarios, ["scenario_id", "var_id"], "left")
    driven = F.col("up").isNotNull() | F.col("low").isNotNull()
    y = F.coalesce("up", "value") * F.coalesce("low", F.lit(1.0))
    y = F.when(driven, scalar.modified(y, F.col("inh"), F.col("act"))).otherwise(F.col("value"))
    return s.select("scenario_id", "var_id", (F.greatest("stim", y) if keep_larger else F.coalesce("stim", y)).alias("value"))


def _near(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``b`` whose values are all those of the scenario's state ``a``."""
    both = a.select("scenario_id", "var_id", F.col("value").alias("end")).join(b, ["scenario_id", "var_id"])
    return both.groupBy(*keys).agg(F.max(F.abs(F.col("value") - F.col("end"))).alias("far")).where(F.col("far") <= TOLERANCE).select(*keys)


def simulate_table(variables: DataFrame, inputs: DataFrame, scenarios: DataFrame, default: float = 0.0, transfer: str = "hill", gate: str = "min", rounds: int = 100, keep_larger: bool = False) -> DataFrame:
    """The rows of :func:`simulate` for a network too large for one task, stepped as tables. Each state is written once, with its
    step; a scenario is stepped until it reaches an attractor, which is found as :func:`simulate` finds it."""
    driven = inputs.select(F.col("output_var").alias("var_id"), F.lit(True).alias("driven")).distinct()
    grid = scenarios.select("scenario_id").distinct().crossJoin(variables.select("var_id")).join(scenarios, ["scenario_id", "var_id"], "left").join(driven, "var_id", "left")
    x = F.coalesce("stim", "init", F.lit(default)).cast("double")
    first = grid.select("scenario_id", "var_id", F.when(F.col("driven"), x).otherwise(scalar.modified(x, F.col("inh"), F.col("act"))).alias("value"), F.lit(0).alias("t"))
    states, ends = [cut(first, "bool")], None
    track = lambda: first.sparkSession.read.schema(states[0].schema).parquet(*(s._cut_path for s in states))
    for t in range(1, max(rounds, int(1.2 * variables.count())) + 2):
        live = states[-1] if ends is None else states[-1].join(ends, "scenario_id", "left_anti")
        new = cut(step(live.drop("t"), inputs, variables, scenarios, transfer, gate, keep_larger).withColumn("t", F.lit(t)), "bool")
        if new.isEmpty():
            break
        found = _near(new, states[-1], ["scenario_id"])
        found = found if t % 2 else found.union(_near(new, states[t // 2], ["scenario_id"]))
        found = cut(found.distinct(), "bool-found")
        if not found.isEmpty():
            back = _near(new.join(found, "scenario_id", "left_semi"), track(), ["scenario_id", "t"]).groupBy("scenario_id").agg(F.max("t").alias("again"))
            back = back.select("scenario_id", F.lit(t).alias("last"), "again")
            ends = cut(back if ends is None else ends.union(back), "bool-ends")
        states.append(new)
    out = track() if ends is None else track().join(ends, "scenario_id", "left")
    reached = F.lit(False) if ends is None else F.col("again").isNotNull()
    inside = F.lit(False) if ends is None else F.coalesce(F.col("t") > F.col("again"), F.lit(False))
    return out.select("scenario_id", "var_id", "t", "value", inside.alias("in_attractor"), reached.alias("reached"))


def expanded(track: DataFrame, length: int) -> DataFrame:
    """Tracks continued to ``length`` rows by repeating their attractor; longer ones stay."""
    last = track.groupBy("scenario_id").agg(F.max("t").alias("last"), (F.max(F.when(F.col("in_attractor"), F.col("t"))) - F.min(F.when(F.col("in_attractor"), F.col("t"))) + 1).alias("cycle"))
    loop = track.join(last, "scenario_id").where(F.col("in_attractor") & (F.col("last") + 1 < length))
    more = loop.withColumn("k", F.explode(F.sequence(F.lit(1), F.ceil((length - 1 - F.col("last")) / F.col("cycle")).cast("int"))))
    more = more.withColumn("t", (F.col("t") + F.col("k") * F.col("cycle")).cast("int")).where(F.col("t") < length)
    return track.unionByName(more.select(*track.columns))


def area(track: DataFrame) -> DataFrame:
    w = W.partitionBy("scenario_id", "var_id")
    t = track.select("scenario_id", "var_id", "t", "value", F.max("t").over(w).alias("last"))
    part = F.when((F.col("t") == 0) | (F.col("t") == F.col("last")), F.col("value") / 2).otherwise(F.col("value"))
    return t.groupBy("scenario_id", "var_id").agg(F.sum(part).alias("auc"))


def compared(base: DataFrame, perturbed: DataFrame, length: int, key: DataFrame | None = None) -> DataFrame:
    """(scenario_id, key, change): relative change of areas over ``length`` rows; perturbed scenarios against the one base
    scenario. ``key``: var_id, key; variables are compared by key, those without are dropped. No attractor: null."""
    names = key if key is not None else base.select("var_id", F.col("var_id").alias("key")).distinct()
    a = area(expanded(base, length).where(F.col("t") < length)).join(base.select("scenario_id", "reached").distinct(), "scenario_id").join(names, "var_id").where("key IS NOT NULL").select("key", F.col("auc").alias("b"), F.col("reached").alias("rb"))
    p = area(expanded(perturbed, length).where(F.col("t") < length)).join(perturbed.select("scenario_id", "reached").distinct(), "scenario_id").join(names, "var_id").where("key IS NOT NULL")
    return p.join(a, "key").select("scenario_id", "key", F.when(F.col("reached") & F.col("rb"), scalar.relative_change(F.col("auc"), F.col("b"))).alias("change"))


def converged_changes(base: DataFrame, perturbed: DataFrame, increase: int = 20, threshold: float = 1e-3, most: int = 1000, key: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Changes over longer and longer horizons until none moves by ``threshold``; (changes, horizon)."""
    horizon = 1 + max(base.agg(F.max("t")).first()[0] or 0, perturbed.agg(F.max("t")).first()[0] or 0)
    now = cut(compared(base, perturbed, horizon, key), "changes")
    while horizon + increase <= most:
        horizon += increase
        new = cut(compared(base, perturbed, horizon, key), "changes")
        moved = new.join(now.withColumnRenamed("change", "old"), ["scenario_id", "key"]).agg(F.max(F.abs(F.col("change") - F.col("old")))).first()[0]
        now = new
        if (moved or 0.0) < threshold:
            break
    return now, horizon


def initial_values(variables: DataFrame, inputs: DataFrame, default: float) -> DataFrame:
    """(var_id, init): ``default`` for those without relation into them and for named ones on a cycle, else 0.
    variables: var_id, source_id (null: accessory)."""
    cyc = on_cycles(inputs.select("input_var", "output_var")).withColumnRenamed("node", "var_id").withColumn("on", F.lit(True))
    driven = inputs.select(F.col("output_var").alias("var_id"), F.lit(True).alias("driven")).distinct()
    v = variables.select("var_id", "source_id").join(cyc, "var_id", "left").join(driven, "var_id", "left")
    return v.select("var_id", F.when(F.col("driven").isNull() | (F.col("on").isNotNull() & F.col("source_id").isNotNull()), F.lit(default)).otherwise(0.0).alias("init"))


def named_stimuli(variables: DataFrame, stimuli: DataFrame) -> DataFrame:
    """(scenario_id, var_id, stim, act, inh, init) of stimuli by name: scenario_id, name, stim. Unknown names are ignored; a name
    of several variables raises."""
    n = variables.groupBy("name").agg(F.min("var_id").alias("var_id"), F.count(F.lit(1)).alias("n"))
    one = F.when(F.col("n") > 1, F.raise_error(F.lit("several variables have one name"))).otherwise(F.col("var_id"))
    none = F.lit(None).cast("double")
    return stimuli.join(n, "name").select("scenario_id", one.cast("long").alias("var_id"), F.col("stim").cast("double").alias("stim"), none.alias("act"), none.alias("inh"), none.alias("init"))


def attractor_ratios(base: DataFrame, perturbed: DataFrame, names: DataFrame) -> DataFrame:
    """(name, ratio) of the first attractor values, without outputs and what didn't change."""
    first = lambda d: d.where("in_attractor").groupBy("var_id").agg(F.min_by("value", "t").alias("v"))
    r = first(perturbed).withColumnRenamed("v", "p").join(first(base), "var_id").join(names, "var_id")
    ratio = F.try_divide(F.col("p"), F.col("v"))
    return r.where(~F.col("name").contains("_output") & (F.abs(ratio - 1) >= 1e-6)).select("name", ratio.alias("ratio"))
