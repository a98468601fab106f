"""Scalar functions of the inference engine, each a pure Column expression that stays inside generated code.

Null in, null out unless said otherwise. Division and logarithms never raise under ANSI mode.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interaction types that activate their target; all others inhibit it.
ACTIVATING = ("ACTIVATOR", "AGONIST", "FULL AGONIST", "PARTIAL AGONIST", "POSITIVE ALLOSTERIC MODULATOR", "POSITIVE MODULATOR", "SUBSTRATE")
# Weight of each data type's digit in an observation key.
KEY_STRIDE = {"CNV": 1, "mRNA_EXP": 10, "Methylation": 100, "miRNA": 1000, "Mutation": 10000}


def _d(x) -> Column:
    return F.lit(float(x))


def hill(x: Column, n: float = 3.0, k: float = 0.5503, g: float = 1.0) -> Column:
    """Saturating transfer g (1 + k^n) x^n / (x^n + k^n)."""
    xn = F.pow(x, _d(n))
    return _d(g) * (1 + _d(k**n)) * xn / (xn + _d(k**n))


def identity(x: Column) -> Column:
    return x.cast("double")


def discretize(x: Column, thresholds: list[float], states: int | None = None) -> Column:
    """Index of the first threshold above ``x``, or their number. Two states over two thresholds: 0 in the middle, 1 in both tails."""
    states = len(thresholds) + 1 if states is None else states
    if states == 2 and len(thresholds) == 2:
        return F.when(x.isNull(), None).when((x >= thresholds[0]) & (x < thresholds[1]), 0).otherwise(1)
    if states != len(thresholds) + 1:
        raise ValueError(f"{len(thresholds)} thresholds can't make {states} states")
    out = F.when(x.isNull(), None)
    for i, t in enumerate(thresholds):
        out = out.when(x < t, i)
    return out.otherwise(len(thresholds))


def log_ratio(prior: Column, posterior: Column) -> Column:
    """log10 of the odds ratio of posterior and prior, the ratio kept within [-1022, 1023]; a ratio of 0 gives -infinity,
    a prior of 0 or a posterior of 1 the cap."""
    up, down, nan = posterior * (1 - prior), (1 - posterior) * prior, F.lit(float("nan"))
    ratio = F.when(down == 0, 1023.0).otherwise(F.least(F.greatest(F.try_divide(up, down), _d(-1022)), _d(1023)))
    undefined = ((up == 0) & (down == 0)) | F.isnan(up) | F.isnan(down)
    return F.when(undefined, nan).when(ratio <= 0, F.lit(float("-inf"))).otherwise(F.log10(F.when(ratio > 0, ratio)))


def ipa(priors: list[Column], posteriors: list[Column]) -> Column:
    """Signed activity from the log ratios of the states down, normal, up; 0 on ties and with fewer than three states."""
    if len(priors) < 3:
        return _d(0)
    down, normal, up = (log_ratio(a, b) for a, b in zip(priors[:3], posteriors[:3], strict=True))
    return F.when((up > down) & (up > normal), up).when((down > up) & (down > normal), -down).otherwise(_d(0))


def empirical_marginal(cdf: Column, states: int, two_sided: bool) -> Column:
    """Array of state probabilities from a cumulative probability; no observation gives all ones."""
    if two_sided and states == 2:
        c = F.when(cdf > 0.5, 1 - cdf).otherwise(cdf)
        out = F.array(2 * c, 1 - 2 * c)
    elif two_sided and states == 3:
        c = F.when(cdf > 0.5, 1 - cdf).otherwise(cdf)
        out = F.when(cdf < 0.5, F.array(1 - 2 * c, 2 * c, _d(0))).when(cdf > 0.5, F.array(_d(0), 2 * c, 1 - 2 * c)).otherwise(F.array(_d(0), _d(1), _d(0)))
    elif not two_sided and states == 2:
        out = F.array(1 - cdf, cdf)
    else:
        raise ValueError("one-sided variables have two states, two-sided ones two or three")
    return F.when(cdf.isNull(), F.array(*[_d(1)] * states)).otherwise(out)


def gaussian(x: Column, mean: float, sd: float = 1.0) -> Column:
    return F.exp(-F.pow(x - mean, _d(2)) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))


def mixture_components(thresholds: list[float], states: int) -> list[tuple[int, float, float, float]]:
    """(state, weight, mean, sd): means are the thresholds with the mid-points between them. Three components over two
    states: the middle is state 0, both outer ones are state 1."""
    means = [thresholds[0]]
    for a, b in zip(thresholds, thresholds[1:], strict=False):
        means += [(a + b) / 2, b]
    if len(means) == 3 and states == 2:
        of = [1, 0, 1]
    elif len(means) == states:
        of = list(range(states))
    else:
        raise ValueError(f"{len(means)} components can't make {states} states")
    return [(s, 1 / len(means), m, 1.0) for s, m in zip(of, means, strict=True)]


def mixture_marginal(x: Column, components: list[tuple[int, float, float, float]]) -> Column:
    """Normalised state probabilities of a Gaussian mixture; without observation the normalised weights."""
    states = max(s for s, *_ in components) + 1
    density = [reduce(Column.__add__, [w * gaussian(x, m, sd) for s, w, m, sd in components if s == k], _d(0)) for k in range(states)]
    weight = [sum(w for s, w, *_ in components if s == k) for k in range(states)]
    total = reduce(Column.__add__, density)
    return F.when(x.isNull(), F.array(*(_d(w / sum(weight)) for w in weight))).otherwise(F.array(*(F.try_divide(d, total) for d in density)))


def affinity_strength(nanomolar: Column) -> Column:
    """0.999 below 1, 0.99 below 10, then linear in the logarithm up to 1e7 (below 0 from about 1.1e6), else 0."""
    v = nanomolar
    return F.when(v.isNull(), None).when(v < 1, 0.999).when(v < 10, 0.99).when(v <= 10e6, -0.196 * (F.log10(F.when(v > 0, v)) - 1) + 0.99).otherwise(0.0)


def modification_type(kind: Column) -> Column:
    """Activation or Inhibition of an interaction type in any case; null and unknown types inhibit."""
    return F.when(F.upper(kind).isin(*ACTIVATING), "Activation").otherwise("Inhibition")


def ic50_weight(x: Column) -> Column:
    return F.pow(_d(2), -x)


def observation_key(states: dict[str, Column]) -> Column:
    """Decimal key: each data type's state plus one at its digit; a missing state leaves a zero."""
    return reduce(Column.__add__, [F.lit(KEY_STRIDE[k]) * (F.coalesce(v, F.lit(-1)) + 1) for k, v in states.items()], F.lit(0))


def assignment_index(states: list[Column], cardinalities: list[int]) -> Column:
    """Position of an assignment in a factor's values; the first variable varies fastest."""
    out, stride = F.lit(0), 1
    for s, n in zip(states, cardinalities, strict=True):
        out, stride = out + s * stride, stride * n
    return out


def assignment_states(index: Column, cardinalities: list[int]) -> list[Column]:
    out, stride = [], 1
    for n in cardinalities:
        out.append((F.floor(index / stride) % n).cast("int"))
        stride *= n
    return out


def log_to_probability(values: Column) -> Column:
    """An array of logarithms as probabilities, shifted by its maximum."""
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, _d(0), lambda a, b: a + b))


def modified(value: Column, inhibition: Column, activation: Column) -> Column:
    """v (1 - i) if there is an inhibition, else v (1 + a) if there is an activation; at most 1."""
    return F.least(F.when(inhibition.isNotNull(), value * (1 - inhibition)).when(activation.isNotNull(), value * (1 + activation)).otherwise(value), _d(1))


def relative_change(perturbed: Column, base: Column, floor: float = 1e-8) -> Column:
    """(p - b) / (p + b) of both raised to at least ``floor``."""
    p, b = F.greatest(perturbed, _d(floor)), F.greatest(base, _d(floor))
    return F.when(perturbed.isNotNull() & base.isNotNull(), (p - b) / (p + b))


def first_named(*names: Column) -> Column:
    """The first name that isn't null or empty."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names))


def normal_tail(d: Column) -> Column:
    """Two-sided probability 2 (1 - Phi(d)) for d >= 0, by the Abramowitz-Stegun rational formula 26.2.17 (error below 1.5e-7)."""
    t = 1 / (1 + 0.2316419 * d)
    # Coefficients of formula 26.2.17.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 2 * F.exp(-d * d / 2) / math.sqrt(2 * math.pi) * poly


def pair_name(a: Column, b: Column) -> Column:
    return F.concat_ws("\t", F.least(a, b), F.greatest(a, b))


def name_parts(name: Column, types: list[str]) -> tuple[Column, Column]:
    """(gene, data type) of names GENE_TYPE; null for names that end in none of ``types``."""
    kind = F.coalesce(*(F.when(name.endswith("_" + t), t) for t in sorted(types, key=len, reverse=True)))
    return F.when(kind.isNotNull(), name.substr(F.lit(1), F.length(name) - F.length(kind) - 1)), kind
