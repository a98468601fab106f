"""Relational operators: projections, joins, aggregations, window computations, orderings and set operations.

All are declarative plans. Sides of joins are left to the optimizer, which broadcasts by measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- projections and filters


def split_names(df: DataFrame, name: str, types: list[str]) -> DataFrame:
    """Adds gene and data_type of names GENE_TYPE."""
    from netquill.functions.scalar import name_parts

    gene, kind = name_parts(F.col(name), types)
    return df.withColumns({"gene": gene, "data_type": kind})


def target_genes(variables: DataFrame, name: str = "name", suffix: str = "_protein") -> DataFrame:
    return variables.where(F.col(name).endswith(suffix)).select(F.regexp_replace(name, f"{suffix}$", "").alias("gene")).distinct()


def split_by_type(obs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """One observation for each sample and data type, named sample_type."""
    out = obs if types is None else obs.where(F.col("data_type").isin(*types))
    return out.withColumn("observation", F.concat_ws("_", "sample_id", "data_type"))


def split_mutations(obs: DataFrame, kind: str = "Mutation") -> DataFrame:
    """Labels a sample's rows mutation / other; a sample with only one of the two isn't split (label all)."""
    is_mut = F.col("data_type") == kind
    by = W.partitionBy("sample_id")
    both = F.max(is_mut.cast("int")).over(by) - F.min(is_mut.cast("int")).over(by) == 1
    return obs.withColumn("part", F.when(~both, "all").when(is_mut, "mutation").otherwise("other"))


def with_all_types(obs: DataFrame, sample: str = "sample_id", kind: str = "data_type") -> DataFrame:
    """Rows of the samples that have as many data types as there are."""
    n = obs.agg(F.count_distinct(kind).alias("n"))
    full = obs.groupBy(sample).agg(F.count_distinct(kind).alias("n")).join(n, "n", "left_semi")
    return obs.join(full, sample, "left_semi")


def shared_in_all(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items that occur in every group."""
    n = df.agg(F.count_distinct(group).alias("n"))
    return df.groupBy(item).agg(F.count_distinct(group).alias("n")).join(n, "n", "left_semi").select(item)


def strong_impacts(results: DataFrame, least: float = 0.01, value: str = "value") -> DataFrame:
    return results.where(F.col(value) >= least)


def hits_or_strong(results: DataFrame, least: float | None = None, value: str = "value") -> DataFrame:
    return results if least is None else results.where(F.col(value) > least)


def subset_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The first column and those of ``names`` that exist, renamed."""
    first, *rest = df.columns
    return df.select(first, *(F.col(f"`{c}`").alias(names[c]) for c in rest if c in names))


# Names of currency molecules.
CURRENCY = ("ATP", "ADP", "Pi", "H2O", "GTP", "GDP", "CO2", "H+")


def without_currency(entities: DataFrame, names: str = "names", currency: tuple[str, ...] = CURRENCY) -> DataFrame:
    """Entities none of whose names is a currency molecule's."""
    return entities.where(~F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, currency))), F.lit(False)))


def good_parameters(df: DataFrame, values: str, threshold: float) -> DataFrame:
    """Learned parameters whose entries 0, 3 and 6 differ pairwise by the threshold and whose first exceeds the seventh."""
    v = [F.element_at(values, i + 1) for i in (0, 3, 6)]
    return df.where((F.abs(v[0] - v[1]) >= threshold) & (F.abs(v[0] - v[2]) >= threshold) & (F.abs(v[1] - v[2]) >= threshold) & (v[0] > v[2]))


# --- joins


def background_fill(scores: DataFrame, samples: DataFrame, genes: DataFrame, value: str = "score") -> DataFrame:
    """Every sample and gene, with the smallest value where a pair has none."""
    grid = samples.distinct().crossJoin(genes.distinct()).crossJoin(scores.agg(F.min(value).alias("__least")))
    keys = samples.columns + genes.columns
    return grid.join(scores.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, "__least")).drop("__least")


def map_through_least(clusters: DataFrame, mapping: DataFrame) -> DataFrame:
    """(drug, cluster) of clusters keyed by an external id; of several ids of a drug the smallest number counts."""
    return clusters.join(mapping, "external_id").groupBy("drug").agg(F.min_by("cluster", "external_id").alias("cluster"))


def with_degrees(pairs: DataFrame, a: str = "gene1", b: str = "gene2") -> DataFrame:
    """Adds d1 and d2, the numbers of distinct partners of both ends."""
    d = degrees(pairs, a, b)
    return pairs.join(d.select(F.col("gene").alias(a), F.col("degree").alias("d1")), a).join(d.select(F.col("gene").alias(b), F.col("degree").alias("d2")), b)


def among(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``other`` has."""
    return df.join(other.select(key), key, "left_semi")


def not_among(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``other`` hasn't."""
    return df.join(other.select(key), key, "left_anti")


def with_property(scores: DataFrame, properties: DataFrame, key: str, score: str) -> DataFrame:
    """The mean score of each key that has a property, with it."""
    return properties.join(scores.groupBy(key).agg(F.avg(score).alias(score)), key)


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().exceptAll(right.distinct())


def relative_changes(base: DataFrame, perturbed: DataFrame, key: str, value: str = "auc") -> DataFrame:
    from netquill.functions.scalar import relative_change

    p = perturbed.select(key, F.col(value).alias("__p"))
    return base.select(key, F.col(value).alias("__b")).join(p, key).select(key, relative_change(F.col("__p"), F.col("__b")).alias("change"))


# --- aggregations


def degrees(pairs: DataFrame, a: str = "gene1", b: str = "gene2") -> DataFrame:
    both = pairs.select(F.col(a).alias("gene"), F.col(b).alias("other")).union(pairs.select(F.col(b), F.col(a)))
    return both.groupBy("gene").agg(F.count_distinct("other").alias("degree"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, ari (Hubert-Arabie) of two labellings of the same rows."""
    two = lambda c: c * (c - 1) / 2.0
    cells = contingency(df, a, b)
    pick = lambda d, k: d.agg(F.sum(two(F.col("n"))).alias(k))
    s = pick(cells, "s").crossJoin(pick(cells.groupBy(a).agg(F.sum("n").alias("n")), "sa")).crossJoin(pick(cells.groupBy(b).agg(F.sum("n").alias("n")), "sb")).crossJoin(cells.agg(F.sum("n").alias("n")))
    expected, most = F.col("sa") * F.col("sb") / two(F.col("n")), (F.col("sa") + F.col("sb")) / 2
    return s.select("n", F.try_divide(F.col("s") - expected, most - expected).alias("ari"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson's r of two columns, n, and their smallest values."""
    return df.agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n"), F.min(a).alias("least_a"), F.min(b).alias("least_b"))


def counted_if(df: DataFrame, key: list[str], conditions: dict[str, Column]) -> DataFrame:
    """How many rows of each key meet each condition."""
    return df.groupBy(*key).agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))


def least_affinity(evidence: DataFrame, key: list[str], value: str, median: str | None = None, kind: str | None = None) -> DataFrame:
    """Smallest assay value of each interaction among the evidence with a median and a type; null if there is none."""
    ok = F.lit(True)
    for c in (median, kind):
        if c:
            ok = ok & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return evidence.groupBy(*key).agg(F.min(F.when(ok, F.col(value))).alias("affinity"))


def impact_summary(diffs: DataFrame, key: list[str], value: str = "change") -> DataFrame:
    return diffs.groupBy(*key).agg(F.sum(F.abs(value)).alias("sum_impact"), F.avg(F.abs(value)).alias("mean_impact"))


def averaged_triples(df: DataFrame, values: str = "values") -> DataFrame:
    """(pos, value): the mean vector, each block of three scaled to a sum of one."""
    mean = df.select(F.posexplode(values).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("v"))
    block = W.partitionBy(F.floor(F.col("pos") / 3))
    return mean.select("pos", F.try_divide(F.col("v"), F.sum("v").over(block)).alias("value"))


# --- window computations


def auc(track: DataFrame, key: str | list[str], order: str | list[str], value: str = "value") -> DataFrame:
    """Trapezoid area under each key's values in order at unit steps; a single value counts half."""
    keys, by = ([key] if isinstance(key, str) else key), ([order] if isinstance(order, str) else order)
    w = W.partitionBy(*keys).orderBy(*by)
    ranked = track.select(*keys, F.col(value).alias("__v"), F.row_number().over(w).alias("__i"), F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("__n"))
    part = F.when((F.col("__i") == 1) | (F.col("__i") == F.col("__n")), F.col("__v") / 2).otherwise(F.col("__v"))
    return ranked.groupBy(*keys).agg(F.sum(part).alias("auc"))


def ecdf(df: DataFrame, group: str | list[str], value: str = "value", name: str = "cpd") -> DataFrame:
    """Adds the share of the group's values up to each row's. Counts come from distinct values, and a group with many of them is
    counted in ranges, so no group is gathered."""
    from netquill.plans.checkpoint import running_totals

    keys = [group] if isinstance(group, str) else group
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_totals(each, keys, value, "__n", "__c").select(*keys, value, (F.col("__c") / F.col("__c_total")).alias(name))
    return df.join(cum, [*keys, value], "left")


def medians(df: DataFrame, group: str, value: str = "value", name: str = "median") -> DataFrame:
    """(group, median) of values that aren't null: the middle one, or the mean of the middle two. Counted in ranges as the ECDF."""
    from netquill.plans.checkpoint import running_totals

    each = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_totals(each, [group], value, "__n", "__c")
    holds = lambda at: (F.col("__c") >= at) & (F.col("__c") - F.col("__n") < at)
    low, high = F.floor((F.col("__c_total") + 1) / 2), F.floor(F.col("__c_total") / 2) + 1
    middle = cum.where(holds(low) | holds(high)).groupBy(group).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return middle.select(group, ((F.col("a") + F.col("b")) / 2).alias(name))


def first_of(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key: an aggregate, so nothing is sorted and a hot key is combined before it moves."""
    rest = [c for c in df.columns if c not in key]
    first = F.min(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], *[F.col(c).alias(f"__{c}") for c in rest]))
    got = df.groupBy(*key).agg(first.alias("__first"))
    return got.select(*key, *(F.col(f"__first.__{c}").alias(c) for c in rest)).select(*df.columns)


def top_of(df: DataFrame, key: list[str], order: list[Column | str], n: int, name: str = "place") -> DataFrame:
    """The first ``n`` rows of each key in order, with their place. The limit reaches below the shuffle: each task passes on its own
    first ``n`` of a key, so a hot key moves few rows."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def rising_steps(series: DataFrame, order: str, value: str) -> DataFrame:
    """One row: how often a value exceeds the one before it. ``order`` must be distinct."""
    from netquill.plans.checkpoint import cut, row_numbers

    n = cut(row_numbers(series.select(F.col(order).alias("at"), F.col(value).alias("now")), "at").select("rn", "now"), "series")
    before = n.select((F.col("rn") + 1).alias("rn"), F.col("now").alias("before"))
    return n.join(before, "rn").agg(F.count_if(F.col("now") > F.col("before")).alias("n_rises"))


def normalised(df: DataFrame, group: list[str], value: str, name: str = "p") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(*group))))


def drawn(states: DataFrame, group: list[str], state: str, p: str, u: str) -> DataFrame:
    """The first state whose cumulative probability reaches the group's uniform number ``u``."""
    cum = F.sum(p).over(W.partitionBy(*group).orderBy(state).rowsBetween(W.unboundedPreceding, 0))
    return states.withColumn("__c", cum).where(F.col(u) <= F.col("__c")).groupBy(*group).agg(F.min(state).alias(state))


# --- orderings and set operations


def dense_index(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Distinct values with their index from 0 in order, numbered without gathering them."""
    from netquill.plans.checkpoint import row_numbers

    return row_numbers(df.select(column).distinct(), column).select(column, (F.col("rn") - 1).alias(name))


def by_numeric_suffix(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(F.substring_index(name, "_", -1).try_cast("bigint"), name)


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their key: the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def union_of(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


# --- matrices


def matrix(df: DataFrame, row: str, column: str, value: str, columns: list, fill: float | None = 0.0, total: str | None = None) -> DataFrame:
    """Pivoted sums with the given columns in order; ``total`` names a column with the row's sum."""
    out = df.groupBy(row).pivot(column, columns).agg(F.sum(value))
    out = out if fill is None else out.fillna(fill, subset=[str(c) for c in columns])
    return out if total is None else out.withColumn(total, reduce(Column.__add__, [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in columns]))
