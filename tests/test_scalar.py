import math

import pytest
from pyspark.sql import functions as F

from netquill.functions import scalar


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize(("prior", "post", "want"), [(0.2, 0.5, 0.60205999), (0.1, 0.9999999, 3.00987563), (0.0, 0.5, 3.00987563), (0.5, 1.0, 3.00987563), (0.5, 0.0, -math.inf)])
def test_log_ratio(spark, prior, post, want):
    assert value(spark, scalar.log_ratio(lit(prior), lit(post))) == pytest.approx(want, abs=1e-7)


def test_log_ratio_undefined(spark):
    assert math.isnan(value(spark, scalar.log_ratio(lit(0.0), lit(0.0))))


@pytest.mark.parametrize(("x", "want"), [(0.5, 0.999), (1, 0.99), (10, 0.99), (100, 0.794), (1000, 0.598), (1e6, 0.01), (1e7, -0.186), (1.1e7, 0.0)])
def test_affinity(spark, x, want):
    assert value(spark, scalar.affinity_strength(lit(x))) == pytest.approx(want)


@pytest.mark.parametrize(("x", "thresholds", "states", "want"), [(4.9, [5.0], None, 0), (5.0, [5.0], None, 1), (-2.0, [-1.0, 1.0], 3, 0), (-1.0, [-1.0, 1.0], 3, 1), (1.0, [-1.0, 1.0], 3, 2), (-2.0, [-1.0, 1.0], 2, 1), (0.0, [-1.0, 1.0], 2, 0), (2.0, [-1.0, 1.0], 2, 1), (None, [5.0], None, None)])
def test_discretize(spark, x, thresholds, states, want):
    assert value(spark, scalar.discretize(lit(x), thresholds, states)) == want


def test_discretize_rejects():
    with pytest.raises(ValueError):
        scalar.discretize(F.lit(1.0), [1.0, 2.0, 3.0], 2)


@pytest.mark.parametrize(("c", "states", "two", "want"), [(0.2, 2, True, [0.4, 0.6]), (0.2, 3, True, [0.6, 0.4, 0.0]), (0.2, 2, False, [0.8, 0.2]), (0.8, 3, True, [0.0, 0.4, 0.6]), (0.5, 3, True, [0, 1, 0]), (None, 3, True, [1, 1, 1])])
def test_empirical(spark, c, states, two, want):
    assert value(spark, scalar.empirical_marginal(lit(c), states, two)) == pytest.approx(want)


def test_observation_key(spark):
    assert value(spark, scalar.observation_key({"CNV": F.lit(1), "mRNA_EXP": F.lit(0), "Methylation": F.lit(1), "miRNA": F.lit(None).cast("int"), "Mutation": F.lit(1)})) == 20212


def test_index_round_trip(spark):
    cards = [3, 3, 3]
    got = spark.range(27).select("id", *(c.alias(f"s{k}") for k, c in enumerate(scalar.assignment_states(F.col("id"), cards))))
    assert got.where(scalar.assignment_index([F.col(f"s{k}") for k in range(3)], cards) != F.col("id")).count() == 0
    assert got.where("id = 1").select("s0").first()[0] == 1  # the first variable varies fastest


def test_mixture(spark):
    comps = scalar.mixture_components([0.0, 2.0], 2)
    assert [c[0] for c in comps] == [1, 0, 1]
    assert [c[2] for c in comps] == [0.0, 1.0, 2.0]
    two = [(0, 0.5, 0.0, 1.0), (1, 0.5, 2.0, 1.0)]
    assert value(spark, scalar.mixture_marginal(lit(0.0), two)) == pytest.approx([0.88079708, 0.11920292], abs=1e-7)
    assert value(spark, scalar.mixture_marginal(lit(None), two)) == pytest.approx([0.5, 0.5])


def test_small_functions(spark):
    assert value(spark, scalar.modified(lit(0.8), lit(0.5), lit(0.9))) == pytest.approx(0.4)
    assert value(spark, scalar.modified(lit(0.8), lit(None), lit(0.9))) == 1.0
    assert value(spark, scalar.relative_change(lit(0.0), lit(0.0))) == 0.0
    assert value(spark, scalar.hill(lit(0.5))) == pytest.approx(0.500025, abs=1e-6)
    assert value(spark, scalar.log_to_probability(F.array(lit(-1000.0), lit(-1000.0)))) == [0.5, 0.5]
    assert value(spark, scalar.modification_type(F.lit("full agonist"))) == "Activation"
    assert value(spark, scalar.modification_type(F.lit(None).cast("string"))) == "Inhibition"
    assert value(spark, scalar.normal_tail(lit(1.96))) == pytest.approx(0.0499958, abs=1e-6)
    assert value(spark, scalar.first_named(F.lit(""), F.lit("b"))) == "b"
    gene, kind = scalar.name_parts(F.lit("TP53_mRNA_EXP"), ["CNV", "mRNA_EXP"])
    assert value(spark, F.concat_ws("|", gene, kind)) == "TP53|mRNA_EXP"
    third = F.lit(1.0) / 3
    assert value(spark, scalar.ipa([third] * 3, [lit(0.1), lit(0.2), lit(0.7)])) == pytest.approx(math.log10(0.7 / 0.3 * 2))
    assert value(spark, scalar.ipa([third] * 3, [lit(0.4), lit(0.2), lit(0.4)])) == 0.0
