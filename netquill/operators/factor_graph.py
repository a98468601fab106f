"""Factor graphs as tables.

``factors``: factor_id, values ARRAY<DOUBLE>; ``links``: factor_id, pos, var_id, states, in the factor's order of
variables. The first variable of a factor varies fastest. ``messages`` have probabilities in rows of
(factor_id, var_id, state, p).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.operators import tiles
from netquill.operators.components import components
from netquill.plans.checkpoint import cut, row_numbers


def with_strides(links: DataFrame) -> DataFrame:
    w = W.partitionBy("factor_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return links.withColumn("stride", F.coalesce(F.product("states").over(w), F.lit(1.0)).cast("long"))


def cells(factors: DataFrame) -> DataFrame:
    return factors.select("factor_id", F.posexplode("values").alias("idx", "val"))


def cell_states(factors: DataFrame, links: DataFrame) -> DataFrame:
    """(factor_id, idx, val, var_id, state): a row for each cell and variable."""
    s = with_strides(links).select("factor_id", "var_id", "states", "stride")
    return cells(factors).join(s, "factor_id").select("factor_id", "idx", "val", "var_id", (F.floor(F.col("idx") / F.col("stride")) % F.col("states")).cast("int").alias("state"))


def variables(links: DataFrame) -> DataFrame:
    return links.select("var_id", "states").distinct()


def invalid_factors(factors: DataFrame, links: DataFrame) -> DataFrame:
    """Factors whose number of values isn't the product of their variables' states."""
    want = links.groupBy("factor_id").agg(F.product("states").cast("long").alias("want"))
    return factors.join(want, "factor_id", "left").where(F.coalesce("want", F.lit(-1)) != F.size("values")).select("factor_id")


def is_tree(links: DataFrame) -> bool:
    """The bipartite graph of factors and variables is connected and without cycle."""
    e = links.select(F.concat(F.lit("f"), F.col("factor_id").cast("string")).alias("a"), F.concat(F.lit("v"), F.col("var_id").cast("string")).alias("b"))
    nodes = e.select("a").union(e.select("b")).distinct().count()
    return nodes == e.count() + 1 and components(e).select("root").distinct().count() == 1


def uninferable(continuous: DataFrame) -> DataFrame:
    """Continuous variables that inference can't handle. continuous: var_id, factor_id, factor_kind, n_vars, n_continuous."""
    bad = (F.count_distinct("factor_id") > 1) | F.bool_or((F.col("factor_kind") != "continuous") | (F.col("n_vars") > 2) | (F.col("n_continuous") > 1))
    return continuous.groupBy("var_id").agg(bad.alias("bad")).where("bad").select("var_id")


MOST_PAIRED = 64  # variables of a factor up to which its pairs are written out, times an eighth of the blocks of variables
MOST_ROWS = 2_000_000  # pairs that are rows of a table; more are packed
MOST_ROWS_OF_FACTOR, BUCKETS = 100_000, 1 << 15  # rows of a factor that one task may take; buckets of factors that are counted first
MOST_BROADCAST = 500_000  # numbered variables
ROWS_A_PART = 200_000


def linked_variables(links: DataFrame) -> DataFrame:
    """(var_id, n_linked): distinct other variables with which a variable shares a factor. Rows may repeat.

    Variables are numbered. Factors are rows with the set of their variables, dealt so that those with near numbers meet in a task,
    where their pairs are mostly merged before they are shuffled, each pair in one direction. Few pairs are rows. More are packed
    (:mod:`netquill.operators.tiles`): variables are cut into blocks of near numbers, and a task gets all pairs of two blocks, a tile, as
    sorted differences of a byte or two. A large factor sends its variables of both blocks to a tile instead of their pairs, and the
    largest, which buckets of factors show, are gathered by block only. So nothing grows with the square of a factor's size."""
    spark = links.sparkSession
    rows = links.select("factor_id", "var_id").where("factor_id IS NOT NULL AND var_id IS NOT NULL")
    numbers = cut(row_numbers(rows.select("var_id").distinct(), "var_id", name="no"), "numbers")
    n = numbers.count()
    at = rows.join(F.broadcast(numbers) if n <= MOST_BROADCAST else numbers.hint("merge"), "var_id").select("factor_id", F.col("no").cast("int" if n < 1 << 31 else "long").alias("no"))
    bucket = F.pmod(F.xxhash64("factor_id"), F.lit(BUCKETS))
    buckets = cut(rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("k")), "buckets")
    parts = max(buckets.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0] // ROWS_A_PART, spark.sparkContext.defaultParallelism)
    full = buckets.where(F.col("k") > MOST_ROWS_OF_FACTOR).select("bucket")
    of_full = at.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi")
    hubs = cut(of_full.groupBy("factor_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > MOST_ROWS_OF_FACTOR).select("factor_id"), "hubs")
    some_hubs = not hubs.isEmpty()
    side = tiles.side_of(n, parts)
    most = MOST_PAIRED * (1 + -(-n // side) // 8)
    other = at.join(hubs, "factor_id", "left_anti") if some_hubs else at
    sets = other.repartition(parts, "factor_id").groupBy("factor_id").agg(F.array_sort(F.collect_set("no")).alias("set")).where(F.size("set") > 1)
    near = sets.select(F.when(F.size("set") > most, F.col("factor_id")).alias("large"), "set").repartitionByRange(parts, F.get("set", F.lit(0)), F.get("set", F.lit(1)))
    sets = cut(near, "sets")
    size = F.size("set").cast("long")
    n_pairs, n_large = sets.agg(F.coalesce(F.sum(size * (size - 1) / 2), F.lit(0)), F.count("large")).first()
    if n_pairs <= MOST_ROWS and not n_large and not some_hubs:
        ahead = sets.select("set", F.posexplode("set").alias("i", "a")).select("a", F.explode(F.slice("set", F.col("i") + 2, most)).alias("b"))
        pairs = cut(ahead.distinct(), "linked")
        each = pairs.select(F.explode(F.array("a", "b")).alias("no")).groupBy("no").agg(F.count(F.lit(1)).alias("n_linked"))
        return each.join(numbers, "no").select("var_id", "n_linked")
    packed = tiles.packed(sets.where("large IS NULL").select("set"), n, side)
    if n_large or some_hubs:
        of_large = sets.where("large IS NOT NULL").select(F.col("large").alias("factor_id"), F.explode("set").alias("no")).union(at.join(hubs, "factor_id", "left_semi"))
        packed = packed.union(tiles.listed(of_large, n, side))
    each = tiles.counted(packed, n, side, parts).groupBy("no").agg(F.sum("n").alias("n_linked"))
    return each.join(numbers, "no").select("var_id", "n_linked")


def evidence_factors(evidence: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(factors, links) of unary evidence; evidence: var_id, value. With two states it is soft, [1 - v, v]; with more the
    state is certain. Unknown variables are ignored. The factor of a variable is named ``-1 - var_id``."""
    known = evidence.join(variables(links), "var_id")
    soft = F.array(1 - F.col("value"), F.col("value"))
    sure = F.transform(F.sequence(F.lit(0), F.col("states") - 1), lambda i: F.when(i == F.col("value").cast("int"), 1.0).otherwise(0.0))
    bad = (F.col("states") == 2) & ~F.col("value").between(0.0, 1.0)
    values = F.when(bad, F.raise_error(F.lit("soft evidence must be between 0 and 1"))).when(F.col("states") == 2, soft).otherwise(sure)
    f = known.select((-1 - F.col("var_id")).alias("factor_id"), values.cast("array<double>").alias("values"))
    return f, known.select((-1 - F.col("var_id")).alias("factor_id"), F.lit(0).alias("pos"), "var_id", "states")


def sliced(factors: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(factor_id, idx, val): the cells that agree with the evidence (var_id, state). Factors all or none of whose variables
    are assigned stay whole."""
    c = cell_states(factors, links).join(evidence.select("var_id", F.col("state").alias("seen")), "var_id", "left")
    n = links.groupBy("factor_id").agg(F.count(F.lit(1)).alias("n_vars"))
    seen = links.join(evidence, "var_id", "left_semi").groupBy("factor_id").agg(F.count(F.lit(1)).alias("n_seen"))
    partly = n.join(seen, "factor_id").where("n_seen < n_vars").select("factor_id", F.lit(True).alias("partly"))
    g = c.groupBy("factor_id", "idx", "val").agg(F.bool_and(F.col("seen").isNull() | (F.col("seen") == F.col("state"))).alias("agrees"))
    return g.join(partly, "factor_id", "left").where(F.col("partly").isNull() | F.col("agrees")).select("factor_id", "idx", "val")


def log_likelihood(factors: DataFrame, links: DataFrame, assignments: DataFrame) -> DataFrame:
    """(sample_id, loglik) of complete assignments (sample_id, var_id, state); an incomplete one raises."""
    s = with_strides(links)
    n = links.groupBy("factor_id").agg(F.count(F.lit(1)).alias("n_vars"))
    at = s.join(assignments, "var_id").groupBy("sample_id", "factor_id").agg(F.sum(F.col("state") * F.col("stride")).alias("idx"), F.count(F.lit(1)).alias("n"))
    total = factors.select(F.count(F.lit(1)).alias("n_factors"))
    v = at.join(n, "factor_id").join(factors, "factor_id").select("sample_id", F.when(F.col("n") == F.col("n_vars"), F.get("values", F.col("idx").cast("int"))).alias("val"))
    got = v.groupBy("sample_id").agg(F.sum(F.when(F.col("val") > 0, F.log("val")).otherwise(F.when(F.col("val") == 0, F.lit(float("-inf"))))).alias("l"), F.count("val").alias("n"))
    return got.crossJoin(total).select("sample_id", F.when(F.col("n") == F.col("n_factors"), F.col("l")).otherwise(F.raise_error(F.lit("an assignment lacks a variable"))).alias("loglik"))


def bethe_log_z(factors: DataFrame, links: DataFrame, var_beliefs: DataFrame, cell_beliefs: DataFrame) -> DataFrame:
    """One row, log_z: sum over variables of (degree - 1) sum b ln b plus sum over cells of b (ln val - ln b). On a tree exact.
    var_beliefs: var_id, state, p; cell_beliefs: factor_id, idx, p."""
    degree = links.groupBy("var_id").agg(F.count_distinct("factor_id").alias("d"))
    v = var_beliefs.join(degree, "var_id").where("p > 0").agg(F.coalesce(F.sum((F.col("d") - 1) * F.col("p") * F.log("p")), F.lit(0.0)).alias("a"))
    c = cells(factors).join(cell_beliefs, ["factor_id", "idx"]).where("p > 0 AND val > 0").agg(F.coalesce(F.sum(F.col("p") * (F.log("val") - F.log("p"))), F.lit(0.0)).alias("b"))
    return v.crossJoin(c).select((F.col("a") + F.col("b")).alias("log_z"))


def multiplied(cell_values: DataFrame, message: DataFrame, states: DataFrame, log: bool = False) -> DataFrame:
    """(factor_id, idx, val): each cell times (``log``: plus) the message of one variable. states: factor_id, idx, state of that
    variable; message: factor_id, state, p."""
    m = cell_values.join(states, ["factor_id", "idx"]).join(message, ["factor_id", "state"])
    return m.select("factor_id", "idx", (F.col("val") + F.col("p") if log else F.col("val") * F.col("p")).alias("val"))


def marginal(factors: DataFrame, links: DataFrame, maximise: bool = False) -> DataFrame:
    """(factor_id, var_id, state, val): sums (or maxima, at least 0) of a factor's cells for each of its variables."""
    c = cell_states(factors, links)
    return c.groupBy("factor_id", "var_id", "state").agg((F.greatest(F.max("val"), F.lit(0.0)) if maximise else F.sum("val")).alias("val"))


def effective_factors(factors: DataFrame, links: DataFrame, continuous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(factors, links) with each continuous factor as the unary factor that its observation makes of it; nothing is changed in
    place, so nothing has to be restored. continuous: factor_id, var_id (the discrete one), marginal ARRAY<DOUBLE>."""
    n = variables(links)
    extra = continuous.join(n, "var_id", "left").select("factor_id", "var_id", F.size("marginal").alias("states"), "marginal")
    f = factors.unionByName(extra.select("factor_id", F.col("marginal").alias("values")))
    return f, links.select("factor_id", "pos", "var_id", "states").unionByName(extra.select("factor_id", F.lit(0).alias("pos"), "var_id", "states"))


def factor_components(links: DataFrame) -> DataFrame:
    """(factor_id, root): factors that share variables, directly or through others, have one root."""
    f = F.concat(F.lit("f"), F.col("factor_id").cast("string"))
    v = F.concat(F.lit("v"), F.col("var_id").cast("string"))
    c = components(links.select(f.alias("a"), v.alias("b")))
    return links.select("factor_id", f.alias("node")).distinct().join(c, "node").select("factor_id", "root")


def outputs(variables_: DataFrame, props: str = "props") -> DataFrame:
    """Variables whose property output is true."""
    return variables_.where(F.col(props)["output"] == "true")
