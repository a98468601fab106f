"""From reaction tables to factor graphs and fuzzy Boolean networks.

``reactions``: reaction_id, pathway_id. ``participants``: reaction_id, entity_id, role (INPUT, CATALYST, ACTIVATOR,
INHIBITOR, OUTPUT), ord. ``entities``: entity_id, name, gene, names. ``parts``: parent_id, child_id, kind (component,
member, candidate). Node names are strings: an entity's id, or for accessory nodes the reaction's id and a suffix, so
that every accessory node has a name of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.operators.relational import dense_index, without_currency
from netquill.plans.checkpoint import cut

FAN_IN = 3
# Chances of the expected state and of each other one; steepness and bounds of perturbation factors.
MATCH, MISMATCH = 0.999, 0.0005
STEEPNESS, LEAST = 10, 4.5e-6
#: Edge labels whose smallest state counts; MEMBER takes the largest, INHIBITOR the opposite state.
SMALLEST = ("INPUT", "CATALYST", "ACTIVATOR", "COMPLEX")


def expected_state(states: list[Column], labels: list[str]) -> Column:
    """Expected target state of three-state parents: smallest of the (inverted for inhibitors) states, or largest for members."""
    kinds = set(labels) - {"INHIBITOR"}
    if "MEMBER" in kinds and kinds & set(SMALLEST):
        raise ValueError("members can't be mixed with other labels")
    plain = [s for s, k in zip(states, labels, strict=True) if k != "INHIBITOR"]
    over = (F.greatest if "MEMBER" in kinds else F.least) if len(plain) > 1 else (lambda x: x)
    out = over(*plain) if plain else F.lit(1)
    for s in (2 - s for s, k in zip(states, labels, strict=True) if k == "INHIBITOR"):
        out = F.least(out, s)
    return out


def factor_values(spark, labels: list[str], states: int = 3) -> DataFrame:
    """(idx, val) of a factor [target, parents...]: a match of the expected state has the large value."""
    n = len(labels) + 1
    grid = spark.range(states**n).select(F.col("id").alias("idx"), *((F.floor(F.col("id") / states**k) % states).cast("int").alias(f"s{k}") for k in range(n)))
    want = expected_state([F.col(f"s{k + 1}") for k in range(len(labels))], labels)
    return grid.select("idx", F.when(F.col("s0") == want, MATCH).otherwise(MISMATCH).alias("val"))


def perturbation_values(spark, labels: list[str]) -> DataFrame:
    """(idx, val) for two states: the output follows 1 - exp(-10 mean) of its parents (the smallest of members)."""
    n = len(labels) + 1
    grid = spark.range(2**n).select(F.col("id").alias("idx"), *((F.floor(F.col("id") / 2**k) % 2).cast("double").alias(f"s{k}") for k in range(n)))
    p = [F.col(f"s{k + 1}") for k in range(len(labels))]
    e = (F.least(*p) if len(p) > 1 else p[0]) if set(labels) == {"MEMBER"} else reduce(Column.__add__, p, F.lit(0.0)) / max(1, len(p))
    low = F.exp(-STEEPNESS * e)
    clamp = lambda x: F.least(F.greatest(x, F.lit(LEAST)), F.lit(1 - LEAST))
    return grid.select("idx", F.when(F.col("s0") == 1, clamp(1 - low)).otherwise(clamp(low)).alias("val"))


MOST_PARENTS = 16


def perturbation_factors(edges: DataFrame) -> DataFrame:
    """(target, parents, values): the two-state factor [target, parents...] of every target, as in :func:`perturbation_values`, its
    parents in order. edges: target, parent, label; more than ``MOST_PARENTS`` must have been split before."""
    g = edges.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("parent", "label"))).alias("x"))  # a few parents
    n = F.size("x")
    clamp = lambda x: F.least(F.greatest(x, F.lit(LEAST)), F.lit(1 - LEAST))

    def value(i: Column) -> Column:
        on = F.bit_count(F.shiftright(i, 1))
        mean = F.when(F.forall("x", lambda p: p["label"] == "MEMBER"), (on == n).cast("double")).otherwise(on / n)
        low = F.exp(-STEEPNESS * mean)
        return F.when(i % 2 == 1, clamp(1 - low)).otherwise(clamp(low))

    cells = F.when(n > MOST_PARENTS, F.raise_error(F.lit("a target has too many parents")).cast("array<int>")).otherwise(F.sequence(F.lit(0), F.pow(F.lit(2.0), n + 1).cast("int") - 1))
    return g.select("target", F.transform("x", lambda p: p["parent"]).alias("parents"), F.transform(cells, value).alias("values"))


def split_fan_in(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(target, parent, label) with at most three parents for each target: parents are sorted by name and every full three get an
    accessory node, as often as needed; what is left of a round is passed up as it is."""
    now = edges.select("target", "parent", "label").distinct()
    done = None
    for k in range(rounds):
        n = F.count(F.lit(1)).over(W.partitionBy("target", "label"))
        rn = F.row_number().over(W.partitionBy("target", "label").orderBy("parent")) - 1
        # Only labels of one kind are split together, so a target's accessory nodes carry its label.
        ranked = cut(now.withColumns({"n": n, "rn": rn}), "fan-in")
        small, large = ranked.where(f"n <= {FAN_IN}"), ranked.where(f"n > {FAN_IN}")
        done = small.select("target", "parent", "label") if done is None else done.union(small.select("target", "parent", "label"))
        if not large.take(1):
            return done
        full = F.col("rn") < F.floor(F.col("n") / FAN_IN) * FAN_IN
        node = F.concat_ws("_", "target", "label", F.lit(k), F.floor(F.col("rn") / FAN_IN).cast("int"))
        done = done.union(large.where(full).select(node.alias("target"), "parent", "label"))
        now = large.where(full).select("target", node.alias("parent"), "label").distinct().union(large.where(~full).select("target", "parent", "label"))
    raise RuntimeError("fan-in isn't split after so many rounds")


def reaction_edges(participants: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(target, parent, label) of the factor graph of reactions: reaction node <- participants, output entity <- reaction.

    Only the first catalyst counts; several activators or inhibitors are grouped as members of an accessory node;
    currency molecules are left out; a reaction without output gives nothing."""
    p = participants.select("reaction_id", F.col("entity_id").cast("string").alias("entity"), "role", "ord")
    if entities is not None:
        kept = without_currency(entities).select(F.col("entity_id").cast("string").alias("entity"))
        p = p.join(kept, "entity", "left_semi")
    p = p.join(p.where("role = 'OUTPUT'").select("reaction_id").distinct(), "reaction_id", "left_semi")
    first = W.partitionBy("reaction_id", "entity").orderBy("ord")
    inp = p.where("role != 'OUTPUT'").withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    inp = inp.withColumn("k", F.row_number().over(W.partitionBy("reaction_id", "role").orderBy("ord", "entity"))).where("role != 'CATALYST' OR k = 1")
    inp = inp.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("reaction_id", "role")))
    grouped = F.col("role").isin("ACTIVATOR", "INHIBITOR") & (F.col("n") > 1)
    target = F.concat_ws("_", "reaction_id", F.lit("OUTPUT"))
    group = F.concat_ws("_", "reaction_id", "role")
    direct = inp.where(~grouped).select(target.alias("target"), F.col("entity").alias("parent"), F.col("role").alias("label"))
    through = inp.where(grouped).select(target.alias("target"), group.alias("parent"), F.col("role").alias("label")).distinct()
    members = inp.where(grouped).select(group.alias("target"), F.col("entity").alias("parent"), F.lit("MEMBER").alias("label"))
    outputs = p.where("role = 'OUTPUT'").select(F.col("entity").alias("target"), target.alias("parent"), F.lit("MEMBER").alias("label")).distinct()
    return direct.union(through).union(members).union(outputs)


def reverse_edges(participants: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(target, parent, label) that let a reaction's catalyst act back on its inputs, through a node of the reaction's own; nothing
    for reactions without catalyst or without an input that isn't a currency molecule."""
    p = participants.select("reaction_id", F.col("entity_id").cast("string").alias("entity"), "role", "ord")
    inputs = p.where("role = 'INPUT'").select("reaction_id", "entity").distinct()
    if entities is not None:
        inputs = inputs.join(without_currency(entities).select(F.col("entity_id").cast("string").alias("entity")), "entity", "left_semi")
    catalyst = p.where("role = 'CATALYST'").groupBy("reaction_id").agg(F.min_by("entity", F.struct("ord", "entity")).alias("catalyst"))
    node = F.concat(F.lit("reverse_input_"), F.col("reaction_id").cast("string"))
    both = inputs.join(catalyst, "reaction_id")
    back = both.select(F.col("entity").alias("target"), node.alias("parent"), F.lit("INPUT").alias("label"))
    return both.select(node.alias("target"), F.col("catalyst").alias("parent"), F.lit("INPUT").alias("label")).distinct().union(back)


def closure(start: DataFrame, parts: DataFrame, stop: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """(parent_id, child_id, kind) of everything that ``start`` (entity_id) is made of; entities in ``stop`` aren't expanded."""
    p = parts if stop is None else parts.join(stop.select(F.col("entity_id").alias("parent_id")), "parent_id", "left_anti")
    seen = cut(start.select("entity_id").distinct(), "closure")
    front, out = seen, None
    for _ in range(rounds):
        got = cut(p.join(front.select(F.col("entity_id").alias("parent_id")), "parent_id", "left_semi").select("parent_id", "child_id", "kind").distinct(), "closure")
        if not got.take(1):
            return got if out is None else out
        out = got if out is None else out.unionByName(got)
        front = cut(got.select(F.col("child_id").alias("entity_id")).distinct().join(seen, "entity_id", "left_anti"), "closure")
        seen = seen.union(front)
    raise RuntimeError("parts nest deeper than that")


def entity_edges(start: DataFrame, parts: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(target, parent, label) of complexes (COMPLEX) and sets (MEMBER, candidates included)."""
    c = closure(start, parts, stop)
    return c.select(F.col("parent_id").cast("string").alias("target"), F.col("child_id").cast("string").alias("parent"), F.when(F.col("kind") == "component", "COMPLEX").otherwise("MEMBER").alias("label"))


def roles(participants: DataFrame) -> DataFrame:
    """(entity_id, roles): comma-joined, in alphabetical order."""
    return participants.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def boolean_network(participants: DataFrame) -> DataFrame:
    """(rel, input, negated, output) of reactions: an AND of inputs, all catalysts and regulators, inhibitors negated.

    Several regulators of one sign meet in an accessory OR node; several outputs hang on an accessory node each. A
    reaction without output, or without anything but outputs, gives nothing."""
    p = participants.select("reaction_id", F.col("entity_id").cast("string").alias("entity"), "role").distinct()
    out = p.where("role = 'OUTPUT'")
    rest = p.where("role != 'OUTPUT'").join(out.select("reaction_id", "entity"), ["reaction_id", "entity"], "left_anti").select("reaction_id").distinct()
    p = p.join(out.select("reaction_id").distinct(), "reaction_id", "left_semi").join(rest, "reaction_id", "left_semi")
    out, inp = p.where("role = 'OUTPUT'"), p.where("role != 'OUTPUT'")
    n_out = out.groupBy("reaction_id").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("one"))
    target = n_out.select("reaction_id", F.when(F.col("n") > 1, F.concat_ws("_", "reaction_id", F.lit("output"))).otherwise(F.col("one")).alias("output"))
    inp = inp.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("reaction_id", "role")))
    grouped = F.col("role").isin("ACTIVATOR", "INHIBITOR") & (F.col("n") > 1)
    node = F.concat_ws("_", "reaction_id", F.lower("role"))
    main = inp.select("reaction_id", F.when(grouped, node).otherwise(F.col("entity")).alias("input"), (F.col("role") == "INHIBITOR").alias("negated")).distinct().join(target, "reaction_id")
    rel = main.select(F.col("reaction_id").cast("string").alias("rel"), "input", "negated", "output")
    either = inp.where(grouped).select(F.concat_ws("_", node, "entity").alias("rel"), F.col("entity").alias("input"), F.lit(False).alias("negated"), node.alias("output"))
    many = out.join(n_out.where("n > 1").select("reaction_id"), "reaction_id", "left_semi")
    fan = many.select(F.concat_ws("_", "reaction_id", F.lit("output"), "entity").alias("rel"), F.concat_ws("_", "reaction_id", F.lit("output")).alias("input"), F.lit(False).alias("negated"), F.col("entity").alias("output"))
    return rel.union(either).union(fan)


def entity_relations(start: DataFrame, parts: DataFrame) -> DataFrame:
    """(rel, input, negated, output): a complex is one AND of its distinct components, a set one relation for each member (OR)."""
    c = closure(start, parts).select(F.col("parent_id").cast("string").alias("output"), F.col("child_id").cast("string").alias("input"), "kind").distinct()
    rel = F.when(F.col("kind") == "component", F.concat(F.col("output"), F.lit("_parts"))).otherwise(F.concat_ws("_", "output", "input"))
    return c.select(rel.alias("rel"), "input", F.lit(False).alias("negated"), "output")


def focused_members(members: DataFrame, focus: DataFrame) -> DataFrame:
    """Members of a set whose gene is in focus; all of them where none is. members: parent_id, child_id, gene; focus: gene."""
    m = members.join(focus.select("gene", F.lit(True).alias("hit")).distinct(), "gene", "left")
    any_hit = F.max(F.col("hit").isNotNull()).over(W.partitionBy("parent_id"))
    return m.withColumn("any", any_hit).where("hit IS NOT NULL OR NOT any").select(*members.columns)


def gene_regulatory(participants: DataFrame, reactions: DataFrame) -> DataFrame:
    """(reaction_id) of black-box events without input and with one output and some regulator."""
    n = participants.groupBy("reaction_id").agg(F.count_if(F.col("role") == "INPUT").alias("i"), F.count_if(F.col("role") == "OUTPUT").alias("o"), F.count_if(F.col("role").isin("ACTIVATOR", "INHIBITOR")).alias("r"))
    return n.where("i = 0 AND o = 1 AND r > 0").join(reactions.where("is_black_box"), "reaction_id", "left_semi").select("reaction_id")


def edge_factors(edges: DataFrame) -> DataFrame:
    """(factor_id, names, values) of a three-state factor [target, parents...] for each target, parents ordered by label and name.
    Each list of labels, of which there are few, has its values made once. Targets must have their fan-in split."""
    parents = edges.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("label", "parent"))).alias("p"))
    rows = cut(parents.select("target", F.transform("p", lambda x: x["label"]).alias("labels"), F.transform("p", lambda x: x["parent"]).alias("parents")), "factors")
    spark, tables = edges.sparkSession, []
    for r in rows.select("labels").distinct().collect():  # at most the multisets of a few labels
        cells = F.transform(F.array_sort(F.collect_list(F.struct("idx", "val"))), lambda c: c["val"])
        tables.append(factor_values(spark, list(r["labels"])).agg(cells.alias("values")).select(F.array(*map(F.lit, r["labels"])).alias("labels"), "values"))
    if not tables:
        return rows.select(F.col("target").alias("factor_id"), F.col("parents").alias("names"), F.array().cast("array<double>").alias("values"))
    values = F.broadcast(reduce(DataFrame.union, tables))
    return rows.join(values, "labels").select(F.col("target").alias("factor_id"), F.concat(F.array("target"), "parents").alias("names"), "values")


def network(relations: DataFrame, participants: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variables, inputs) of a Boolean network, as simulation and injection take them.

    variables: var_id, name, source_id (the entity, null for accessory nodes), gene (of proteins), identical (accessory nodes use
    the identity), output (whether a reaction gives it), driven (whether a relation leads to it); inputs: rel_id, output_var,
    input_var, negated. relations: rel, input, negated, output; entities: entity_id, gene and, where it tells proteins, class."""
    r = cut(relations.select("rel", "input", "negated", "output").distinct(), "relations")
    names = cut(dense_index(r.select(F.col("input").alias("name")).union(r.select("output")), "name", "var_id"), "names")
    gene = F.when(F.col("class") == "protein", F.col("gene")) if "class" in entities.columns else F.col("gene")
    known = entities.select(F.col("entity_id").cast("string").alias("name"), F.col("entity_id").alias("source_id"), gene.alias("gene"))
    given = participants.where("role = 'OUTPUT'").select(F.col("entity_id").cast("string").alias("name"), F.lit(True).alias("o")).distinct()
    driven = r.select(F.col("output").alias("name"), F.lit(True).alias("d")).distinct()
    v = names.join(known, "name", "left").join(given, "name", "left").join(driven, "name", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    v = v.select(F.col("var_id").cast("long").alias("var_id"), "name", "source_id", "gene", F.col("source_id").isNull().alias("identical"), yes("o").alias("output"), yes("d").alias("driven"))
    ids = dense_index(r, "rel", "rel_id")
    end = lambda c: names.select(F.col("name").alias(c), F.col("var_id").cast("long").alias(f"{c}_var"))
    i = r.join(ids, "rel").join(end("input"), "input").join(end("output"), "output").select("rel_id", "output_var", "input_var", "negated")
    return cut(v, "variables"), cut(i, "inputs")
