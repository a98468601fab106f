"""Permutations of rows by a keyed bijection on their numbers: no sort, no state, the same for any partitioning.

Rounds of swap or not (Hoang, Morris and Rogaway, 2012): in each a number x has the partner (k - x) mod n, and the larger of
the two decides by a hash whether they change places. Every round is its own inverse, so the whole is a bijection for any n.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.plans.checkpoint import row_numbers

PRIME = (1 << 31) - 1  # fixed value: of the rounds' hashes


def keys(seed: int, rounds: int = 120) -> list[tuple[int, int, int]]:
    """Keys of the rounds: where the partners are, and a multiplier and a shift of the hash. Some six rounds for each bit of n mix
    well."""
    draw = random.Random(seed)
    return [(draw.randrange(1 << 62), draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(rounds)]


def permuted(x: Column, n: Column, seed: int, rounds: int = 120) -> Column:
    """Where number ``x`` of 0 .. n - 1 goes."""
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in keys(seed, rounds)))

    def swap_or_not(x: Column, key: Column) -> Column:
        partner = F.pmod(F.pmod(key["k"], n) - x, n)
        top = F.greatest(x, partner)
        mixed = (F.pmod(top, F.lit(PRIME)) * key["a"]) % PRIME + (F.floor(top / PRIME) * 48271) % PRIME + key["b"]
        return F.when(mixed % PRIME % 2 == 1, partner).otherwise(x)

    return F.aggregate(table, x.cast("long"), swap_or_not)


def permuted_sql(x: str, n: str, seed: int, rounds: int = 120) -> str:
    """DuckDB SQL for :func:`permuted` below ``PRIME`` rows."""
    table = ", ".join(f"{{'x': 0::BIGINT, 'k': {k}, 'a': {a}, 'b': {b}}}" for k, a, b in keys(seed, rounds))
    partner = f"((k.k % {n} - s.x + {n}) % {n})"
    swapped = f"CASE WHEN ((greatest(s.x, {partner}) * k.a) % {PRIME} + k.b) % {PRIME} % 2 = 1 THEN {partner} ELSE s.x END"
    return f"list_reduce([{table}], lambda s, k: {{'x': {swapped}, 'k': 0, 'a': 0, 'b': 0}}, {{'x': {x}::BIGINT, 'k': 0, 'a': 0, 'b': 0}}).x"


def shuffled(df: DataFrame, order: list[str], labels: list[str], seed: int, times: int = 1) -> DataFrame:
    """``df`` ``times`` over, with a column rep and the ``labels`` of another row of it: in each repetition every row's labels go to
    one row, so margins stay. ``order`` names columns that number the rows (distinct together). A repetition is one join on row
    numbers; which row goes where depends on seed, repetition and number only."""
    numbered = row_numbers(df, *order, name="__rn").withColumn("__rn", F.col("__rn") - 1)
    n = df.count()
    reps = [numbered.select(F.lit(k).alias("rep"), *[c for c in df.columns if c not in labels], permuted(F.col("__rn"), F.lit(n), seed + k).alias("__to")) for k in range(times)]
    out = reps[0]
    for r in reps[1:]:
        out = out.unionByName(r)
    return out.join(numbered.select(F.col("__rn").alias("__to"), *labels), "__to").select("rep", *df.columns)
