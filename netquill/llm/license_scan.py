"""License scans by an exact set-similarity join, in built-in DataFrame operations only.

Words are the runs of other characters than ASCII punctuation, blanks and controls after lower-casing A-Z.

*Base*: the places where the words of a fixed phrase stand consecutively.

*Method*: overlapping blocks of words are joined with license templates; a block matches if it holds at least
``threshold`` of a template's distinct words. Tokens are ordered by their document frequency over all documents,
rarest first. Of a template only the prefix enters the join (a block without any of its ``size - overlap + 1``
rarest words can't match); length filter (the block must have ``overlap`` template words) and positional filter
(words that can still follow in both) prune before the match is verified on the whole sets. Blocks are twice as
long as the longest template and start at every word. Only those that begin with a template word and hold one of a
prefix are formed: any other match has its words in one of these too.

The templates are a fixed list, so their index is a few hundred rows at most and is broadcast; rows of a document
are combined before they are shuffled.

Cases: null and empty texts have no words, no place and empty labels, score 0; repeated rows each return a row;
texts of any length are scanned whole; an empty table returns an empty table; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import ascii_lower
from netquill.llm.exact_stream import located

# Base phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# License notices in their usual words.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def places(words: Column, phrase: list[str]) -> Column:
    """Starts (from 0) at which the words of ``phrase`` stand consecutively."""

    def here(i: Column) -> Column:
        same = [F.element_at(words, (i + k + 1).cast("int")) == w for k, w in enumerate(phrase)]
        out = same[0]
        for s in same[1:]:
            out = out & s
        return out

    last = F.size(words) - len(phrase)
    found = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)
    present = F.lit(True)
    for w in set(phrase):
        present = present & F.array_contains(words, w)
    return F.when(present & (last >= 0), found).otherwise(F.array().cast("array<int>"))


def token_order(words: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words by the number of rows of ``words`` (column words) that have them, rarest first."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    seen = words.select(F.explode(F.array_intersect(_strings(vocabulary), F.col("words"))).alias("w")).groupBy("w").count()
    n = {r["w"]: r["count"] for r in seen.collect()}  # at most the fixed vocabulary
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    templates = TEMPLATES if templates is None else templates
    order = token_order(docs.select(words_of(F.col(text_col)).alias("words")), templates)
    rank = {w: i for i, w in enumerate(order)}
    longest = max((len(t.split()) for _, t in templates), default=1)
    prefixes, entries = set(), []
    for n, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        overlap = max(1, math.ceil(threshold * len(tokens) - 1e-9))
        for i, w in enumerate(tokens[: len(tokens) - overlap + 1]):
            prefixes.add(w)
            entries.append(F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(w).alias("word"), F.lit(i).alias("i"), _strings(tokens).alias("tokens"), F.lit(len(tokens)).alias("size"), F.lit(overlap).alias("overlap")))
    if not entries:
        raise ValueError("no template")
    lookup = docs.sparkSession.range(1).select(F.inline(F.array(*entries)))

    base = located(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "at").select("id", "at", words_of(F.col("text")).alias("words"))
    found = [places(F.col("words"), p.split()).alias(f"p{k}") for k, (p, _) in enumerate(PHRASES)]
    candidate = F.arrays_overlap(F.col("words"), _strings(sorted(prefixes)))
    among = lambda i, chosen: F.array_contains(_strings(sorted(chosen)), F.element_at("words", (i + 1).cast("int")))
    rare = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), lambda i: among(i, prefixes))
    starts = F.array_distinct(F.flatten(F.transform(rare, lambda q: F.filter(F.sequence(F.greatest(q - (2 * longest - 1), F.lit(0)), q), lambda s: among(s, order)))))
    blocks = F.transform(starts, lambda s: F.array_join(F.array_intersect(_strings(order), F.slice(F.col("words"), s + 1, 2 * longest)), " "))
    blocks = F.when(candidate, F.array_distinct(blocks)).otherwise(F.array().cast("array<string>"))
    rows = base.select("id", "at", F.size("words").alias("n_words"), *found, blocks.alias("blocks"))
    every = F.concat(*(F.col(f"p{k}") for k in range(len(PHRASES))))
    labels = F.concat(*(F.when(F.size(f"p{k}") > 0, _strings([label])).otherwise(_strings([])) for k, (_, label) in enumerate(PHRASES)))
    rows = rows.select("id", "at", "n_words", every.alias("all"), F.array_sort(F.array_distinct(labels)).alias("base"), F.explode_outer("blocks").alias("block")).withColumn("block", F.split("block", " "))
    rows = rows.select("id", "at", "n_words", "all", "base", "block", F.posexplode_outer("block").alias("j", "token"))
    shared = F.size(F.array_intersect(F.col("tokens"), F.col("block")))
    rest = F.least(F.col("size") - F.col("i"), F.size("block") - F.col("j"))  # this word and what can follow it in both
    joined = rows.join(F.broadcast(lookup), (F.col("token") == F.col("word")) & (F.size("block") >= F.col("overlap")) & (rest >= F.col("overlap")) & (shared >= F.col("overlap")), "left")
    out = joined.groupBy("id", "at", "n_words", "all", "base").agg(F.max(shared / F.col("size")).alias("best"), F.collect_set("label").alias("found"))
    n_base = F.size("all")
    return out.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_base.cast("long").alias("n_base"),
        F.array_min("all").cast("long").alias("first_word"), F.array_max("all").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the same rows: the block from every word on is compared with every template, without filters. Sets of words
    are bit sets over the templates' words, 62 to a number."""
    longest = max(len(t.split()) for _, t in TEMPLATES)
    words = sorted({w for _, t in TEMPLATES for w in t.split()})
    parts = range(-(-len(words) // 62))
    mask = lambda some: [sum(1 << (i % 62) for i, w in enumerate(words) if w in some and i // 62 == k) for k in parts]
    numbers = lambda some: ", ".join(f"{x}::BIGINT" for x in mask(some))
    columns = ", ".join(f"m{k}" for k in parts)
    vocabulary = ", ".join(f"('{w}', {numbers({w})})" for w in words)
    values = ", ".join(f"('{label}', {numbers(set(t.split()))}, {len(set(t.split()))}, {max(1, math.ceil(threshold * len(set(t.split())) - 1e-9))})" for label, t in TEMPLATES)
    window = f"OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {2 * longest - 1} FOLLOWING)"
    held = ", ".join(f"bit_or(coalesce(m{k}, 0)) {window} AS b{k}" for k in parts)
    common = " + ".join(f"bit_count(b{k} & m{k})" for k in parts)
    places_sql = " + ".join(
        f"[{{'s': i, 'l': '{label}'}} FOR i IN range(0, len(w) - {len(p.split()) - 1}) IF " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + "]" for p, label in PHRASES
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT *, {places_sql} AS p FROM d),
t AS (SELECT * FROM (VALUES {values}) AS t(label, {columns}, size, least)),
v AS (SELECT * FROM (VALUES {vocabulary}) AS v(word, {columns})),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
blocks AS (SELECT rid, {held} FROM x LEFT JOIN v ON v.word = x.word),
m AS (SELECT rid, label, {common} AS n, size FROM blocks, t WHERE {common} >= least),
g AS (SELECT rid, max(n / size) AS best, list(DISTINCT label) AS found FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min([x.s FOR x IN p])::BIGINT AS first_word, list_max([x.s FOR x IN p])::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct([x.l FOR x IN p])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct([x.l FOR x IN p] || coalesce(found, []))), ',') AS labels,
       CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM b LEFT JOIN g USING (rid)
"""
