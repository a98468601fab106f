"""How the sources of each language differ in their words: shards aggregated by DuckDB, merged by Spark.

1. Tasks count the terms of their rows, combined for each language and source before anything is shuffled.
2. Counts are dealt into shards by the hash of language and term, so that a shard has all of a term. In each shard DuckDB
   sums them and keeps the terms that enough documents of the language have; Spark adds up the sizes of groups and
   vocabularies.
3. Kept counts are dealt the same way, with the sizes joined. In each shard DuckDB works out how often the counts 1, 2, ..
   stand, for each pair of sources what their common terms add, and the first terms of each source.
4. Spark sums the pairs and ranks. A term that neither source has adds the same everywhere, one that a single source has
   depends on its count only; so only common terms are paired, and terms that aren't there are never written out.

All arithmetic is on integers. A shard holds the kept counts of its terms, so more shards make them smaller; DuckDB has a
bound on its memory and beyond it goes to the worker's scratch folder, which is deleted with it. The pairs of sources of a
language are the result's own size.

Cases: null texts, languages and sources are ''; every row is a document of its own, repeated ones too; empty texts give
their group without terms; a language without kept terms has values of 0; equal values are ranked by the item's bytes; very
long texts and terms are taken whole; an empty table gives an empty table; only the named columns are read, so others may
clash.
"""

from __future__ import annotations

import tempfile
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.llm.common import materialize, shared

FLUSH_TERMS = 400_000  # distinct terms that a task counts before it sends them on
DUCK_MEMORY = "600MB"
SCALE = 1_000_000_000  # fixed value: probabilities are counted in billionths
#: Bytes that terms have; A-Z are lowered, everything else parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(rows: DataFrame, flush: int = FLUSH_TERMS) -> DataFrame:
    """(lang, source, term, n, docs) of ``rows`` (lang, source, text), in parts to be added up: occurrences and documents. Every
    group has a row without term too."""

    def run(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def sent():
            for (lang, source), (n, docs) in groups.items():
                terms = [None, *(t.decode("utf-8") for t in n)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs = groups.setdefault((lang or "", source or ""), (Counter(), Counter()))
                terms = text.encode("utf-8").translate(_TERMS).split() if text else []
                size -= len(n)
                n.update(terms)
                docs.update(set(terms))
                size += len(n)
                if size >= flush:
                    yield from sent()
                    groups, size = {}, 0
        yield from sent()

    return rows.mapInArrow(run, COUNTS)


def in_duckdb(shards: DataFrame, sql: list[str], schema: str) -> DataFrame:
    """The rows of the last statement of ``sql`` on each partition of ``shards``, which DuckDB sees as ``shard``."""
    kinds = shards.schema

    def run(batches):
        import duckdb
        from pyspark.sql.pandas.types import to_arrow_schema

        with tempfile.TemporaryDirectory() as spill, duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": spill}) as con:
            con.register("shard", pa.RecordBatchReader.from_batches(to_arrow_schema(kinds), (pa.RecordBatch.from_arrays(b.columns, names=kinds.names) for b in batches)))
            for statement in sql[:-1]:
                con.execute(statement)
            for batch in con.sql(sql[-1]).to_arrow_reader(50_000):
                yield batch

    return shards.mapInArrow(run, schema)


#: Kept counts of a shard; rows without term: every group (n = 0), and with neither source how many terms are kept.
KEEP_SQL = [
    "CREATE TABLE c AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM shard GROUP BY ALL",
    "CREATE TABLE t AS SELECT lang, term FROM c WHERE term IS NOT NULL GROUP BY ALL HAVING sum(docs) >= {least}",
    """SELECT lang, source, term, n FROM c SEMI JOIN t USING (lang, term) UNION ALL SELECT lang, source, NULL, 0 FROM c WHERE term IS NULL
    UNION ALL SELECT lang, NULL, NULL, count(*)::BIGINT FROM t GROUP BY lang""",
]

_P = f"(1 + ({SCALE}::HUGEINT * ({{n}} + 2)) // ({{all}} + 2 * kept))::BIGINT"

#: Partial sums of a shard. Of kind pair: what the common terms of two sources add beyond either's own; of kind count: how many
#: terms a source has n times; of kind term: its first terms.
SUM_SQL = [
    "CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // (p + q)",
    f"CREATE TABLE c AS SELECT lang, source, term, n, {_P.format(n='n', all='size')} AS p, {_P.format(n='0', all='size')} AS p0, {_P.format(n='sum(n) OVER (PARTITION BY lang, term)', all='lang_size')} AS q FROM shard",
    """SELECT 'pair' AS kind, a.lang, a.source, b.source AS item, NULL::BIGINT AS n, sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::BIGINT AS value
    FROM c AS a JOIN c AS b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
    UNION ALL SELECT 'count', lang, source, NULL, n, count(*)::BIGINT FROM c GROUP BY ALL
    UNION ALL SELECT 'term', lang, source, term, NULL, value FROM (SELECT *, f(p, q) AS value FROM c WHERE p > q) QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}""",
]


def _p(n: Column | str, size: Column | str, kept: Column | str) -> Column:
    """Probability in billionths; decimals, since counts of any size are scaled."""
    d = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    return F.try_add(F.lit(1), F.call_function("div", (d(n) + 2) * F.lit(SCALE).cast("decimal(10,0)"), d(size) + d(kept) * 2))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank). Part pair: the divergence of a source from each other source of its language, largest
    first; part term: the ``top`` terms that set a source apart from its language."""
    rows = docs.select(*(F.col(c).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    first = [s.format(least=least_docs) for s in KEEP_SQL]
    kept = materialize(in_duckdb(term_counts(rows).repartition("lang", "term"), first, "lang string, source string, term string, n long"), "kept-terms")
    sizes = kept.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("size"))
    kept_of = kept.where("source IS NULL").groupBy("lang").agg(F.sum("n").alias("kept"))
    groups = sizes.join(sizes.groupBy("lang").agg(F.sum("size").alias("lang_size")), "lang").join(kept_of, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    groups = materialize(groups, "groups")
    counted = kept.where("term IS NOT NULL").join(shared(groups), ["lang", "source"])
    second = [s.format(top=top) if k == 2 else s for k, s in enumerate(SUM_SQL)]
    sums = materialize(in_duckdb(counted.repartition("lang", "term"), second, "kind string, lang string, source string, item string, n long, value long"), "term-sums")

    group = groups.where("kept > 0").select("lang", "source", "size", "kept", _p(F.lit(0), "size", "kept").alias("p0"))
    other = group.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    same_lang = group.join(other, "lang").where("source != item").withColumn("both0", _f(F.col("p0"), F.col("q0")))  # the result's pairs
    counts = sums.where("kind = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("terms"))
    own = counts.join(same_lang, ["lang", "source"]).select("lang", "source", "item", (F.col("terms") * (_f(_p("n", "size", "kept"), F.col("q0")) - F.col("both0"))).alias("value"))
    common = sums.where("kind = 'pair'").select("lang", "source", "item", "value")
    turned = lambda t: t.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    everywhere = same_lang.select("lang", "source", "item", (F.col("kept") * F.col("both0")).alias("value"))
    empty = groups.where("kept = 0")
    without = empty.join(empty.select("lang", F.col("source").alias("item")), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    parts = everywhere
    for more in (own, turned(own), common, turned(common), without):
        parts = parts.unionByName(more)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = sums.where("kind = 'term'").select("lang", "source", "item", "value", F.lit("term").alias("part"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def oracle_sql(least_docs: int = 10, top: int = 10) -> str:
    """DuckDB SQL for the rows of :func:`audit`, with every term written out for every source."""
    p = lambda n, size: f"1 + ({SCALE}::HUGEINT * ({n} + 2)) // ({size} + 2 * kept)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {least_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS kept FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d), s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL), l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL), ls AS (SELECT lang, sum(n) AS size FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "coalesce(s.size, 0)")} AS p, {p("l.n", "ls.size")} AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN l ON l.lang = g.lang AND l.term = k.term JOIN ls ON ls.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
      UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {top}"""
