"""URL filter: rules by host and path, and link-graph propagation for the rest.

A rule fits its host and all subdomains if the url's path starts with the rule's; the longest rule wins. The hosts
of pages that rules allow are trusted seeds and those of pages that rules block are blocked seeds, each weighted
by the share of the host's pages. Personalised PageRank (its sum over walks of every length, not scaled by 1 - damping) carries trust along host edges (a link to another host
passes its host's trust on, divided among its links) and distrust against them (who links to a blocked host is
distrusted); an isolated seed whose pages all match has the value 1. Pages without a rule are blocked if their
host's distrust exceeds its trust by ``threshold``.

Links are the absolute and protocol-relative ones in href attributes; links within a host count for nothing. Ranks
are a table of hosts; each round is an aggregate and joins, written to the shared folder, and adds the walks that are
a link longer. A round passes on at most ``damping`` of the round before, so all that is still to come to a host is less
than what walks now times damping / (1 - damping); the walks end when that can't move any host over the threshold, or
is less than a tolerance of a billionth (values that lie on the threshold to that precision count as they are then).

Cases: a null url or one without ``://`` has an empty host and path and fits no rule and is allowed; a null page has
no links; repeated rows count as pages each; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import ascii_lower, materialize
from netquill.plans.checkpoint import free

# The rules, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>]+)"""
DAMPING, THRESHOLD, TOLERANCE = 0.85, 0.5, 1e-9
SQL_ROUNDS = 200
BROADCAST_HOSTS = 100_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int | None = None) -> Column:
    """The longest fitting rule as text, or (``what`` = 0) its verdict; null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # later ones win
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, rule[1] + rule[2] if what is None else rule[what]).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(HREF), 1)
    hosts = F.array_distinct(F.transform(links, lambda x: ascii_lower(F.regexp_extract(x, "//(.*)$", 1))))
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(hosts).alias("dst"))
    return found.where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def ranks(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float | None = None) -> DataFrame:
    """(host, trust, distrust): the seeds' weights and what reaches a host from them, round by round, until what is still to come is
    less than ``tolerance``, or less than every host's distance of distrust - trust from ``threshold``. seeds: host, trust,
    distrust; edges: src, dst, n."""
    edges = materialize(edges, "host-edges")
    if edges.isEmpty():
        return seeds
    out = edges.groupBy("src").agg(F.sum("n").alias("o"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("i"))
    links, edges = edges, materialize(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("o")).alias("forth"), (F.col("n") / F.col("i")).alias("back")), "host-edges")
    free(links)
    seeds = materialize(seeds, "host-seeds")
    now = total = seeds
    while True:
        forth = edges.join(now.where("trust > 0"), F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("forth") * F.col("trust") * damping).alias("trust"), F.lit(0.0).alias("distrust"))
        back = edges.join(now.where("distrust > 0"), F.col("dst") == F.col("host")).select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("back") * F.col("distrust") * damping).alias("distrust"))
        both = lambda d: d.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        before, now = now, materialize(both(forth.union(back)), "host-ranks")
        known, total = total, materialize(both(total.union(now)), "host-ranks")
        free(before, known if known is not before else None)
        walking = now.agg(F.sum("trust"), F.sum("distrust")).first()
        to_come = max(walking[0] or 0.0, walking[1] or 0.0) * damping / (1 - damping)
        if to_come > tolerance and threshold is not None:
            margin = total.agg(F.min(F.abs(F.col("distrust") - F.col("trust") - threshold))).first()[0]
            if margin > 2 * to_come:  # the factor: rounding
                break
        if to_come <= tolerance:
            break
    free(now, edges)
    return total


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """(id, host, path, rule, verdict) of each row."""
    rules = RULES if rules is None else rules
    src = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    src = src.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), rule_of(F.col("host"), F.col("path"), rules, 0).alias("ruled"))
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = src.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    blocked = ranks(seeds, host_edges(pages, url_col, html_col), damping, threshold=threshold).where(F.col("distrust") - F.col("trust") >= threshold).select("host", F.lit("block").alias("method"))
    blocked = materialize(blocked, "blocked-hosts")
    small = blocked.count() <= BROADCAST_HOSTS  # then the pages needn't move; beyond it a sort-merge join that splits hot hosts
    return src.join(F.broadcast(blocked) if small else blocked, "host", "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "method", F.lit("allow")).alias("verdict"))


def oracle_sql() -> str:
    """DuckDB SQL for the same rows; the walks from the seeds by recursion, ``SQL_ROUNDS`` rounds without another end."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    order = sorted(RULES, key=lambda r: -(len(r[1]) + len(r[2])))

    def case(what) -> str:
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, h, p)}'" for v, h, p in order) + " END"

    href = HREF.replace("'", "''")
    return f"""
WITH RECURSIVE u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{upper}', '{lower}') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
r AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM u),
s AS (SELECT host, avg((coalesce(ruled, '') = 'allow')::INT) AS trust, avg((coalesce(ruled, '') = 'block')::INT) AS distrust FROM r WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, unnest(list_distinct([translate(regexp_extract(x, '//(.*)$', 1), '{upper}', '{lower}') FOR x IN regexp_extract_all(coalesce(html, ''), '{href}', 1)])) AS dst FROM u),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
w AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM e),
a AS (SELECT src AS at, dst AS host, {DAMPING} * forth AS forth, 0.0::DOUBLE AS back FROM w UNION ALL SELECT dst, src, 0, {DAMPING} * back FROM w),
p AS (SELECT 0 AS k, host, trust, distrust FROM s
  UNION ALL SELECT k + 1, a.host, sum(forth * trust), sum(back * distrust) FROM p JOIN a ON a.at = p.host WHERE k < {SQL_ROUNDS} GROUP BY k, a.host),
f AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM p GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN f.distrust - f.trust >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN f ON r.host = f.host
"""
