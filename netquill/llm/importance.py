"""Importance resampling towards a target distribution of hashed n-grams.

A document's features are its runs of 1 to ``longest`` words; each has a bucket, the CRC-32 of its bytes. The gain of a
bucket says how much likelier it is in the target texts than in the documents, a document's weight is the mean gain of its
features, and seeded Gumbel noise on the weights makes the highest scores a weighted sample without replacement.

Each task takes its documents in chunks of about ``chunk_chars`` characters. The words of a chunk become numbers, and their
suffix array puts equal runs of words side by side: where the longest common prefix of neighbours has k words, both begin
with the same k-gram. Each run of the array is hashed once, continuing the checksum of its prefix, and its bucket is
scattered back to all places of the run. Suffixes are ordered by their first ``longest`` words, which is all that the
common prefixes need. The texts are passed over twice, first for the counts (as many as buckets a task), then for the scores.

Cases: null and empty texts have no features and weight 0; an empty target gives every bucket its share of smoothing; texts
of any length are taken whole; repeated rows each get a score; equal scores go to smaller identifiers, null ones last (their
noise is that of the text ''); empty tables give empty tables; only the named columns are read, so others may clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import materialize
from netquill.plans.checkpoint import row_numbers

CHUNK_CHARS = 4_000_000
#: Bytes that words have; A-Z are lowered, everything else parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_WORDS).split() if text else []


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``x`` in the order of what begins there, by its first ``depth`` numbers at least (an end is smaller than any
    number): ranks of twice the length are made of two ranks until they reach so far."""
    rank, reach = x.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while reach < depth and len(x):
        after = np.zeros(len(x), np.int64)
        after[:-reach] = rank[reach:]
        pair = rank * (int(rank.max()) + 1) + after
        order = np.argsort(pair, kind="stable")
        rank = np.empty(len(x), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], np.diff(pair[order]) != 0]))
        reach *= 2
    return order


def common_prefixes(x: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many numbers, at most ``depth``, each suffix shares with the one before it in ``order``; 0 (the end of a text) is equal
    to nothing."""
    padded = np.concatenate([x, np.zeros(depth, x.dtype)])
    out, same = np.zeros(len(x), np.int64), np.ones(max(len(x) - 1, 0), bool)
    for k in range(depth):
        at = padded[order + k]
        same &= (at[1:] == at[:-1]) & (at[1:] != 0)
        out[1:] += same
    return out


def buckets_of(texts: list[list[bytes]], longest: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(for k = 1 .. ``longest`` the bucket of the k-gram at each place, -1 where the text ends before; the first place of each text
    and the end). Every text has a place more than it has words."""
    number: dict[bytes, int] = {}
    for t in texts:
        for w in t:
            number.setdefault(w, len(number) + 1)
    vocabulary = [b"", *number]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    edges = np.concatenate([[0], np.cumsum(sizes)])
    x = np.zeros(int(edges[-1]), np.int64)
    for t, a in zip(texts, edges.tolist(), strict=False):
        x[a : a + len(t)] = np.fromiter(map(number.__getitem__, t), np.int64, len(t))
    order = suffix_array(x, longest)
    prefix = common_prefixes(x, order, longest)
    left = np.repeat(edges[1:] - 1, sizes) - np.arange(len(x))  # words from a place to its text's end
    out, checksum = [], np.zeros(len(x), np.int64)  # of the (k-1)-gram, in the array's order
    for k in range(1, longest + 1):
        begins = np.flatnonzero(prefix < k)  # a run of equal k-grams begins; those that a text's end cuts are runs of one
        whole = begins[left[order[begins]] >= k]
        gap = b" " if k > 1 else b""
        last = x[order[whole] + k - 1].tolist()
        crc = np.full(len(begins), -1, np.int64)
        crc[left[order[begins]] >= k] = [zlib.crc32(gap + vocabulary[w], c) for w, c in zip(last, checksum[whole].tolist(), strict=True)]
        checksum = np.repeat(crc, np.diff(np.append(begins, len(x))))
        bucket = np.full(len(x), -1, np.int64)
        bucket[order] = np.where(checksum >= 0, checksum % buckets, -1)
        out.append(bucket)
    return out, edges


def _chunks(batches, chunk_chars: int):
    """(columns, words of each text) of so many rows that their texts have about ``chunk_chars`` characters. The text is the last
    column."""
    columns, texts, chars = [], [], 0
    for batch in batches:
        start = 0
        for r, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            texts.append(words_of(t))
            chars += len(t or "") + 1
            if chars >= chunk_chars:
                columns.append(batch.slice(start, r + 1 - start))
                yield pa.Table.from_batches(columns), texts
                columns, texts, chars, start = [], [], 0, r + 1
        if start < batch.num_rows:
            columns.append(batch.slice(start))
    if texts:
        yield pa.Table.from_batches(columns), texts


def bucket_counts(texts: DataFrame, longest: int = 2, buckets: int = 10_000, text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(bucket, n): how many features of all texts each bucket has, where it has any."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for _, words in _chunks(batches, chunk_chars):
            for b in buckets_of(words, longest, buckets)[0]:
                counts += np.bincount(b[b >= 0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["bucket", "n"])

    per_task = texts.select(F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "bucket long, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain): floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for every bucket, of the counts (bucket, n) of
    both sides."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))
    n = both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return n.join(F.broadcast(total)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))  # totals: one row


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the floored mean of its features' gains."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches):
        for rows, words in _chunks(batches, chunk_chars):
            by_length, edges = buckets_of(words, longest, buckets)
            total, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for b in by_length:
                ok = b >= 0
                for into, value in ((total, np.where(ok, held.value[b], 0)), (n, ok)):
                    into += np.diff(np.concatenate([[0], np.cumsum(value, dtype=np.int64)])[edges])
            weight = np.floor_divide(total, np.maximum(n, 1))
            for batch in pa.table([rows.column(0), pa.array(np.diff(edges) - 1), pa.array(n), pa.array(weight)], [id_col, "n_words", "n_features", "weight"]).to_batches():
                yield batch

    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row. Of the rows with ``least_words`` words and more, ``percent`` in a
    hundred are drawn, the highest scores first, and numbered from 1; the others' rank is null."""
    count = lambda t, col: bucket_counts(t, longest, buckets, col, chunk_chars)
    table = np.zeros(buckets, np.int64)
    for r in gains(count(docs, text_col), count(target, target_text_col), buckets).collect():  # ``buckets`` rows
        table[r["bucket"]] = r["gain"]
    w = weighted(docs, table, longest, id_col, text_col, chunk_chars)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")
    scored = materialize(w.withColumn("score", F.col("weight") + noise).withColumn("__in", F.col("n_words") >= least_words), "resample-scored")
    take = scored.where("__in").count() * percent // 100
    placed = row_numbers(scored, F.desc("__in"), F.desc("score"), F.asc_nulls_last(id_col), name="__rn")
    return placed.select(id_col, "n_words", "n_features", "weight", "score", F.when(F.col("__rn") <= take, F.col("__rn")).alias("rank"))


def oracle_sql(percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> str:
    """DuckDB SQL for the rows of :func:`resample` with runs of one and two words. The checksum is worked out bit by bit, eight
    steps a byte, for each distinct feature."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex) // 2 + 1), lambda i: ('0x' || substr(hex, 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1]))"
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws"
    runs = "unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f"
    return f"""WITH RECURSIVE crc_steps(k, v, s) AS (SELECT range::BIGINT, range::BIGINT, 0 FROM range(256) UNION ALL SELECT k, xor(v >> 1, 3988292384 * (v & 1)), s + 1 FROM crc_steps WHERE s < 8),
w AS (SELECT doc_id, rid, {words} FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)), b AS (SELECT {words} FROM benchmark),
df AS (SELECT rid, {runs} FROM w), bf AS (SELECT {runs} FROM b),
h AS (SELECT f, hex(encode(f)) AS hex, steps FROM (SELECT f FROM df UNION SELECT f FROM bf), (SELECT list(v ORDER BY k) AS steps FROM crc_steps WHERE s = 8)),
k AS (SELECT f, xor({crc}, 4294967295) % {buckets} AS bucket FROM h),
s AS (SELECT bucket, count(*) AS n FROM df JOIN k USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bf JOIN k USING (f) GROUP BY 1),
g AS (SELECT k.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS gain FROM (SELECT DISTINCT bucket FROM k) k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
d AS (SELECT rid, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d USING (rid)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id) AS rn FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {least_words} AND rn <= {percent} * (SELECT count(*) FROM x WHERE n_words >= {least_words}) // 100 THEN rn END AS rank FROM r"""
