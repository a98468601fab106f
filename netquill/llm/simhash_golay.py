"""SimHash near-duplicates by Golay-code fuzzy hashing.

The perfect binary Golay code [23, 12, 7] puts every 23-bit word within 3 bits of exactly one of 4096 codewords.
A segment of a fingerprint (padded with zeros to 23 bits) is decoded to the indices of codewords nearby: the
nearest, and all within 4 bits, of which there are 1 or 6. If two segments differ in at most one bit, the
nearest codeword of either is within 4 bits of the other, so an index row (nearest) and a query row (all
nearby) meet.

*Links up to 3 bits* (:func:`links_within_3`, :func:`connecting_within_3`). A 64-bit fingerprint has three segments. Of at most 3
errors either one segment has none and another one at most, or each has exactly one. So the keys are, for the first case, a
segment as it is with a codeword of another (6 ordered pairs), and for the second, codewords of the first two segments with
one half of the third as it is, of which a half is without error (2 halves): 8 index rows and at most 108 query rows a
distinct fingerprint, of keys of 33 and 34 bits, so that unrelated fingerprints seldom meet among less than 10^10.
Candidates are verified in the join. Equal fingerprints are one node, so copies are never paired.

*Groups by similarity* (:func:`drop_near_copies`). For a Jaccard similarity of 0.8 and more a wide fingerprint is
used: 27 segments of 23 bits, and a key for each pair of neighbouring segments (both nearest codewords). The fingerprint
takes each shingle once, as the similarity does. A star in each bucket gathers close copies with a link for each. The keys
are a locality-sensitive hash, so what they miss is found by an exact set-similarity join (:func:`across`).

For that the shingles of all documents are counted and put in one order, rarest first; two sets of a similarity s share
one of the first n - ceil(s n) + 1 of either. Counting deals the hashes of all shingles by their bits, packed; very
frequent ones, which a sample shows, aren't dealt (no task may get a third of all rows) but come last in the order. Of what
is counted only shingles that several rows have come back. In each bucket a star around the node in whose order the
shingle comes first, which is the one with the fewest rare shingles, gathers what is linked; then every two nodes of
different components meet. Sizes, the shingles that no other component has, and a sketch of each set (a bit for each
residue of the hashes, set if an odd number of shingles has it: two sets differ in at least as many shingles as their
sketches in bits) rule pairs out within the join, and what their prefixes share after it. None of these loses a pair. All
candidates are verified on their whole shingle sets.

A node is a set of shingles (equal sets are copies); whatever else is linked was verified.

Cases: null and empty texts have fingerprint zero, which links like any other; texts with fewer words than a
shingle are one shingle; repeated rows share their fingerprint; null identifiers never name a component that has
another; an empty table returns an empty table; only the named columns are read.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.llm.common import materialize, merged, shared
from netquill.llm.exact_stream import located, unused
from netquill.operators.components import components
from netquill.plans.checkpoint import free, row_numbers

SEED = 42
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS_64 = ((0, 22), (22, 21), (43, 21))  # first bit and width
WIDE_WORDS, WIDE_SEGMENTS = 10, 27


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each syndrome: the error pattern, and the codeword indices to add for all codewords within 4 bits (-1: none)."""
    leader = np.zeros(2048, np.int64)
    for weight in range(4):
        errors = np.array([sum(1 << b for b in c) for c in itertools.combinations(range(23), weight)], np.int64)
        leader[_syndrome(errors)] = errors
    message = np.arange(4096, dtype=np.int64) << 11
    code = message | _syndrome(message)
    seven = code[np.bitwise_count(code) == 7]
    near = np.full((2048, 6), -1, np.int64)
    near[:, 0] = 0
    for s in range(2048):
        e = leader[s]
        if int(e).bit_count() == 3:
            near[s, 1:] = seven[(seven & e) == e] >> 11
    return leader, near


LEADER, NEAR = _tables()


def nearest(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the nearest codeword of each 23-bit word."""
    return (v ^ LEADER[_syndrome(v)]) >> 11


def nearby(v: np.ndarray) -> np.ndarray:
    """Indices of all codewords within 4 bits of each word, 6 columns, -1 where there are fewer."""
    s = _syndrome(v)
    add = NEAR[s]
    return np.where(add < 0, -1, ((v ^ LEADER[s]) >> 11)[:, None] ^ add)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    stops = ends[size - 1 :] if len(words) >= size else ends[-1:]
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)], np.uint64)


def _mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


CHUNK, LONG = 1 << 16, 1 << 13  # bytes of a text, of a word
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BYTES = _mixed_bits(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.cache
def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def _hashes(joined: bytes, size: int) -> np.ndarray:
    """A polynomial hash of the bytes of each shingle of words that single blanks separate."""
    c = np.frombuffer(joined, np.uint8)
    gap = np.flatnonzero(c == 32)
    start, end = np.append(0, gap + 1), np.append(gap, len(c))
    n = max(1, len(start) - size + 1)
    up, down = _both_powers(1 << (len(c)).bit_length())
    sums = np.empty(len(c) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[c] * up[: len(c)], out=sums[1:])
    first, last = start[:n], end[min(size, len(start)) - 1 :]
    return _mixed_bits((sums[last] - sums[first]) * down[first])


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; texts are worked off in chunks, which overlap by a shingle less a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(joined) > LONG:  # a word of any length takes little room
        words = [w if len(w) <= LONG else xxhash.xxh3_128_hexdigest(w).encode() for w in words]
        joined = b" ".join(words)
    if len(joined) <= CHUNK:
        return np.unique(_hashes(joined, size))
    parts, at, step = [], 0, max(size, len(words) * CHUNK // len(joined))
    while at == 0 or at + size <= len(words):
        parts.append(_hashes(b" ".join(words[at : at + step + size - 1]), size))
        at += step
    return np.unique(np.concatenate(parts))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; a bit is set if it is in over half the hashes. The first word takes the hashes as they are."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    h = np.empty((len(hashes), words), np.uint64)
    h[:, 0] = hashes
    for k in range(1, words):
        h[:, k] = _mixed_bits(h[:, k - 1])
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(h), 255 * 64):
        bits = np.unpackbits(h[i : i + 255 * 64].view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def prints(rows: DataFrame, shingle: int, words: int = 1) -> DataFrame:
    """``rows``: id, at, text. (id, at, f0, f1, ...) of each row."""
    names = [f"f{k}" for k in range(words)]

    def run(batches):
        for batch in batches:
            got = np.stack([fingerprint(shingle_hashes(t, shingle), words) for t in batch.column(2).to_pylist()]).view(np.int64) if batch.num_rows else np.zeros((0, words), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[:, k]) for k in range(words))], ["id", "at", *names])

    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInArrow(run, f"id {kinds[0]}, at {kinds[1]}, " + ", ".join(f"{n} long" for n in names))


def frequent(rows: DataFrame, shingle: int, sample: int = 10_000, least: int = 10, most: int = 500_000) -> np.ndarray:
    """Shingles that ``least`` of about ``sample`` rows of ``rows`` (node, text) have, rarest first. They aren't dealt out to be
    counted; which ones are here decides about the order only."""

    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], ["s"])

    some = rows.where(F.pmod(F.xxhash64("node"), F.lit(max(1, rows.count() // sample))) == 0).select("text").mapInArrow(run, "s long")
    got = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "s").limit(most).toArrow()
    return got.column("s").to_numpy().view(np.uint64)[::-1].copy()


def _ranks(often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(often)
    return often[order], order.astype(np.int64)


def _rank(hashes: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The place of each hash among the frequent ones, -1 where it isn't one."""
    if not len(often[0]) or not len(hashes):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(often[0], hashes), len(often[0]) - 1)
    return np.where(often[0][at] == hashes, often[1][at], -1)


def prefix_length(n: Column, similarity: float) -> Column:
    return n - F.ceil(similarity * n - 1e-9) + 1


def sketch(hashes: np.ndarray, words: int = WIDE_WORDS) -> np.ndarray:
    """A bit for each residue of the hashes: whether an odd number of them has it."""
    odd = np.bincount(((hashes >> np.uint64(7)) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


FREQUENT = 1 << 62  # keys of frequent shingles; those of others, a count and a part of the hash, are below


def set_prints(rows: DataFrame, shingle: int, words: int, similarity: float, often: np.ndarray | None = None) -> DataFrame:
    """``rows``: id, node, text. (id, node, d0, d1, f0, ..., q0, ..., n, c, last) of each row; d0 and d1: a 128-bit digest of its set
    of shingles; f0, ...: the fingerprint of the set, each shingle once; q0, ...: its sketch; n: their number; c: how many aren't
    frequent; last: the keys of the frequent ones that the prefix reaches to."""
    names = [f"f{k}" for k in range(words)] + [f"q{k}" for k in range(words)]
    held = rows.sparkSession.sparkContext.broadcast(_ranks(np.zeros(0, np.uint64) if often is None else often))

    def run(batches):
        for batch in batches:
            got, n, c, last = np.zeros((batch.num_rows, 2 + 2 * words), np.uint64), [], [], []
            for r, t in enumerate(batch.column(2).to_pylist()):
                distinct = shingle_set(t, shingle)
                got[r, :2] = np.frombuffer(xxhash.xxh3_128_digest(distinct.tobytes(), SEED), np.uint64)
                got[r, 2 : 2 + words] = fingerprint(distinct, words)
                got[r, 2 + words :] = sketch(distinct, words)
                rank = _rank(distinct, held.value)
                rank = np.sort(rank[rank >= 0])
                n.append(len(distinct))
                c.append(len(distinct) - len(rank))
                reach = len(distinct) - math.ceil(similarity * len(distinct) - 1e-9) + 1 - c[-1]
                last.append((FREQUENT + rank[: max(0, reach)]).tobytes())
            got = got.view(np.int64)
            columns = [batch.column(0), batch.column(1), *(pa.array(got[:, k]) for k in range(2 + 2 * words)), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(last, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "d0", "d1", *names, "n", "c", "last"])

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, node long, d0 long, d1 long, " + ", ".join(f"{n} long" for n in names) + ", n long, c long, last binary")


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit numbers, all first ones, then all second ones: equal bytes stand together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


TOKENS_A_TASK = 1_000_000
TOKENS_A_BLOCK = 250_000


def shared_shingles(rows: DataFrame, shingle: int, often: np.ndarray, tokens: int) -> DataFrame:
    """(node, key) of each shingle of ``rows`` (node, text) that several rows have and that isn't frequent, the key being its number
    of rows and a part of its hash. ``tokens``: how many shingles there are about, which sets the number of tasks and bytes."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // TOKENS_A_TASK))
    width = min(7, max(5, -(-(tokens.bit_length() + 7) // 8)))  # of less than one in a hundred the rest of the hash is another's
    held = spark.sparkContext.broadcast(_ranks(often))

    def blocks(s: list, node: list, size: list):
        h, of = np.concatenate(s), np.repeat(np.array(node, np.int64), size)
        to = (h >> np.uint64(8)) % np.uint64(4 * parts)
        order = np.argsort(to, kind="stable")
        h, of, to = h[order], of[order], to[order].astype(np.int64)
        ends = np.append(np.flatnonzero(np.diff(to)) + 1, len(to)).tolist()
        begins = [0, *ends[:-1]]
        low = h >> np.uint64(64 - 8 * width)
        yield pa.RecordBatch.from_arrays([pa.array(to[begins].astype(np.int32)), pa.array([_planes(low[a:b], width) for a, b in zip(begins, ends, strict=True)], pa.binary()), pa.array([_planes(of[a:b], 8) for a, b in zip(begins, ends, strict=True)], pa.binary())], ["part", "s", "nodes"])

    def dealt(batches):
        s, node, size, held_now = [], [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingle_set(t, shingle)
                h = h[_rank(h, held.value) < 0]
                if len(h):
                    s.append(h)
                    node.append(i)
                    size.append(len(h))
                    held_now += len(h)
                if held_now >= TOKENS_A_BLOCK:
                    yield from blocks(s, node, size)
                    s, node, size, held_now = [], [], [], 0
        if s:
            yield from blocks(s, node, size)

    def counted(batches):
        s, node = [], []
        for batch in batches:
            s += [_unplaned(x, width) for x in batch.column(1).to_pylist()]
            node += [_unplaned(x, 8) for x in batch.column(2).to_pylist()]
        if not s:
            return
        s, node = np.concatenate(s), np.concatenate(node)
        order = np.argsort(s, kind="stable")
        s, node = s[order], node[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        n = np.diff(np.append(first, len(s)))
        some = np.repeat(n > 1, n)
        key = (np.minimum(np.repeat(n, n)[some], (1 << (62 - 8 * width)) - 1).astype(np.int64) << (8 * width)) | s[some].astype(np.int64)
        node = node[some].astype(np.int64)
        order = np.argsort(node, kind="stable")  # rows of a node together take less room
        for a in range(0, len(key), 100_000):
            at = order[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(key[at])], ["node", "key"])

    out = rows.select("node", "text").mapInArrow(dealt, "part int, s binary, nodes binary")
    return out.repartition(parts, "part").mapInArrow(counted, "node long, key long")


def prefixes(nodes: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """(s, node, n, i) of the shingles s in the prefixes of ``nodes`` (node, n, c, last) that other rows have, too; i: their place.
    ``keys``: node, key of all that aren't frequent. What no other row has comes first."""
    w = W.partitionBy("node")
    place = F.col("c") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy("key")) - 1
    rare = keys.join(nodes.select("node", "n", "c"), "node").withColumn("i", place).where(F.col("i") < prefix_length(F.col("n"), similarity)).select(F.col("key").alias("s"), "node", "n", "i")

    def run(batches):
        for batch in batches:
            last = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            size = [len(x) for x in last]
            if sum(size):
                node, n, c = (np.repeat(batch.column(k).to_numpy(), size) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(last), node, n, c + np.concatenate([np.arange(k) for k in size]))], ["s", "node", "n", "i"])

    return rare.union(nodes.where("length(last) > 0").select("node", "n", "c", "last").mapInArrow(run, "s long, node long, n long, i long"))


def _segment_keys(batches, query: bool):
    """(key, f, root) of rows (f, root)."""
    for batch in batches:
        f, root = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        seg = [((f >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS_64]
        each = [nearby(s) for s in seg] if query else [nearest(s)[:, None] for s in seg]
        for family, (i, j) in enumerate(itertools.permutations(range(3), 2)):  # segment i without error, j with one at most
            key = np.where(each[j] < 0, -1, (family << 36) | (seg[i][:, None] << 12) | each[j])
            yield _keyed(key, f, root)
        a, b = each[0][:, :, None], each[1][:, None, :]
        both = np.where((a < 0) | (b < 0), -1, (a << 12) | b).reshape(len(f), -1)
        for family, half in ((6, seg[2] & 1023), (7, seg[2] >> 10)):  # one error in each segment, so none in a half of the third
            yield _keyed(np.where(both < 0, -1, (family << 36) | (half[:, None] << 24) | both), f, root)


def _keyed(key: np.ndarray, f: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    at = np.nonzero(key >= 0)
    return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(f[at[0]].view(np.int64)), pa.array(root[at[0]])], ["key", "f", "root"])


def _rows(rooted: DataFrame, query: bool) -> DataFrame:
    return rooted.mapInArrow(lambda x: _segment_keys(x, query), "key long, f long, root long")


def _spread(nodes: DataFrame) -> DataFrame:
    """A number of partitions, so that few large tasks aren't made of them."""
    return nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.columns[0])


def _bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links_within_3(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b of every two of the distinct fingerprints ``nodes`` (one long column) that differ in 1 to 3 bits."""
    one = _spread(nodes.select(F.col(nodes.columns[0]).alias("f"))).select("f", F.col("f").alias("root"))
    index = _rows(one, False).select("key", F.col("f").alias("b"))
    query = _rows(one, True).select("key", F.col("f").alias("a"))
    return query.join(merged(index), (query.key == index.key) & (F.col("a") < F.col("b")) & (_bits("a", "b") <= 3)).select("a", "b").distinct()


def connecting_within_3(nodes: DataFrame) -> DataFrame:
    """(a, b): links of at most 3 bits that connect the same components as all of them, without the pairs inside a dense group.

    A star around the smallest and one around the largest index row of each bucket gather dense groups first. Then only rows of
    different components are compared: in each bucket the rows of its most frequent component are never held against
    each other."""
    one = materialize(_spread(nodes.select(F.col(nodes.columns[0]).alias("f"))).select("f", F.col("f").alias("root")), "simhash-links")
    index = _rows(one, False).select("key", "f")
    ends = index.groupBy("key").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo < hi")
    star = index.join(merged(ends), "key").select(F.col("f").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where((F.col("a") != F.col("b")) & (_bits("a", "b") <= 3))
    star = materialize(star.distinct(), "simhash-links")
    roots = components(star)
    rooted = materialize(_spread(one.select("f").join(roots, F.col("f") == F.col("node"), "left").select("f", F.coalesce("root", "f").alias("root"))), "simhash-links")
    index = _rows(rooted, False)
    most = index.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    flagged = lambda d, f, r: d.join(merged(most), "key").select("key", F.col("f").alias(f), F.col("root").alias(r), (F.col("root") == F.col("most")).alias(f"{r}_most"))
    i = materialize(flagged(index, "b", "rb"), "simhash-links")
    q = materialize(flagged(_rows(rooted, True), "a", "ra"), "simhash-links")  # only rows whose key some index row has
    across = (F.col("ra") != F.col("rb")) & (_bits("a", "b") <= 3)
    pairs = q.join(merged(i.where("NOT rb_most")), "key").where(across).select("a", "b").union(q.where("NOT ra_most").join(merged(i.where("rb_most")), "key").where(across).select("a", "b"))
    return star.union(pairs)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of each row; links: fingerprints that differ in at most 3 bits."""
    rows = docs.select(F.col(id_col).alias("id"), F.lit(0).alias("at"), F.col(text_col).cast("string").alias("text"))
    p = materialize(prints(rows, shingle).select("id", "f0"), "simhash")
    least = materialize(p.groupBy("f0").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    comp = components(connecting_within_3(least.select("f0")))
    comp = materialize(comp, "simhash-roots")
    linked = least.join(shared(comp), least.f0 == comp.node).select("f0", "root", "rep")
    lowest = linked.groupBy("root").agg(F.min("rep").alias("low"))
    named = linked.join(lowest, "root").select(F.col("f0").alias("node"), "low")
    several = least.join(named, least.f0 == named.node, "left").where("n > 1 OR low IS NOT NULL").select("f0", F.coalesce("low", "rep").alias("low"))
    several = materialize(several, "simhash-components")  # all other rows are components of their own
    return p.join(shared(several), "f0", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.coalesce("low", "id").alias("component_id"))


#: Pairs of segments that make the keys: neighbours, which are enough for close copies.
NEIGHBOURS = [(i, i + 1) for i in range(WIDE_SEGMENTS - 1)]


def _wide_keys(batches, chosen: list[tuple[int, int]]):
    pairs, weights = np.array(chosen), 1 << np.arange(23, dtype=np.int64)
    for batch in batches:
        f = np.stack([batch.column(k + 1).to_numpy() for k in range(WIDE_WORDS)], 1)
        bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")[:, : 23 * WIDE_SEGMENTS]
        seg = bits.reshape(len(f), WIDE_SEGMENTS, 23).astype(np.int64) @ weights
        code = nearest(seg.reshape(-1)).reshape(seg.shape)
        key = (np.arange(len(pairs), dtype=np.int64) << 24) | (code[:, pairs[:, 0]] << 12) | code[:, pairs[:, 1]]
        node = np.repeat(batch.column(0).to_numpy(), len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(node)], ["key", "node"])


def most_bits(similarity: float, words: int = WIDE_WORDS, deviations: float = 5.0) -> int:
    """Differing bits that a pair of this Jaccard similarity stays below, but for ``deviations`` standard deviations."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(64 * words * share + deviations * math.sqrt(64 * words * share * (1 - share)))


def _keys(nodes: DataFrame, chosen: list[tuple[int, int]]) -> DataFrame:
    names = [f"f{k}" for k in range(WIDE_WORDS)]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that few large tasks aren't made of them
    return nodes.select("node", *names).repartition(parts, "node").mapInArrow(lambda x: _wide_keys(x, chosen), "key long, node long")


def _measured(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """``pairs`` (node, hub) with far, the number of bits in which their fingerprints differ, at most ``most``."""
    names = [f"f{k}" for k in range(WIDE_WORDS)]
    left = nodes.select("node", *(F.col(c).alias(f"a{c}") for c in names))
    right = nodes.select(F.col("node").alias("hub"), *(F.col(c).alias(f"b{c}") for c in names))
    far: Column = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in names), F.lit(0))
    return pairs.join(left, "node").join(right, "hub").select("node", "hub", far.alias("far")).where(F.col("far") <= most)


def _rooted(index: DataFrame, roots: DataFrame) -> DataFrame:
    """``index`` with root, that of the node's component or itself."""
    return index.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(index: DataFrame) -> DataFrame:
    """(s) of the shingles that nodes of several components have."""
    return index.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s")


def _may(similarity: float, times: str, i: str, j: str) -> Column:
    """Whether sets of n and m shingles can have the similarity if their prefixes share ``times``, the last ones at places ``i`` and ``j``.
    All others they share come after these in both, and after the end of one prefix."""
    beyond = F.greatest(*(F.ceil(similarity * F.col(c) - 1e-9) - 1 for c in ("n", "m")))
    others = F.least(beyond, F.col("n") - F.col(i) - 1, F.col("m") - F.col(j) - 1)
    return F.col(times) + others + 1e-6 >= similarity / (1 + similarity) * (F.col("n") + F.col("m"))


def _sizes(similarity: float) -> Column:
    return F.least("n", "m") + 1e-6 >= similarity * F.greatest("n", "m")


def _stars(index: DataFrame, similarity: float) -> DataFrame:
    """(node, hub): in each bucket the node whose prefix has the shingle first, with those of other components that look similar; of
    a component the hub that a node meets most often."""
    hub = index.groupBy("s").agg(F.min(F.struct(F.col("i").alias("j"), "node", "root", F.col("n").alias("m"))).alias("hub")).select("s", F.col("hub.node").alias("hub"), F.col("hub.root").alias("other"), "hub.m", "hub.j")
    met = index.join(hub, "s").where((F.col("root") != F.col("other")) & _sizes(similarity)).groupBy("node", "hub", "other", "n", "m").agg(F.count(F.lit(1)).alias("times"), F.max("i").alias("i"), F.max("j").alias("j"))
    return met.where(_may(similarity, "times", "i", "j")).groupBy("node", "other").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub")).select("node", "hub")


SKETCH = [f"q{k}" for k in range(WIDE_WORDS)]


def across(index: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, hub): all pairs of nodes of different components that can have the similarity. In each bucket only the nodes of its
    most frequent component aren't held against each other. ``index``: s, node, n, i, root, of the shingles that several
    components have; ``nodes``: node, q0, ..."""
    most = index.groupBy("s", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    rows = index.join(most, "s").select("s", "node", "n", "i", "root", (F.col("root") == F.col("most")).alias("is_most"))
    # Of the prefix, what isn't in the index is in no set of another component: at most ``can`` shingles are shared with one.
    can = index.groupBy("node").agg((F.first("n") - prefix_length(F.first("n"), similarity) + F.count(F.lit(1))).alias("can")).where("can > 0")
    rows = materialize(rows.join(can, "node").join(nodes.select("node", *SKETCH), "node"), "simhash-across")
    other = rows.where("NOT is_most").select("s", F.col("node").alias("hub"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other"), F.col("can").alias("can2"), *(F.col(q).alias(f"o{q}") for q in SKETCH))
    least = similarity / (1 + similarity) * (F.col("n") + F.col("m"))  # shingles that a pair of this similarity shares
    differ: Column = sum((F.bit_count(F.col(q).bitwiseXOR(F.col(f"o{q}"))) for q in SKETCH), F.lit(0))
    likely = _sizes(similarity) & (F.least("can", "can2") + 1e-6 >= least) & (differ <= F.col("n") + F.col("m") - 2 * least + 1e-6)
    pairs = rows.join(merged(other), "s").where((F.col("root") != F.col("other")) & (F.col("is_most") | (F.col("node") < F.col("hub"))) & likely)
    low = F.col("node") < F.col("hub")
    either = lambda a, b, name: F.when(low, F.col(a)).otherwise(F.col(b)).alias(name)
    pairs = pairs.select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub"), either("n", "m", "n"), either("m", "n", "m"), either("i", "j", "i"), either("j", "i", "j"))
    met = pairs.groupBy("node", "hub", "n", "m").agg(F.count(F.lit(1)).alias("times"), F.max("i").alias("i"), F.max("j").alias("j"))
    return met.where(_may(similarity, "times", "i", "j")).select("node", "hub")


def similar(nodes: DataFrame, index: Callable[[], DataFrame], texts_of: Callable[[DataFrame], DataFrame], shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes that verified links connect. ``nodes``: node, f0, ..., q0, ..., n; ``index``: gives s, node, n, i of
    the shared shingles of their prefixes; ``texts_of``: (node, text) of the nodes in a table's column node.

    First the keys of neighbouring segments: in each bucket a star around the smallest node, of which each node verifies its
    closest; this gathers even a large group of copies with a link for each. Then the prefixes: stars again, and at last all
    pairs across what isn't connected yet."""

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "simhash-pairs")
        wanted = pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct()
        out = verified(pairs, texts_of(wanted), shingle, similarity)
        free(pairs)
        return out

    keys = _keys(nodes, NEIGHBOURS)
    star = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    star = _measured(keys.join(merged(star), "key").where("node != hub").select("node", "hub").distinct(), nodes, most_bits(similarity))
    links = checked(star.groupBy("node").agg(F.min_by("hub", F.struct("far", "hub")).alias("hub")))
    roots = materialize(components(links), "simhash-roots")

    def mixed(rows: DataFrame) -> DataFrame:
        rooted = _rooted(rows, shared(roots))
        return rooted.join(shared(materialize(_mixed(rooted), "simhash-mixed")), "s", "left_semi")

    rows = materialize(mixed(index()).drop("root"), "simhash-index")
    links = links.union(checked(_stars(_rooted(rows, shared(roots)), similarity)))
    roots = materialize(components(links), "simhash-roots")
    return components(links.union(checked(across(mixed(rows), nodes, similarity))))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (node, hub) whose texts' shingle sets have the Jaccard similarity. ``texts``: node, text of the pairs' nodes."""

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "hashes"])

    def alike(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["node", "hub"])

    s = materialize(texts.mapInArrow(sets, "node long, hashes binary"), "simhash-sets")
    both = pairs.join(s, "node").withColumnRenamed("hashes", "x").join(s.select(F.col("node").alias("hub"), F.col("hashes").alias("y")), "hub")
    out = materialize(both.select("node", "hub", "x", "y").mapInArrow(alike, "node long, hub long"), "simhash-links")
    free(s)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The row with the smallest identifier of each group of near copies, with all columns of ``docs``."""
    at = unused(docs, "__at")
    rows = located(docs, at)
    # A row's node is a number of its file and its place there, so it is the same in every pass.
    files = materialize(row_numbers(rows.select(F.col(f"{at}.file").alias("file")).distinct(), "file", name="k"), "simhash-files")
    text = F.col(text_col).cast("string").alias("text")
    src = rows.select(F.col(id_col).alias("id"), F.col(at).alias("at"), text).join(shared(files, 2_000_000), F.col("at.file") == F.col("file"))
    src = src.select("id", (F.shiftleft("k", 40) + F.col("at.row")).alias("node"), "text")
    often = frequent(src.select("node", "text"), shingle)
    p = materialize(set_prints(src, shingle, WIDE_WORDS, similarity, often), "simhash-wide")
    least = materialize(p.groupBy("d0", "d1").agg(F.min("node").alias("node")), "simhash-nodes")  # a node is a set of shingles
    nodes = materialize(p.drop("id", "d0", "d1").join(least.select("node"), "node", "left_semi"), "simhash-nodes")

    def index() -> DataFrame:
        tokens = p.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        return materialize(prefixes(nodes, shared_shingles(src, shingle, often, tokens), similarity), "simhash-prefixes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        return src.join(shared(materialize(wanted, "simhash-wanted")), "node", "left_semi").select("node", "text")

    roots = materialize(similar(nodes, index, texts_of, shingle, similarity), "simhash-roots")
    named = least.join(roots, "node", "left").select("d0", "d1", F.coalesce("root", "node").alias("root"))
    grouped = materialize(p.select("id", "node", "d0", "d1").join(named, ["d0", "d1"]).select("id", "node", "root"), "simhash-grouped")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.col("first.node").alias("keep"))
    gone = grouped.join(shared(materialize(first, "simhash-first")), "root").where(F.col("node") != F.col("keep"))
    gone = gone.join(shared(files, 2_000_000), F.shiftrightunsigned("node", 40) == F.col("k")).select(F.struct("file", F.col("node").bitwiseAND(F.lit((1 << 40) - 1)).alias("row")).alias(at))
    gone = materialize(gone, "simhash-gone")
    free(p, least, nodes, roots, grouped)  # what stays depends on this list only
    return rows.join(shared(gone), at, "left_anti").drop(at)
