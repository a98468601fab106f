"""Encoding, divergence of sources, importance resampling: against the library and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from netquill.llm import bpe_codec, importance, source_divergence

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def ranks():
    return bpe_codec.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        top = rnd.choice([40, 128, 256, 0x600, 0x3000, 0x20000, 0x110000])
        t = "".join(chr(rnd.randrange(top)) if rnd.random() < 0.6 else rnd.choice(" \n\t'sa1<|endoftext|>\x1c\x85 ") for _ in range(rnd.randrange(60)))
        yield "".join(c for c in t if not 0xD800 <= ord(c) < 0xE000)


# --- encoding


def test_words_and_pieces_as_the_library_has_them(ranks, library, monkeypatch):
    split = bpe_codec.splitter(PATTERN, bpe_codec.newer_letters(PATTERN))
    for t in [*mixed(4, 3000), *(a for a in mixed(7, 3000) if a.isascii()), *(a[:9] for a in mixed(8, 9000) if a[:9].isascii()), ''.join(map(chr, range(128))), "a" * 20_000, "'ll'LL don't", " " * 99, "՘a 1՘"]:
        assert [i for w in split(t) for i in bpe_codec.encode_word(ranks, w.encode())] == library.encode_ordinary(t), repr(t)
    monkeypatch.setattr(bpe_codec, "CUT_CHARS", 7)
    for t in [*mixed(5, 1000), "ab  cd\n ef   gh i  " * 9]:
        assert [w for p in bpe_codec._pieces(t) for w in split(p)] == split(t)


def test_numbers():
    for x in ([], [0], [2**32 - 1, 0, 70_000, 255], list(range(5000))):
        assert bpe_codec.unpack_numbers(bpe_codec.pack_numbers(np.array(x, np.int64))).tolist() == x


def test_words_are_packed():
    for x in ([], [b""], [b"a", b"", "é\0".encode(), b"x" * 70_000]):
        assert bpe_codec.unpack_words(bpe_codec.pack_words(x)) == x


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    """In whichever chunks a word stands, it comes to one bucket, and the rows of a bucket come together."""
    docs = spark.createDataFrame([(k, f"all of them have word {k % 7}") for k in range(100)], "doc_id long, text string").repartition(4)
    spots = bpe_codec.explode_words(docs, PATTERN, 5, chunk_chars=60)
    words = [(r["chunk"], r["bucket"], w) for r in spots.where("words IS NOT NULL").collect() for w in bpe_codec.unpack_words(r["words"])]
    assert len({(b, w) for _, b, w in words}) == len({w for _, _, w in words}) == 12
    assert len({(c, w) for c, _, w in words}) == len(words) and len({c for c, _, _ in words}) > 20


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("chunk_chars", [50, bpe_codec.CHUNK_CHARS])
def test_round_trip(spark, odd, empty, library, chunk_chars):
    got = bpe_codec.round_trip(odd, PATH, PATTERN, chunk_chars=chunk_chars)
    assert got.columns == ["doc_id", "n_tokens", "ids", "bytes"]
    want = [(r["doc_id"], (ids := library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in odd.select("doc_id", "text").collect()]
    assert collections.Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["bytes"])) for r in got.collect()) == collections.Counter((i, len(ids), packed(ids), b) for i, ids, b in want)
    assert bpe_codec.round_trip(empty, PATH, PATTERN).count() == 0


def test_round_trip_of_many(spark, library):
    texts = [*mixed(6, 400), *mixed(6, 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = bpe_codec.encode(docs, PATH, PATTERN, chunk_chars=700)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_decode(spark, ranks, library):
    rows = spark.createDataFrame([(1, library.encode_ordinary("over and over")), (1, []), (2, None)], "doc_id long, ids array<int>")
    assert [(r["doc_id"], r["bytes"] and bytes(r["bytes"])) for r in bpe_codec.decode(rows, ranks).orderBy("doc_id", F.desc("ids")).collect()] == [(1, b"over and over"), (1, b""), (2, None)]
    with pytest.raises(Exception, match="isn't in the vocabulary"):
        bpe_codec.decode(spark.createDataFrame([([99_999_999],)], "ids array<int>"), ranks).collect()


# --- divergence of sources


def divergences(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    df = collections.Counter((lang, w) for lang, _, ws in docs for w in set(ws))
    terms = {lang: sorted(w for (g, w), n in df.items() if g == lang and n >= least) for lang, _, _ in docs}
    n = collections.Counter((lang, s, w) for lang, s, ws in docs for w in ws if df[lang, w] >= least)
    groups = sorted({(lang, s) for lang, s, _ in docs})
    size = collections.Counter()
    for (lang, s, _), k in n.items():
        size[lang, s] += k
        size[lang] += k
    total = collections.Counter()
    for (lang, _, w), k in n.items():
        total[lang, w] += k
    p = lambda k, all_, v: 1 + 10**9 * (k + 2) // (all_ + 2 * v)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, s in groups:
        v = len(terms[lang])
        own = {w: p(n[lang, s, w], size[lang, s], v) for w in terms[lang]}
        pairs = [(o, sum(f(own[w], p(n[lang, o, w], size[lang, o], v)) for w in terms[lang])) for g, o in groups if g == lang and o != s]
        apart = [(w, f(own[w], q)) for w in terms[lang] if n[lang, s, w] and own[w] > (q := p(total[lang, w], size[lang], v))]
        for part, items, most in (("pair", pairs, None), ("term", apart, top)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.append((lang, s, part, item, value, rank))
    return sorted(out)


def test_audit_against_brute_force(spark, odd, empty):
    rnd = random.Random(2)
    words = ["w%s" % chr(97 + i) for i in range(20)] + ["École", "ß", "中文", "A1b"]
    rows = [(rnd.choice(["en", "de", None, "xx"]), rnd.choice(["a", "b", "c", "d", "é", None]), None if k % 40 == 0 else " ".join(rnd.choices(words, k=rnd.randrange(12)))) for k in range(400)]
    rows += [("none", s, "rare" + s) for s in "abc"] + [("en", "new", ""), ("en", "hot", "wa " * 30_000)] * 2
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    got = source_divergence.audit(docs, least_docs=5, top=4)
    assert sorted(map(tuple, got.collect())) == divergences(rows, 5, 4)
    of_odd = [(r["lang"], r["source"], r["text"]) for r in odd.select("lang", "source", "text").collect()]
    assert sorted(map(tuple, source_divergence.audit(odd, least_docs=2).collect())) == divergences(of_odd, 2, 10)
    assert source_divergence.audit(empty).count() == 0


def test_counts_are_sent_on_when_many(spark):
    docs = spark.createDataFrame([("en", "a", f"w{chr(97 + k % 26)} x y") for k in range(300)], "lang string, source string, text string")
    n = source_divergence.term_counts(docs.coalesce(1), flush=3).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("d"))
    assert {r["term"]: (r["n"], r["d"]) for r in n.collect()}["x"] == (300, 300)


# --- resampling


def features(text, longest):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]


def resampled(docs, target, percent, least, longest, buckets, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x, longest)[1]) for texts in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for i, text in docs:
        n, fs = features(text, longest)
        w = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(([*r, drawn.get(id(r))] for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_resample_against_brute_force(spark, longest):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["ÉTÉ", "中文", "Ab"]
    docs = [(i, None if i % 30 == 0 else " ".join(rnd.choices(words, k=rnd.randrange(40)))) for i in range(150)]
    target = [None, "", *(" ".join(rnd.choices(words[:6], k=9)) for _ in range(20))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame([(x, 1) for x in target], "text string, item_id long")
    got = importance.resample(d, t, least_words=5, longest=longest, buckets=97, chunk_chars=300)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((list(r) for r in got.collect()), key=str) == resampled(docs, target, 25, 5, longest, 97)


def test_resample_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = importance.resample(odd, empty, percent=60, least_words=3)
    assert sorted((list(r) for r in got.collect()), key=str) == resampled(rows, [], 60, 3, 2, 10_000)
    assert importance.resample(empty, odd).count() == 0


def test_suffix_array_and_prefixes():
    rnd = np.random.default_rng(3)
    for depth in (1, 2, 3, 7):
        x = np.concatenate([[*rnd.integers(1, 4, n), 0] for n in (0, 30, 1, 200)]).astype(np.int64)
        order = importance.suffix_array(x, depth)
        begin = [tuple(x[i : i + depth]) for i in order]
        assert sorted(order) == list(range(len(x))) and begin == sorted(begin)
        for k, n in enumerate(importance.common_prefixes(x, order, depth)[1:], 1):
            a, b = begin[k - 1], begin[k]
            want = next((j for j in range(depth) if j >= min(len(a), len(b)) or a[j] != b[j] or a[j] == 0), depth)
            assert n == want
