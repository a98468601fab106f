"""Exact and near copies, against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netquill.llm import exact_stream, simhash_golay
from netquill.operators.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_against_brute_force(spark, odd):
    got = exact_stream.report(odd).collect()
    data = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in odd.collect()]
    groups = {}
    for i, t in data:
        groups.setdefault(t, []).append(i)
    want = sorted(((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in data), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups)  # one row of each group, also where identifiers repeat
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_survives_colliding_digests(spark, odd):
    weak = exact_stream.report(odd, digest=lambda t: F.substring(exact_stream.sha256(t), 1, 0)).collect()
    real = exact_stream.report(odd).collect()
    key = lambda rows: sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows), key=str)
    assert key(weak) == key(real)


def test_exact_state_is_on_disk_and_plans_native(spark, odd, empty):
    assert exact_stream.report(empty).count() == 0
    plan = exact_stream.report(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    kept = exact_stream.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 8


def multiplied(spark, tmp_path, name="__at"):
    """Rows that a scan multiplies in different ways, each twice, with a column of the locator's name."""
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(k, f"text number {k % 3} with five words and more", k) for k in range(4)], f"doc_id long, text string, {name} long").write.parquet(path)
    d = spark.read.parquet(path)
    return [d.crossJoin(spark.range(2)), d.withColumn("e", F.explode(F.array(F.lit(1), F.lit(2)))), d.union(d), spark.read.parquet(path, path), d.withColumn("_metadata", F.lit("mine")).union(d.withColumn("_metadata", F.lit("x")))]


def test_rows_of_joins_generators_and_unions_are_rows_of_their_own(spark, tmp_path):
    for k, many in enumerate(multiplied(spark, tmp_path)):
        assert many.count() == 8
        got = exact_stream.report(many).collect()
        assert len(got) == 8 and sum(r["kept"] for r in got) == 3
        assert sorted(r["group_size"] for r in got) == [2, 2, 2, 2, 4, 4, 4, 4]
        for drop in (exact_stream.drop_copies, simhash_golay.drop_near_copies)[: 2 if k in (0, 4) else 1]:
            kept = drop(many)
            assert kept.columns == many.columns and kept.count() == 3


def test_a_plain_scan_is_located_where_it_is(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.range(10).write.parquet(path)
    d = spark.read.parquet(path)
    assert exact_stream._one_scan(d.where("id > 3").select("id")) and not exact_stream._one_scan(d.limit(3)) and not exact_stream._one_scan(d.distinct())
    assert exact_stream.located(d.where("id > 3"), "here").select("here").distinct().count() == 6


def test_texts_of_single_rows_are_not_moved(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(k, f"text {k // 2 if k < 6 else k}") for k in range(50)], "doc_id long, text string").write.parquet(path)
    got = exact_stream.report(spark.read.parquet(path))
    assert got.where("group_size = 2").count() == 6 and got.where("kept").count() == 47


# --- Golay code and links


def test_golay_code():
    message = np.arange(4096, dtype=np.int64) << 11
    code = message | simhash_golay._syndrome(message)
    assert np.bincount(np.bitwise_count(code), minlength=24)[[0, 7, 8, 11, 12, 15, 16, 23]].tolist() == [1, 253, 506, 1288, 1288, 506, 253, 1]
    v = np.random.default_rng(1).integers(0, 1 << 23, 500)
    assert np.bitwise_count(v ^ code[simhash_golay.nearest(v)]).max() <= 3
    for x, near in zip(v[:100], simhash_golay.nearby(v[:100]), strict=True):
        assert set(np.flatnonzero(np.bitwise_count(code ^ x) <= 4)) == set(near[near >= 0])


def brute_print(text, k):
    words = [w for w in (text or "").translate(LOWER).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    sh = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50, 700):
        t = " \n".join(rnd.choice(["Ab", "c", "École", "x y", "\u0085"]) for _ in range(n))
        assert int(simhash_golay.fingerprint(simhash_golay.shingle_hashes(t, 3))[0]) == brute_print(t, 3)
    assert int(simhash_golay.fingerprint(simhash_golay.shingle_hashes(None, 3))[0]) == 0
    long = simhash_golay.shingle_hashes("a b c d e f " * 9000, 3)
    assert int(simhash_golay.fingerprint(long)[0]) == int(simhash_golay.fingerprint(long[:6])[0])


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(8)]
    f = sorted({*map(int, base), *near})
    got = sorted((r["a"], r["b"]) for r in simhash_golay.links_within_3(spark.createDataFrame([(x,) for x in f], "f long")).collect())
    assert got == [(a, b) for i, a in enumerate(f) for b in f[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert len(got) > 300


def test_connecting_links_connect_the_same(spark):
    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 7), replace=False)) for b in base for _ in range(8)]
    dense = [int(base[0]) ^ (1 << x) for x in range(63)] + [int(base[0]) ^ (1 << x) ^ (1 << y) for x in range(20) for y in range(x)]
    f = sorted({*map(int, base), *near, *dense})
    nodes = spark.createDataFrame([(x,) for x in f], "f long")
    some = simhash_golay.connecting_within_3(nodes)
    edges = some.collect()
    assert all((e["a"] ^ e["b"]).bit_count() <= 3 for e in edges)
    roots = lambda d: sorted(map(tuple, components(d).collect()))
    every = simhash_golay.links_within_3(nodes)
    assert roots(some) == roots(every)
    assert len(edges) < every.count() / 4


def test_keys_are_not_broadcast(spark):
    """Spark sizes the keys of a fingerprint, of which there are up to 108, as one row, and broadcast them."""
    f = np.random.default_rng(5).integers(0, 1 << 63, 4000, dtype=np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in np.append(f, f[:50] ^ 5)], "f long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxBroadcastTableSize")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")  # a larger one is an error
    try:
        assert simhash_golay.links_within_3(nodes).count() == 50
        assert components(simhash_golay.connecting_within_3(nodes)).count() == 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_report_rows(spark, odd, empty):
    got = simhash_golay.report(odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == odd.count()
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.collect()}
    assert rows[1][0] == rows[6][0] == f"{brute_print('the cat sat on the mat and the dog ate the bone.', 3):016x}"
    assert rows[6][1] == 1 and rows[3] == rows[4] == rows[2] == ("0" * 16, 2)
    assert simhash_golay.report(empty).count() == 0


def near_copies(seed=8, groups=40):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    docs, pairs = [], []
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 300))]
        docs.append((10 * g, " ".join(base)))
        for c in range(1, 4):
            w = list(base)
            for _ in range(rnd.randrange(1, max(2, len(w) // 60))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            docs.append((10 * g + c, " ".join(w)))
    sets = {i: {*zip(*(t.split()[k:] for k in range(5)), strict=False)} for i, t in docs}
    for i in sets:
        for j in sets:
            if i < j and i // 10 == j // 10 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs.append((i, j))
    return docs, pairs


def test_near_copies_recall_and_precision(spark):
    docs, pairs = near_copies()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("clash"))
    kept_rows = simhash_golay.drop_near_copies(d)
    kept = {r["doc_id"] for r in kept_rows.collect()}
    assert kept_rows.columns == d.columns
    linked = {x for p in pairs for x in p}
    assert {i for i, _ in docs} - kept <= linked  # nothing without a partner at 0.8 goes
    both = [p for p in pairs if p[0] in kept and p[1] in kept]
    assert len(both) <= 0.05 * len(pairs) and len(pairs) > 60


def repeated_line(seed, line, times, own):
    rnd = random.Random(seed)
    return " ".join([f"l{k}" for k in range(line)] * times + [f"w{rnd.randrange(10**9)}" for _ in range(own)])


def test_a_repeated_line_alone_makes_no_near_copies(spark):
    texts = [repeated_line(k, 9, 200, 100) for k in range(3)] + [repeated_line(10 + k, 15, 60, 400) for k in range(3)]
    got = simhash_golay.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(6))


def family(seed=21, size=240, pairs=60):
    """Texts of 200 words that differ in 4 places from a common one, so most are below 0.8 to each other, and copies of some with 3 more changes."""
    rnd = random.Random(seed)
    base, own = [f"b{k}" for k in range(200)], lambda: f"w{rnd.randrange(10**9)}"
    docs = []
    for _ in range(size):
        w = list(base)
        for at in rnd.sample(range(200), 4):
            w[at] = own()
        docs.append(w)
    for k in range(pairs):
        w = list(docs[k])
        for at in rnd.sample(range(200), 3):
            w[at] = own()
        docs.append(w)
    return [(k, " ".join(w)) for k, w in enumerate(docs)]


def groups_by_brute_force(docs, similarity=0.8):
    sets = {i: {*zip(*(t.split()[k:] for k in range(5)), strict=False)} for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in sets}), len(links)


def test_near_copies_inside_a_large_family_below(spark):
    docs = family()
    want, n_links = groups_by_brute_force(docs)
    got = simhash_golay.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert n_links >= 60 and len(want) > 150


def test_near_copies_are_all_found(spark):
    docs, _ = near_copies(seed=31)
    got = simhash_golay.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == groups_by_brute_force(docs)[0]


def test_wide_fingerprints_take_each_shingle_once(spark):
    rnd = random.Random(41)
    own, line = " ".join(f"w{rnd.randrange(10**9)}" for _ in range(1000)), " ".join(f" l{k}" for k in range(9))
    docs = [(k, f"{own} {' '.join([line] * times)}") for k, times in enumerate((1, 30, 100, 200))]
    rows = spark.createDataFrame([(i, i, t) for i, t in docs], "id long, node long, text string")
    words = [f"f{k}" for k in range(simhash_golay.WIDE_WORDS)]
    f = [[r[w] for w in words] for r in simhash_golay.set_prints(rows, 5, len(words), 0.8).orderBy("id").collect()]
    far = [sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(f[0], x, strict=True)) for x in f[1:]]
    assert max(far) <= simhash_golay.most_bits(0.99)
    got = simhash_golay.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [r["doc_id"] for r in got.collect()] == [0]


def banded(seed=51, families=170, size=14):
    """Families in which pairs of all similarities from 0.5 up occur."""
    rnd, docs = random.Random(seed), []
    for g in range(families):
        base = [f"g{g}w{k}" for k in range(400)]
        for _ in range(size):
            w = list(base)
            for at in rnd.sample(range(400), rnd.randrange(8)):
                w[at] = f"x{rnd.randrange(10**9)}"
            docs.append(" ".join(w))
    return list(enumerate(docs))


def linked_pairs(docs):
    sets = {i: {*zip(*(t.split()[k:] for k in range(5)), strict=False)} for i, t in docs}
    return [(i, j, s) for i in sets for j in sets if i < j and i // 14 == j // 14 and (s := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= 0.8]


@pytest.mark.parametrize("saturated", [False, True])
def test_recall_in_bands_of_similarity(spark, monkeypatch, saturated):
    """Every pair is in one group, in each band of similarity; also if all documents share every key of close copies."""
    docs = banded()
    pairs = linked_pairs(docs)
    if saturated:
        monkeypatch.setattr(simhash_golay, "_keys", lambda nodes, chosen: nodes.select(F.lit(1).cast("long").alias("key"), "node"))
    left = {r["doc_id"] for r in simhash_golay.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    bands = [sum(lo <= s < lo + 0.05 for *_, s in pairs) for lo in (0.8, 0.85, 0.9, 0.95)]
    assert min(bands) > 1000
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j, _ in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert sorted(left) == sorted({find(i) for i in root})  # which pairs are linked decides which documents stay, so none is missed


def test_near_copies_odd_rows(odd, empty):
    got = simhash_golay.drop_near_copies(odd)
    ids = sorted((r["doc_id"] for r in got.collect()), key=str)
    assert got.columns == odd.columns and simhash_golay.drop_near_copies(empty).count() == 0
    assert ids == sorted([1, 2, 5, 7, None, 9, 10], key=str)  # rows without words are one group; 1 and 6 differ only in case


@pytest.mark.parametrize("similarity", [0.8, 0.9, 1.0])
def test_most_bits(similarity):
    assert simhash_golay.most_bits(similarity, deviations=-3.0) <= simhash_golay.most_bits(similarity) < 200
