"""Archives, url filter, packing and decontamination: round trips and brute force."""

import io
import os
import random
import subprocess
import sys
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netquill.llm import decontam, packing, url_filter, warc_zip
from netquill.llm.common import prepare

PATH = public_tokenizers.path("byte_bpe_50k.json")
PAGES = "page_id long, url string, html string"


# --- archives


def members(data):
    return warc_zip.ZipMembers(len(data), lambda at, n: data[at : at + n])


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 in a comment"])
def test_zip_directory(wide, comment):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open("a/data", "w", force_zip64=wide) as f:
            f.write(b"0123456789" * 50)
        z.writestr("ä.txt", b"hello")
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = comment
    data = raw.getvalue()
    m = members(data)
    for name, want in (("a/data", b"0123456789" * 50), ("ä.txt", b"hello")):
        at, n = m.place(name)
        assert data[at : at + n] == want
    with pytest.raises(ValueError):
        m.place("packed")  # it isn't stored
    with pytest.raises(ValueError):
        members(data[: len(data) // 2])


def test_zip64_records():
    """Sizes and offsets beyond 32 bits come from the ZIP64 records."""
    import struct

    name, big = b"m", 5 << 32
    extra = struct.pack("<HHQQQ", 1, 24, big, big, big + 7)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert members(entry + end64 + locator + end).members == {"m": (big + 7, big, big)}


def pages(spark):
    prepare(spark)
    same = "<p>" + "é" * 60 + "</p>"
    rows = [(1, "http://a/x y", same), (2, "http://b", same), (3, None, None), (4, "http://c", ""), (5, "u\r\nX: y", "short"), (6, "d", "short"), (0, "http://é/%41", same), (0, "again", same), (None, "n", same), (9, "z", "b" * 300_000)]
    return spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit(1), "digest": F.lit("x")})


def test_archive_round_trip(spark):
    import hashlib

    p = pages(spark)
    manifest = warc_zip.write(p, package_bytes=200)
    assert manifest.agg(F.sum("records")).first()[0] == 10 and manifest.count() > 2
    got = {(r["page_id"], r["url"]): r for r in warc_zip.read(spark, manifest).collect()}
    assert len(got) == 10
    for r in p.collect():
        raw = (r["html"] or "").encode()
        x = next(v for (i, _), v in got.items() if i == r["page_id"] and v["payload_bytes"] == len(raw))
        assert x["payload_digest"] == hashlib.sha256(raw).hexdigest()
        if x["record_type"] == "response":
            assert bytes(x["payload"]) == raw and x["refers_to"] is None
        else:
            assert x["payload"] is None and x["refers_to"] == 0
    kinds = Counter((k[0], v["record_type"]) for k, v in got.items())
    assert kinds[(0, "response")] == 2 and kinds[(1, "revisit")] == kinds[(2, "revisit")] == kinds[(None, "revisit")] == 1
    assert kinds[(5, "response")] == kinds[(6, "response")] == 1  # below 100 bytes
    assert {v["url"] for (i, _), v in got.items() if i == 3} == {None}
    assert {v["url"] for (i, _), v in got.items() if i == 5} == {"u%0D%0AX: y"}


def test_archive_of_string_identifiers(spark):
    p = pages(spark).where("page_id IS NOT NULL AND page_id > 0").withColumn("page_id", F.concat(F.lit("p"), "page_id"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc_zip.read(spark, warc_zip.write(p)).collect()}
    assert got["p1"] == ("response", None) and got["p2"] == ("revisit", "p1") and len(got) == 7


def test_archive_of_nothing_and_damage(spark, tmp_path):
    assert warc_zip.read(spark, warc_zip.write(pages(spark).limit(0))).count() == 0
    with pytest.raises(ValueError):
        warc_zip.parse(warc_zip.record(1, "u", b"abc", "x", None)[:-12])
    got = warc_zip.parse(warc_zip.record(1, "http://x/ü", b"abc", "d", None))
    assert got["payload"] == b"abc" and got["warc"]["warc-target-uri"] == "http://x/ü"


# --- url filter


def test_rules(spark):
    urls = {
        "http://A.NET/x": ("a.net", "/x", "net/", "block"), "http://example.net/en/1?q": ("example.net", "/en/1", "example.net/en/", "allow"),
        "https://m.example.net/fr": ("m.example.net", "/fr", "net/", "block"), "http://x.net": ("x.net", "", None, "allow"), "http://badnet/": ("badnet", "/", None, "allow"),
        "ftp://q.example.com/de/#f": ("q.example.com", "/de/", "example.com/de/", "block"), "http://o.org/fr/": ("o.org", "/fr/", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "x\n://H/p\nq?r": ("h", "/p\nq", None, "allow"),
    }
    d = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], PAGES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(d).collect()}
    assert [got[k] for k in range(len(urls))] == list(urls.values())


def test_propagation_against_brute_force(spark):
    rnd = random.Random(3)
    hosts = [f"h{k}.com" for k in range(12)] + ["bad.net", "worse.net", "good.org"]
    data = []
    for k in range(120):
        h = rnd.choice(hosts)
        links = [rnd.choice(hosts) for _ in range(rnd.randrange(4))]
        path = "/fr/" if h == "good.org" else "/x"
        data.append((k, f"http://{h}{path}", "".join(f"<a HREF='//{x.upper()}/z'>" for x in links) + '<a href="/local">'))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(data, PAGES)).collect()}
    edges, n, ruled = Counter(), Counter(), Counter()
    for _, u, html in data:
        src = u.split("/")[2]
        n[src] += 1
        ruled[src] += 1 if src.endswith(".net") else (-1 if src == "good.org" else 0)
        for dst in {x.split("/")[2].lower() for x in html.split("'")[1::2]} - {src}:
            edges[src, dst] += 1
    out, into = Counter(), Counter()
    for (a, b), c in edges.items():
        out[a] += c
        into[b] += c
    nodes = {*n, *(b for _, b in edges)}
    st, sd = {h: max(0, -ruled[h]) / max(1, n[h]) for h in nodes}, {h: max(0, ruled[h]) / max(1, n[h]) for h in nodes}
    tr, di = dict(st), dict(sd)
    for _ in range(url_filter.SQL_ROUNDS):
        nt, nd = dict(st), dict(sd)
        for (a, b), c in edges.items():
            nt[b] += 0.85 * c / out[a] * tr[a]
            nd[a] += 0.85 * c / into[b] * di[b]
        tr, di = nt, nd
    for k, u, _ in data:
        h = u.split("/")[2]
        want = "block" if h.endswith(".net") or (h != "good.org" and di[h] - tr[h] >= url_filter.THRESHOLD) else "allow"
        assert got[k] == want, (h, tr[h], di[h])
    assert {h for h in nodes if h.endswith(".com") and di[h] - tr[h] >= 0.5}  # the method blocks some host that no rule does


@pytest.mark.parametrize("verdict", ["block", "allow"])
def test_many_small_gains_add_up(spark, verdict):
    """A hub that reaches a seed over a thousand hosts only: no host between gets much."""
    seed, hub = ("seed.test", "hub.test") if verdict == "block" else ("hub.test", "seed.test")
    mids = [f"m{k}.test" for k in range(1000)]
    link = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    pages = [(0, "http://seed.test/", link(*mids) if seed == "hub.test" else ""), (1, "http://hub.test/", link(*mids) if hub == "hub.test" else "")]
    pages += [(k + 2, f"http://{m}/", link("seed.test" if verdict == "block" else "hub.test")) for k, m in enumerate(mids)]
    if verdict == "allow":  # trust of 0.7225 from the seed against distrust of 0.85 from a blocked host: allowed by their difference
        pages += [(5000, "http://bad.test/", ""), (5001, "http://hub.test/", link("bad.test"))]
    rules = [("block" if verdict == "block" else "allow", "seed.test", "/"), ("block", "bad.test", "/")]
    got = {r["host"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, PAGES), rules).collect()}
    assert got["hub.test"] == verdict
    ranks = url_filter.ranks(spark.createDataFrame([("seed.test", 0.0, 1.0)], "host string, trust double, distrust double"), url_filter.host_edges(spark.createDataFrame(pages, PAGES)))
    if verdict == "block":
        assert {r["host"]: r["distrust"] for r in ranks.collect()}["hub.test"] == pytest.approx(0.7225)


def test_url_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


# --- packing


def test_encoder_equals_the_library():
    rnd, own, library = random.Random(5), packing.Encoder(PATH), Tokenizer.from_file(PATH)
    assert own.fast is not None
    for _ in range(3000):
        top = rnd.choice([40, 128, 256, 0x3000, 0x20000, 0x110000])
        t = "".join(c for c in (chr(rnd.randrange(top)) if rnd.random() < 0.6 else rnd.choice(" \n'sa1<|endoftext|>\x1c\x85 ") for _ in range(rnd.randrange(60))) if not 0xD800 <= ord(c) < 0xE000)
        assert own(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing_is_an_exact_partition(odd, empty):
    docs = odd.where("doc_id IS NULL OR doc_id != 7").repartition(2)
    got = packing.pack(docs, PATH, tokens=256, segments=5).collect()
    library, pieces, sequences = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d in docs.collect():
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    short = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256 and len(s) <= 5
        short += at & (at - 1) != 0
    assert short <= 2
    assert packing.pack(empty, PATH).count() == 0


def test_packing_limits():
    rnd = random.Random(1)
    for tokens, segments, loss in ((32, 3, 20), (64, 8, 64), (10, 2, 30), (16, 16, 5)):
        p, sizes, skip = packing.Packer(tokens, segments, loss, 7), [], []
        for k in range(300):
            sizes.append(rnd.randrange(1, 90))
            skip.append(rnd.choice([0, rnd.randrange(60)]))
            p.add(k, np.arange(sizes[-1], dtype=np.uint32), skip[-1])
        p.finish()
        total, by_seq = Counter(), defaultdict(list)
        for doc, start, length, *_, seq, _ in p.out:
            total[doc] += length
            by_seq[seq].append((length, max(0, start + length - max(start, skip[doc]))))
        assert all(total[k] == sizes[k] for k in range(300))
        assert all(sum(x for x, _ in s) <= tokens and len(s) <= segments and sum(y for _, y in s) <= loss for s in by_seq.values())


def test_each_choice_is_the_largest_dot_product(monkeypatch):
    """Every piece that a sequence takes whole is, of what is buffered and fits, the one with the largest product."""
    tokens, segments, loss, rnd, checked = 64, 6, 40, random.Random(4), 0
    p = packing.Packer(tokens, segments, loss, 0)
    limits, state = np.array([tokens, segments, loss], float), {}
    take, emit = p._take, p._emit

    def taken(i):
        nonlocal checked
        free = state.setdefault("free", limits.copy())
        sizes = p.size[: len(p.held)]
        fitting = [k for k in range(len(sizes)) if (sizes[k] <= free).all()]
        products = {k: float((sizes[k] / limits) @ (free / limits)) for k in fitting}
        assert i in products and products[i] >= max(products.values()) - 1e-12
        free -= sizes[i]
        checked += 1
        return take(i)

    def emitted(pieces):
        state.clear()
        return emit(pieces)

    monkeypatch.setattr(p, "_take", taken)
    monkeypatch.setattr(p, "_emit", emitted)
    for k in range(200):
        p.add(k, np.arange(rnd.randrange(1, 50), dtype=np.uint32), rnd.randrange(20))
    p.finish()
    assert checked > 150


def test_short_texts_are_padded_little():
    for segments, most in ((1024, 0.01), (128, 0.7)):
        p = packing.Packer(1024, segments, 1024, 0)
        for k in range(20_000):
            p.add(k, np.arange(3, dtype=np.uint32), 0)
        p.finish()
        length = Counter()
        for x in p.out:
            length[x[5]] += x[2]
        padding = sum(1024 - n for n in length.values() if n & (n - 1))  # a power of two isn't padded
        assert sum(length.values()) == 60_000 and padding / (60_000 + padding) <= most


def test_buffer_holds_only_its_own_tokens():
    p = packing.Packer(1024, 1024, 1024, 0)
    for k in range(300):
        p.add(k, np.zeros(1_000_001, np.uint32), 0)
        p.out.clear()
    assert len(p.held) == 300 and sum(ids.base.nbytes if ids.base is not None else ids.nbytes for (_, ids, _, _), _ in p.held) < 2_000_000


def test_loss_column(spark, odd):
    docs = odd.limit(3).withColumn("prompt", F.lit(4))
    assert packing.pack(docs, PATH, tokens=16, loss=8, loss_from="prompt").count() >= 3
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, tokens=0)


# --- decontamination


def fewest(window, doc):
    prev = [0] * (len(doc) + 1)
    for i, c in enumerate(window, 1):
        cur = [i]
        for j, x in enumerate(doc, 1):
            cur.append(min(prev[j - 1] + (c != x), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


@pytest.mark.parametrize("pairs", [1, 40, 500_000])
@pytest.mark.parametrize("alphabet", ["ab ", "abc ", "abcdefghij "])
def test_leaks_against_brute_force(alphabet, pairs, monkeypatch):
    rnd, positives = random.Random(3), 0
    monkeypatch.setattr(decontam, "MOST_PAIRS", pairs)

    def text(n):
        return " ".join("".join(rnd.choice(alphabet) for _ in range(n)).split())

    for _ in range(120):
        items = [text(rnd.randrange(4, 60)) for _ in range(3)]
        leak = list(rnd.choice(items))
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(max(1, len(leak)))
            leak[at : at + rnd.randrange(2)] = rnd.choice(["x", "", "yz"])
        doc = decontam.normalise(text(60) + "".join(leak) + text(30))
        index = decontam.build([0, 1, 2], items, q=3, window=24, edits=4)
        want = {}
        for n, i in enumerate(index.items):
            t, w = decontam.normalise(items[i]), int(index.window[n])
            best = min(fewest(t[s : s + w], doc) for s in range(len(t) - w + 1))
            if best <= index.edits[n]:
                want[n] = best
        assert decontam.find(index, decontam.codes(doc)) == want
        positives += len(want)
    assert positives > 60


def test_repetitive_texts_take_bounded_memory():
    """A process of 1.2 GB of addresses finds what repetitive texts of up to two million characters leak."""
    code = """
import resource, sys
resource.setrlimit(resource.RLIMIT_AS, (1_200_000_000, 1_200_000_000))
from netquill.llm import decontam as d
for item, doc, want in (("lol " * 500, "lol " * 12_500, {0: 0}), ("lol " * 500, "lol " * 50_000, {0: 0}), ("x" * 2000, "x" * 2_000_000, {0: 0}), ("lol " * 500, "lol lol lol lol x " * 3000, {}), ("lol " * 500, ("lol " * 9 + "x yz ") * 2000, {0: 4})):
    assert d.find(d.build([0], [item]), d.codes(d.normalise(doc))) == want, item[:9]
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), capture_output=True, text=True, env={**os.environ, "OPENBLAS_NUM_THREADS": "1"})
    assert done.returncode == 0, done.stderr


def test_leaks_in_long_texts_and_blocks(spark, odd, empty):
    item = "this benchmark question asks for the capital of a country that nobody has ever named before today"
    b = spark.createDataFrame([(1, item), (2, None), (3, "tiny"), (4, "another question about rivers and mountains which is long enough for a window")], "item_id long, text string")
    docs = odd.select("doc_id", "text", "item_id").union(spark.createDataFrame([(100, "word " * 50_000 + item.upper() + "?!" + " word" * 9, "x"), (101, item.replace("capital", "capitol"), "x"), (102, item[:50], "x")], "doc_id long, text string, item_id string"))
    for chars in (2_000_000, 60):
        got = sorted(tuple(r) for r in decontam.hits(docs, b, block_chars=chars).collect())
        assert got == [(100, 1, 0), (101, 1, 0)] or got == [(100, 1, 0), (101, 1, 1)]
        kept = decontam.drop_leaks(docs.withColumn("__at", F.lit(1)), b, block_chars=chars)
        assert kept.columns == [*docs.columns, "__at"] and kept.count() == docs.count() - 2
    twice = b.union(spark.createDataFrame([(7, item), (None, item), (1, "one more text of the item with the number one, long enough to have a window")], b.schema))
    for chars in (2_000_000, 60):
        got = Counter((r["doc_id"], r["item_id"]) for r in decontam.hits(docs, twice, block_chars=chars).collect())
        assert got == {(d, i): 1 for d in (100, 101) for i in (1, 7, None)}
    assert decontam.hits(empty, b).count() == 0 and decontam.hits(docs, b.limit(0)).count() == 0
    assert decontam.drop_leaks(docs, b.limit(0)).count() == docs.count()
