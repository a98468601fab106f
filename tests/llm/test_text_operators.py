"""Language, tokens, toxicity, licenses: against libraries, brute force and held-out rows."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netquill.llm import bpe_count, langid, license_scan, toxicity
from netquill.llm.common import ascii_lower, remainder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# --- tokens


def texts(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        top = rnd.choice([40, 128, 256, 0x3000, 0x20000, 0x110000])
        t = "".join(chr(rnd.randrange(top)) if rnd.random() < 0.6 else rnd.choice(" \n\t'sa1<|endoftext|>\x1c\x85 ") for _ in range(rnd.randrange(60)))
        yield "".join(c for c in t if not 0xD800 <= ord(c) < 0xE000) + rnd.choice(["", "<|endoftext|>", "a<|endoftext|> b"])


def test_counts_equal_the_library():
    own, library = bpe_count.HeapBpe(PATH), Tokenizer.from_file(PATH)
    for t in [*texts(3, 4000), "a" * 20_000, "'ll'LL don't", " " * 99]:
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe_count.HeapBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_count_tokens_rows(odd, empty):
    got = bpe_count.count_tokens(odd, PATH, limit=20)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == odd.count()
    rows = by_id(got, "n_bytes", "n_tokens", "over_limit")
    assert rows[2] == rows[3] == (0, 0, False)
    assert rows[9][0] == 150_000 and rows[9][2] and rows[1][2] is False
    assert bpe_count.count_tokens(empty, PATH).count() == 0


# --- language


def corpus(spark, n=240):
    rnd = random.Random(5)
    words = {"en": "the of and to in is that for with from this have their which about".split(), "de": "der die und das nicht mit sich auch eine werden über schön große für".split(), "fr": "le la et les des une dans pour qui avec être très même école après".split()}
    out = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, " ".join(rnd.choice(words[lang]) for _ in range(30)).capitalize() + ".", lang))
    return spark.createDataFrame(out, "doc_id long, text string, lang string"), words


def test_language_held_out(spark, odd):
    docs, _ = corpus(spark)
    held = remainder(F.col("doc_id"), 3) == 1
    model = langid.train(docs, keep=~held)
    assert model.langs == ["de", "en", "fr"]
    got = langid.identify(docs, model).join(docs.where(held), "doc_id")
    assert got.count() > 40 and got.where("lang_pred != lang OR score < 0.9 OR score > 1").count() == 0


def test_language_mixture(spark):
    docs, words = corpus(spark)
    model = langid.train(docs)
    mixed = " ".join(words["en"] * 4 + words["de"] * 2)
    (lang,), (score,) = langid.infer(model, [mixed])
    assert lang == "en" and 0.5 < score < 0.85  # about two thirds
    (lang,), (score,) = langid.infer(model, [" ".join(words["fr"] * 5)])
    assert lang == "fr" and score == 1.0  # one language: the penalty keeps the set small


def likelihoods(seed, k=4):
    """Words of one document: their likelihood in each language relative to the best, and the cost of a further language."""
    rng = np.random.default_rng(seed)
    n, mix = int(rng.integers(1, 200)), rng.dirichlet([0.2] * k)
    ll = -rng.gamma(2, 3, size=(n, k))
    ll[np.arange(n), rng.choice(k, size=n, p=mix)] += rng.gamma(2, 3, size=n)
    return np.exp(ll - ll.max(1)[:, None]).T, 2 * np.log(max(n, 2))


def plain_em(like, langs, rounds=1500):
    pi, course = np.ones(len(langs)) / len(langs), []
    for _ in range(rounds):
        r = like[langs] * pi[:, None]
        course.append(np.log(r.sum(0)).sum())
        pi = (r / r.sum(0)).mean(1)
    return pi, course


def test_mixtures_against_all_sets_of_languages():
    for seed in range(30):
        like, cost = likelihoods(seed)
        every = [list(s) for size in range(1, 5) for s in itertools.combinations(range(4), size)]
        best = max(every, key=lambda s: plain_em(like, s)[1][-1] - (len(s) - 1) * cost)
        pi, course = plain_em(like, best)
        got, value = langid.mixtures(like, np.zeros(like.shape[1], int), 1, np.array([cost]))
        assert value[0] == pytest.approx(course[-1] - (len(best) - 1) * cost, abs=0.05)
        assert np.diff(course).min(initial=0) > -1e-9  # the likelihood that the rounds raise is the one that is penalised
        assert np.flatnonzero(got[0] > 1e-6).tolist() == [x for x, p in zip(best, pi, strict=True) if p > 1e-6] or value[0] >= course[-1] - (len(best) - 1) * cost - 1e-3


def test_likelihood_rises_and_the_bound_holds():
    for seed in range(20):
        like, _ = likelihoods(seed)
        doc, all_ = np.zeros(like.shape[1], int), np.ones((1, 4))
        course = [langid._em(like, doc, 1, all_, tolerance=0.0, rounds=r) for r in (0, 1, 2, 5, 20, 400)]
        lls, bounds = [c[1][0] for c in course], [c[2][0] for c in course]
        assert all(b >= a - 1e-9 for a, b in zip(lls, lls[1:], strict=False))
        assert min(bounds) >= lls[-1] - 1e-9


def test_four_languages_in_one_text(spark):
    docs, words = corpus(spark)
    es = "el los las una para con por como pero sus más está también".split()
    model = langid.train(docs.union(spark.createDataFrame([(1000 + k, " ".join(random.Random(k).choices(es, k=30)), "es") for k in range(80)], docs.schema)))
    logp, (grams, starts) = model.logp, langid.trigrams(langid.normalise(" ".join(w for x in (words["en"], words["de"], words["fr"], es) for w in x * 9)))
    ll = np.add.reduceat(logp[grams], starts, axis=0).astype(float)
    pi, _ = langid.mixtures(np.exp(ll - ll.max(1)[:, None]).T, np.zeros(len(ll), int), 1, np.array([2 * np.log(len(ll))]))
    assert (pi[0] > 0.1).all()


def test_language_odd_rows(spark, odd, empty):
    docs, _ = corpus(spark)
    model = langid.train(docs)
    got = langid.identify(odd, model)
    assert got.count() == odd.count() and got.columns == ["doc_id", "lang_pred", "score"]
    rows = by_id(got, "lang_pred", "score")
    for k in (2, 3, 4, 5):
        assert rows[k] == ("und", 0.0)
    assert rows[7][0] != "und"
    assert langid.identify(empty, model).count() == 0
    untrained = langid.train(docs.where("doc_id < 0"))
    assert {r["lang_pred"] for r in langid.identify(odd, untrained).collect()} == {"und"}


def test_language_alike_in_any_batch(spark):
    docs, _ = corpus(spark, 60)
    model = langid.train(docs)
    all_texts = [r["text"] for r in docs.collect()]
    whole = langid.infer(model, all_texts)
    alone = [langid.infer(model, [t]) for t in all_texts]
    assert whole[0] == [a[0][0] for a in alone] and list(whole[1]) == pytest.approx([a[1][0] for a in alone])


# --- toxicity


def labelled(spark, n=400):
    rnd = random.Random(9)
    calm = [f"{a}{b}" for a in ("than", "ere", "ing", "ou", "st") for b in ("the", "ion", "ed", "ly")]
    rude = ["idiot", "scum", "moron", "trash"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [rnd.choice(calm) for _ in range(rnd.randrange(20, 200))]
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(rude))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark, odd):
    docs, labels = labelled(spark)
    held = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, keep=~held)
    got = toxicity.score(docs, model).join(labels.where(held), "doc_id")
    assert got.count() > 50 and got.where("predicted != toxic").count() == 0
    assert got.where("(score >= 0.5) != (predicted = 1) OR score < 0 OR score > 1").count() == 0
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 320


def test_toxicity_odd_rows(spark, odd, empty):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels.union(spark.createDataFrame([(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")))
    got = toxicity.score(odd, model)
    assert got.count() == odd.count()
    rows = by_id(got, "score", "predicted")
    assert rows[2] == rows[3] == rows[4] and rows[2][1] == 0
    assert toxicity.score(empty, model).count() == 0 and toxicity.drop_toxic(empty, model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd, none).collect()} == {0}
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(odd, one).collect()} == {0}


def plain_scores(docs, labels, texts, alpha=1.0, min_z=4.0, l2=1e-3):
    """The same classifier from strings, dictionaries and dense matrices."""

    def grams(text):
        import regex

        padded = f" {regex.sub(r'[^\p{L}\p{M}\p{N}]+', ' ', (text or '').lower())} ".replace("  ", " ") if text else ""
        return {padded[i : i + n] for n in (3, 4, 5, 6) for i in range(len(padded) - n + 1) if " " not in padded[i + 1 : i + n - 1]}

    y = np.array([labels[i] for i, _ in docs], float)
    sets = [grams(t) for _, t in docs]
    seen = {g: (sum(g in s for s, t in zip(sets, y, strict=True) if t), sum(g in s for s, t in zip(sets, y, strict=True) if not t)) for g in set().union(*sets)}
    r = {}
    for g, (p, q) in seen.items():
        x = np.log((p + alpha) / (y.sum() + alpha)) - np.log((q + alpha) / ((1 - y).sum() + alpha))
        if p + q >= 2 and abs(x) / np.sqrt(1 / (p + alpha) + 1 / (q + alpha)) >= min_z:
            r[g] = x
    columns = sorted(r)
    matrix = lambda rows: np.array([[r[g] if g in s else 0.0 for g in columns] for s in rows])
    x, w, b = matrix(sets), np.zeros(len(columns)), 0.0
    for _ in range(20_000):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        step = 1 / (0.25 * ((x**2).sum(1).max() + 1) + l2)
        w, b = w - step * (x.T @ g + l2 * w), b - step * g.sum()
    return 1 / (1 + np.exp(-(matrix([grams(t) for t in texts]) @ w + b)))


def test_toxicity_against_brute_force(spark):
    docs, labels = labelled(spark, 150)
    model = toxicity.train(docs, labels)
    got = by_id(toxicity.score(docs, model), "score")
    rows, of = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()], {r["doc_id"]: r["toxic"] for r in labels.collect()}
    want = plain_scores(rows, of, [t for _, t in rows])
    assert [got[i][0] for i, _ in rows] == pytest.approx(list(want), abs=0.02)


def test_toxicity_repeated_identifiers_and_wide_rows(spark):
    docs, labels = labelled(spark)
    many = docs.union(docs.where("doc_id = 5").crossJoin(spark.range(200)).select("doc_id", "text"))
    a, b = toxicity.train(docs, labels), toxicity.train(many, labels)
    assert a.ids.tolist() == b.ids.tolist() and a.weights.tolist() == pytest.approx(b.weights.tolist(), abs=1e-5)
    few = toxicity.train(docs, labels, max_columns=5)
    got = toxicity.score(docs, few).join(labels, "doc_id")
    assert got.where("predicted != toxic").count() < 5


# --- licenses


def brute_licenses(text, templates, threshold=license_scan.THRESHOLD):
    import re

    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    hits = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    longest, best, found = max(len(t.split()) for _, t in templates), 0.0, {label for _, label in hits}
    for i in range(max(len(w), 1)):
        block = set(w[i : i + 2 * longest])
        for label, t in templates:
            share = len(block & set(t.split())) / len(set(t.split()))
            if share >= threshold - 1e-9:
                found.add(label)
                best = max(best, share)
    places = [i for i, _ in hits]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(found)), 1.0 if places else best


def test_licenses_against_brute_force(spark, odd):
    rnd = random.Random(11)
    rows = []
    for i in range(120):
        w = [rnd.choice("the of a under license work code v 2 0 gnu apache".split()) for _ in range(rnd.randrange(80))]
        if i % 3:
            t = rnd.choice(license_scan.TEMPLATES)[1].split() if i % 2 else rnd.choice(license_scan.PHRASES)[0].split()
            if i % 4 == 1:
                t.pop(rnd.randrange(len(t)))
            at = rnd.randrange(len(w) + 1)
            w[at:at] = t
        rows.append((i, rnd.choice([" ", "-", "\n"]).join(w).title()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    got = sorted((tuple(r) for r in license_scan.scan(docs).collect()), key=str)
    want = sorted(((r["doc_id"], *brute_licenses(r["text"], license_scan.TEMPLATES)) for r in docs.collect()), key=str)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert [g[-1] for g in got] == pytest.approx([w[-1] for w in want])


CLEAR = "redistribution and use in source and binary forms with or without modification are permitted subject to the limitations in the disclaimer below provided that the following conditions are met"


def test_licenses_at_every_offset(spark):
    numbered = " ".join(f"{k} {w}" if k % 2 else w for k, w in enumerate(dict(license_scan.TEMPLATES)["bsd"].split()))
    texts = [" ".join(["x"] * k + [t] + ["y"] * 50) for t in (CLEAR, numbered) for k in range(42)]
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "labels", "score")
    assert [got[k] for k in range(84)] == [("bsd", 1.0)] * 84


def test_licenses_against_every_start(spark):
    rnd = random.Random(17)
    words, docs = "the of a under license work public x y z gnu version".split(), []
    for i in range(150):
        t = rnd.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rnd.randrange(30)):
            t.insert(rnd.randrange(len(t)), rnd.choice(words))
        docs.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(90))) + " " + " ".join(t)))
    longest, want = max(len(t.split()) for _, t in license_scan.TEMPLATES), {}
    for i, text in docs:
        w = text.split()
        shares = [(len({*w[s : s + 2 * longest]} & {*t.split()}) / len({*t.split()}), label) for s in range(len(w)) for label, t in license_scan.TEMPLATES]
        met = [(share, label) for share, label in shares if share >= license_scan.THRESHOLD - 1e-9]
        want[i] = (",".join(sorted({label for _, label in met})), max((share for share, _ in met), default=0.0))
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).where("n_base = 0").collect()
    assert len(got) > 80 and all((r["labels"], r["score"]) == (want[r["doc_id"]][0], pytest.approx(want[r["doc_id"]][1])) for r in got)


def test_license_plan_is_native(odd, empty):
    plan = license_scan.scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert license_scan.scan(empty).count() == 0


def test_rows_of_joins_and_generators_are_rows_of_their_own(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(k, f"x licensed under the mit license {k}", "z") for k in range(4)], "doc_id long, text string, __at string").write.parquet(path)
    d = spark.read.parquet(path)
    for many in (d.crossJoin(spark.range(2)), d.withColumn("e", F.explode(F.array(F.lit(1), F.lit(2)))), d.union(d), spark.read.parquet(path, path)):
        got = license_scan.scan(many)
        assert got.count() == 8 and got.where("labels = 'mit'").count() == 8


def test_ascii_lower(spark):
    d = spark.createDataFrame([("ÀBKİz",), ("ABC",)], "t string").select(ascii_lower(F.col("t")).alias("x"))
    assert [r["x"] for r in d.collect()] == ["ÀbKİz", "abc"]
