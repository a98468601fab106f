"""Language identification by multilingual mixture inference.

Every word of a text is drawn from one language of an unknown mixture; its likelihood under a language is the
product of its letter-trigram probabilities (hashed, additively smoothed). Expectation-maximisation gives the
proportions of the languages, run until a bound shows that no others are likelier by more than a hundredth; the set
of languages is selected by penalised likelihood, each further language costing ``penalty`` times half the logarithm of
the number of words: it grows, whatever the number of languages, until no larger set can have a higher one.
The prediction is the language of the largest proportion.

The trigram counts are learned from a documented bound of about ``rows_per_lang`` texts a language, chosen by a
hash of the identifier; predictions cover every row and whole texts.

Cases: null, empty or letterless texts give ``und`` with score 0; ties go to the smaller language name; without
training rows everything is ``und``; repeated rows each return a row; an empty table returns an empty table;
only the named columns are read.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
CHUNK_CHARS = 1_000_000
_GAP = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def trigrams(norm: str) -> tuple[np.ndarray, np.ndarray]:
    """Of blank-padded words: the hashed trigram around each letter, and where each word's trigrams begin."""
    codes = np.frombuffer(norm.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mid = codes[1:-1]
    letter = mid != 32
    h = (codes[:-2] * _A) ^ (mid * _MUL) ^ (codes[2:] * _B)
    h = ((h ^ (h >> np.uint64(29))) * _MUL >> np.uint64(64 - BITS)).astype(np.int64)
    first = (letter & (codes[:-2] == 32))[letter]
    return h[letter], np.flatnonzero(first)


def normalise(text: str | None) -> str:
    return f" {_GAP.sub(' ', text.lower()).strip()} " if text else "  "


@dataclasses.dataclass
class Model:
    langs: list[str]  # sorted
    logp: np.ndarray  # buckets x languages, float32


def train(docs: DataFrame, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 1500, alpha: float = 0.05) -> Model:
    """Trigram probabilities of each language from at most about ``rows_per_lang`` of its rows."""
    src = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    src = (src.where(keep) if keep is not None else src).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    size = {r[0]: r[1] for r in src.groupBy("__lang").count().collect()}  # a row a language
    if not size:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    langs = sorted(size)
    share = F.create_map(*[F.lit(x) for lang, n in size.items() for x in (lang, min(1.0, rows_per_lang / n))])
    sample = src.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_003)) < share[F.col("__lang")] * 1_000_003).select("__lang", "__text")

    def counts(batches):
        n = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n.setdefault(lang, np.zeros(1 << BITS, np.int64))
                np.add.at(n[lang], trigrams(normalise(text))[0], 1)
        for lang, c in n.items():
            at = np.flatnonzero(c)
            for i in range(0, len(at), 50_000):
                k = at[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(c[k])], ["lang", "bucket", "n"])

    got = sample.mapInArrow(counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((1 << BITS, len(langs)))  # bounds what comes to the driver: buckets times languages
    at = np.searchsorted(langs, got.column("lang").to_numpy(zero_copy_only=False).astype(str)) if got.num_rows else np.zeros(0, int)
    n[got.column("bucket").to_numpy(), at] = got.column("n").to_numpy()
    used = (n.sum(1) > 0).sum() + 1
    return Model(langs, np.log((n + alpha) / (n.sum(0) + alpha * used)).astype(np.float32))


def _em(like: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray, enough: np.ndarray | None = None, tolerance: float = 0.01, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions, log likelihood and an upper bound of it, of each document over its allowed languages.

    like: languages x words, relative to each word's best language; each word counts once, in the proportions as in the
    likelihood, so no round lowers it. The likelihood is concave: no proportions can beat it by more than the steepest
    slope beyond the number of words, which is the bound. A document is done when the two are within ``tolerance``, or when
    the bound is at most ``enough``."""
    pi = allowed / allowed.sum(1, keepdims=True)
    ll, bound = np.zeros(n_docs), np.full(n_docs, np.inf)
    enough = np.full(n_docs, -np.inf) if enough is None else enough
    some, l, d = np.arange(n_docs), like, doc  # what isn't done, its words, and their documents among it
    for t in range(rounds + 1):
        n = np.bincount(d, minlength=len(some))
        now = pi[some]
        r = l * now.T[:, d]
        total = np.maximum(r.sum(0), 1e-300)
        slope = np.stack([np.bincount(d, x / total, len(some)) for x in l], 1)
        ll[some] = np.bincount(d, np.log(total), len(some))
        bound[some] = np.minimum(bound[some], ll[some] + np.where(allowed[some] > 0, slope, 0).max(1) - n)
        going = (bound[some] - ll[some] > tolerance) & (bound[some] > enough[some])
        if t == rounds or not going.any():
            break
        pi[some] = now * slope / np.maximum(n, 1)[:, None]
        if going.mean() < 0.7:  # leave out the words of what is done
            pi[some[~going]] = now[~going]
            number = np.cumsum(going) - 1
            mine = going[d]
            some, l, d = some[going], l[:, mine], number[d[mine]]
    return pi, ll, bound


def _of(some: np.ndarray, n_docs: int, like: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some documents, these numbered anew."""
    number = np.full(n_docs, -1)
    number[some] = np.arange(len(some))
    mine = number[doc] >= 0
    return like[:, mine], number[doc[mine]]


def mixtures(like: np.ndarray, doc: np.ndarray, n_docs: int, cost: np.ndarray, beam: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and penalised log likelihood of each document's best set of languages.

    Sets grow by one language at a time: all extensions of the ``beam`` likeliest sets of a size are tried, which are all
    sets there are of up to four languages. A document is done when the bound over all languages shows that no larger set
    can have a higher penalised likelihood; a set is left when its bound shows that it can't."""
    k, every = len(like), np.arange(n_docs)
    single = np.stack([np.bincount(doc, np.log(x), n_docs) for x in like], 1)
    pi = np.zeros((n_docs, k))
    pi[every, single.argmax(1)] = 1.0
    best = single.max(1)
    some = np.flatnonzero(best < -cost) if k > 1 else every[:0]  # relative to each word's best language nothing is above 0
    l, d = _of(some, n_docs, like, doc)
    _, _, top = _em(l, d, len(some), np.ones((len(some), k)), best[some] + cost[some])
    some, top = some[top > best[some] + cost[some]], top[top > best[some] + cost[some]]
    kept, size = [[(j,) for j in np.argsort(-single[i], kind="stable")[:beam].tolist()] for i in some], 1
    while len(some):
        size += 1
        wider = [sorted({tuple(sorted((*a, j))) for a in sets for j in range(k) if j not in a}) for sets in kept]
        l, d = _of(some, n_docs, like, doc)
        found: list[list] = [[] for _ in some]
        for c in range(max(map(len, wider))):
            has = np.array([i for i, w in enumerate(wider) if len(w) > c])
            allowed = np.zeros((len(has), k))
            allowed[np.repeat(np.arange(len(has)), size), [j for i in has for j in wider[i][c]]] = 1.0
            mine, extra = some[has], (size - 1) * cost[some[has]]
            p, ll, _ = _em(*(_of(has, len(some), l, d) if len(has) < len(some) else (l, d)), len(has), allowed, best[mine] + extra)
            up = ll - extra > best[mine]
            best[mine[up]], pi[mine[up]] = (ll - extra)[up], p[up]
            for i, x in zip(has, ll.tolist(), strict=True):
                found[i].append((-x, wider[i][c]))
        going = (top - size * cost[some] > best[some]) & (size < k)
        kept = [[a for _, a in sorted(f)[:beam]] for f, g in zip(found, going, strict=True) if g]
        some, top = some[going], top[going]
    return pi, best


def infer(model: Model, texts: list[str | None], penalty: float = 4.0) -> tuple[list[str], np.ndarray]:
    """(predicted language, its proportion) of each text."""
    n, k = len(texts), len(model.langs)
    lang, score = ["und"] * n, np.zeros(n)
    norms = [normalise(t) if t and _LETTER.search(t) else "" for t in texts]
    known = [i for i in range(n) if norms[i]]
    if not known or not k:
        return lang, score
    ll, doc = [], []
    for d, i in enumerate(known):
        grams, starts = trigrams(norms[i])
        if len(starts):
            ll.append(np.add.reduceat(model.logp[grams], starts, axis=0).astype(np.float64))
            doc.append(np.full(len(starts), d))
    if not ll:
        return lang, score
    ll, doc = np.concatenate(ll), np.concatenate(doc)
    m = len(known)
    like = np.exp(np.maximum(ll - ll.max(1)[:, None], -700.0).T)
    words = np.bincount(doc, minlength=m)
    pi, _ = mixtures(like, doc, m, penalty * 0.5 * np.log(np.maximum(words, 2)))
    for d, i in enumerate(known):
        j = int(pi[d].argmax())
        lang[i], score[i] = model.langs[j], min(1.0, float(pi[d, j]))
    return lang, score


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row."""
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHUNK_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                lang, score = infer(model, texts[at:end])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(lang, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])
                at = end

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, lang_pred string, score double")
