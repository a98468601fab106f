"""Toxicity: a character n-gram linear classifier with naive-Bayes-scaled features.

Features are hashed character n-grams (3 to 6 characters, inside blank-padded words, present or absent).
Over labelled texts each gets the log-count ratio ``r`` of its smoothed share among toxic and clean texts;
those whose ratio is significant (|r| at least ``min_z`` standard errors) become columns valued ``r``, and a
logistic regression over them gives the score. All counting is distributed; what reaches the driver is
bounded by ``max_features``, by ``max_rows``, the documented bound on the labelled rows that train, and by
``max_columns``, the most columns that one of them trains with (those of the largest ratios).

Cases: a null or empty text has no n-gram and gets the score of the intercept; without labelled rows of both
classes the score is the smoothed base rate (0 without any); texts of any length are read whole; repeated
rows each return a row; labelled rows with a null label, identifier or text are not learned from (a document
labelled both ways counts once for each label, rows of one identifier once, with the smallest of their texts); an empty table returns an empty table; only the named
columns are read.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import materialize

ORDERS = (3, 4, 5, 6)
BITS = 20
_GAP = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def buckets(text: str | None) -> np.ndarray:
    """Buckets of a text's n-grams, repeats included. An n-gram may start or end with a blank, not cross one."""
    if not text:
        return np.zeros(0, np.int32)
    codes = np.frombuffer(f" {_GAP.sub(' ', text.lower())} ".replace("  ", " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    blank = codes == 32
    h, crossing, found = codes * _STEP, np.zeros(len(codes), bool), []
    for n in range(2, ORDERS[-1] + 1):
        if len(codes) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * _STEP + codes[n - 1 :]
        if n > 2:
            crossing = crossing[:-1] | blank[n - 2 : -1]
        else:
            crossing = crossing[:-1]
        if n in ORDERS:
            found.append(((h[~crossing] * _MUL) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


@dataclasses.dataclass
class Model:
    ids: np.ndarray  # sorted buckets
    weights: np.ndarray  # ratio times regression weight
    intercept: float

    def scorer(self):
        table = np.zeros(1 << BITS, np.float32)
        table[self.ids] = self.weights
        used = table != 0

        def score(text: str | None) -> float:
            b = buckets(text)
            x = self.intercept + float(table[np.unique(b[used[b]])].sum(dtype=np.float64))
            return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))

        return score


def _logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n_cols: int, l2: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the mean log loss plus ``l2`` / 2 times the squared weights."""
    n = len(y)
    norm = np.bincount(rows, vals**2, n).max(initial=1e-9)
    step = 1 / (0.25 * (norm + 1) + l2)
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = v = np.zeros(n_cols)
    b = c = float(np.log(base / (1 - base)))
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, vals * v[cols], n) + c, -50, 50)))
        g = (p - y) / n
        w1, b1 = v - step * (np.bincount(cols, vals * g[rows], n_cols) + l2 * v), c - step * g.sum()
        m = t / (t + 3)
        v, c = w1 + m * (w1 - w), b1 + m * (b1 - b)
        w, b = w1, b1
    return w, b


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, max_features: int = 20_000, max_columns: int = 4_000, min_z: float = 4.0, alpha: float = 1.0, l2: float = 1e-3) -> Model:
    """Fit on at most about ``max_rows`` labelled rows, chosen by a hash of their identifier. ``keep``: which rows of
    ``labels`` may be learned from."""
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    lab = (lab.where(keep) if keep is not None else lab).select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("int").alias("__y")).distinct()
    lab = lab.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))

    def features(batches):
        for batch in batches:
            found = [np.unique(buckets(t)).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["y", "ids"])

    sample = texts.join(F.broadcast(lab), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text")).select("__y", "__text")  # max_rows bounds the broadcast side
    sample = materialize(sample.mapInArrow(features, "y int, ids binary"), "toxic-sample")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        rate = (size.get(1, 0) + 1) / (sum(size.values()) + 2) if size else 0.0
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(rate / (1 - rate))) if rate else -500.0)

    def counts(batches):
        n = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for y, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y, np.frombuffer(ids, "<i4")] += 1
        at = np.flatnonzero(n.sum(0))
        for i in range(0, len(at), 50_000):
            k = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[1, k]), pa.array(n[0, k])], ["id", "p", "q"])

    p, q = F.col("p") + alpha, F.col("q") + alpha
    ratio = F.log(p / (size[1] + alpha)) - F.log(q / (size[0] + alpha))
    chosen = (
        sample.mapInArrow(counts, "id int, p long, q long").groupBy("id").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        .where(F.col("p") + F.col("q") >= 2).select("id", ratio.alias("r"), (F.abs(ratio) / F.sqrt(1 / p + 1 / q)).alias("z"))
        .where(F.col("z") >= min_z).orderBy(F.desc("z"), "id").limit(max_features).collect()
    )
    ids = np.array(sorted(r["id"] for r in chosen), np.int32)
    r = np.array([r["r"] for r in sorted(chosen, key=lambda r: r["id"])])

    def columns(batches):
        for batch in batches:
            found = []
            for b in batch.column(1).to_pylist():
                b = np.frombuffer(b, "<i4")
                at = np.searchsorted(ids, b)
                at[at == len(ids)] = 0
                at = at[ids[at] == b] if len(ids) else at[:0]
                if len(at) > max_columns:
                    at = np.sort(at[np.argsort(-np.abs(r[at]), kind="stable")[:max_columns]])
                found.append(at.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["y", "cols"])

    got = sample.mapInArrow(columns, "y int, cols binary").collect()  # at most max_rows rows
    y = np.array([x["y"] for x in got], float)
    each = [np.frombuffer(x["cols"], "<i4") for x in got]
    rows, cols = np.repeat(np.arange(len(y)), [len(x) for x in each]), np.concatenate(each).astype(np.int64)
    if not len(cols):
        base = (size[1] + 1) / (size[0] + size[1] + 2)
        return Model(ids[:0], np.zeros(0, np.float32), float(np.log(base / (1 - base))))
    w, b = _logistic(rows, cols, r[cols], y, len(ids), l2)
    return Model(ids, (w * r).astype(np.float32), float(b))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row."""
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        of = model.scorer()
        for batch in batches:
            s = np.array([of(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double, predicted int")


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, with all their columns."""
    at, schema = df.columns.index(text_col), df.schema

    def run(batches):
        of = model.scorer()
        for batch in batches:
            keep = pa.array([of(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return df.mapInArrow(run, schema)
