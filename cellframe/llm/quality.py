"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is read as words: runs of letters in lower case, runs of digits as one sign, runs of other signs as they stand, line ends. A word that
repeats the one before is named so, and so is a word in capitals; single words and pairs are hashed into a fixed number of buckets,
their counts damped by a logarithm and scaled to length one. Whole texts are read.

Training takes a sample of labelled rows, SAMPLE at most whatever the corpus holds (the smallest hashes of their ids), so its cost is bounded; it runs in one
task, in an order fixed by the hash, so reruns agree. Weights have a fixed size and are sent to all executors. Scoring is one pass of sparse dot products.

Defined results. An empty or null text is scored by the bias. Rows without label, or with a null label, are not learnt from. With no
labelled rows at all, or one class only, every score is that class's share (0.5 if there is none). Repeated rows score alike. If an
id has several labels the largest counts once; of several texts of an id that with the least hash is learnt from. Other columns of the input are kept out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, documents, is_small, written

BUCKETS = 1 << 18
#: Most rows to learn from.
SAMPLE = 16_384
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.1, 0.1
THRESHOLD = 0.7
#: Words whose hash a Python process remembers.
KNOWN = 50_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|(?:[^\w\s]|_)+")
_known: dict[str, int] = {}


def _hash(token: str) -> int:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    if len(_known) >= KNOWN:
        _known.clear()
    _known[token] = h
    return h


_SAME, _UPPER, _NUMBER = (zlib.crc32(s) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for s in (b"\x00same", b"\x00upper", b"\x00number"))


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bucket numbers (int32) and values (float32) of length one; empty for a text without words."""
    words = _TOKEN.findall(text) if text else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    known = _known
    h = np.empty(len(words), dtype=np.uint64)
    last = ""
    for i, w in enumerate(words):
        if w == last:
            h[i] = _SAME
            continue
        last = w
        if len(w) > 1 and w.isupper():
            h[i] = _UPPER
        elif w.isdigit():
            h[i] = _NUMBER
        else:
            k = known.get(w)
            h[i] = k if k is not None else _hash(w.lower()) if w.islower() else _hash_as(w)
    pairs = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] + np.uint64(0x165667B19E3779F9))
    both = np.concatenate((h, pairs * np.uint64(0x9E3779B97F4A7C15)))
    at, n = np.unique((both >> np.uint64(40)) % np.uint64(buckets), return_counts=True)
    v = np.log1p(n)
    return at.astype(np.int32), (v / np.sqrt((v * v).sum())).astype(np.float32)


def _hash_as(word: str) -> int:
    """The hash of its lower case, remembered for the word as it stands."""
    h = _known.get(word.lower())
    h = _hash(word.lower()) if h is None else h
    if len(_known) < KNOWN:
        _known[word] = h
    return h


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights by bucket; the last is the bias, which isn't shrunk."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for _ in range(epochs):
        for (at, v), y in zip(rows, labels):
            at, v = np.append(at, buckets), np.append(v, 1.0)
            w = _weights(z[at], n[at], alpha, beta, l1, l2)
            if at[-1] == buckets:
                w[-1] = -z[buckets] * alpha / (beta + np.sqrt(n[buckets]))
            g = (sigmoid(w @ v) - y) * v
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = _weights(z, n, alpha, beta, l1, l2)
    w[buckets] = -z[buckets] * alpha / (beta + np.sqrt(n[buckets]))
    return w


def _weights(z, n, alpha, beta, l1, l2):
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def _features_of(buckets):
    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):  # features are handed on in small pieces
                part = b.iloc[i : i + 256]
                found = [features(t, buckets) for t in part["text"]]
                yield pd.DataFrame({"_order": part["_order"].to_numpy(), "label": part["label"].to_numpy(), "at": [f[0] for f in found], "v": [f[1] for f in found]})

    return run


def _train_all(buckets):
    def run(batches: Iterator[pd.DataFrame]):
        # the sample as three flat arrays: one copy of it, without an object for each row
        at, v, sizes, y, order = [], [], [], [], []
        for b in batches:
            at.append(np.concatenate([*b["at"], np.zeros(0)]).astype(np.int32))
            v.append(np.concatenate([*b["v"], np.zeros(0)]).astype(np.float32))
            sizes += map(len, b["at"])
            y.append(b["label"].to_numpy(float))
            order.append(b["_order"].to_numpy(np.int64))
        w = np.zeros(buckets + 1)
        if sizes:
            at, v, y, order = map(np.concatenate, (at, v, y, order))
            ends = np.cumsum(sizes)
            rows = [(at[e - n : e], v[e - n : e]) for e, n in zip(ends.tolist(), sizes)]
            first = np.argsort(order, kind="stable")
            if 0 < y.mean() < 1:
                w = train([rows[k] for k in first], y[first], buckets)
            else:
                w[buckets] = 35.0 if y[0] else -35.0
        yield pd.DataFrame({"w": [w.astype(np.float32).tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE, buckets: int = BUCKETS) -> np.ndarray:
    """Weights from rows of docs that have a label (by id); docs holds only rows that may be learnt from."""
    wanted = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).filter("_id is not null and label is not null").groupBy("_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.lit("quality"), F.col("_id").cast("string"))
    ids = docs.select(F.col(doc_id).alias("_id")).filter("_id is not null").distinct()
    chosen = written(wanted.join(ids, "_id").withColumn("_order", order).orderBy("_order", "_id").limit(sample), "quality-labels")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen) if is_small(chosen) else chosen, "_id")
    # of rows that repeat an id the one whose text has the least hash is learnt from
    rows = rows.groupBy("_id", "label", "_order").agg(F.min(F.struct(F.xxhash64("text").alias("_th"), "text")).getField("text").alias("text"))
    rows = rows.select("text", F.col("label").cast("double").alias("label"), "_order").mapInPandas(_features_of(buckets), "_order long, label double, at array<int>, v array<float>")
    got = rows.repartition(1).mapInPandas(_train_all(buckets), "w binary").first()
    return np.frombuffer(got["w"], dtype=np.float32).astype(np.float64)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with column score appended (an existing one is replaced)."""
    buckets = len(weights) - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = sent.value.astype(np.float64)
        for s in texts:
            out = np.empty(len(s))
            for i, t in enumerate(s):
                at, v = features(t, buckets)
                out[i] = w[at] @ v + w[buckets]
            yield pd.Series(sigmoid(out))

    return docs.withColumn("score", of(F.col(text)))


def op8_quality(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = crc32_of("doc_id") % 4 == 2
    weights = fit(docs.filter(~held), documents(spark, sf_dir, "labels"))
    return score(docs, weights).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
