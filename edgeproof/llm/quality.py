"""Quality classifier: random-indexing word vectors pooled a document, and a two-layer network.

Every word has a sparse random index vector; a word's context vector is the sum of the index
vectors around it over the whole corpus. Words are hashed to a fixed number of rows, so the
context table has a fixed size however large the corpus: partitions add up their own tables before
a small shuffle of table blocks. Documents are pooled (mean, spread, likeness of neighbours, all of
word vectors) and a two-layer network, with a temperature fitted on held-back labelled rows, gives
the probability.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, hash_words, mix64, one_label, raw_texts, scan, slices

ROWS, DIM, NONZERO, WINDOW, BLOCKS = 1 << 13, 32, 4, 2, 32
#: Characters worked on at once: bounds a task's memory.
SLICE_CHARS = 2_000_000
#: The bound on labelled rows that the network is fitted on.
MAX_LABELLED = 20_000
_PIECE = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\s]+")


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each piece (a run of letters and digits, or of other signs), and counts."""
    split = [_PIECE.findall(t.lower()) for t in texts]
    counts = np.array([len(s) for s in split], dtype=np.int64)
    h = hash_words([w for s in split for w in s])
    return (mix64(h) >> np.uint64(64 - 13)).astype(np.int64), counts


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's index vector."""
    rng = np.random.default_rng(seed)
    place = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO]
    return place, rng.choice([-1.0, 1.0], (ROWS, NONZERO))


def contexts(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Context vectors of one batch, by row, with the word counts in the last column."""
    place, sign = index_vectors()
    out = np.zeros(ROWS * DIM)
    doc = np.repeat(np.arange(len(counts)), counts)
    for off in range(1, WINDOW + 1):
        ok = doc[off:] == doc[:-off]
        a, b = rows[:-off][ok], rows[off:][ok]
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                out += np.bincount(x * DIM + place[y, j], weights=sign[y, j], minlength=ROWS * DIM)
    return np.concatenate([out.reshape(ROWS, DIM), np.bincount(rows, minlength=ROWS)[:, None]], axis=1)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """Context vectors over all documents, scaled to unit length, ROWS x DIM."""

    def part(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            texts = raw_texts(batch)
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                rows, counts = pieces(texts[a:b])
                got = contexts(rows, counts)
                total = got if total is None else total + got
        if total is not None:
            each = ROWS // BLOCKS
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([total[i * each : (i + 1) * each].astype("<f4").tobytes() for i in range(BLOCKS)], pa.binary())], names=["block", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        data = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in pdf["data"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [data.astype("<f8").tobytes()]})

    # A first sum within groups of partitions, so that no task reads a block of every partition.
    parts = documents.select("text").mapInArrow(part, "block int, data binary").withColumn("side", F.pmod(F.spark_partition_id(), F.lit(64)))
    first = parts.groupBy("block", "side").applyInPandas(lambda k, p: pd.DataFrame({"block": [k[0]], "data": [sum(np.frombuffer(x, "<f4").astype(np.float64) for x in p["data"]).astype("<f4").tobytes()]}), "block int, data binary")
    got = {r["block"]: r["data"] for r in first.groupBy("block").applyInPandas(add, "block int, data binary").collect()}  # 2 MB whatever the corpus
    if not got:
        return np.zeros((ROWS, DIM))
    table = np.concatenate([np.frombuffer(got[i], "<f8") for i in range(BLOCKS)]).reshape(ROWS, DIM + 1)
    vec, n = table[:, :DIM], table[:, DIM:]
    vec = vec / np.sqrt(np.maximum(n, 1))  # common words' sums grow; their direction is what counts
    return vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)


FEATURES = 2 * DIM + 5


def pool(rows: np.ndarray, counts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and three likenesses of neighbours' vectors of each document, its size, and 1."""
    out = np.zeros((len(counts), FEATURES), np.float32)
    out[:, -1] = 1
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    at = (np.cumsum(counts) - counts)[full]
    n = counts[full][:, None]
    v = vectors.astype(np.float32)[rows]
    mean = np.add.reduceat(v, at) / n
    out[full, :DIM] = mean
    out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, at) / n - mean * mean, 0))
    for j, off in enumerate((1, 2)):
        near = np.zeros(len(rows), np.float32)
        near[off:] = (v[off:] * v[:-off]).sum(1)
        same = np.zeros(len(rows), np.float32)
        same[off:] = near[off:] > 0.9999
        for a in range(off):
            near[np.minimum(at + a, len(near) - 1)] = 0
            same[np.minimum(at + a, len(near) - 1)] = 0
        out[full, 2 * DIM + j] = np.add.reduceat(near, at) / n[:, 0]
        if off == 1:
            out[full, 2 * DIM + 2] = np.add.reduceat(same, at) / n[:, 0]
    out[full, 2 * DIM + 3] = np.log1p(n[:, 0]) / 8
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    notes: dict = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 1) -> Network:
    """Adam on the cross entropy; a fifth of the rows is held back for the temperature."""
    rng = np.random.default_rng(seed)
    f = x.shape[1] if x.ndim == 2 else FEATURES
    net = Network(np.zeros(f), np.ones(f), np.zeros((f, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else min(max(float(y[0]), 0.01), 0.99)
        net.b2 = float(np.log(p / (1 - p)))
        return net
    net.mean, net.scale = x.mean(0), x.std(0) + 1e-3
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 50 else order
    use = order[len(y) // 5 :] if len(y) >= 50 else order
    net.w1, net.w2 = rng.normal(0, 1 / np.sqrt(f), (f, hidden)), rng.normal(0, 1 / np.sqrt(hidden), hidden)
    params = [net.w1, net.b1, net.w2, np.array([0.0])]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - net.mean) / net.scale
    for _ in range(epochs):
        rng.shuffle(use)
        for s in range(0, len(use), 256):
            b = use[s : s + 256]
            h = np.tanh(z[b] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -30, 30))) - y[b]) / len(b)
            dh = d[:, None] * params[2] * (1 - h * h)
            grads = [z[b].T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            t += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, best = net.logits(x[held]), np.inf
    for temp in np.geomspace(0.3, 10, 60):
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / temp, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))
        if loss < best:
            best, net.temperature = loss, float(temp)
    return net


def classify(documents: DataFrame, labels: DataFrame, usable, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, score: the probability that a document's quality label is 1, learnt from the
    labelled rows where usable holds (at most about bound of them, by a hash of the id).

    Null and empty texts are scored as texts without words; null ids are scored, never learnt
    from; repeated rows are scored each; no usable label, or one kind only, gives a constant.
    """
    spark = documents.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(documents))

    def vectorise(batch):
        ids, texts = column(batch, "doc_id"), raw_texts(batch)
        for a, b in slices([len(t) for t in texts], SLICE_CHARS):
            x = pool(*pieces(texts[a:b]), vectors.value)
            yield {"doc_id": ids.slice(a, b - a), "x": [r.astype("<f4").tobytes() for r in x]}

    pooled = cut(scan(documents.select("doc_id", "text"), vectorise, "doc_id long, x binary"), "pooled")
    known = one_label(labels, "quality").where(usable)
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    rows = pooled.join(F.broadcast(known), "doc_id").select("doc_id", "x", "label").toPandas().sort_values(["doc_id", "x"])  # about bound rows at most
    x = np.stack([np.frombuffer(v, "<f4") for v in rows["x"]]).astype(np.float64) if len(rows) else np.zeros((0, FEATURES))
    net = train(x, rows["label"].to_numpy(dtype=float))
    sent = spark.sparkContext.broadcast(net)

    def judge(batch):
        x = np.stack([np.frombuffer(v, "<f4") for v in column(batch, "x").to_pylist()]).astype(np.float64)
        return {"doc_id": column(batch, "doc_id"), "score": sent.value.probability(x)}

    return scan(pooled, judge, "doc_id long, score double")
