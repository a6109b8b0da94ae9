"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents, so token labels are derived: in toxic documents, tokens with a
feature (word, prefix or suffix) that is many times commoner in toxic documents than in clean
ones, and then, once, the tokens that the field itself tags. The field has two states; a token's
score is a sum over its hashed features and those of its neighbours. Forward-backward marginals
give toxic spans; their sums and maxima, through a small logistic model, the document's score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chain import batches, gather, recursions
from .common import column, hash_words, mix64, one_label, scan, slices, text_slices

#: Hashed feature space; characters of prefixes and suffixes that are features.
SPACE, AFFIXES = 1 << 18, (3, 4, 5, 6, 7)
#: The bound on labelled documents that the field is fitted on, and on characters of each batch.
MAX_LABELLED, BATCH_CHARS = 3_000, 2_000_000
#: Clean documents for each toxic one that the field itself is fitted on; all take part in the
#: token labels and in the documents' logistic model.
CLEAN_SHARE = 2
_TOKEN = re.compile(r"[^\W_]+")
_AROUND = (0, -1, 1)  # whose features count for a token


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of words: runs of letters and digits."""
    return [m.span() for m in _TOKEN.finditer(text)]


class Vocabulary:
    """Numbers of distinct words, and the features of each, worked out once."""

    def __init__(self):
        self.of: dict[str, int] = {}

    def index(self, words: list[str]) -> np.ndarray:
        of = self.of
        return np.fromiter((of.setdefault(w, len(of)) for w in words), dtype=np.int64, count=len(words))

    def table(self) -> np.ndarray:
        """Hashed features of each word: itself, its prefixes, its suffixes."""
        words, out = list(self.of), []
        for s in range(0, len(words), 50_000):  # the features as text take the most memory
            fresh = []
            for w in words[s : s + 50_000]:
                b = w.lower()
                fresh += [("w:" + b).encode(), *(f"p{k}:{b[:k]}".encode() for k in AFFIXES), *(f"s{k}:{b[-k:]}".encode() for k in AFFIXES[:3])]
            out.append((mix64(hash_words(fresh)) >> np.uint64(46)).astype(np.int64).reshape(-1, 1 + len(AFFIXES) + 3))
        return np.concatenate(out) if out else np.zeros((0, 1 + len(AFFIXES) + 3), np.int64)


def read(texts: list[str]) -> tuple[list[list[tuple[int, int]]], np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each text, numbers of tokens, each token's row in the table, the table."""
    spans, words = [tokens(t) for t in texts], Vocabulary()
    counts = np.array([len(s) for s in spans], dtype=np.int64)
    index = words.index([t[a:b] for t, s in zip(texts, spans, strict=True) for a, b in s])
    return spans, counts, index, words.table()


def read_sample(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As read, without spans and a slice at a time: for the driver."""
    words, counts, index = Vocabulary(), [], []
    for a, b in slices([len(t) for t in texts], BATCH_CHARS):
        found = [_TOKEN.findall(t) for t in texts[a:b]]
        counts += [len(f) for f in found]
        index.append(words.index([w for f in found for w in f]))
    return np.array(counts, dtype=np.int64), np.concatenate(index) if index else np.zeros(0, np.int64), words.table()


@dataclass
class Field:
    weights: np.ndarray  # (neighbour, feature): score of the toxic state
    bias: float
    step: np.ndarray  # log transition scores
    head: np.ndarray  # the logistic model over document features
    prior: float

    def scores(self, counts: np.ndarray, index: np.ndarray, table: np.ndarray) -> np.ndarray:
        total = np.full(len(index), self.bias)
        ends = np.cumsum(counts)
        for k, off in enumerate(_AROUND):
            own = self.weights[k][table].sum(1)[index] if len(table) else np.zeros(0)
            if off == 0:
                total += own
                continue
            moved = np.zeros(len(index))
            if off < 0:
                moved[1:] = own[:-1]
                moved[(ends - counts)[counts > 0]] = 0
            else:
                moved[:-1] = own[1:]
                moved[ends[counts > 0] - 1] = 0
            total += moved
        return total

    def marginals(self, counts: np.ndarray, score: np.ndarray, want_xi: bool = False):
        """P(toxic) of each token; with want_xi also expected transitions."""
        p, xi, loglik = np.zeros(len(score)), np.zeros((2, 2)), 0.0
        starts = np.cumsum(counts) - counts
        full = np.flatnonzero(counts)
        for g in batches(counts[full]):
            g = full[g]
            at = gather(starts[g], counts[g])
            x = np.clip(score[at], -30, 30)
            top = np.maximum(x, 0)
            e = np.stack([np.exp(-top), np.exp(x - top)], 1)
            r = recursions(e, counts[g], np.exp(self.step), np.ones(2))
            p[at], xi, loglik = r.gamma[:, 1], xi + r.xi, loglik + r.loglik.sum() + top.sum()
        return (p, xi, loglik) if want_xi else p

    def documents(self, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Features of each document from its tokens' marginals."""
        starts = np.cumsum(counts) - counts
        out = np.zeros((len(counts), 6))
        full = np.flatnonzero(counts)
        if len(full):
            sums = np.add.reduceat(p, starts[full])
            out[full, 0] = np.maximum.reduceat(p, starts[full])
            out[full, 1] = np.log1p(sums)
            out[full, 2] = np.sqrt(sums / counts[full]) * 3
            hard = np.add.reduceat((p > 0.5).astype(float), starts[full])
            out[full, 3] = np.log1p(hard)
            out[full, 4] = hard >= 2
        out[:, 5] = 1
        return out

    def document_scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.head, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) / 100 * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (y - p) - ridge * len(y) / 100 * w)
        w += d
        if np.abs(d).max() < 1e-6:
            break
    return w


def _token_labels(counts, index, table, toxic, lift: float = 12.0, support: float = 0.02) -> np.ndarray:
    """1 for tokens of toxic documents with a feature at least lift times as common there as in
    clean ones and found in at least 4 toxic documents and that share of them."""
    doc = np.repeat(np.arange(len(counts)), counts)
    bad = toxic[doc]
    width = table.shape[1]
    # Occurrences of words, carried over to their features.
    n1, n0 = bad.sum() + 1, (~bad).sum() + 1
    c1, c0 = (np.bincount(table.ravel(), weights=np.repeat(np.bincount(index[m], minlength=len(table)), width), minlength=SPACE) for m in (bad, ~bad))
    rate = ((c1 + 0.1) / n1) / ((c0 + 1.0) / n0)
    seen = np.unique(index[bad] * np.int64(len(counts)) + doc[bad])
    pairs = np.unique(table[seen // len(counts)] * np.int64(len(counts)) + (seen % len(counts))[:, None])
    docs = np.bincount(pairs // len(counts), minlength=SPACE)
    hot = (rate >= lift) & (docs >= max(4.0, support * toxic.sum()))
    return (hot[table].any(1)[index] & bad).astype(float)


def fit(rows: pd.DataFrame, rounds: tuple[int, ...] = (30, 15)) -> Field:
    """rows: doc_id, text, label. Full-batch adaptive gradient steps, in rounds: after each one, tokens of
    toxic documents that the field tags are labelled too."""
    rows = rows.drop_duplicates("text")
    y = rows["label"].to_numpy().astype(bool)
    field = Field(np.zeros((len(_AROUND), SPACE)), 0.0, np.zeros((2, 2)), np.zeros(6), float(y.mean()) if len(y) else 0.5)
    if not len(y) or y.all() or not y.any():
        p = min(max(field.prior, 1e-3), 1 - 1e-3)
        field.head[5] = math.log(p / (1 - p))
        return field
    counts_all, index_all, table = read_sample([t or "" for t in rows["text"]])
    labelled = _token_labels(counts_all, index_all, table, y)
    clean = np.flatnonzero(~y)
    used = np.sort(np.concatenate([np.flatnonzero(y), clean[:: max(1, len(clean) // max(1, CLEAN_SHARE * int(y.sum())))]]))
    at = gather((np.cumsum(counts_all) - counts_all)[used], counts_all[used])
    counts, index, target, toxic = counts_all[used], index_all[at], labelled[at], np.repeat(y[used], counts_all[used])
    feats, firsts, lasts = table[index], (np.cumsum(counts) - counts)[counts > 0], np.cumsum(counts)[counts > 0] - 1
    follows = np.ones(len(index), bool)
    follows[firsts] = False
    rate = target.mean() + 1e-6
    field.bias, field.step = math.log(rate / (1 - rate)), np.array([[0.0, 0.0], [0.0, 0.5]])
    seen = np.full_like(field.weights, 1e-8)
    for k, steps in enumerate(rounds):
        gold = np.zeros((2, 2))
        np.add.at(gold, (np.roll(target, 1)[follows].astype(int), target[follows].astype(int)), 1)
        for _ in range(steps):
            p, xi, _ = field.marginals(counts, field.scores(counts, index, table), True)
            d = target - p
            for j, off in enumerate(_AROUND):
                moved = d.copy()  # a neighbour's features get the gradient of the token they tell about
                if off < 0:
                    moved[:-1] = d[1:]
                    moved[lasts] = 0
                elif off > 0:
                    moved[1:] = d[:-1]
                    moved[firsts] = 0
                use = np.abs(moved) > 1e-3
                grad = np.bincount(feats[use].ravel(), weights=np.repeat(moved[use], feats.shape[1]), minlength=SPACE) - 0.02 * field.weights[j]
                seen[j] += grad * grad
                field.weights[j] += (0.5 if off == 0 else 0.1) * grad / np.sqrt(seen[j])
            field.bias += 0.5 * d.sum() / (np.abs(d).sum() + 1)
            field.step += 0.2 * (gold - xi) / (np.abs(gold - xi).sum() + 10)
        if k + 1 < len(rounds):
            p = field.marginals(counts, field.scores(counts, index, table))
            target = np.where(toxic, np.maximum(target, p > 0.5), 0.0)
    p = field.marginals(counts_all, field.scores(counts_all, index_all, table))
    field.head = _logistic(field.documents(counts_all, p), y.astype(float))
    return field


def training_rows(documents: DataFrame, labels: DataFrame, usable, bound: int = MAX_LABELLED) -> pd.DataFrame:
    """Labelled rows to fit on: all, or a sample by a hash of the id of about bound rows."""
    known = one_label(labels, "toxic").where(usable)
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    # What is left of the labels is about bound rows: small enough to send to the texts.
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return rows.select("doc_id", "text", "label").toPandas().sort_values("doc_id", ignore_index=True)


def score(documents: DataFrame, field: Field, spans: bool = True) -> DataFrame:
    """doc_id, score (0 to 1), n_toxic (tokens tagged), spans (their places, in code points).

    Null and empty texts get the score of a text without tokens. Neighbouring toxic tokens make
    one span. Null ids and repeated rows are scored like others.
    """
    sent = documents.sparkSession.sparkContext.broadcast(Field(field.weights.astype(np.float32), field.bias, field.step, field.head, field.prior))

    def run(batch):
        model: Field = sent.value
        ids = column(batch, "doc_id")
        for a, b, texts in text_slices(column(batch, "text"), BATCH_CHARS):
            places, counts, index, table = read(texts)
            p = model.marginals(counts, model.scores(counts, index, table))
            total = model.document_scores(model.documents(counts, p))
            found, hits = [], []
            starts = np.cumsum(counts) - counts
            for i in range(b - a):
                hit = np.flatnonzero(p[starts[i] : starts[i] + counts[i]] > 0.5)
                out: list = []
                for j in hit.tolist():
                    if out and out[-1][2] == j - 1:
                        out[-1][1:] = [places[i][j][1], j]
                    else:
                        out.append([*places[i][j], j])
                found.append([{"start": x[0], "end": x[1]} for x in out])
                hits.append(len(hit))
            yield {"doc_id": ids.slice(a, b - a), "score": total, "n_toxic": hits, "spans": found}

    return scan(documents.select("doc_id", "text"), run, "doc_id long, score double, n_toxic int, spans array<struct<start:int,end:int>>")


def keep_clean(documents: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, all columns; nothing is shuffled."""
    sent = documents.sparkSession.sparkContext.broadcast(Field(field.weights.astype(np.float32), field.bias, field.step, field.head, field.prior))
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            model: Field = sent.value
            for a, b, texts in text_slices(batch.column(at), BATCH_CHARS):
                _, counts, index, table = read(texts)
                total = model.document_scores(model.documents(counts, model.marginals(counts, model.scores(counts, index, table))))
                yield batch.slice(a, b - a).filter(pa.array(total < threshold))

    return documents.mapInArrow(run, documents.schema)
