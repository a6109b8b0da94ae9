"""A hidden Markov language model over words.

States emit word classes (hashed, a fixed number, and the end of text), and a class emits its words
with discounted corpus frequencies. What is discounted, in all classes together, is the probability of
one more event, an unseen word: as in the base score all unseen words are one. Together this is a
distribution over texts. Baum-Welch starts from the corpus' class counts with seeded noise; its
counts are worked out a partition at a time, over all training documents in every round, and added up;
a text's likelihood is exact, by the scaled forward recursion over the whole text.

The corpus is encoded once, in chunks of documents: word numbers local to the chunk and the chunk's
distinct words. Words' corpus counts are added up before and after one shuffle. Those of the words in
the most chunks, of which there are a bounded number, are sent to all tasks; of the others, the words in
more than one chunk meet their chunks by a join in which no word has many rows.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chain import batches, gather, recursions
from .common import column, cut, mix64, ragged, raw_texts, scan, slices, token_batch

#: States, word classes (the end is one more), discount, blocks of the count tables.
STATES, CLASSES, DISCOUNT, BLOCKS = 8, 1 << 13, 0.5, 16
#: Baum-Welch rounds, each over all training documents.
ROUNDS = 10
#: Characters of a chunk, of what is split into words at once, tokens of the chunks counted together.
CHUNK_CHARS, SLICE_CHARS, COUNT_TOKENS = 12_000_000, 2_000_000, 4_000_000
#: A word is common if it is in so many chunks, or in more than one in so many of all rows of a word and
#: a chunk: there are at most so many common words.
COMMON_CHUNKS, COMMON_WORDS = 64, 100_000
_CHUNK = "chunk long, ids array<bigint>, held array<boolean>, counts binary, tokens binary, words binary, n_train binary"


def class_of(words: np.ndarray) -> np.ndarray:
    return (mix64(words) >> np.uint64(64 - 13)).astype(np.int64)


_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((c, pa.binary()) for c in ("counts", "tokens", "words", "n_train"))])


def _encode(batches_):
    """Chunks of a partition. Word numbers are ordered by frequency: small numbers, which pack well."""
    from pyspark import TaskContext

    schema, part, k = _CHUNK_ARROW, TaskContext.get().partitionId(), 0
    for batch in batches_:
        texts = raw_texts(batch)
        ids, held = column(batch, "doc_id").to_pylist(), column(batch, "held_out").to_pylist()
        for a, b in slices([len(t) for t in texts], CHUNK_CHARS):
            parts = [token_batch(texts[a + x : a + y]) for x, y in slices([len(t) for t in texts[a:b]], SLICE_CHARS)]  # words as objects take the most memory
            h, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(u), np.int64)
            rank[order] = np.arange(len(u))
            tokens = rank[inverse].astype("<u4")
            train = np.repeat(~np.array(held[a:b], dtype=bool), counts)
            n_train = np.bincount(tokens[train], minlength=len(u)).astype("<u4")
            planes = tokens.view(np.uint8).reshape(-1, 4).T.tobytes()  # like bytes side by side
            row = [part * (1 << 32) + k, ids[a:b], held[a:b], counts.astype("<u4").tobytes(), planes, u[order].tobytes(), n_train.tobytes()]
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


@dataclass
class Chunk:
    ids: list
    held: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    words: np.ndarray
    n_train: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        tokens = np.ascontiguousarray(np.frombuffer(row["tokens"], np.uint8).reshape(4, -1).T).view("<u4")[:, 0] if row["tokens"] else np.zeros(0, "<u4")
        return cls(list(row.get("ids", ())), np.array(row["held"], dtype=bool), np.frombuffer(row["counts"], "<u4").astype(np.int64), tokens, np.frombuffer(row["words"], np.uint64), np.frombuffer(row.get("n_train", b""), "<u4").astype(np.int64))

    def sequences(self, which: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Word classes (or what own has for each word) of the documents chosen, each with the end class,
        and their lengths."""
        own, starts = class_of(self.words) if own is None else own, np.cumsum(self.counts) - self.counts
        n = self.counts[which] + 1
        out = np.full(int(n.sum()), CLASSES, np.int64)
        last = np.cumsum(n) - 1
        inner = np.ones(len(out), bool)
        inner[last] = False
        out[inner] = own.take(self.tokens.take(gather(starts[which], self.counts[which])))
        return out, n


_COLUMNS = ("ids", "held", "counts", "tokens", "words", "n_train")
#: What a round of Baum-Welch reads of them.
_COUNTED = ("held", "counts", "tokens", "words")


def _chunks(batch) -> list[Chunk]:
    names = batch.schema.names
    return [Chunk.of(r) for r in batch.select([x for x in names if x in _COLUMNS]).to_pylist()]


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # (class, state)

    @classmethod
    def initial(cls, freq: np.ndarray, seed: int = 2) -> Model:
        rng = np.random.default_rng(seed)
        emit = (freq[:, None] + 1e-3) * rng.gamma(2.0, 0.5, (CLASSES + 1, STATES))
        step = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(step, 0.9)
        return cls(np.full(STATES, 1 / STATES), step, emit / emit.sum(0))

    def counts(self, seq: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, transitions and emissions of sequences, and their log likelihood."""
        first, xi, out, ll = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES)), 0.0
        for g in batches(n, 600_000):
            got = self._count(seq, (np.cumsum(n) - n)[g], n[g])
            first, xi, out, ll = first + got[0], xi + got[1], out + got[2], ll + got[3]
        return first, xi, out, ll

    def _count(self, seq: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """One batch, the longest sequence first: chain.recursions in single precision and in place,
        as each place is scaled and a place of all sequences is one slice."""
        longest = int(n[0])
        active = np.searchsorted(-n, -np.arange(longest), "left")
        ends = np.cumsum(active)
        at = [slice(lo, hi) for lo, hi in zip((ends - active).tolist(), ends.tolist(), strict=True)]
        index = np.empty(int(ends[-1]), np.int64)
        for t, here in enumerate(at):
            np.add(starts[: active[t]], t, out=index[here])
        x = seq.take(index)
        step, back, one = self.step.astype("f4"), np.ascontiguousarray(self.step.T, "f4"), np.ones(STATES, "f4")
        e = self.emit.astype("f4").take(x, axis=0)  # rows at once: an index of rows goes value by value
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e), "f4")
        last = alpha[:0]
        for t, here in enumerate(at):
            cur = alpha[here]
            if t:
                np.dot(last[: len(cur)], step, out=cur)
            else:
                cur[:] = self.start
            cur *= e[here]
            c = np.dot(cur, one)
            scale[here] = c
            cur /= c[:, None]
            last = cur
        e /= scale[:, None]
        xi = np.zeros((STATES, STATES))
        for t in range(longest - 1, 0, -1):
            msg = e[at[t]]
            msg *= beta[at[t]]
            below = slice(at[t - 1].start, at[t - 1].start + len(msg))
            xi += alpha[below].T @ msg
            np.dot(msg, back, out=beta[below])
        alpha *= beta
        by_state = np.ascontiguousarray(alpha.T, float)
        out = np.stack([np.bincount(x, weights=w, minlength=CLASSES + 1) for w in by_state], axis=1)
        return alpha[at[0]].sum(0, dtype=float), xi * self.step, out, float(np.log(scale.astype(float)).sum())

    @classmethod
    def update(cls, first: np.ndarray, xi: np.ndarray, out: np.ndarray) -> Model:
        """New parameters from counts. Emissions lean on the classes' overall shares, so every
        class keeps some probability in every state."""
        share = (out.sum(1) + 1.0) / (out.sum() + len(out))
        emit = out + 20.0 * share[:, None]
        return cls((first + 1) / (first.sum() + STATES), (xi + 1) / (xi.sum(1, keepdims=True) + STATES), emit / emit.sum(0))


def _expect(chunks: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts over all training documents. Tables are added up in each task, then by
    block in a small shuffle; what reaches the driver has a fixed size."""
    sent = chunks.sparkSession.sparkContext.broadcast(model)

    def part(batches_):
        total, held_back, size = None, [], 0
        # Chunks are counted some at a time: long documents side by side take as many steps as one.
        for c in itertools.chain((c for batch in batches_ for c in _chunks(batch)), [None]):
            if c is not None:
                held_back.append(c.sequences(np.flatnonzero(~c.held)))
                size += len(held_back[-1][0])
            if held_back and (c is None or size >= COUNT_TOKENS):
                got = sent.value.counts(*(np.concatenate(x) for x in zip(*held_back, strict=True)))[:3]
                total = got if total is None else [x + y for x, y in zip(total, got, strict=True)]
                held_back, size = [], 0
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total])
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in np.array_split(flat, BLOCKS)], pa.binary())], names=["block", "data"])

    add = lambda data: sum(np.frombuffer(x, "<f4").astype(np.float64) for x in data).astype("<f4").tobytes()
    parts = chunks.select(*_COUNTED).mapInArrow(part, "block int, data binary").withColumn("side", F.pmod(F.spark_partition_id(), F.lit(64)))
    first = parts.groupBy("block", "side").applyInPandas(lambda k, p: pd.DataFrame({"block": [k[0]], "data": [add(p["data"])]}), "block int, data binary")
    got = {r["block"]: r["data"] for r in first.groupBy("block").applyInPandas(lambda k, p: pd.DataFrame({"block": [k[0]], "data": [add(p["data"])]}), "block int, data binary").collect()}
    size = STATES + STATES**2 + (CLASSES + 1) * STATES
    if not got:
        flat = np.zeros(size)
    else:
        flat = np.concatenate([np.frombuffer(got[i], "<f4") for i in range(BLOCKS)]).astype(np.float64)
    return flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES), flat[STATES + STATES**2 :].reshape(-1, STATES)


def _word_counts(chunks: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, pd.DataFrame]:
    """Counts that chunks can't know themselves, as (chunk, word, c); tokens and distinct words of each
    class; words and counts of the common words."""

    def pairs(batch):
        for chunk, c in zip(column(batch, "chunk").to_pylist(), _chunks(batch), strict=True):
            yield {"word": c.words.view(np.int64), "chunk": np.full(len(c.words), chunk), "n": c.n_train}

    rows = cut(scan(chunks, pairs, "word long, chunk long, n long"), "words")
    totals = cut(rows.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("k")), "totals")

    def of_class(batch):
        word, c = column(batch, "word").to_numpy(), column(batch, "c").to_numpy()
        yield {"class": class_of(word.view(np.uint64)), "n": c, "v": (c > 0).astype(np.int64), "k": column(batch, "k")}

    n_class, v_class, n_rows = np.zeros(CLASSES), np.zeros(CLASSES), 0
    for r in scan(totals, of_class, "class int, n long, v long, k long").groupBy("class").agg(*(F.sum(x).alias(x) for x in "nvk")).collect():  # at most CLASSES rows
        n_class[r["class"]], v_class[r["class"]], n_rows = r["n"], r["v"], n_rows + r["k"]
    most = max(COMMON_CHUNKS, n_rows // COMMON_WORDS)
    common = totals.where(F.col("k") > most).select("word", "c").toPandas().sort_values("word")  # at most COMMON_WORDS, and few below a large corpus
    others = totals.where(F.col("k").between(2, most)).select("word", "c")
    rest = rows.join(F.broadcast(rows.sparkSession.createDataFrame(common[["word"]], "word long")), "word", "left_anti") if len(common) else rows
    return rest.join(others, "word").where("c <> n").select("chunk", "word", "c"), n_class, v_class, common


def language_model(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """documents(doc_id, text, held_out) -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, known_base_score, known_score: learnt from the rows that are not held out.

    base_score is the log10 probability under add-one word frequencies, score that of the hidden
    Markov model; the known_ columns are the parts of the tokens that training texts have, each given all
    tokens before it, so the rest is what unseen words add. Null and empty texts are one end; null ids and
    repeated rows are rows like any; with no training rows every word is unseen and classes are evenly
    likely.
    """
    docs = documents.select("doc_id", "text", "held_out")
    n_training = docs.agg(F.count(F.when(~F.col("held_out"), 1))).first()[0]
    chunks = cut(docs.mapInArrow(_encode, _CHUNK), "chunks")
    away, n_class, v_class, common = _word_counts(chunks)
    total = int(n_class.sum()) + n_training
    distinct = int(v_class.sum()) + (n_training > 0)

    model = Model.initial(np.append(n_class, n_training))
    for _ in range(rounds if n_training else 1):  # without training rows a round of no counts makes all even
        model = Model.update(*_expect(chunks, model))
    sent = documents.sparkSession.sparkContext.broadcast((model, n_class, v_class, common["word"].to_numpy().view(np.uint64), common["c"].to_numpy()))

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        model, n_class, v_class, *known_words = sent.value
        unseen = np.where(n_class > 0, DISCOUNT * v_class / np.maximum(n_class, 1), 1.0)  # of each class
        emit = np.concatenate([model.emit, unseen[None, :] @ model.emit[:-1]])
        parts = []
        for row in left.to_dict("records"):
            k = Chunk.of(row)
            c, order = k.n_train.copy(), np.argsort(k.words)
            for words, n in ((right["word"].to_numpy().view(np.uint64), right["c"].to_numpy()), known_words):
                at = np.minimum(np.searchsorted(k.words, words, sorter=order), len(order) - 1)
                here = k.words[order[at]] == words if len(order) else np.zeros(len(words), bool)
                c[order[at[here]]] = n[here]
            own = class_of(k.words)
            word = np.where(c > 0, np.log10(np.maximum(c - DISCOUNT, 1e-9) / np.maximum(n_class[own], 1)), 0.0)
            base = np.log10((c + 1.0) / (total + 1.0 * (distinct + 1)))
            end = math.log10((n_training + 1.0) / (total + 1.0 * (distinct + 1)))
            doc = np.repeat(np.arange(len(k.counts)), k.counts)
            add = lambda x, docs=doc, k=k: np.bincount(docs, weights=x[k.tokens], minlength=len(k.counts))
            seq, n = k.sequences(np.arange(len(k.counts)), np.where(c > 0, own, CLASSES + 1))
            at, each = np.cumsum(n) - n, np.empty(len(seq))
            for g in batches(n, 300_000):
                places = gather(at[g], n[g])
                each[places] = recursions(emit[seq[places]], n[g], model.step, model.start, False).each / math.log(10)
            of = np.repeat(np.arange(len(n)), n)
            known = (seq < CLASSES) | ((seq == CLASSES) & (n_training > 0))
            parts.append(pd.DataFrame({
                "doc_id": pd.array(k.ids, dtype="Int64"), "held_out": k.held, "n_tokens": k.counts + 1, "n_known": add((c > 0).astype(float)).round().astype(np.int64) + (n_training > 0),
                "train_tokens": total, "base_score": add(base) + end, "score": add(word) + np.bincount(of, weights=each, minlength=len(n)),
                "known_base_score": add(np.where(c > 0, base, 0.0)) + end * (n_training > 0), "known_score": add(word) + np.bincount(of, weights=np.where(known, each, 0.0), minlength=len(n)),
            }))
        scores = ("base_score", "score", "known_base_score", "known_score")
        return pd.concat(parts) if parts else pd.DataFrame({"doc_id": pd.array([], dtype="Int64"), "held_out": np.zeros(0, bool), **{x: np.zeros(0, np.int64) for x in ("n_tokens", "n_known", "train_tokens")}, **{x: np.zeros(0) for x in scores}})

    return chunks.groupBy("chunk").cogroup(away.groupBy("chunk")).applyInPandas(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, known_base_score double, known_score double")
