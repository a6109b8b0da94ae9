"""Baum-Welch over all training documents."""

import random

import numpy as np

from edgeproof.llm import hmm
from edgeproof.llm.chain import recursions
from edgeproof.llm.common import token_batch


def test_baum_welch_sees_every_training_document(spark, monkeypatch):
    """All rounds count all training documents, beyond the size at which a sample once began; the
    counts are those of the plain recursions."""
    rng, seen = random.Random(4), []
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 9))), i % 7 == 2) for i in range(2500)]
    words = sum(len(t.split()) + 1 for _, t, held in rows if not held)
    expect = hmm._expect

    def watched(chunks, model):
        got = expect(chunks, model)
        seen.append((model, got))
        return got

    monkeypatch.setattr(hmm, "_expect", watched)
    monkeypatch.setattr(hmm, "CHUNK_CHARS", 9000)
    assert hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(2)).count() == 2500
    assert len(seen) == 10
    assert all(abs(out.sum() - words) < 1 and abs(first.sum() - sum(not r[2] for r in rows)) < 1 for _, (first, _, out) in seen)
    shares = np.bincount(hmm.class_of(token_batch([t.encode() for _, t, held in rows if not held])[0]), minlength=hmm.CLASSES + 1)
    assert (seen[0][0].emit[:-1].sum(1) > 1e-4).tolist() == (shares[:-1] > 0).tolist()  # starts from all classes
    model, (first, xi, out) = seen[-1]
    h, n = token_batch([t.encode() for _, t, held in rows if not held])
    seq = np.insert(hmm.class_of(h), np.cumsum(n), hmm.CLASSES)
    want = recursions(model.emit[seq], n + 1, model.step, model.start)
    assert np.allclose(xi, want.xi, rtol=1e-3) and np.allclose(first, want.first, rtol=1e-3)
    assert np.allclose(out.sum(0), want.gamma.sum(0), rtol=1e-3)


def plain_scores(rows):
    """The model from its definition, a token and a state at a time: training, then each text's log10
    probability and the part of its known tokens."""
    from collections import Counter

    number = lambda w: int(hmm.class_of(token_batch([w.encode()])[0])[0])
    texts = [t.lower().split() for _, t, _ in rows]
    train = [t for t, (_, _, held) in zip(texts, rows) if not held]
    c = Counter(w for t in train for w in t)
    n, v = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, k in c.items():
        n[number(w)] += k
        v[number(w)] += 1
    model = hmm.Model.initial(np.append(n, len(train)))
    states = range(hmm.STATES)

    def forward(emit):
        alpha = [[model.start[s] * emit[0][s] for s in states]]
        for e in emit[1:]:
            alpha.append([sum(alpha[-1][r] * model.step[r][s] for r in states) * e[s] for s in states])
        return alpha

    for _ in range(hmm.ROUNDS):
        first, xi, out = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.CLASSES + 1, hmm.STATES))
        for t in train:
            seq = [*map(number, t), hmm.CLASSES]
            emit = [model.emit[x] for x in seq]
            alpha, beta = forward(emit), [[1.0] * hmm.STATES]
            for e in emit[:0:-1]:
                beta.insert(0, [sum(model.step[s][r] * e[r] * beta[0][r] for r in states) for s in states])
            total = sum(alpha[-1])
            for i, x in enumerate(seq):
                for s in states:
                    out[x, s] += alpha[i][s] * beta[i][s] / total
                    if i:
                        for r in states:
                            xi[r, s] += alpha[i - 1][r] * model.step[r][s] * emit[i][s] * beta[i][s] / total
            first += np.array(alpha[0]) * beta[0] / total
        model = hmm.Model.update(first, xi, out)
    unseen = [sum(model.emit[x][s] * (hmm.DISCOUNT * v[x] / n[x] if n[x] else 1.0) for x in range(hmm.CLASSES)) for s in states]
    got = []
    for t in texts:
        emit = [[model.emit[number(w)][s] * (c[w] - hmm.DISCOUNT) / n[number(w)] if c[w] else unseen[s] for s in states] for w in t] + [model.emit[hmm.CLASSES]]
        p = [1.0, *(sum(a) for a in forward(emit))]
        each = [np.log10(b / a) for a, b in zip(p, p[1:])]
        got.append((sum(each), sum(x for x, w in zip(each, [*t, None]) if w is None or c[w])))
    return got


def test_scores_by_brute_force(spark, monkeypatch):
    """Every text's score, known and unseen tokens, over chunks and with common words."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(12)}" if rng.random() < 0.9 else f"rare{rng.randrange(99)}" for _ in range(rng.randrange(0, 7))), i % 5 == 2) for i in range(40)]
    want = plain_scores(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    for common in (64, 2):
        monkeypatch.setattr(hmm, "CHUNK_CHARS", 100)
        monkeypatch.setattr(hmm, "COMMON_CHUNKS", common)
        got = {r["doc_id"]: (r["score"], r["known_score"]) for r in hmm.language_model(df).collect()}
        assert np.allclose([got[i] for i in range(40)], want, rtol=2e-3, atol=2e-3)
        assert any(held and a < b - 0.1 for (a, b), (_, _, held) in zip(want, rows))


def test_texts_of_one_word_stay_within_one(spark):
    """Each known word, any unseen word (one event) and no word at all: together less than certain, as
    longer texts have the rest."""
    train = ["a b", "b a c", "c c", "a", ""]
    after = ["a", "b", "c", "unseen", ""]
    rows = [(i, t, False) for i, t in enumerate(train)] + [(100 + i, t, True) for i, t in enumerate(after)]
    got = {r["doc_id"]: 10 ** r["score"] for r in hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert all(got[100 + i] > 0 for i in range(5)) and sum(got[100 + i] for i in range(5)) < 1


def test_a_round_reads_only_what_it_counts():
    """Sequences need neither ids nor training counts of a chunk."""
    words, tokens = np.array([11, 12], np.uint64), np.array([0, 1, 0], "<u4")
    row = {"held": [False, True], "counts": np.array([2, 1], "<u4").tobytes(), "tokens": tokens.view(np.uint8).reshape(-1, 4).T.tobytes(), "words": words.tobytes()}
    assert set(row) == set(hmm._COUNTED)
    own = hmm.class_of(words)
    seq, n = hmm.Chunk.of(row).sequences(np.array([0]))
    assert seq.tolist() == [own[0], own[1], hmm.CLASSES] and n.tolist() == [3]
