"""Quality, toxicity and the language model."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeproof.llm import hmm, quality, queries, toxicity
from edgeproof.llm.chain import recursions
from edgeproof.llm.common import bucket_of


def area(y, s):
    r = np.argsort(np.argsort(s)) + 1.0
    pos = np.asarray(y) == 1
    return (r[pos].mean() - (pos.sum() + 1) / 2) / (~pos).sum()


def test_recursions_against_enumeration():
    rng = np.random.default_rng(4)
    counts, s = [4, 1, 6, 3], 3
    scores, step, start = rng.random((14, s)) + 0.1, rng.random((s, s)), rng.random(s)
    r = recursions(scores, counts, step, start)
    at, xi = 0, np.zeros((s, s))
    for k, n in enumerate(counts):
        total, marg = 0.0, np.zeros((n, s))
        local = np.zeros((s, s))
        for path in itertools.product(range(s), repeat=n):
            w = start[path[0]] * np.prod([scores[at + i, p] for i, p in enumerate(path)]) * np.prod([step[a, b] for a, b in itertools.pairwise(path)])
            total += w
            for i, p in enumerate(path):
                marg[i, p] += w
            for a, b in itertools.pairwise(path):
                local[a, b] += w
        assert math.isclose(r.loglik[k], math.log(total), rel_tol=1e-9)
        assert np.allclose(r.gamma[at : at + n], marg / total)
        xi += local / total
        at += n
    assert np.allclose(r.xi, xi)


def test_long_sequences_do_not_underflow():
    r = recursions(np.full((200_000, 2), 1e-6), [199_999, 1], np.full((2, 2), 0.5), np.full(2, 0.5))
    assert np.isfinite(r.loglik).all() and math.isclose(r.loglik[0], 199_999 * math.log(1e-6), rel_tol=1e-9)


def test_toxicity_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = queries.toxic_field(spark, "/root/testdata/sf0.01", docs)
    rows = toxicity.score(docs, field).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id").toPandas()
    held = rows[[zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]]
    assert rows.score.between(0, 1).all() and area(held.y, held.score) > 0.7 and ((held.score >= 0.3) == (held.y == 1)).mean() > 0.85
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = Counter(texts[r["doc_id"]][s["start"] : s["end"]].lower() for r in toxicity.score(docs, field).collect() for s in r["spans"])
    assert {"idiot", "moron", "stupid"} <= {w for k in found for w in k.split()}
    kept = toxicity.keep_clean(docs, field)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in toxicity.score(docs, field).collect() if r["score"] < 0.3}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels, F.coalesce(bucket_of("doc_id", 5), F.lit(-1)) > 0).join(labels.groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id").toPandas()
    held = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]]
    assert rows.score.between(0, 1).all() and area(held.y, held.score) > 0.95


def test_context_vectors():
    """Batch sums equal a plain loop over neighbours."""
    rng = np.random.default_rng(1)
    rows, counts = rng.integers(0, quality.ROWS, 30), np.array([12, 0, 1, 17])
    place, sign = quality.index_vectors()
    want = np.zeros((quality.ROWS, quality.DIM))
    at = 0
    for n in counts:
        for i in range(at, at + n):
            for j in range(at, at + n):
                if i != j and abs(i - j) <= quality.WINDOW:
                    want[rows[i], place[rows[j]]] += sign[rows[j]]
        at += n
    assert np.allclose(quality.contexts(rows, counts)[:, :-1], want)


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_classifiers_on_odd_rows(spark, which, request):
    docs = request.getfixturevalue(which)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (8, 1, None), (None, 1, 1), (5, None, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    n = docs.count()
    for known in (labels, labels.limit(0)):
        got = quality.classify(docs, known, F.lit(True)).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
        field = toxicity.fit(toxicity.training_rows(docs, known, F.lit(True)))
        got = toxicity.score(docs, field).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.keep_clean(docs, field).columns == docs.columns


def base_scores(rows):
    words = [(t or "").encode().lower().split() for _, t, _ in rows]
    c = Counter()
    for w, (_, _, held) in zip(words, rows):
        if not held:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    return [(len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None])) for w in words]


def test_language_model(spark, monkeypatch):
    rng = random.Random(6)
    tongues = [[f"{p}{k}" for k in range(60)] for p in ("ab", "cd", "ef")]
    rows = [(i, " ".join(rng.choice(tongues[i % 3]) if rng.random() < 0.97 else f"rare{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60))), i % 5 == 2) for i in range(150)] + [(None, "AB1 Éa\xa0b", False), (900, None, True), (901, "", False), (901, "", False)]
    monkeypatch.setattr(hmm, "CHUNK_CHARS", 3000)
    df = spark.createDataFrame([(*r, 3.0, "x") for r in rows], "doc_id long, text string, held_out boolean, score double, word string").repartition(3, "text")
    got = hmm.language_model(df).collect()
    want = Counter((i, h, a, b, c, round(s, 6)) for (i, _, h), (a, b, c, s) in zip(rows, base_scores(rows)))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # states find the three tongues
    assert all(r["score"] < 0 for r in got)


def test_language_model_sums_to_one(spark):
    """Over all texts of one word and of none, with unseen words as one class each, probability is at most 1."""
    rows = [(i, t, False) for i, t in enumerate(["a", "b", "a", "", "a b"])] + [(10 + i, t, True) for i, t in enumerate(["", "a", "b"])]
    got = hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()
    assert 0 < sum(10 ** r["score"] for r in got if r["held_out"]) <= 1


def test_language_model_edges(spark):
    schema = "doc_id long, text string, held_out boolean"
    assert hmm.language_model(spark.createDataFrame([], schema)).count() == 0
    got = hmm.language_model(spark.createDataFrame([(1, "only held out", True)], schema)).collect()
    assert got[0]["n_known"] == 0 and got[0]["train_tokens"] == 0 and got[0]["base_score"] == 0 and math.isfinite(got[0]["score"])
