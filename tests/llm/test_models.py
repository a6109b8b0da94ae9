"""The classifiers against their definitions, in plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeproof.llm import quality, toxicity
from edgeproof.llm.common import hash_words, mix64


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    good, bad = [f"word{k}" for k in range(40)], [f"junk{k}" for k in range(8)]
    return [(i, " ".join(rng.choice(bad if i % 2 and rng.random() < 0.5 else good) for _ in range(rng.randrange(0, 25)))) for i in range(n)]


def plain_features(text, vector):
    """Mean, spread, likeness of neighbours one and two apart, share of repeats, size, 1."""
    words = [vector(w) for w in quality._PIECE.findall(text.encode().lower())]
    if not words:
        return [0.0] * (quality.FEATURES - 1) + [1.0]
    n, dims = len(words), range(quality.DIM)
    mean = [sum(w[d] for w in words) / n for d in dims]
    spread = [math.sqrt(max(0.0, sum(w[d] ** 2 for w in words) / n - mean[d] ** 2)) for d in dims]
    near = lambda off: [sum(a * b for a, b in zip(words[i], words[i - off])) for i in range(off, n)]
    return [*mean, *spread, sum(near(1)) / n, sum(near(2)) / n, sum(x > 0.9999 for x in near(1)) / n, math.log1p(n) / 8, 1.0]


def test_quality_scores_by_definition(spark):
    """Context sums, pooling, network and temperature of every document."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    place, sign = quality.index_vectors()
    row = lambda w: int((mix64(hash_words([w])) >> np.uint64(64 - 13))[0])
    table, times = {}, {}
    for _, t in rows:
        words = [row(w) for w in quality._PIECE.findall(t.encode().lower())]
        for i, w in enumerate(words):
            times[w] = times.get(w, 0) + 1
            own = table.setdefault(w, np.zeros(quality.DIM))
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if j != i:
                    for p, s in zip(place[words[j]], sign[words[j]]):
                        own[p] += s
    unit = {w: (v / math.sqrt(times[w])) / max(np.linalg.norm(v / math.sqrt(times[w])), 1e-9) for w, v in table.items()}
    x = np.array([plain_features(t, lambda w: unit[row(w)]) for _, t in rows])
    usable = [i for i, _ in rows if i % 5]
    net = quality.train(x[usable], np.array([float(i % 2) for i in usable]))
    want = [1 / (1 + math.exp(-(sum(math.tanh(sum((x[i][f] - net.mean[f]) / net.scale[f] * net.w1[f][h] for f in range(quality.FEATURES)) + net.b1[h]) * net.w2[h] for h in range(len(net.w2))) + net.b2) / net.temperature)) for i, _ in rows]
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, F.col("doc_id") % 5 != 0).collect()}
    assert np.allclose([got[i] for i, _ in rows], want, atol=0.02)


def test_network_learns_what_no_line_parts():
    """Two layers: the sign of a product; and the temperature lowers the held-back loss."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.train(x, y)
    assert ((net.probability(x) > 0.5) == (y == 1)).mean() > 0.9 and net.temperature > 0


def test_token_labels_by_definition():
    """Tokens of toxic texts with a feature that is common there and rare elsewhere."""
    texts = ["you vile troll", "such a vile day", "a vile thing", "vile vile", "trolling again"] * 2 + ["a fine day"] * 40
    toxic = np.array([True] * 10 + [False] * 40)
    _, counts, index, table = toxicity.read(texts)
    got = toxicity._token_labels(counts, index, table, toxic)
    words, doc = [w for t in texts for w in t.split()], np.repeat(np.arange(len(texts)), counts)
    seen = {}
    for w, d in zip(words, doc):
        for f in set(table[index[words.index(w)]].tolist()):
            a = seen.setdefault(f, [0, 0, set()])
            a[0 if toxic[d] else 1] += list(table[index[words.index(w)]]).count(f)
            if toxic[d]:
                a[2].add(d)
    n1, n0 = toxic[doc].sum() + 1, (~toxic[doc]).sum() + 1
    hot = {f for f, (c1, c0, docs) in seen.items() if ((c1 + 0.1) / n1) / ((c0 + 1) / n0) >= 12 and len(docs) >= 4}
    want = [float(toxic[d] and any(f in hot for f in table[index[k]])) for k, d in enumerate(doc)]
    assert got.tolist() == want
    assert {w for w, x in zip(words, got) if x} >= {"vile"} and not {w for w, x in zip(words, got) if x} & {"a", "day", "fine"}


def test_toxic_scores_by_enumeration(spark):
    """Marginals over all taggings, spans and document score of a field with random weights."""
    rng = np.random.default_rng(6)
    field = toxicity.Field(rng.normal(0, 0.8, (3, toxicity.SPACE)).astype(np.float32).astype(float), -0.3, rng.normal(0, 0.5, (2, 2)), rng.normal(0, 1, 6), 0.5)
    texts = ["one two three four", "five", "", None, "Six, seven... eight nine ten", "  --  ", "one one"]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).collect()}
    for i, t in enumerate(texts):
        places = toxicity.tokens(t or "")
        _, counts, index, table = toxicity.read([t or ""])
        own = [[sum(field.weights[k][f] for f in table[j]) for j in index] for k in range(3)]
        n = len(places)
        score = [field.bias + own[0][j] + (own[1][j - 1] if j else 0) + (own[2][j + 1] if j + 1 < n else 0) for j in range(n)]
        total, p = 0.0, [0.0] * n
        for tags in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(s for s, y in zip(score, tags) if y) + sum(field.step[a][b] for a, b in itertools.pairwise(tags)))
            total += w
            p = [x + w * y for x, y in zip(p, tags)]
        p = [x / total for x in p]
        hard = sum(x > 0.5 for x in p)
        features = [max(p), math.log1p(sum(p)), math.sqrt(sum(p) / n) * 3, math.log1p(hard), float(hard >= 2), 1] if n else [0, 0, 0, 0, 0, 1]
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(features, field.head)))), abs=1e-4)
        assert got[i]["n_toxic"] == hard
        inside = {k for s in got[i]["spans"] for k in range(s["start"], s["end"])}
        assert all((places[j][0] in inside) == (p[j] > 0.5) for j in range(n))


def test_field_follows_its_gradient():
    """After fitting, tagged words of toxic texts are far likelier than before, and clean words stay clean."""
    import pandas as pd

    rows = pd.DataFrame([(i, f"a {'vile' if i % 3 == 0 else 'fine'} day number{i} again", int(i % 3 == 0)) for i in range(120)], columns=["doc_id", "text", "label"])
    field = toxicity.fit(rows)
    _, counts, index, table = toxicity.read(["a vile day", "a fine day"])
    p = field.marginals(counts, field.scores(counts, index, table))
    assert p[1] > 0.9 and max(p[0], p[2], *p[3:]) < 0.5
    s = field.document_scores(field.documents(counts, p))
    assert s[0] > 0.9 and s[1] < 0.1
