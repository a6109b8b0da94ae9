import random
from collections import Counter

import numpy as np

from edgeproof.llm import neardup
from edgeproof.llm.components import components
from edgeproof.llm.neardup import Forest, deduplicate, jaccard_counts, near_duplicates


def brute(rows):
    """class and number of links of each id, over all pairs."""
    sets = {}
    for i, t, _ in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent, links = {i: i for i in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and len(x & y) / len(x | y) >= 0.8:
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = root(ids[a]), root(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: (root(i), links[i]) for i in ids}


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return out


def sample(seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((8, 60, 200)))]
        for c in range(rng.choice((1, 2, 5, 25))):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice((0, 1, 2, 4)))), f"s{g}"))
    return rows + [(900, "just four words here", "s"), (901, "just four words here", "s"), (902, "", "s"), (903, None, "s"), (904, "", "s")]


def test_against_all_pairs(documents, monkeypatch):
    rows = sample()
    want = brute(rows)
    for block in (512, 7):  # also with groups and buckets in many blocks
        monkeypatch.setattr(neardup, "GROUP_BLOCK", block)
        monkeypatch.setattr(neardup, "BUCKET_BLOCK", 4 * block)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(documents(rows)).collect()}
        assert got == want


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["doc_id"], r["text"], None) for r in docs.collect()])
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(docs).collect()} == want
    kept = {r["doc_id"] for r in deduplicate(docs).collect()}
    assert kept == {i for i, (c, _) in want.items() if c == i}


def test_odd_rows(odd, empty):
    got = near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[4]["n_links"] == 1 and by[4]["n_copies"] == 2 and by[2]["class_id"] == 2 and by[None]["class_id"] is None
    assert deduplicate(odd).columns == odd.columns and deduplicate(odd).count() == 9
    assert near_duplicates(empty).count() == 0 and deduplicate(empty).count() == 0


def test_floor_reaches_the_recall():
    assert Forest(tries=20, depth=6, recall=0.9999).floor() == 4
    assert Forest(tries=20, depth=8, recall=0.9).floor() == 8
    assert Forest(tries=1, depth=5, recall=0.999).floor() == 1


def test_prefixes_shorten_as_far_as_they_must(monkeypatch):
    """A run whose members are linked at a longer prefix is not matched again at a shorter one."""
    runs, real = [], neardup._merge
    monkeypatch.setattr(neardup, "_merge", lambda group, sketch, rows, least: (runs.append(len(rows)), real(group, sketch, rows, least)))
    alike, apart = np.zeros((4, 20), int), np.arange(60).reshape(3, 20)
    same = np.zeros((4, 2), int)
    assert len(set(neardup.forest_links(same, alike, 4, 10).tolist())) == 1 and runs == [4]  # at the full depth only
    runs.clear()
    paths = np.array([[0, 0], [0, 1], [0, 1], [5, 0], [0, 0], [5, 0], [7, 7]])
    lead = neardup.forest_links(paths, np.concatenate([alike, apart]), 4, 10)
    assert len({*lead[:4].tolist()}) == 1 and len(set(lead.tolist())) == 4 and runs == [2, 2, 2, 4, 2, 7]


def test_links_of_a_subtrie_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(2, 14))
        paths, sketch = rng.integers(0, 2, (n, 2)), rng.integers(0, 3, (n, 12))
        lead = neardup.forest_links(paths, sketch, 4, 7)
        want = np.arange(n)
        for _ in range(n):
            for i in range(n):
                for j in range(n):
                    if (sketch[i] == sketch[j]).sum() >= 7:
                        want[i] = want[j] = min(want[i], want[j])
        assert (lead[:, None] == lead[None, :]).tolist() == (want[:, None] == want[None, :]).tolist()


def test_recall_of_pairs_at_the_threshold(spark, documents):
    """Pairs just above the threshold, found by the forest itself."""
    rng = random.Random(9)
    rows, pairs = [], []
    for g in range(300):
        base = [f"g{g}w{k}" for k in range(100)]
        other = list(base)
        for at in rng.sample(range(10, 90, 20), 2):  # two words apart: 10 shingles of 96 on either side
            other[at] = f"x{g}{at}"
        pairs.append((2 * g, 2 * g + 1))
        rows += [(2 * g, " ".join(base), "s"), (2 * g + 1, " ".join(other), "s")]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(rows)).collect()}
    assert 86 / 106 < 0.82 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_rows_of_one_id(documents):
    """Rows with one id and different texts are different documents, and keep their other columns."""
    rng = random.Random(10)
    a, b, c = (" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(3))
    docs = documents([(7, a, "s1"), (7, b, "s2"), (7, b, "s2"), (8, b, "s3"), (9, c, "s4"), (6, c, "s5"), (2, "", "s6"), (2, "", "s6"), (None, a, "s7")]).withColumnRenamed("rank", "place")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in near_duplicates(docs).collect())
    assert got == [(0, 0, 0), (2, 2, 0), (2, 2, 0), (6, 6, 1), (7, 7, 0), (7, 7, 2), (7, 7, 2), (8, 7, 2), (9, 6, 1)]
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["source"]) for r in kept.collect()) == [(0, "s7"), (2, "s6"), (2, "s6"), (6, "s5"), (7, "s1"), (7, "s2")]


def test_hubs(spark, monkeypatch):
    """Stars whose centres are hubs, in a chain."""
    from edgeproof.llm import components as module

    monkeypatch.setattr(module, "HUB", 5)
    edges = [(c * 100 + i, c * 100 + 50) for c in range(8) for i in range(40)] + [(c * 100 + 50, c * 100 + 150) for c in range(7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 8 * 41


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 40)).astype(np.uint64)) for _ in range(9)]
    got = jaccard_counts(sets)
    assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(9) for j in range(9) if i != j)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
