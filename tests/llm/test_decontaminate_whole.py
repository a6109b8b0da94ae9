"""Passages across the cuts of the hits, and parts of items."""

import random

import numpy as np
from test_decontaminate import words

from edgeproof.llm import decontaminate
from edgeproof.llm.decontaminate import Budget, Windows, normalise


def edited(rng, text, every):
    """A letter replaced in each stretch of so many."""
    chars = list(text)
    for at in range(every // 2, len(chars), every):
        chars[at] = "z"
    return "".join(chars)


def test_passages_across_cuts(monkeypatch):
    """Wherever the hits are cut, the same windows are found, once each."""
    rng = random.Random(11)
    items = [(i, words(rng, 40)) for i in range(8)]
    text = " ".join(words(rng, 30) + " " + edited(rng, t, 15) for _, t in items)
    codes, _, starts = normalise([text])
    index = Windows(items, Budget())
    whole = sorted(index.matches(codes, starts))
    assert {index.item[w] for _, w, *_ in whole} == set(range(8))
    real = decontaminate.slices
    for most in (60, 97, 150, 400):
        monkeypatch.setattr(decontaminate, "slices", lambda sizes, limit, most=most: real(sizes, min(limit, most)))
        got = index.matches(codes, starts)
        assert sorted(x[:2] for x in got) == [x[:2] for x in whole] and len({x[:2] for x in got}) == len(got)


def test_parts_of_items():
    """Any 63 normalised characters of an item are found, at every start, with 3 edits as well."""
    rng = random.Random(12)
    item = words(rng, 60)
    assert len(item) > 240
    item = item[:240]
    index = Windows([(1, item)], Budget())
    lead, tail = words(rng, 20), words(rng, 20)
    for s in range(240 - 63 + 1):
        part = item[s : s + 63]
        for passage in (part, edited(rng, part, 21)):
            codes, _, starts = normalise([f"{lead} q{passage}q {tail}"])
            assert index.matches(codes, starts), (s, passage)


def test_hits_of_every_slice_by_brute_force():
    """Every window of every item against every text, aligned without any filter."""
    rng = random.Random(13)
    items = [(i, words(rng, n)) for i, n in enumerate((6, 12, 25, 40))]
    index = Windows(items, Budget())
    texts = [words(rng, 25) for _ in range(12)]
    for k, t in enumerate(texts[:8]):
        i = k % 4
        texts[k] = f"{t} {edited(rng, items[i][1], (9, 14, 20, 500)[k // 2 % 4])} {t[::-1]}"
    codes, _, starts = normalise(texts)
    ends = np.append(starts[1:], len(codes)) - 1
    want = set()
    for t, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        for w, pattern in enumerate(index.codes):
            row = np.zeros(b - a + 1, int)
            for i, c in enumerate(pattern, 1):  # least edits against any part
                diag = row[:-1] + (codes[a:b] != c)
                new = np.minimum(np.append(i, diag), row + 1)
                row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
            if row.min() <= index.edits[w]:
                want.add((t, w, int(row.min())))
    assert {x[:3] for x in index.matches(codes, starts)} == want and len(want) > 10


def test_tiny_items():
    index = Windows([(1, "Yes!"), (2, "42"), (3, "?!")], Budget())
    assert [x[:2] for x in index.leaks([" yes ", "yes and no", "42.", "", "?!", "YES", "421"])] == [(0, 1), (2, 2), (5, 1)]


def test_one_item_of_two_texts_over_blocks(spark, documents):
    """An item's texts are found as one item, however many blocks the benchmark takes."""
    rng = random.Random(14)
    a, b, c = (words(rng, 30) for _ in range(3))
    bench = spark.createDataFrame([(1, a), (1, b), (2, c), (3, "yes")], "item_id long, text string")
    docs = documents([(7, f"{a} and {b}", "s"), (7, c, "s"), (8, words(rng, 50), "s"), (9, "Yes.", "s")]).withColumnRenamed("rank", "__key")
    for budget in (Budget(), Budget(block_chars=100)):
        got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, budget).collect())
        assert got == [(7, 1), (7, 2), (9, 3)]
        assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench, budget).collect()] == [8]
