import random

import numpy as np

from edgeproof.llm.common import mix64
from edgeproof.llm.decontaminate import Budget, Windows, align, decontaminate, find_leaks, grams, normalise


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_normalise():
    codes, place, starts = normalise(["  Ab,  c!", "", "É1\x00z"])
    text = "".join(map(chr, codes))
    assert text.replace("\x00", "|") == "ab c ||é1 z|"
    assert len(starts) == 3 and len(place) == len(codes)
    assert [chr(c) for c in codes if c == ord("z")] == ["z"]


def distance(window, text):
    """Least edits of window against any part of text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(window, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, t in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min()


def test_banded_alignment():
    rng = random.Random(5)
    for _ in range(60):
        window = [rng.randrange(5) for _ in range(40)]
        inner = list(window)
        for _ in range(rng.randrange(0, 5)):
            at, kind = rng.randrange(len(inner)), rng.randrange(3)
            if kind == 0:
                inner[at] = 9
            elif kind == 1:
                del inner[at]
            else:
                inner.insert(at, 9)
        lead = [7] * rng.randrange(0, 20)
        text = lead + inner + [8] * rng.randrange(0, 20)
        want = distance(window, text)
        got = align(np.array(window, np.uint32), np.array(text, np.uint32), len(lead), 12, 6)
        assert got is not None and got[0] == want
        assert align(np.array(window, np.uint32), np.array([7] * 80, np.uint32), 10, 12, 6) is None


def test_planted(spark, documents):
    rng = random.Random(8)
    items = [(i, words(rng, rng.choice((15, 40, 60)))) for i in range(12)]
    rows, want = [], set()
    for d in range(60):
        text = words(rng, 150)
        if d % 3 == 0:
            i, passage = items[rng.randrange(12)]
            if d % 2:
                passage = passage.upper().replace(" ", "  ,\n")
            chars = list(passage)
            for _ in range(int(0.03 * len(chars))):
                chars[rng.randrange(len(chars))] = rng.choice("abcdefghij")
            cut = rng.randrange(len(text))
            text = text[:cut] + " " + "".join(chars) + " " + text[cut:]
            want.add((d, i))
        rows.append((d, text, "s"))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "tiny"), (None, None)], "item_id long, text string")
    docs = documents([*rows, (None, items[0][1], "s"), (700, None, "s"), (701, "", "s")])
    got = find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] is not None} == want
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench, Budget(block_chars=900)).collect() if r["doc_id"] is not None} == want
    texts = {d: t for d, t, _ in rows}
    for r in got:
        if r["doc_id"] is not None:
            assert 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]])
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(60), 700, 701} - {d for d, _ in want}


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "nothing of this is anywhere in these odd rows at all, I hope so")], "item_id long, text string")
    assert find_leaks(odd, bench).count() == 0 and decontaminate(odd, bench).count() == 10
    assert find_leaks(empty, bench).count() == 0 and decontaminate(empty, bench).count() == 0
    assert find_leaks(odd, bench.limit(0)).count() == 0


def test_grams_stop_at_text_ends():
    codes, _, _ = normalise(["abcdefghij", "abcdefghij"])
    h = grams(codes, 8)
    assert (h[:3] == h[11:14]).all() and (h[3:11] == 0).all()


def test_each_gram_is_kept_once():
    """Places are looked up among distinct grams, and grams of any length are those of their definition."""
    text = "the same words and the same words and the same words again, at some length"
    w = Windows([(1, text), (2, text)], Budget())
    assert (w.gram[1:] > w.gram[:-1]).all() and w.times.sum() == len(w.window) > len(w.gram)
    codes, _, _ = normalise([text, "", "abc", "é漢\U0001f600 abcdefgh"])
    for q in range(1, 12):
        want = [0 if i + q > len(codes) or 0 in codes[i : i + q] else sum(int(c) * pow(0x100000001B3, q - 1 - j) for j, c in enumerate(codes[i : i + q])) % 2**64 for i in range(len(codes))]
        mixed = mix64(np.array(want, np.uint64))
        assert (grams(codes, q) == np.where(np.array(want, np.uint64) == 0, 0, mixed)).all()
