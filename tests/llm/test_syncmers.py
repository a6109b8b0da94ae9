import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from edgeproof.llm.syncmers import DRIFT, INNER, KMER, SPAN, anchors, fingerprint, inner_runs, likeness, range_starts, with_edited, with_next


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(text):
    """Anchors by the definition: every k-mer, every inner run."""
    text_hash = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    pack = lambda h, i: (h & ~0xFFFFFFFF) | i << 1
    out = []
    for i in range(len(text) - KMER + 1):
        h = [text_hash(text[i + j : i + j + INNER]) for j in range(SPAN)]
        if min(h) in (h[0], h[-1]):
            out.append(pack(signed(xxhash.xxh64_intdigest(text[i : i + KMER].encode("utf-32-be"), 42)), i))
    return sorted(out) if out else [pack(text_hash(text), 0)] if text else []


def brute_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    first = lambda xs: {x >> 32: (x & 0xFFFFFFFF) >> 1 for x in reversed(xs)}
    u, v = first(a), first(b)
    s = sorted(v[h] - u[h] for h in u.keys() & v.keys())
    runs = 1 if len(s) == 1 else sum((i > 0 and x - s[i - 1] <= DRIFT) or (i + 1 < len(s) and s[i + 1] - x <= DRIFT) for i, x in enumerate(s))
    return runs / (len(u) + len(v) - len(s))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def alike(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(likeness(anchors(F.col("a")), anchors(F.col("b")))).first()[0]


def test_every_anchor(spark, sf, documents):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + ["", "a", "a b c", "a b c d", " \n ", "x" * 15, "x" * 16, "same " * 50, "x" * 300, prose(1, 4000), "É漢字\n\U0001f600" * 9, "ſ \r\n" * 20]
    got = {r["doc_id"]: list(r["anchors"]) for r in fingerprint(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}


def test_likeness(spark):
    a = " ".join(f"w{i}" for i in range(400))
    rows = [("same", a, a), ("none", a, " ".join(f"z{i}" for i in range(400))), ("shift", a, "new start here " + a), ("empty", "", ""), ("half", "", a), ("three", a, " ".join(f"w{i}" for i in range(300))), ("unlike", "a few words", "some others")]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    got = {r["k"]: r["x"] for r in df.select("k", likeness(anchors(F.col("a")), anchors(F.col("b"))).alias("x")).collect()}
    assert got["same"] == 1 and got["none"] == 0 and got["empty"] == 1 and got["half"] == 0 and got["unlike"] == 0
    assert got["shift"] > 0.9 and 0.55 < got["three"] < 0.95


def test_text_without_spaces(spark):
    """A character put in front changes nothing but places, and a length changes no piece."""
    rng = random.Random(8)
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000))
    assert alike(spark, cjk, "新" + cjk) > 0.99
    text = prose(9, 100)
    assert alike(spark, text[:255], text[:257]) > 0.9


def test_passage_in_a_long_text(spark):
    """50 shared words are seen in texts of 3,000, as one run over all anchors."""
    passage, x, y = prose(2, 50), prose(3, 3000), prose(4, 3000)
    a, b = f"{x} {passage}", f"{passage} {y}"
    got = alike(spark, a, b)
    assert got == pytest.approx(brute_likeness(brute(a), brute(b))) and got > 0.005


def test_insertion_in_the_middle(spark):
    """A copy with 200 words put in its middle keeps the matches on both sides."""
    words = prose(5, 600).split()
    assert alike(spark, " ".join(words), " ".join([*words[:300], *prose(6, 200).split(), *words[300:]])) > 0.7


def test_places_do_not_wrap(spark):
    """A shared end after 1.2 million characters lies on its own diagonal."""
    tail = prose(10, 100)
    got = spark.createDataFrame([("x" * 1_200_000 + tail,)], "a string").select(F.max(F.array_max(F.transform(anchors(F.col("a")), lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)))))).first()[0]
    assert got >> 1 > 1_200_000


def test_edited_texts_by_brute_force(documents, spark, sf):
    """Text, both fingerprints and both likenesses of every document against their definitions."""
    texts = {i * 7 % 41: "".join(chr(97 + (i * j) % 26) + (" " if j % 5 == 0 else "") for j in range(i * 3)) + "é\U0001f600" for i in range(1, 41)}
    texts |= {200 + i: r["text"] for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").limit(40).collect())}
    texts |= {100: None, 101: "", 102: prose(7, 200)[:300], 103: "", 104: prose(7, 200)[:250], 105: prose(7, 200)[:260], 106: "ab", 107: prose(7, 200)[:260]}
    got = {r["doc_id"]: r for r in with_edited(documents([(i, t, "s") for i, t in texts.items()] + [(None, "no id at all", "s"), (None, None, "s")])).collect()}
    ids = sorted(texts)
    shown = lambda xs: ",".join(f"{x & (2**64 - 1):016x}" for x in xs)
    for k, i in enumerate(ids):
        t, nxt = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        a, b, c = brute(t), brute(edited), brute(nxt)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["fingerprint"] == shown(a) and got[i]["edited_fingerprint"] == shown(b)
        assert got[i]["near_edited"] == pytest.approx(brute_likeness(a, b)) and got[i]["near_next"] == pytest.approx(brute_likeness(a, c))
    assert got[102]["near_edited"] > 0.6 and got[104]["near_next"] > 0.8
    assert got[None]["near_next"] in (0.0, 1.0)


def test_odd_rows(odd, empty):
    got = with_edited(odd).collect()
    assert len(got) == 10 and len({r["fingerprint"] for r in got if r["doc_id"] == 4}) == 1
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert with_edited(empty).count() == 0


def test_next_rows(spark):
    """The next id's row over many ranges, with repeated ids and one id only."""

    def pairs(ids):
        rows = spark.createDataFrame([(i, k, f"{i}.{k}") for i in ids for k in range(1 + i % 3)], "id long, rank int, own string").repartition(7)
        starts = range_starts(rows.select("id"), 9)
        return sorted((r["own"], r["ahead"]) for r in with_next(rows, "id", "rank", "own", starts).collect())

    for ids in (list(range(5, 500, 3)), [0], [4], [-7, 2**62]):
        after = dict(zip(ids, [*ids[1:], ids[0]]))
        assert pairs(ids) == sorted((f"{i}.{k}", f"{after[i]}.0") for i in ids for k in range(1 + i % 3))


def test_runs_of_plain_texts_need_no_pattern(spark):
    """Runs cut out of bytes and runs found by the pattern hash the same; plain texts go the short way."""
    texts = ["", "a", "abcde", "abcdef", "abc\n\x00 def\tghi", prose(11, 80), prose(12, 40) + "é", "漢字" * 9, "\U0001f600abcdefg"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", inner_runs(F.col("t")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: [signed(xxhash.xxh64_intdigest(t[j : j + INNER].encode(), 42)) for j in range(len(t) - INNER + 1)] for i, t in enumerate(texts)}
