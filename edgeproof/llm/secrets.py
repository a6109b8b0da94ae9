"""Secret scans in SQL expressions only.

Three patterns give the base spans. Beside them, every run of key-like characters is a candidate:
a window slides over it, and the Shannon entropy of the window is kept up to date from the counts of
its characters, of which a step changes two. What exceeds its character class's limit is a span,
unless the candidate is on the allow list or a base span overlaps it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .syncmers import let

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run shorter than 20 characters holds no longer one, so this is the same
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_SECRET = 6

#: Candidates, the window, and each class's pattern and least entropy in bits a character.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/=_-]{20,}", 20
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("base32", r"^[A-Z2-7=]+$", 3.4), ("base64", r"", 3.75))
#: Allowed: words joined by signs, numbers and dates, placeholders (and runs of one sign, see allowed).
#: What a loop has taken is never given back, so a pattern takes one walk over the candidate.
WORDS = r"^[A-Za-z]{1,24}+(?:[_/=+-]++[A-Za-z]{1,24}+)*+[_/=+-]*+$"
ALLOWED = (WORDS, r"^[0-9=_/+-]+$", r"(?i:example|sample|dummy|changeme|placeholder|xxxx|0123456789|abcdefgh)")
#: Matches whose places are summed up together; counts in a packed number, of 5 bits each.
STRETCH, PACKED = 256, 12


def running(sizes: Column) -> Column:
    """The sum of all sizes before each one: within stretches, then over the stretches' sums, as an
    array that grows by one is copied."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    cut = lambda b: F.slice(sizes, b * STRETCH + 1, STRETCH)
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(sizes) / STRETCH).cast("int") - 1, F.lit(0)))

    def sums(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    totals = F.transform(numbers, lambda b: F.aggregate(cut(b), F.lit(0), lambda acc, x: acc + x))
    return let(sums(totals, zero["at"]), lambda firsts: F.flatten(F.transform(firsts, lambda first, b: sums(cut(b), first))))


def places(text: Column, pattern: str) -> Column:
    """start, end (code points) and m, the match, of all matches: what lies between them is the
    text split by the pattern, so lengths add up to places."""

    def placed(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda x: F.length(x["g"]) + F.length(x["m"]))
        start = lambda x, at: at + F.length(x["g"])
        return F.zip_with(pairs, let(sizes, running), lambda x, at: F.struct(start(x, at).alias("start"), (start(x, at) + F.length(x["m"])).alias("end"), x["m"].alias("m")))

    pairs = F.filter(F.zip_with(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda x: x["m"].isNotNull())
    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,m:string>>"))


def hot_part(candidate: Column) -> Column:
    """first, last: the part of a candidate that windows over the limit cover (0, 0 if none)."""
    logs = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)))
    limit = F.lit(CLASSES[-1][2])
    for _, pattern, least in reversed(CLASSES[:-1]):
        limit = F.when(candidate.rlike(pattern), F.lit(least)).otherwise(limit)

    def over(signs: Column, limit: Column, logs: Column) -> Column:
        count = lambda n, x: F.call_function("shiftright", F.get(n, x["slot"]), x["shift"]).bitwiseAND(F.lit(31)).cast("int")

        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(signs, i), F.when(i >= WINDOW, F.get(signs, i - WINDOW))
            # The sum of c log c over counts c: a sign comes in, then one goes out. Counts stand in
            # packed numbers, of which a step writes eight.
            more = count(acc["n"], new)
            grown = acc["s"] - F.get(logs, more) + F.get(logs, more + 1)
            fewer = count(acc["n"], old) + F.when((old["slot"] == new["slot"]) & (old["shift"] == new["shift"]), 1).otherwise(0)
            total = F.when(i >= WINDOW, grown - F.get(logs, fewer) + F.get(logs, fewer - 1)).otherwise(grown)
            n = F.transform(acc["n"], lambda v, k: v + F.when(k == new["slot"], new["unit"]).otherwise(0) - F.when(k == old["slot"], old["unit"]).otherwise(0))
            hot = (i >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= limit)
            first = F.when(hot & (acc["last"] == 0), i - (WINDOW - 1)).otherwise(acc["first"])
            return F.struct(n.alias("n"), total.alias("s"), first.alias("first"), F.when(hot, i + 1).otherwise(acc["last"]).alias("last"))

        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), math.ceil(96 / PACKED)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("first"), F.lit(0).alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(signs) - 1), zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    def sign(x: Column) -> Column:
        code, shift = F.ascii(x) - 32, F.pmod(F.ascii(x) - 32, F.lit(PACKED)) * 5
        return F.struct(F.floor(code / PACKED).cast("int").alias("slot"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("unit"))

    signs = F.transform(F.filter(F.split(candidate, ""), lambda x: x != ""), sign)
    return let(signs, lambda c: let(limit, lambda t: let(logs, lambda g: over(c, t, g))))


def allowed(candidate: Column) -> Column:
    """Whether a candidate is on the allow list."""
    one_sign = F.length(F.replace(candidate, F.substring(candidate, 1, 1), F.lit(""))) == 0
    for pattern in ALLOWED:
        one_sign = one_sign | candidate.rlike(pattern)
    return one_sign


def entropy_spans(text: Column) -> Column:
    """start, end of candidates' parts whose windows exceed their class's limit."""

    def judged(x: Column) -> Column:
        empty = F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))
        part = F.when(allowed(x["m"]), empty).otherwise(hot_part(x["m"]))
        return let(part, lambda p: F.struct((x["start"] + p["first"]).alias("start"), (x["start"] + p["last"]).alias("end"), p["last"].alias("hot")))

    return F.filter(F.transform(places(text, CANDIDATE), judged), lambda x: x["hot"] > 0)


def overlapped(x: Column, spans: Column) -> Column:
    """Whether x overlaps one of the spans, which stand in order and apart: the last one that starts
    before x ends is found by halving."""

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        before = F.get(spans, mid)["start"] < x["end"]
        return F.when(acc["lo"] >= acc["hi"], acc).when(before, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    ends = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(32)), ends, half, lambda acc: F.get(spans, acc["lo"] - 1)["end"])
    return F.coalesce(last > x["start"], F.lit(False))


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (start, kind number, end) in code points by start, then kind.

    kind numbers are places in KINDS. Null texts are empty; null ids, repeated rows and empty
    tables are nothing special; of a text with very many matches all are returned.
    """
    text = F.coalesce("text", F.lit(""))

    def kind(found: Column, number: int, keep=None) -> Column:
        return F.transform(F.filter(found, keep) if keep else found, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))

    assigned = kind(places(text, ASSIGN), 0, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= LEAST_SECRET)
    base = ("assign", "access", "hex")
    found = documents.select("doc_id", assigned.alias("assign"), kind(places(text, ACCESS), 1).alias("access"), kind(places(text, HEX), 2).alias("hex"), entropy_spans(text).alias("dense"))
    extra = F.filter("dense", lambda x: ~(overlapped(x, F.col("assign")) | overlapped(x, F.col("access")) | overlapped(x, F.col("hex"))))
    return found.select("doc_id", F.array_sort(F.concat(*base, kind(extra, 3))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
