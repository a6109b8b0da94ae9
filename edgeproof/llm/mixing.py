"""Mixing sources to target weights by Sainte-Lague apportionment.

Equal blocks of words are the seats. A source gets whole blocks and one last part of a block, so its
quota is its target to the word. Blocks go from each source to its shards (hashed groups of its
documents of bounded size; a rare source is one shard) by highest quotients, so that every shard has
an integer quota and selects its own blocks: documents of a shard stand in a seeded order, its words
form a ring, and the quota takes blocks from the ring's start, going round a second time where a
target exceeds the source. Nothing but quotas is ordered across shards.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Words in a block (a seat), documents meant for a shard, shards of a group.
BLOCK, SHARD_DOCS, FAN = 16, 1024, 512
SPACE = r"[\x20\x09-\x0D]"


def sainte_lague(weights, seats: int, caps=None) -> np.ndarray:
    """Seats by highest quotients weight / (2 seats + 1), first index at ties, none above its cap.

    Instead of one seat at a time, a bisection finds a divisor that gives nearly all seats at
    once; only the last few go one by one. Empty or zero weights get nothing.
    """
    w = np.asarray(weights, dtype=float)
    cap = np.full(len(w), np.iinfo(np.int64).max // 4) if caps is None else np.asarray(caps, dtype=np.int64)
    cap = np.where(w > 0, cap, 0)
    if not len(w) or seats <= 0:
        return np.zeros(len(w), np.int64)
    seats = min(seats, int(cap.sum()))

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(np.minimum(w / divisor, 4e18) + 0.5), cap).astype(np.int64)

    lo, hi = w[w > 0].min(initial=1.0) / (4.0 * (seats + 1)), 4 * w.sum() + 1
    while given(lo).sum() < seats:
        lo /= 16
    for _ in range(80):
        mid = math.sqrt(lo * hi)
        if given(mid).sum() <= seats:
            hi = mid
        else:
            lo = mid
    got = given(hi * (1 + 1e-9))
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(got < cap)]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return got


def apportion(words, quota: int, block: int, most) -> np.ndarray:
    """Words for each unit, quota in all (as far as most allows): whole blocks by highest quotients, the
    rest of the quota to the unit that the next block would go to. A unit stops at most words, and what
    a last block has beyond that goes to the units with room, in order."""
    w, most = np.asarray(words, np.int64), np.asarray(most, np.int64)
    caps = -(-most // block)
    seats = sainte_lague(w, quota // block, caps)
    out = seats * block
    if rest := quota - int(out.sum()):
        open_ = np.flatnonzero((seats < caps) & (w > 0))
        if len(open_):
            out[open_[np.argmax(w[open_] / (2 * seats[open_] + 1))]] += min(rest, block)
    out = np.minimum(out, most)
    room = most - out
    before = np.cumsum(room) - room
    return out + np.clip(quota - int(out.sum()) - before, 0, room)


def _share(down: DataFrame, up: str, unit: str, block: int) -> DataFrame:
    """Hand each parent's quota on to its units. down: source_key, the parent, unit, words, quota, most."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([unit])
        return pdf[["source_key", unit]].assign(quota=apportion(pdf["words"], int(pdf["quota"].iloc[0]), block, pdf["most"]))

    return down.groupBy("source_key", *([up] if up else [])).applyInPandas(group, f"source_key string, {unit} long, quota long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source_key, words, docs -> source_size, docs, target: weighted shares of share x all words, none
    above cap x its source, what is above going to the others by weight until none is."""
    # The rank of a source among all: sorted partitions, and each partition's first rank.
    parts = cut(sources.orderBy("source_key").select("*", F.spark_partition_id().alias("part")).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "sources")
    counts = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect())
    first, total = {}, 0
    for part, n in counts:
        first[part], total = total, total + n
    starts = F.coalesce(*(F.when(F.col("part") == p, F.lit(s)) for p, s in first.items() if s), F.lit(0)) if total else F.lit(0)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(starts + F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(parts.select("source_key", "words", "docs", w.alias("weight"), (F.lit(cap) * F.col("words")).alias("most")), "weights")
    everything = ranked.agg(F.sum("words"), F.sum("weight")).first()
    goal, rate = share * float(everything[0] or 0), math.inf
    if everything[1]:
        rate = goal / everything[1]
        while True:  # each round caps at least one more source; the driver reads three numbers
            full = F.col("most") <= rate * F.col("weight")
            taken, free = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
            new = math.inf if not free else max(0.0, goal - float(taken or 0)) / free
            if new <= rate * (1 + 1e-12) or not free:
                rate = new if not free else max(rate, new)
                break
            rate = new
    return ranked.select("source_key", F.col("words").cast("long").alias("source_size"), "docs", F.when(F.lit(math.isinf(rate)), F.col("most")).otherwise(F.least("most", F.lit(rate if math.isfinite(rate) else 0.0) * F.col("weight"))).alias("target"))


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in order, repeating; share of all words; how often a document may be
    taken; words of a block; documents of a shard; the seed of the order within shards."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: int = 2
    block: int = BLOCK
    shard_docs: int = SHARD_DOCS
    seed: int = 7

    def _rows(self, documents: DataFrame, *keep: Column) -> DataFrame:
        """keep, source_key, size, and what the order within a shard goes by."""
        key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("b"), F.col("source")))
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        return documents.select(*keep, key.alias("source_key"), size.alias("size"), F.xxhash64(F.lit(self.seed), "doc_id", "text").alias("place"))

    def _dealt(self, rows: DataFrame, goals: DataFrame) -> DataFrame:
        """Rows with words, their source's goal and their shard: as many shards as the source needs."""
        shards = F.ceil(F.col("docs") / self.shard_docs)
        return rows.where("size > 0").join(goals, "source_key").withColumn("shard", F.pmod(F.col("place"), shards).cast("long")).drop("docs")

    def _plan(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Goals of the sources, quotas of the shards."""
        sources = rows.groupBy("source_key").agg(F.sum("size").alias("words"), F.count(F.when(F.col("size") > 0, 1)).alias("docs"))
        goals = cut(targets(sources, self.weights, self.share, self.cap), "targets")
        cells = cut(self._dealt(rows, goals).groupBy("source_key", "shard").agg(F.sum("size").alias("words")), "cells").withColumn("group", F.floor(F.col("shard") / FAN))
        most = (F.lit(self.cap) * F.col("words")).cast("long").alias("most")
        groups = cells.groupBy("source_key", "group").agg(F.sum("words").alias("words"))
        wanted = goals.select("source_key", F.round("target").cast("long").alias("quota"))
        upper = _share(groups.select("*", most).join(wanted, "source_key"), "", "group", self.block)
        lower = _share(cells.select("*", most).join(upper, ["source_key", "group"]), "group", "shard", self.block)
        return goals, cut(lower.join(cells.select("source_key", "shard", "words"), ["source_key", "shard"]), "quotas")

    def _taken(self, rows: DataFrame, goals: DataFrame, quotas: DataFrame, *order: str) -> DataFrame:
        """Rows with words, and how many of them are taken: the quota along the ring, pass after pass."""
        ring = Window.partitionBy("source_key", "shard").orderBy("place", *order, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = self._dealt(rows, goals).withColumn("end", F.sum("size").over(ring)).join(quotas, ["source_key", "shard"])
        start = F.col("end") - F.col("size")
        within = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - k * F.col("words") - start))
        return placed.withColumn("taken", sum((within(k) for k in range(1, self.cap)), within(0)).cast("long"))


def mix(documents: DataFrame, how: Mix = Mix()) -> DataFrame:
    """One row a document row: its size in words, its source's size and target, words taken, its shard.

    taken is whole passes over the document plus the part of it that the last block covers. A source's
    taken words are its target, rounded. Null and empty texts have size 0, nothing of them is taken and
    they have no shard; a null source is a source of its own, last in order; null ids are ordinary rows;
    repeated rows are drawn each for itself (those equal in id and text stand in one shard); an empty
    table gives no rows.
    """
    rows = cut(how._rows(documents, F.col("doc_id")), "sized")
    goals, quotas = how._plan(rows)
    out = ("doc_id", "size", "source_size", "target", "taken", "shard")
    none = rows.where("size = 0").join(goals, "source_key").withColumns({"taken": F.lit(0).cast("long"), "shard": F.lit(None).cast("long")})
    return how._taken(rows, goals, quotas, "doc_id").select(*out).unionByName(none.select(*out))


def realise(documents: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mix as documents, all columns: a row for each whole pass, and one cut row for a part that is
    taken. A part keeps its words from the start, as they stand; copies keep the id. Every row carries
    its own share of the mix through the one exchange by shard, so null and repeated ids lose nothing.
    """
    cols = documents.columns
    rows = how._rows(documents, F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), F.col("doc_id"))
    light = cut(how._rows(documents, F.col("doc_id")), "sized")
    goals, quotas = how._plan(light)
    picked = how._taken(rows, goals, quotas, "doc_id").where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.pmod(F.col("taken"), F.col("size")).cast("int")
    each = picked.select("row", rest.alias("rest"), F.explode(F.concat(F.array_repeat(F.lit(False), whole), F.array_repeat(F.lit(True), F.signum(rest).cast("int")))).alias("cut"))
    text, cut_ = F.col("row.text"), F.col("cut")
    lead = F.when(text.rlike(f"^{SPACE}"), F.lit(1)).otherwise(F.lit(0))
    after = F.element_at(F.split(text, f"{SPACE}+", F.col("rest") + lead + 1), -1)
    part = F.col("row").withField("text", F.substring(text, F.lit(1), F.length(text) - F.length(after)))
    each = each.withColumn("row", F.when(cut_, part).otherwise(F.col("row")))
    if "n_chars" in cols:
        chars = F.length("row.text").cast(documents.schema["n_chars"].dataType)
        each = each.withColumn("row", F.when(cut_, F.col("row").withField("n_chars", chars)).otherwise(F.col("row")))
    return each.select("row.*")
