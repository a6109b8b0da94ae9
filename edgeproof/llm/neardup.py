"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Documents with the same set of word shingles form a class; only one of each class goes on.
2. The forest has a number of prefix tries. In each one a class stands at the path of its minhash
   values. At the floor, the longest prefix that a pair at the threshold shares in some trie with the
   target recall, the tries are cut into subtries; a subtrie's paths are sorted, and the longest common
   prefixes of neighbours make its levels. Matching starts at the full depth and shortens prefixes a
   value at a time: members of one run whose sketches (all minhash values) can be similar are linked.
   A run stops where its members are all linked, as no shorter prefix of theirs can add anything, or at
   the floor, where the recall is reached.
3. The links' components are candidate groups. Within a group, block by block, all pairs are verified
   by their exact Jaccard similarity. Only counts and one link a member to its leader leave a block,
   never the pairs.

Large subtries and groups are cut into blocks, and a task works on a pair of blocks: nothing is
capped, and a task's memory is bounded. The work in a group of near copies is quadratic in its
distinct texts, which an exact number of links needs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, column, cut, mix64, raw_texts, scan, slices, token_batch
from .components import components

#: How many deviations less often than the mean sketch values may agree at the threshold; block sizes.
SIGMAS, BUCKET_BLOCK, GROUP_BLOCK = 5.5, 2048, 512


@dataclass(frozen=True)
class Forest:
    """Shingle width, similarity, number of tries, depth of each, recall wanted at the threshold."""

    width: int = 5
    similarity: float = 0.8
    tries: int = 20
    depth: int = 6
    recall: float = 0.9999
    seed: int = 11

    def floor(self) -> int:
        """The longest prefix, from the full depth down, that pairs at the threshold share in some trie
        with the recall wanted: where shortening ends."""
        d = self.depth
        while d > 1 and 1 - (1 - self.similarity**d) ** self.tries < self.recall:
            d -= 1
        return d

    def least_alike(self) -> int:
        """Equal sketch values that a pair at the threshold has, save for SIGMAS deviations."""
        k, s = self.tries * self.depth, self.similarity
        return max(1, math.floor(k * s - SIGMAS * math.sqrt(k * s * (1 - s))))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The set of each text's word shingles as sorted hashes; a text of fewer words is one shingle."""
    h, counts = token_batch(texts)
    ends = np.cumsum(counts)
    full = np.zeros(len(h), np.uint64)
    for j in range(min(width, len(h))):
        full[: len(h) - j] = full[: len(h) - j] * np.uint64(0x9E3779B97F4A7C15) + h[j:]
    full = mix64(full)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(full[end - n : end - width + 1]))
        elif n:
            x = np.uint64(n)
            with np.errstate(over="ignore"):
                for y in h[end - n : end]:
                    x = x * np.uint64(0x9E3779B97F4A7C15) + y
            out.append(mix64(np.array([x])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(forest: Forest):
    rng = np.random.default_rng(forest.seed)
    k = forest.tries * forest.depth
    mul, add = rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)
    used = forest.floor()

    def run(batch):
        ids, place, texts = column(batch, "doc_id"), column(batch, "place"), raw_texts(batch)
        for a, b in slices([len(t) for t in texts], 8_000_000):
            sets = shingle_sets(texts[a:b], forest.width)
            sizes = np.array([len(s) for s in sets])
            has = np.flatnonzero(sizes)
            m = np.zeros((len(sets), k), np.uint32)
            one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(has):
                flat = np.concatenate([sets[i] for i in has])
                at = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
                for j in range(k):
                    m[has, j] = np.minimum.reduceat(((flat * mul[j] + add[j]) >> np.uint64(32)).astype(np.uint32), at)
                one[has], two[has] = np.add.reduceat(mix64(flat), at), np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
            labels = np.zeros((len(sets), forest.tries), np.uint64)
            for t in range(forest.tries):
                for d in range(used):
                    labels[:, t] = mix64(labels[:, t] * np.uint64(31) + m[:, t * forest.depth + d] + np.uint64(t * 7919 + 1))
            offs = np.arange(0, (len(sets) + 1) * forest.tries, forest.tries, dtype=np.int32)
            yield {
                "doc_id": ids.slice(a, b - a), "place": place.slice(a, b - a), "n_shingles": sizes,
                "d1": one.view(np.int64), "d2": two.view(np.int64),
                "labels": pa.ListArray.from_arrays(pa.array(offs), pa.array(labels.ravel().view(np.int64))),
                "sketch": [x.tobytes() for x in (m & 0xFFFF).astype("<u2")],
            }

    return run


def _blocks(df: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """Deal members of each key to pairs of blocks i <= j (one pair if the key is small).

    df has n, the key's number of members. Adds bi, bj and own (the member's block). A member of a
    key with m blocks goes to m pairs, so rows grow by n / size for the large keys only.
    """
    m = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), member), m).cast("int")
    return df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), m - 1))).withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other", "n")


def _merge(group: np.ndarray, sketch: np.ndarray, rows: np.ndarray, least: int) -> None:
    """Join the groups of a run's rows by pairs with at least so many equal values, in place."""
    rest = rows
    while len(rest):
        own = group[rest] == group[rest[0]]
        name, queue, rest = group[rest[0]], rest[own].tolist(), rest[~own]
        while queue and len(rest):
            near = (sketch[rest] == sketch[queue.pop()]).sum(1) >= least
            if near.any():
                more = np.isin(group[rest], group[rest[near]])
                queue += rest[more].tolist()
                group[rest[more]] = name
                rest = rest[~more]


def forest_links(paths: np.ndarray, sketch: np.ndarray, floor: int, least: int) -> np.ndarray:
    """For each row of a subtrie, a row that names its group. paths: the values below the floor."""
    order = np.lexsort(paths.T[::-1]) if paths.shape[1] else np.arange(len(paths))
    paths = paths[order]
    common = floor + np.cumprod(paths[1:] == paths[:-1], axis=1).sum(1)
    group, sketch = np.arange(len(order)), sketch[order]
    for depth in range(floor + paths.shape[1], floor - 1, -1):
        cuts = np.flatnonzero(common < depth) + 1
        for rows in np.split(np.arange(len(order)), cuts):
            if len(rows) > 1 and (group[rows] != group[rows[0]]).any():  # else a shorter prefix adds nothing
                _merge(group, sketch, rows, least)
    out = np.empty(len(order), np.int64)
    out[order] = order[group]
    return out


def candidate_edges(classes: DataFrame, forest: Forest) -> DataFrame:
    """classes(node, labels, sketch) -> edges a, b between classes that can be similar. Only classes
    that share a subtrie with another one send their sketch."""
    rows = classes.select("node", F.posexplode("labels").alias("trie", "label"))
    counts = rows.groupBy("trie", "label").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(counts, ["trie", "label"])
    dealt = _blocks(shared, "label", "node", BUCKET_BLOCK).join(classes.select("node", "sketch"), "node")
    least, floor, depth, tries = forest.least_alike(), forest.floor(), forest.depth, forest.tries
    keys = ["trie", "label", "bi", "bj"]
    bins = max(dealt.sparkSession._jsc.sc().defaultParallelism() * 8, classes.count() // 500)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, "node"], ignore_index=True)
        nodes, sketch = pdf["node"].to_numpy(), np.frombuffer(b"".join(pdf["sketch"]), "<u2").reshape(len(pdf), tries * depth)
        trie = pdf["trie"].to_numpy()
        new = (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(1)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        size = np.diff(np.append(starts, len(pdf)))
        two = starts[size == 2]  # most subtries: a pair
        two = two[(sketch[two] == sketch[two + 1]).sum(1) >= least] if len(two) else two
        a, b = [nodes[two + 1]], [nodes[two]]
        for s, n in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            rows = slice(s, s + n)
            first = trie[s] * depth
            lead = forest_links(sketch[rows, first + floor : first + depth], sketch[rows], floor, least)
            a.append(nodes[rows])
            b.append(nodes[rows][lead])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]}).drop_duplicates()

    # Few rows share a label, so whole labels go to a bin; a large subtrie's block pairs are apart.
    deal = dealt.withColumn("bin", F.pmod(F.xxhash64(*keys), F.lit(bins)))
    return deal.groupBy("bin").applyInPandas(group, "a long, b long").distinct()


def jaccard_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from a bit matrix of the shared shingles only."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, df = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    keep = df[inverse] > 1
    new = np.cumsum(df > 1) - 1
    rows, cols = rows[keep], new[inverse[keep]]
    order = np.argsort(cols, kind="stable")
    rows, cols, g = rows[order], cols[order], np.zeros((n, n), np.float32)
    width = 4096
    for c in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        lo, hi = np.searchsorted(cols, [c, c + width])
        x = np.zeros((n, width), np.float32)
        x[rows[lo:hi], cols[lo:hi] - c] = 1
        g += x @ x.T
    return g


def verify_links(members: DataFrame, forest: Forest, bins: int) -> DataFrame:
    """members(comp, node, copies, text, n) -> node, links, leader.

    links counts the documents linked to node in one block pair; leader is the least class that links
    lead to within it.
    """
    s, width = forest.similarity, forest.width

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["comp", "bi", "bj"], sort=False):
            g = g.drop_duplicates("node").sort_values("node")
            nodes, copies, own = g["node"].to_numpy(), g["copies"].to_numpy(), g["own"].to_numpy()
            sets = shingle_sets([t.encode("utf-8", "replace") for t in g["text"].fillna("")], width)
            size = np.array([len(x) for x in sets], dtype=np.float64)
            linked = jaccard_counts(sets) >= s / (1 + s) * (size[:, None] + size[None, :]) - 1e-6
            np.fill_diagonal(linked, False)
            if g["bi"].iloc[0] != g["bj"].iloc[0]:
                linked &= own[:, None] != own[None, :]  # pairs of one block are counted in its own pair
            lead = np.arange(len(nodes))
            while True:  # least label over links
                new = np.minimum(lead, np.where(linked, lead[None, :], len(nodes)).min(1))
                new = new[new]
                if (new == lead).all():
                    break
                lead = new
            out.append(pd.DataFrame({"node": nodes, "links": linked @ copies, "leader": nodes[lead]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("node", "links", "leader")})

    dealt = _blocks(members, "comp", "node", GROUP_BLOCK)
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("comp", "bi", "bj"), F.lit(bins)))
    return dealt.groupBy("bin").applyInPandas(group, "node long, links long, leader long")


def _joined(documents: DataFrame, forest: Forest) -> DataFrame:
    """Every row with an id: doc_id, place (its text's hash), n_shingles, and its class: rep (its least
    id), copies, links, comp (the group of classes that links make) and least (the group's least id)."""
    base = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("place"))
    signed = cut(scan(base, _signatures(forest), "doc_id long, place long, n_shingles long, d1 long, d2 long, labels array<bigint>, sketch binary").where("doc_id is not null"), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("copies"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    # A class has a number of its own, as rows of one id may be in several; it stays as it is written.
    classes = cut(classes.select("d1", "d2", F.col("first.doc_id").alias("rep"), F.col("first.place").alias("place"), "copies", "labels", "sketch", F.monotonically_increasing_id().alias("node")), "classes")
    groups = cut(components(candidate_edges(classes, forest)), "groups")
    sizes = groups.groupBy("comp").agg(F.count("*").alias("n"))
    chosen = groups.join(sizes, "comp").join(classes.select("node", "rep", "place", "copies"), "node")
    texts = base.withColumnRenamed("doc_id", "rep").join(chosen, ["rep", "place"])
    bins = max(documents.sparkSession._jsc.sc().defaultParallelism() * 4, groups.count() // 128)
    checked = cut(verify_links(texts.select("comp", "node", "copies", "text", "n"), forest, bins), "checked")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    final = cut(components(checked.select(F.col("node").alias("a"), F.col("leader").alias("b"))).join(classes.select("node", "rep"), "node"), "final")
    least = final.groupBy("comp").agg(F.min("rep").alias("least"))
    final = final.select("node", "comp").join(least, "comp")
    found = classes.select("d1", "d2", "rep", "copies", "node").join(links, "node", "left").join(final, "node", "left")
    found = found.select("d1", "d2", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "node").alias("comp"), F.coalesce("least", "rep").alias("least"))
    return signed.select("doc_id", "place", "n_shingles", "d1", "d2").join(found, ["d1", "d2"], "left")


def near_duplicates(documents: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row a document row: doc_id, rep_id, class_id, n_links, n_copies.

    rep_id is the least id with the same shingle set (the class that pairs are verified for),
    class_id the least id of all that links lead to, n_links the number of other documents whose
    similarity is at the threshold or above, copies included, n_copies the class's size. Texts of
    fewer words than a shingle are one shingle; null and empty texts have none: they are alone
    (class_id is the id, n_links 0). Rows with a null id are kept, with null class and no links.
    Repeated rows are copies of each other; rows of one id and different texts are judged by their texts.
    """
    own = F.col("n_shingles") > 0
    out = _joined(documents, forest).select(
        "doc_id", F.when(own, F.col("rep")).otherwise(F.col("doc_id")).alias("rep_id"), F.when(own, F.col("least")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(own, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).alias("n_links"), F.when(own, F.col("copies")).otherwise(F.lit(1)).alias("n_copies"),
    )
    nameless = documents.where("doc_id is null").select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("rep_id", "class_id")), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(nameless)


def deduplicate(documents: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One document row of each group that links make stays: the one with the least id, and of rows with
    that id the one whose text hashes least (of rows equal in id and text, one). All columns.

    Rows with a null id, and null or empty texts, are in no class and all stay.
    """
    alone = F.col("row.doc_id").isNull() | ~F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    first = _joined(documents, forest).where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    named = rows.where(~alone).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("place"))
    kept = named.join(first.select("first.doc_id", "first.place"), ["doc_id", "place"], "left_semi").dropDuplicates(["doc_id", "place"])
    return rows.where(alone).unionByName(kept.select("row")).select("row.*")
