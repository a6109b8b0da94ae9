"""Document fingerprints of closed syncmers, in SQL expressions only.

The k-mers of a text are its runs of 16 characters, at every character. Of each one the inner runs of
6 are hashed; the k-mer is a closed syncmer if the least of them is its first or its last. Which ones
are chosen depends on nothing but the k-mer, so shared passages choose the same anchors wherever they
stand, with or without white space. A fingerprint has every anchor and where it stands; two
fingerprints are as alike as the anchors that both hold on diagonals with a run of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of an inner run, inner runs of a k-mer, and so characters of a k-mer.
INNER, SPAN = 6, 11
KMER = INNER + SPAN - 1
#: A packed anchor is 32 bits of hash, 31 bits of place and a lowest bit that stays free: it tells two
#: fingerprints apart when they are merged. A place never wraps: a string is shorter than 2^31.
PLACE_BITS = 32
_MASK = (1 << PLACE_BITS) - 1
#: Diagonals, in characters, that matched anchors of a run may be apart.
DRIFT = 256
_NONE = "array<bigint>"


def let(value: Column, body) -> Column:
    """Bind value to a name in body, so that it is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def place_of(anchor: Column) -> Column:
    """Where an anchor stands, in code points."""
    return F.shiftright(anchor.bitwiseAND(F.lit(_MASK)), 1)


def closed(text: Column) -> Column:
    """Places of the closed syncmers of the text, in order."""

    def mark(h: Column):
        def one(edge: Column, i: Column) -> Column:
            # The lesser of the first and the last against each inner run between them: the first
            # greater one ends it, so few are looked at: each test holds those after it.
            return F.when(reduce(lambda after, test: test & after, [edge <= F.get(h, i + j) for j in range(SPAN - 2, 0, -1)]), i)

        return one

    def chosen(h: Column) -> Column:
        edges = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - (SPAN - 1), F.lit(0))), F.slice(h, SPAN, F.size(h)), lambda a, b: F.least(a, b))
        return F.array_compact(F.transform(edges, mark(h)))

    return let(inner_runs(text), chosen)


def inner_runs(text: Column) -> Column:
    """Hashes of the runs of 6 characters, at every character. In a text of one byte a character a run is
    cut out of the bytes; a hash is of bytes, so both ways give the same."""
    runs = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{INNER}}}))."), F.lit(1))  # the last sign moves on by a code point
    cut = lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - (INNER - 1)), lambda i: F.xxhash64(F.substring(b, i, F.lit(INNER))))
    plain = (F.octet_length(text) == F.length(text)) & (F.length(text) >= INNER)
    return F.when(plain, let(F.encode(text, "UTF-8"), cut)).otherwise(F.transform(runs, lambda x: F.xxhash64(x)))


def named(text: Column, places: Column) -> Column:
    """Anchors, packed as hash and place, at the places. In UTF-32 a place is an offset."""

    def of(wide: Column) -> Column:
        return F.transform(places, lambda p: F.xxhash64(F.substring(wide, p * 4 + 1, F.lit(4 * KMER))).bitwiseAND(F.lit(~_MASK)).bitwiseOR(F.shiftleft(p.cast("long"), 1)))

    return let(F.encode(text, "UTF-32"), of)


def whole(found: Column, text: Column) -> Column:
    """Anchors in the order of their hashes. A text without a closed syncmer (all texts shorter than a
    k-mer are) has one anchor, all of it; an empty text has none."""
    alone = F.when(F.length(text) > 0, F.array(F.xxhash64(text).bitwiseAND(F.lit(~_MASK)))).otherwise(F.array().cast(_NONE))
    return F.when(F.size(found) > 0, F.sort_array(found)).otherwise(alone)


def anchors(text: Column) -> Column:
    """The fingerprint of a text: see closed and whole."""
    return let(closed(text), lambda places: whole(named(text, places), text))


def spliced(left: Column, kept: Column, right: Column, taken: Column, text: Column, after: Column) -> Column:
    """The named closed syncmers of text[:kept] + after[:taken] from those of text (left) and after
    (right): a k-mer lies in one of the two or crosses the seam, and only those that cross are worked out."""
    most = F.lit(KMER - 1)
    before = F.least(kept, most)
    seam = F.concat(F.substring(text, kept - before + 1, before), F.substring(after, F.lit(1), F.least(taken, most)))
    moved = lambda found, by: F.transform(found, lambda x: x + F.shiftleft(by.cast("long"), 1))
    across = let(seam, lambda t: let(closed(t), lambda places: named(t, places)))
    return F.concat(F.filter(left, lambda x: place_of(x) <= kept - KMER), moved(across, kept - before), moved(F.filter(right, lambda x: place_of(x) <= taken - KMER), kept))


def written(anchors_: Column) -> Column:
    """A fingerprint as text: hexadecimal anchors."""
    return F.lower(F.array_join(F.transform(anchors_, lambda x: F.lpad(F.hex(x), 16, "0")), ","))


def likeness(a: Column, b: Column) -> Column:
    """Anchors that both have, on diagonals that hold a run, over those that either has: 0 to 1.

    A repeated hash counts once, where it stands first. A match is part of a run if another one lies
    within DRIFT diagonals, so passages count wherever they moved to; a text's only match counts too.
    Two empty fingerprints are alike (1); an empty one is like no other (0).
    """
    def once(x: Column) -> Column:
        return F.filter(x, lambda v, i: (i == 0) | (F.shiftright(v, PLACE_BITS) != F.shiftright(F.get(x, i - 1), PLACE_BITS)))

    def pair(x: Column, y: Column) -> Column:
        """The shift of two neighbours in the merged order that have one hash."""
        gap = place_of(y) - place_of(x)
        return F.when(F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS), F.when(x.bitwiseAND(F.lit(1)) == 0, gap).otherwise(-gap))

    def in_runs(shifts: Column) -> Column:
        beside = lambda s, i: (F.coalesce(s - F.get(shifts, i - 1) <= DRIFT, F.lit(False))) | (F.coalesce(F.get(shifts, i + 1) - s <= DRIFT, F.lit(False)))
        return F.when(F.size(shifts) == 1, F.lit(1)).otherwise(F.size(F.filter(shifts, beside)))

    def of(x: Column, y: Column) -> Column:
        merged = F.sort_array(F.concat(x, F.transform(y, lambda v: v + 1)))
        shifts = let(merged, lambda m: F.sort_array(F.array_compact(F.zip_with(m, F.slice(m, 2, F.size(m)), pair))))
        return let(shifts, lambda s: in_runs(s) / (F.size(x) + F.size(y) - F.size(s)))

    ratio = let(a, lambda u: let(b, lambda v: let(once(u), lambda x: let(once(v), lambda y: of(x, y)))))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(ratio)


def range_starts(ids: DataFrame, ranges: int) -> list[int]:
    """The least id of each of about so many ranges with ids, in order: a number a range comes to the driver."""
    parts = ids.where("id is not null").repartitionByRange(ranges, "id").select("id", F.spark_partition_id().alias("range"))
    return sorted(r["first"] for r in parts.groupBy("range").agg(F.min("id").alias("first")).collect())


def range_of(ident: Column, starts: list[int]) -> Column:
    """The number of the range that an id is in, by halving."""
    table, zero = F.array(*map(F.lit, starts)).cast("array<bigint>"), F.struct(F.lit(0).alias("lo"), F.lit(len(starts)).alias("hi"))

    def of(t: Column) -> Column:
        def half(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            return F.when(acc["lo"] >= acc["hi"], acc).when(F.get(t, mid) <= ident, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(len(starts).bit_length() + 1)), zero, half, lambda acc: acc["lo"] - 1)

    return let(table, of)


def with_next(rows: DataFrame, id_: str, rank: str, payload: str, starts: list[int]) -> DataFrame:
    """rows with ahead: the payload of the next greater id, the least one after the greatest; of rows
    with one id the one of least rank stands for it.

    One exchange by ranges of ids; within a range the next row is a window's, and the last id of a range
    takes the first row of the next range, which is looked up in the rows themselves.
    """
    placed = rows.withColumn("range", range_of(F.col(id_), starts))
    order = Window.partitionBy("range").orderBy(id_, rank)
    # Plain columns: what a window works out first travels with the rows. Rows of one id look past each
    # other: the last of them has the next id's row, and shares it.
    placed = placed.withColumn("later", F.lead(payload).over(order)).withColumn("following", F.lead(id_).over(order))
    shared = placed.withColumn("later", F.when(F.col("following") > F.col(id_), F.col("later")))
    shared = shared.withColumn("later", F.first("later", ignorenulls=True).over(Window.partitionBy("range", id_)))
    before = {s: (i - 1) % len(starts) for i, s in enumerate(starts)}
    link = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    firsts = rows.where(F.col(id_).isin(starts)).groupBy(id_).agg(F.min_by(payload, rank).alias("first")).select(link[F.col(id_)].alias("range"), "first")
    return shared.join(firsts, "range").withColumn("ahead", F.coalesce("later", "first")).drop("later", "following", "first", "range")


def fingerprint(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint (anchors) of each document row; null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.length(text).cast("long").alias("n_chars"), anchors(text).alias("anchors"))


def with_edited(documents: DataFrame) -> DataFrame:
    """Each document, its text with the last quarter replaced by the head of the next document's,
    both fingerprints, and the likeness of its own to the edited text's and the next document's.

    The next document has the next greater id; of repeated ids, the row whose text hashes least
    stands for the id. Rows with a null id have no next: an empty text stands for it. Null texts are
    empty. A text's anchors are found once, where it is read, and travel as places with the text; the
    edited text's are put together from its own and the next one's.
    """
    every = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = documents.sparkSession
    starts = range_starts(every.select(F.col("doc_id").alias("id")), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    marked = every.withColumn("own", F.struct("text", closed(F.col("text")).alias("places")))
    none = F.struct(F.lit("").alias("text"), F.array().cast("array<int>").alias("places"))
    joined = marked.where("doc_id is null").select("doc_id", "own", none.alias("ahead"))
    if starts:
        named_rows = marked.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("rank"), "own")
        joined = joined.unionByName(with_next(named_rows, "doc_id", "rank", "own", starts).select("doc_id", "own", "ahead"))
    joined = joined.select("doc_id", F.col("own").alias("one"), F.col("ahead").alias("two"))
    text, ahead = F.col("one.text"), F.col("two.text")
    n, quarter = F.length(text), F.floor(F.length(text) / 4).cast("int")
    head = F.substring(ahead, F.lit(1), quarter)
    found = joined.select(
        "doc_id", text.alias("text"), ahead.alias("ahead"), n.alias("n"), (n - quarter).alias("kept"), F.length(head).alias("taken"), F.concat(F.substring(text, F.lit(1), n - quarter), head).alias("edited"),
        named(text, F.col("one.places")).alias("own"), named(ahead, F.col("two.places")).alias("next"),
    )
    other = spliced(F.col("own"), F.col("kept"), F.col("next"), F.col("taken"), F.col("text"), F.col("ahead"))
    both = found.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        whole(F.col("own"), F.col("text")).alias("own"), let(other, lambda x: whole(x, F.col("edited"))).alias("other"), whole(F.col("next"), F.col("ahead")).alias("next"),
    )
    return both.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
