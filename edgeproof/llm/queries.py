"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, mixing, neardup, packing, quality, secrets, syncmers, toxicity, warc
from .common import bucket_of, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = secrets.joined(F.filter("spans", lambda x: x["kind"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.coalesce(bucket_of("doc_id", 5), F.lit(-1))
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold > 0)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_hidden_markov_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.coalesce(bucket_of("doc_id", 7), F.lit(-1))
    return hmm.language_model(table(spark, sf_dir, "documents").withColumn("held_out", fold == 2))


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.with_edited(table(spark, sf_dir, "documents"))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op9_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def toxic_field(spark: SparkSession, sf_dir: str, documents: DataFrame) -> toxicity.Field:
    fold = F.coalesce(bucket_of("doc_id", 4), F.lit(2))
    return toxicity.fit(toxicity.training_rows(documents, table(spark, sf_dir, "labels"), fold != 2))


def op10_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fold = F.coalesce(bucket_of("doc_id", 4), F.lit(-1))
    scored = toxicity.score(documents, toxic_field(spark, sf_dir, documents))
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_toxic", "spans")


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_secret_scan, op5_quality_classifier, op6_hidden_markov_model,
    op7_syncmer_fingerprints, op8_warc_transactions, op9_packed_tokens, op10_toxic_spans,
)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES: dict[str, str] = {
    # All pairs that share a shingle, and all that is reachable over pairs at the threshold.
    "op2_ngram_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  p AS (SELECT a, b, k = x.n AND k = y.n AS same FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9*k >= 4*(x.n + y.n)),
  r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
  c AS (SELECT a, min(b) AS b FROM r GROUP BY 1),
  l AS (SELECT a, count(*) AS links, count(*) FILTER (WHERE same) AS copies, min(b) FILTER (WHERE same) AS twin FROM p GROUP BY 1)
  SELECT d.doc_id, least(d.doc_id, coalesce(twin, d.doc_id)) AS rep_id, least(d.doc_id, coalesce(c.b, d.doc_id)) AS class_id, coalesce(links, 0) AS n_links, coalesce(copies, 0) + 1 AS n_copies
  FROM documents d LEFT JOIN c ON c.a = d.doc_id LEFT JOIN l ON l.a = d.doc_id""",
    # What the archives must say, from the pages themselves.
    "op8_warc_transactions": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST((i // 4)*5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5*(i % 4) AS BIGINT)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
    CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM d""",
}
__all__ = ["ORACLES", "QUERIES", "toxic_field"]
