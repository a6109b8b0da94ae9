import base64
import gzip
import hashlib
import random
import time

from edgeproof.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, top int")


def test_round_trip(spark):
    tricky = "<p>WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n\r\n\r\né漢\U0001f600</p>"
    rows = [(1, "http://a/\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", tricky), (4, "http://d", None), (5, "http://e", ""), (9, "http://f", "<p>one</p>"), (10, "http://g", "z" * 200_000), (None, "http://h", "no id"), (11, "http://i", tricky), (11, "http://i", tricky)]
    got = warc.round_trip(pages(spark, rows)).collect()
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        b, best = html.encode(), top[html]
        assert (r["payload_bytes"], r["digest"]) == (len(b), digest(b))
        if r["page_id"] is None or r["page_id"] == best:
            assert r["kind"] == "response" and r["refers_to"] is None
        else:
            assert r["kind"] == "revisit" and r["refers_to"] == best


def test_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    top = {}
    for r in df.collect():
        top[r["html"]] = max(top.get(r["html"], -1), r["page_id"])
    want = {(r["page_id"], len(r["html"].encode()), digest(r["html"].encode()), "response" if top[r["html"]] == r["page_id"] else "revisit", None if top[r["html"]] == r["page_id"] else top[r["html"]]) for r in df.collect()}
    assert {tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "digest", "kind", "refers_to").collect()} == want


def test_small_payloads_stay_responses(spark):
    got = warc.round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), least=4).collect()
    assert {r["page_id"]: r["kind"] for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_assembly(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, [(1, "http://a", "x"), (2, "http://b", "x"), (3, None, "y")]), path)
    records = warc.read_records(spark, path, with_payload=True)
    assert records.count() == 9
    captures = {r["metadata"]["page_id"]: r for r in warc.assemble(records).collect()}
    assert captures[1]["main"]["kind"] == "revisit" and captures[1]["main"]["refers_to"] == captures[2]["main"]["id"] and captures[2]["main"]["payload"] == "x"
    assert captures[1]["request"]["uri"] == "http://a" and captures[3]["request"]["uri"] is None
    left = warc.assemble(records.where("kind <> 'request'")).collect()
    assert len(left) == 3 and all(r["request"] is None for r in left)
    assert warc.assemble(records.where("kind = 'metadata'")).count() == 0
    assert warc.round_trip(pages(spark, []).limit(0)).count() == 0


def test_members_and_lengths():
    a, b = (f"WARC/1.1\r\nWARC-Type: {k}\r\nContent-Length: {len(x)}\r\n\r\n{x}\r\n\r\n".encode() for k, x in (("response", "WARC/1.0\r\n\r\n"), ("metadata", "")))
    got = list(warc.parse(warc.inflate(gzip.compress(a) + gzip.compress(b))))
    assert [(h["warc-type"], x) for h, x in got] == [("response", b"WARC/1.0\r\n\r\n"), ("metadata", b"")]
    assert warc.inflate(a) == a


def test_a_member_a_record():
    """As crawlers write them: tens of thousands of members, in time that grows with their number."""
    rng, body = random.Random(3), []
    for i in range(30_000):
        body.append(bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40))) if i % 500 else rng.randbytes(200_000))
    data = b"".join(gzip.compress(x, 1) for x in body)
    began = time.perf_counter()
    assert warc.inflate(data) == b"".join(body)
    assert time.perf_counter() - began < 5
    assert warc.inflate(data, piece=7) == b"".join(body)
