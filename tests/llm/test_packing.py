import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeproof.llm.packing import best_fit_decreasing, pack, unpack


def plain(sizes, size):
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(rows)) if room[r] >= sizes[i]]
        if not fits:
            rows.append([])
            room.append(size)
            fits = [len(rows) - 1]
        best = min(room[r] for r in fits)
        r = next(r for r in fits if room[r] == best)
        rows[r].append(i)
        room[r] -= sizes[i]
    return rows


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 64).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(1, n), max_size=60))))
def test_best_fit(case):
    size, sizes = case
    got, want = best_fit_decreasing(sizes, size), plain(sizes, size)
    assert sorted(i for r in got for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= size for r in got)
    assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(sum(sizes[i] for i in r) for r in want)  # whichever of equal rooms is taken


def check(rows, size):
    for r in rows:
        ids, place = (np.frombuffer(r[c], f"<{r['dtype']}") for c in ("ids", "position_ids"))
        cu = r["cu_seqlens"]
        assert len(ids) == len(place) == size and cu[0] == 0 and cu[-1] <= size and len(cu) == len(r["doc_ids"]) + 1 == len(r["starts"]) + 1
        for a, b in zip(cu, cu[1:]):
            assert (place[a:b] == np.arange(b - a)).all()
        assert (ids[cu[-1] :] == 50256).all()


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for size in (2048, 64):
        rows = [r.asDict() for r in pack(docs, row_tokens=size).collect()]
        check(rows, size)
        assert unpack(rows) == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_odd_rows(odd, empty, documents):
    rows = [r.asDict() for r in pack(odd, row_tokens=128).collect()]
    check(rows, 128)
    tokens = {}
    for r in rows:
        for d, a, b in zip(r["doc_ids"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            tokens[d] = tokens.get(d, 0) + b - a
    assert tokens[1] == tokens[2] == 1 and tokens[5] > 30_000 and None in tokens and tokens[4] == 4
    assert pack(empty).count() == 0


def test_places_in_wide_rows(documents):
    """A row of more than 65,535 places needs wider numbers."""
    rows = [r.asDict() for r in pack(documents([(1, "word " * 70_000, "s")]), row_tokens=100_000).collect()]
    check(rows, 100_000)
    assert {r["dtype"] for r in rows} == {"u4"} and max(b for r in rows for b in r["cu_seqlens"]) > 65_536
