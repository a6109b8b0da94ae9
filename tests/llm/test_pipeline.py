import corpus_pipeline as cp
from edgeproof.llm import decontaminate, mixing, neardup, queries, toxicity
from edgeproof.llm.common import cut, table
from edgeproof.llm.packing import unpack


def test_stages(spark, sf):
    docs = cut(table(spark, sf, "documents"), "start")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "packing"]
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        out = cut(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "toxicity":
            scores = toxicity.score(docs, queries.toxic_field(spark, sf, docs)).collect()
            assert ids(out) == {r["doc_id"] for r in scores if r["score"] < 0.3}
        elif name == "near_duplicates":
            classes = neardup.near_duplicates(docs).collect()
            assert ids(out) == {r["class_id"] for r in classes} and out.count() == len(ids(out))
        elif name == "decontamination":
            assert ids(out) == ids(docs) - ids(decontaminate.find_leaks(docs, table(spark, sf, "benchmark")))
        else:
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
            words = {}
            for r in out.collect():
                words[r["doc_id"]] = words.get(r["doc_id"], 0) + len([w for w in r["text"].encode().split()])
            assert words == {i: n for i, n in taken.items() if n}
        docs = out
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert ids(docs) == {d for r in packed.collect() for d in r["doc_ids"]}


def test_odd_rows(spark, odd, empty, sf):
    for start in (odd, empty):
        docs = start
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == start.columns
        assert cp.STAGES[-1][1](spark, docs, sf).count() >= 0


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert unpack([]) == {}


def test_shared_folder():
    """On a cluster without one the operators refuse; frames kept stay, the rest is deleted."""
    from types import SimpleNamespace

    import pytest

    from edgeproof.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "local-cluster[3,2,3000]", "yarn"):
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf)))


def test_sweep(spark):
    from edgeproof.llm.common import drop_cut, sweep, written

    before = written()
    a, b, c = (cut(spark.range(n), f"sweep{n}") for n in (1, 2, 3))
    drop_cut(a)
    assert len(written() - before) == 2
    sweep(spark, c, before)
    assert len(written() - before) == 1 and c.count() == 3
    sweep(spark, but=before)
    assert written() == before
