"""Helpers shared by the training-data operators: tables, durable cuts, words and hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: list[str] = []
#: Folders written so far, for sweep.
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a temporary one if all run in this
    process (tests); on a cluster that is an error, as every machine would write to its own."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="edgeproof-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which sweep will delete."""
    path = f"{shared_dir(spark)}/edgeproof/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends in replicated files.

    Unlike a local checkpoint this survives lost executors, and later readers prune columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    out = df.coalesce(partitions) if partitions else df
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def folder(df: DataFrame) -> str | None:
    """The folder that a cut was written to."""
    return next((f for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()} if "/edgeproof/" in f), None)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut that nothing reads any more."""
    tail = (folder(df) or "/").rsplit("/", 1)[1]
    for path in [x for x in _WRITTEN if tail and x.endswith("/" + tail)]:
        _delete(df.sparkSession, path)


def written() -> frozenset[str]:
    """The folders of this session's cuts and archives."""
    return frozenset(_WRITTEN)


def sweep(spark: SparkSession, keep: DataFrame | None = None, but: frozenset[str] = frozenset()) -> None:
    """Delete the cuts and archives of this session, but for keep and those named, when every frame made
    of them has been used: between the stages of a pipeline, and after a query's result is written."""
    tail = (folder(keep) or "/").rsplit("/", 1)[1] if keep is not None else ""
    for path in [x for x in _WRITTEN if x not in but and not (tail and x.endswith("/" + tail))]:
        _delete(spark, path)


def scan(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str) -> DataFrame:
    """mapInArrow where fn turns one record batch into a dict of columns (or several dicts)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    df.sparkSession  # an active session is needed to parse the schema
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            got = fn(batch)
            for cols in [got] if isinstance(got, dict) else got or ():
                arrays = [x if isinstance(x := cols[f.name], pa.Array) else pa.array(x, type=f.type) for f in target]
                arrays = [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a run of items into spans of about limit in total size; an item is never cut."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str]]]:
    """Spans of a text column of about limit bytes each, with their texts (null as empty): only one
    span's texts stand in Python at a time."""
    data = texts.cast(pa.binary())
    for a, b in slices(pc.fill_null(pc.binary_length(data), 0).to_pylist(), limit):
        yield a, b, [(t or b"").decode("utf-8", "replace") for t in data.slice(a, b - a).to_pylist()]


def hash_words(words: list[bytes]) -> np.ndarray:
    """A fixed 64-bit hash of each word (the same in every process)."""
    if not words:
        return np.zeros(0, np.uint64)
    values = np.empty(len(words), dtype=object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)


def token_batch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of the texts, and each text's number of words."""
    split = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    return hash_words([w for s in split for w in s]), counts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def bucket_of(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; null ids fall in no bucket."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each count, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """One 0/1 label a document: null labels and ids go; of contradicting repeats the larger stays."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy("doc_id").agg(F.max(F.col(name).cast("int")).alias("label"))
