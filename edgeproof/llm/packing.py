"""Token ids packed into fixed rows by best-fit decreasing.

Texts are tokenised and end with an end token. A document longer than a row is split losslessly:
whole rows, and a rest. Rests and short documents are packed, longest first, each into the open
row with the least room that still fits; a segment tree over room sizes finds it. Groups of
documents are packed where they were read, without a shuffle; a group is bounded by its tokens.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, scan, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW_TOKENS, GROUP_TOKENS = 2048, 2_000_000


class Rooms:
    """Open rows by room, with a segment tree that counts them over the rooms 0..size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and the row of least room >= need; it leaves the tree."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a right sibling has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], size: int) -> list[list[int]]:
    """Rows of piece numbers. Pieces of equal size keep their order."""
    rooms, rows = Rooms(size), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = rooms.take(sizes[i])
        if got is None:
            room, row = size, len(rows)
            rows.append([])
        else:
            room, row = got
        rows[row].append(i)
        if room > sizes[i]:
            rooms.add(room - sizes[i], row)
    return rows


def load_ranks(path: str) -> bytes:
    """The vocabulary file, read where the job starts: its size is a constant of the tokenizer."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), max(table.values()) + 1


def pack(documents: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row a packed sequence of row_tokens ids.

    ids and position_ids: row_tokens little-endian unsigned integers (dtype says which) of the
    tokens and of their places in their segment (positions start anew at 0 with each segment);
    cu_seqlens: 0 and the segments' cumulative lengths, the last one where padding begins; doc_ids
    and starts: each segment's document and the place of its first token in the document's tokens.
    The end token, also used as padding, is the first id after the vocabulary. Null and empty
    texts are one end token; null ids stay null; repeated rows are packed each time.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    state: dict = {}

    def run(batch):
        if "encode" not in state:
            state["encode"], state["end"] = _encoder(ranks.value)
        encode, end = state["encode"].encode_ordinary, state["end"]
        dtype = np.dtype("<u2") if max(end, row_tokens) <= 65535 else np.dtype("<u4")
        ids = column(batch, "doc_id").to_pylist()
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        for a, b in slices([len(t) // 2 + 1 for t in texts], group_tokens):
            tokens = [np.array([*encode(t), end], dtype=dtype) for t in texts[a:b]]
            pieces = [(i, s, min(row_tokens, len(t) - s)) for i, t in enumerate(tokens) for s in range(0, len(t), row_tokens)]
            rows = best_fit_decreasing([p[2] for p in pieces], row_tokens)
            for x in range(0, len(rows), 512):
                part = rows[x : x + 512]
                matrix = np.full((len(part), row_tokens), end, dtype)
                place = np.zeros((len(part), row_tokens), dtype)
                cu, doc, start = [], [], []
                for r, row in enumerate(part):
                    ends = [0]
                    for p in row:
                        i, s, n = pieces[p]
                        matrix[r, ends[-1] : ends[-1] + n] = tokens[i][s : s + n]
                        place[r, ends[-1] : ends[-1] + n] = np.arange(n)
                        ends.append(ends[-1] + n)
                    cu.append(ends)
                    doc.append([ids[a + pieces[p][0]] for p in row])
                    start.append([pieces[p][1] for p in row])
                yield {"dtype": pa.array([dtype.str[1:]] * len(part)), "ids": [m.tobytes() for m in matrix], "position_ids": [m.tobytes() for m in place], "cu_seqlens": cu, "doc_ids": doc, "starts": start}

    return scan(documents.select("doc_id", "text"), run, "dtype string, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, starts array<int>")


def write_packed(documents: DataFrame, path: str, **options) -> None:
    """Write packed rows as Parquet: the binary columns are the matrices' rows."""
    pack(documents, **options).write.parquet(path)


def unpack(rows: list[dict], vocabulary: str = VOCABULARY) -> dict:
    """doc_id -> text, from all rows of a packed table (a check of small tables)."""
    encoder, end = _encoder(load_ranks(vocabulary))
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], f"<{r['dtype']}")
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.setdefault(d, []).append((s, ids[a:b].tolist()))
    out = {}
    for d, x in parts.items():
        tokens = [t for _, p in sorted(x) for t in p]
        assert tokens[-1] == end
        out[d] = encoder.decode(tokens[:-1])
    return out
