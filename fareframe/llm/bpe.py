"""Byte-level BPE: encoding, decoding and token offsets of whole texts."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareframe.llm.arrays import ragged, same_pieces, text_chunks
from fareframe.llm.pretokens import pieces
from fareframe.llm.scratch import extended, ship

#: Pieces, and bytes of pieces and ids, that a worker remembers; beyond either it starts anew.
CACHED_PIECES = 200_000
CACHED_BYTES = 8 << 20


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the adjacent pair of lowest rank is joined, leftmost first, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Coder:
    """One vocabulary: encodes and decodes concatenated documents with arrays."""

    def __init__(self, table: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, i in self.ranks.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[bytes, bytes] = {}  # piece -> ids, as 32-bit integers
        self.held = 0

    def _ids(self, piece: bytes) -> bytes:
        got = self.known.get(piece)
        if got is None:
            if len(self.known) >= CACHED_PIECES or self.held > CACHED_BYTES:
                self.known.clear()
                self.held = 0
            got = self.known[piece] = np.array(merge(piece, self.ranks), np.uint32).tobytes()
            self.held += len(piece) + len(got)
        return got

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first id of each document (length n + 1)."""
        starts, ends, first = pieces(data, offs)
        at, which = same_pieces(data, starts, ends)
        raw = data.tobytes()
        found = [self._ids(raw[s:e]) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        size = np.array([len(x) // 4 for x in found], np.int64)
        flat = np.frombuffer(b"".join(found), np.uint32)
        begin = np.cumsum(size) - size
        count = size[which]
        cuts = np.concatenate([[0], np.cumsum(count)])[first]
        return flat[ragged(begin[which], count)], cuts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and each id's byte offset (length n + 1)."""
        n = self.lengths[ids]
        return self.bytes[ragged(self.starts[ids], n)], np.concatenate([[0], np.cumsum(n)])


@functools.lru_cache(maxsize=4)
def coder(table: bytes) -> Coder:
    return Coder(table)


def vocabulary(spark: SparkSession, path: str):
    """The rank file as a broadcast of fixed size; only the driver needs the file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts_first(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.col("text").cast("string"))


def encode(docs: DataFrame, path: str, offsets: bool = True, proof: str | None = None) -> DataFrame:
    """The rows with ``ids`` (array<int>) and ``offsets`` (array<int>: the byte at which each token starts).

    Null text has null ids and offsets, empty text empty ones. All other columns stay; existing columns ``ids`` and
    ``offsets`` are replaced. Without ``offsets`` only the ids are added. ``proof`` names a further column for the
    SHA-256 (lowercase hex) of the bytes that the ids decode to, taken in the same pass; null for null text.
    """
    ship(docs.sparkSession)
    docs = _texts_first(docs.drop("ids", "offsets", *([proof] if proof else [])))
    added = ["ids", "offsets"] if offsets else ["ids"]
    schema = extended(docs, ", ".join([f"{c} array<int>" for c in added] + ([f"`{proof}` string"] if proof else [])))
    table = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(table.value)
        for rows, data, offs in text_chunks(batches):
            ids, cuts = c.encode(data, offs)
            null = rows.column(rows.schema.get_field_index("text")).is_null().to_numpy(zero_copy_only=False)
            values = [ids.astype(np.int32)]
            if offsets:
                n = c.lengths[ids]
                values.append((np.cumsum(n) - n - np.repeat(offs[:-1], np.diff(cuts))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v, pa.int32()), mask=pa.array(null)) for v in values]
            if proof:
                back, where = c.decode(ids)
                sums = [hashlib.sha256(back[where[a] : where[b]].tobytes()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                lists.append(pa.array(sums, pa.string(), mask=null))
            names = [*rows.schema.names, *added, *([proof] if proof else [])]
            yield pa.RecordBatch.from_arrays([*rows.columns, *lists], names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded`` (binary) from ``ids``; null ids give null."""
    ship(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    table = vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(table.value)
        for rows in batches:
            lists = rows.column(rows.schema.get_field_index("ids"))
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            out: list[bytes | None] = []
            for i in range(0, len(lists), 256):
                part = lists.slice(i, 256)
                back, where = c.decode(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                ends = where[cuts[i : i + len(part) + 1] - cuts[i]]
                raw = back.tobytes()
                out += [raw[a:b] if x else None for x, a, b in zip(part.is_valid().to_pylist(), ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], [*rows.schema.names, "decoded"])

    return encoded.mapInArrow(run, extended(encoded, "decoded binary"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, each row in one pass: encoded, then decoded from its ids.

    Null text counts as empty: no tokens, and the digests of nothing. Rows that repeat a doc_id each get their row.
    Other columns are ignored.
    """
    ship(docs.sparkSession)
    table = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(table.value)
        for rows, data, offs in text_chunks(batches):
            ids, cuts = c.encode(data, offs)
            back, where = c.decode(ids)
            sha: Callable[[np.ndarray], str] = lambda v: hashlib.sha256(v.tobytes()).hexdigest()
            ids = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.array([sha(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()),
                    pa.array([sha(back[where[a] : where[b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = _texts_first(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
