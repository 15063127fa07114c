"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareframe.llm.arrays import Spans, mix, text_chunks
from fareframe.llm.minhash import signatures
from fareframe.llm.pretokens import code_points
from fareframe.llm.scratch import ship, written

LEVELS = 4
#: The first level whose phrases are compared: about 30 characters long on average.
FROM_LEVEL = 3
REGISTERS = 64


@functools.cache
def _toss_table(size: int) -> np.ndarray:
    """For two different labels below ``size``: twice the lowest bit in which they differ, plus the first one's bit."""
    a, b = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    low = (a ^ b) & -(a ^ b)
    place = np.log2(np.maximum(low, 1)).astype(int)
    return (2 * place + ((a >> place) & 1)).astype(np.uint8).ravel()


def toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, different for neighbours, that depend on a symbol and the four before it only.

    Each round keeps, of a symbol and its left neighbour, where they first differ and which way. ``first`` marks the
    symbols without a left neighbour.
    """
    d = np.ones(len(symbols), np.uint64)
    d[1:] = symbols[1:] ^ symbols[:-1]
    d[first] = 1
    low = d & (~d + np.uint64(1))
    place = (low.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)
    label = (np.uint64(2) * place + ((symbols >> place) & np.uint64(1))).astype(np.uint8)
    for size in (128, 16, 8):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ 1
        label = _toss_table(size)[label.astype(np.int32) * size + left]
    return label


def parse(symbols: np.ndarray, owner_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up: names of the phrases and marks of each document's first phrase.

    Runs of one symbol become one symbol first. A phrase starts where the label is larger than both neighbours', so
    equal stretches of text are cut alike except within a few symbols of their ends, wherever they stand.
    """
    change = np.ones(len(symbols), bool)
    change[1:] = (symbols[1:] != symbols[:-1]) | owner_first[1:]
    at = np.flatnonzero(change)
    if len(at) < len(symbols):
        length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
        one = symbols[at]
        symbols = np.where(length > 1, mix(one ^ (length << np.uint64(40))), one)
        owner_first = owner_first[at]
    label = toss(symbols, owner_first)
    start = owner_first.copy()
    start[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~owner_first[2:]
    begin = np.flatnonzero(start)
    return Spans(mix(symbols))(begin, np.append(begin[1:], len(symbols))), owner_first[begin]


def phrase_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The distinct phrase names of each text from FROM_LEVEL to LEVELS; an empty text has none."""
    cp, lead = code_points(data)
    cuts = np.searchsorted(lead, offs)
    filled = np.flatnonzero(np.diff(cuts))
    n = len(offs) - 1
    out = [np.zeros(0, np.uint64)] * n
    if not len(filled):
        return out
    first = np.zeros(len(cp), bool)
    first[cuts[filled]] = True
    names, owner = [], []
    symbols = cp.astype(np.uint64)
    for level in range(1, LEVELS + 1):
        symbols, first = parse(symbols, first)
        if level >= FROM_LEVEL:
            names.append(mix(symbols + np.uint64(level)))
            owner.append(filled[np.cumsum(first) - 1])
    names, owner = np.concatenate(names), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(n + 1))
    for i in filled:
        out[i] = np.unique(names[order[bounds[i] : bounds[i + 1]]])
    return out


def fingerprints(data: np.ndarray, offs: np.ndarray) -> list[str]:
    """Hex registers of each text's phrase set; an empty text's fingerprint is empty."""
    sets = phrase_sets(data, offs)
    return [g.tobytes().hex() if len(s) else "" for s, g in zip(sets, signatures(sets, REGISTERS), strict=True)]


def likeness(a: str, b: str) -> float:
    """The estimated share of phrases in common (2 * intersection / sum of sizes); two empty texts are alike."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(v), np.uint16) for v in (a, b))
    j = float((x == y).mean())
    return 2 * j / (1 + j)


def _edit(text: bytes, after: bytes) -> tuple[int, bytes]:
    """Code points of ``text``, and its bytes with the last quarter replaced by the start of ``after``."""
    lead = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    n = len(lead)
    k = n // 4
    if k == 0:
        return n, text
    # The first k characters take at most 4k bytes.
    ahead = np.flatnonzero((np.frombuffer(after, np.uint8, min(len(after), 4 * k + 4)) & 0xC0) != 0x80)
    return n, text[: lead[n - k]] + (after[: ahead[k]] if len(ahead) > k else after)


def _compare(ids: list, texts: list[bytes], afters: list[bytes], prints: list[str], after_prints: list[str]) -> list[pa.Array]:
    edits = [_edit(t, a) for t, a in zip(texts, afters, strict=True)]
    edited = []
    i = 0
    while i < len(edits):  # about a megabyte at a time
        j, size = i, 0
        while j < len(edits) and (j == i or size + len(edits[j][1]) <= 1 << 20):
            size += len(edits[j][1])
            j += 1
        part = [e for _, e in edits[i:j]]
        edited += fingerprints(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in part])]))
        i = j
    return [
        pa.array(ids, pa.int64()),
        pa.array([n for n, _ in edits], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for _, e in edits], pa.string()),
        pa.array(prints, pa.string()),
        pa.array(edited, pa.string()),
        pa.array([likeness(a, b) for a, b in zip(prints, edited, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(prints, after_prints, strict=True)], pa.float64()),
    ]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order: results of all but the task's last one; the first and the last one's texts beside them."""
    pid = TaskContext.get().partitionId()

    def rows(cols: list[pa.Array], kind: int, texts: list) -> pa.RecordBatch:
        n = len(cols[0])
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array([kind] * n, pa.int32()), pa.array([pid] * n, pa.int64()), pa.array(texts, pa.binary())], [*_NAMES, "kind", "pid", "text"]
        )

    def edge(kind: int, doc_id: int | None, text: bytes, fp: str) -> pa.RecordBatch:
        cols = [pa.array([doc_id], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([fp]), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
        return rows(cols, kind, [text])

    held = None
    for part, data, offs in text_chunks(batches):
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        ids, prints = part.column(0).to_pylist(), fingerprints(data, offs)
        if held is None:
            yield edge(1, ids[0], texts[0], prints[0])
        else:
            ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
        if len(ids) > 1:
            yield rows(_compare(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:]), 0, [None] * (len(ids) - 1))
        held = ids[-1], texts[-1], prints[-1]
    if held is not None:
        yield edge(2, *held)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        yield pa.RecordBatch.from_arrays(_compare(cols[0], cols[1], cols[3], cols[2], cols[4]), _NAMES)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; see ``_RESULT`` for the columns.

    The edited text has the last quarter of the characters replaced by as many (or all) from the start of the next
    document in the order of doc_id; the last document is followed by the first.

    Documents are dealt out by ranges of doc_id and stream through each task in order, every one beside its successor.
    The successor of a task's last document is the first of the next task that has any: one text per task is joined
    for it afterwards.

    Defined cases: null text is empty: 0 characters, an empty fingerprint, likeness 1 to another empty text and 0 to
    any other; rows that repeat a doc_id stand in the order of their texts and each get a row; rows without doc_id come
    first; a single document is its own successor. Other columns are ignored. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    streamed = written(ordered.mapInArrow(_stream, _RESULT + ", kind int, pid long, text binary"), "fingerprints")
    # One row per task, without texts: which task comes after which.
    heads = streamed.where("kind = 1").select("pid")
    turn = Window.orderBy("pid")
    after = heads.withColumn("next", F.coalesce(F.lead("pid").over(turn), F.min("pid").over(Window.partitionBy())))
    first = streamed.where("kind = 1").select(F.col("pid").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    last = streamed.where("kind = 2").select("pid", "doc_id", "text", "fingerprint")
    joined = last.join(after, "pid").join(first, "next").select("doc_id", "text", "fingerprint", "next_text", "next_fp")
    return streamed.where("kind = 0").select(*_NAMES).unionByName(joined.mapInArrow(_edges, _RESULT))
