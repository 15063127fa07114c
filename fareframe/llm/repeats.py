"""Finds every window of fixed length that occurs twice in a corpus, from a sparse array of suffixes.

A window is WIDTH consecutive units (bytes or words) of one text. Its *anchor* is the GRAM-unit substring of least hash
in it, so equal windows have equal anchors at equal offsets, and one anchor serves a stretch of consecutive windows.
Only the suffixes at anchors are kept, one entry for about (WIDTH - GRAM) / 2 positions:

  key    hash of the anchor: the prefix by which suffixes are sorted and dealt out
  span   hash of all the text that the anchor's windows cover
  row    the text's 64-bit id;  at  first window and number of windows
  state  what the batch of texts at hand tells already: LONE, COPIED for one entry of several with equal key and span,
         DECIDED for the others of these

Neighbours in the order of (key, span) decide almost everything: equal spans are repeats as a whole. What is left are
keys with several spans, which is where repeated passages begin and end. For these the texts of one entry per span are
fetched and their windows compared one by one.

Entries that recur within one batch are repeats at once. Only one of them is dealt out by its key, so a key that a third
of all texts hold, or a text that repeats a few words over and over, sends few rows to the key's task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareframe.llm.arrays import Spans, byte_values, mix, ragged, text_buffers, text_chunks, words
from fareframe.llm.scratch import written

#: Entries with the same key that one task compares at once; keys with more are dealt out window by window.
GROUP_ROWS = 20_000
LONE, COPIED, DECIDED = 0, 1, 2
#: Added to the state of an entry that was scanned before, with all that were there then.
OLD = 4
_AT = 16  # bits for the number of windows in ``at``


@dataclass(frozen=True)
class Unit:
    """What windows are made of."""

    by_word: bool
    width: int
    gram: int

    def cut(self, data: np.ndarray, offs: np.ndarray):
        """Values, first unit of each document (length n + 1), byte starts and ends of the units."""
        if self.by_word:
            starts, ends, first = words(data, offs)
            return Spans(byte_values()[data])(starts, ends), first, starts, ends
        return byte_values()[data], offs, None, None


def _windows(values: np.ndarray, first: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of every anchor, in units; windows never cross documents."""
    n = len(values) - unit.width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    spans = Spans(values)
    at = np.arange(len(values) - unit.gram + 1)
    bits = np.uint64(max(20, int(len(values)).bit_length()))
    low = ((spans(at, at + unit.gram) >> bits) << bits) | at.astype(np.uint64)
    have, need = 1, unit.width - unit.gram + 1
    while have < need:  # least of a sliding range, by doubling
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    low = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(values) + 1, np.int64)
    sizes = np.diff(first)
    enough = sizes >= unit.width
    np.add.at(valid, first[:-1][enough], 1)
    np.add.at(valid, first[1:][enough] - unit.width + 1, -1)
    inside = np.flatnonzero(np.cumsum(valid[:n]))
    anchor = low[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)
    begin = np.flatnonzero(new)
    return anchor[begin], inside[begin], np.diff(np.append(begin, len(inside)))


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null as empty) and ``row``, the id of the pair."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def entries(docs: DataFrame, unit: Unit) -> DataFrame:
    """The sparse suffix entries (key, span, row, at, state) of ``identified`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in text_chunks(batches):
            values, first, _, _ = unit.cut(data, offs)
            anchor, start, count = _windows(values, first, unit)
            spans = Spans(values)
            key = spans(anchor, anchor + unit.gram)
            span = mix(spans(start, start + count - 1 + unit.width) + (anchor - start).astype(np.uint64))
            doc = np.searchsorted(first, start, side="right") - 1
            row = rows.column(rows.schema.get_field_index("row")).to_numpy(zero_copy_only=False)[doc]
            place = (start - first[doc]) << _AT | count
            _, one, which, times = np.unique(mix(key ^ mix(span)), return_index=True, return_inverse=True, return_counts=True)
            state = np.where(times[which] > 1, DECIDED, LONE).astype(np.int32)
            state[one[times > 1]] = COPIED
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), pa.array(row), pa.array(place), pa.array(state)],
                ["key", "span", "row", "at", "state"],
            )

    return docs.select("row", "text").mapInArrow(run, "key long, span long, row long, at long, state int")


def dealt(rows: DataFrame) -> DataFrame:
    """Entries by key, in the order of (key, span); decided ones anywhere."""
    place = F.when(F.col("state") == DECIDED, F.xxhash64("row", "at")).otherwise(F.col("key"))
    return rows.repartition(place).sortWithinPartitions("key", "span")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of (key, span): marks repeats, and one entry of each span where a key has several.

    kind 0: all its windows are repeats. kind 1: the entry of a span that occurs once, beside other spans of its key.
    kind 2: the same for a span that occurs more often, which is a repeat already. ``fresh`` is false for
    entries that were scanned before; one that copies in its own batch made a repeat isn't told again. Looks one row ahead
    and remembers two facts about the rows before, whatever the length of a group.
    """
    held, seen_before, other_before = None, False, False
    names = ["kind", "key", "row", "at", "fresh"]

    def out(kind: int, key: np.ndarray, row: np.ndarray, at: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(key), kind, np.int32))
        return pa.RecordBatch.from_arrays([kinds, pa.array(key), pa.array(row), pa.array(at), pa.array(state < OLD)], names)

    def decide(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, seen_before, other_before
        key, span, row, at, state = cols
        n = len(key)
        same_key = np.append(key[1:] == key[:-1], False)
        same = np.append((key[1:] == key[:-1]) & (span[1:] == span[:-1]), False)  # as the next row
        before = np.append(seen_before, same[:-1])  # as the row before
        # Does the key have another span before this row's span? True from its second span on.
        index = np.arange(n)
        key_start = np.maximum.accumulate(np.where(np.append(True, ~same_key[:-1]), index, 0))
        span_start = np.maximum.accumulate(np.where(np.append(True, ~same[:-1]), index, 0))
        other = (span_start > key_start) | ((key_start == 0) & other_before)
        done = n if last else n - 1
        if not last:
            held = [c[-1:] for c in cols]
        twice, copied = (before | same)[:done], (state % OLD == COPIED)[:done]
        repeat = twice | copied
        border = (~same & (other | same_key))[:done]
        for kind, pick in ((0, twice | copied & (state[:done] < OLD)), (1, border & ~repeat), (2, border & repeat)):
            yield out(kind, *(x[:done][pick] for x in (key, row, at, state)))
        if not last:
            seen_before, other_before = bool(before[-1]), bool(other[-1])

    for batch in batches:
        if batch.num_rows:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            known = cols[4] == DECIDED
            if known.any():
                yield out(0, *(cols[i][known] for i in (0, 2, 3, 4)))
                cols = [c[~known] for c in cols]
                if not len(cols[0]):
                    continue
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            yield from decide(cols, False)
    if held is not None:
        yield from decide(held, True)


def _window_hashes(data: np.ndarray, offs: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and place of every window of each text."""
    values, first, _, _ = unit.cut(data, offs)
    count = np.maximum(np.diff(first) - unit.width + 1, 0)
    start = ragged(first[:-1], count)
    doc = np.repeat(np.arange(len(count)), count)
    return Spans(values)(start, start + unit.width), doc, start - first[:-1][doc]


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows of one row, which stand in order, as (row, at)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    return row[begin], start[begin] << _AT | np.diff(np.append(begin, len(row)))


def _compare(unit: Unit):
    """Entries with their text in the order of the key: windows that occur twice under one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(rows: pa.RecordBatch) -> pa.RecordBatch:
            data, offs = text_buffers(rows.column(4))
            key, row, at = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            single = rows.column(3).to_numpy(zero_copy_only=False)
            tag, doc, place = _window_hashes(data, offs, unit)
            tag = mix(tag ^ key.view(np.uint64)[doc])
            order = np.argsort(tag, kind="stable")
            again = np.zeros(len(tag), bool)
            equal = tag[order][1:] == tag[order][:-1]
            again[order[1:][equal]] = True
            again[order[:-1][equal]] = True
            again &= single[doc]
            r, a = _runs(row[doc[again]], (at[doc[again]] >> _AT) + place[again])
            return pa.RecordBatch.from_arrays([pa.array(r), pa.array(a)], ["row", "at"])

        held = None
        for batch in batches:
            whole = batch if held is None else pa.concat_batches([held, batch])
            start = 0
            key = whole.column(0).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(key[1:] != key[:-1]) + 1
            while len(ends) and ends[-1] > start:  # whole keys, about 2000 entries at a time
                fit = ends[ends > start]
                end = int(max(fit[0], fit[np.searchsorted(fit, start + 2000, side="right") - 1]))
                yield groups(whole.slice(start, end - start))
                start = end
            held = whole.slice(start)
        if held is not None and held.num_rows:
            yield groups(held)

    return run


def _each_window(unit: Unit):
    """Every window of the entries as a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in text_chunks(batches, "part", 1 << 18):
            row, at = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            single = rows.column(3).to_numpy(zero_copy_only=False)
            tag, doc, place = _window_hashes(data, offs, unit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tag.view(np.int64)), pa.array(row[doc]), pa.array((at[doc] >> _AT) + place), pa.array(single[doc])], ["tag", "row", "start", "single"]
            )

    return run


def _parts(unit: Unit):
    """Cuts the texts that the asked entries cover out of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in text_chunks(batches):
            _, first, starts, ends = unit.cut(data, offs)
            raw = data.tobytes()
            key, row, at, single, part = [], [], [], [], []
            for i, (r, asked) in enumerate(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True)):
                for x in asked:
                    a = int(first[i]) + (x["at"] >> _AT)
                    b = a + (x["at"] & ((1 << _AT) - 1)) - 1 + unit.width
                    part.append(raw[starts[a] : ends[b - 1]] if unit.by_word else raw[a:b])
                    key.append(x["key"])
                    row.append(r)
                    at.append(x["at"])
                    single.append(x["kind"] == 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(row, pa.int64()), pa.array(at, pa.int64()), pa.array(single, pa.bool_()), pa.array(part, pa.binary())],
                ["key", "row", "at", "single", "part"],
            )

    return run


def scanned(rows: DataFrame, name: str) -> DataFrame:
    """What ``_scan`` tells of entries, given in any order."""
    return written(dealt(rows).mapInArrow(_scan, "kind int, key long, row long, at long, fresh boolean"), f"{name}-scan")


def scan(rows: DataFrame, docs: DataFrame, unit: Unit, name: str) -> list[DataFrame]:
    """(row, at) of repeated windows among entries, given in any order; ``docs`` holds their texts (``identified``)."""
    found = scanned(rows, name)
    return settled(found.where("kind = 0"), found.where("kind > 0"), docs, unit, name)


def touched(found: DataFrame) -> DataFrame:
    """The border entries of ``scanned`` rows whose key has a fresh one; the others were compared when the last came."""
    border = found.where("kind > 0")
    return border.join(border.where("fresh").select("key").distinct(), "key", "left_semi").select(found.columns)


def settled(whole: DataFrame, border: DataFrame, docs: DataFrame, unit: Unit, name: str) -> list[DataFrame]:
    """(row, at) of entries that are repeats as a whole and of repeated windows among border entries, each given once."""
    asked = border.groupBy("row").agg(F.collect_list(F.struct("key", "at", "kind")).alias("asked"))
    texts = docs.select("row", "text")
    schema = "key long, row long, at long, single boolean, part binary"
    parts = asked.join(texts, "row").select("row", "text", "asked").mapInArrow(_parts(unit), schema)
    crowded = border.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS).select("key")
    parts = written(parts, f"{name}-parts")
    few = parts.join(crowded, "key", "left_anti").select("key", "row", "at", "single", "part")
    few = few.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(unit), "row long, at long")
    many = parts.join(crowded, "key", "left_semi").select("key", "row", "at", "single", "part")
    many = many.mapInArrow(_each_window(unit), "tag long, row long, start long, single boolean")
    twice = many.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tag")
    many = many.where("single").join(twice, "tag", "left_semi")
    many = many.select("row", F.shiftleft(F.col("start"), _AT).bitwiseOR(F.lit(1).cast("long")).alias("at"))
    return [whole.select("row", "at"), few, many]


def covered(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` units some window of the ``at`` values covers."""
    start, count = at >> _AT, at & ((1 << _AT) - 1)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + count - 1 + width, -1)
    return np.cumsum(depth[:n]) > 0


def with_repeats(docs: DataFrame, found: list[DataFrame]) -> DataFrame:
    """``identified`` documents with ``at``: all repeated windows found of each, or null."""
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    hits = hits.groupBy("row").agg(F.collect_list("at").alias("at"))
    return docs.join(hits, "row", "left")
