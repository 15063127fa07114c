"""Removes repeated word passages, found at locally chosen grams of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareframe.llm.arrays import ragged, text_chunks
from fareframe.llm.repeats import Unit, covered, entries, identified, scan, with_repeats
from fareframe.llm.scratch import ship

WORDS = 35
UNIT = Unit(by_word=True, width=WORDS, gram=14)


def _strip(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in text_chunks(batches):
            _, first, starts, ends = unit.cut(data, offs)
            lists = rows.column(rows.schema.get_field_index("at")).to_pylist()
            counts = np.diff(first)
            removed, kept = [], []
            for i, at in enumerate(lists):
                s, e = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
                if at:
                    gone = covered(np.array(at, np.int64), len(s), unit.width)
                    s, e = s[~gone], e[~gone]
                removed.append(int(counts[i]) - len(s))
                # Each word and one byte after it; that byte becomes the blank.
                size = e - s
                out = np.full(int(size.sum()) + len(s), 0x20, np.uint8)
                out[ragged(np.cumsum(size + 1) - size - 1, size)] = data[ragged(s, size)]
                kept.append(out[:-1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def drop_repeated_words(docs: DataFrame, unit: Unit = UNIT) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words outside every repeated window, joined by one blank.

    Suffixes at locally chosen grams of words are dealt out by the gram's hash; a group that is too large for one task is
    split by the hash of the whole window. Within a group, neighbours that share a window are found by comparing hashes.
    This hash scan stands in place of a suffix tree: no letter order and no common prefix lengths are made.

    Words are runs of other characters than the six ASCII blanks, unchanged. Defined cases: null or blank text has no
    words; a text of fewer words loses nothing; rows that repeat, doc_id included, are copies of one another and go as
    such; rows without doc_id take part. Other columns are ignored. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    corpus = identified(docs)
    found = scan(entries(corpus, unit), corpus, unit, "substrings")
    rows = with_repeats(corpus, found).select("doc_id", "text", "at")
    return rows.mapInArrow(_strip(unit), "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """As ``drop_repeated_words``, with the SHA-256 of the kept words."""
    return drop_repeated_words(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
