"""Exact byte-level duplicates across a corpus that arrives in batches, over a logarithmic family of suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareframe.llm.arrays import text_chunks
from fareframe.llm.repeats import DECIDED, OLD, Unit, covered, dealt, entries, identified, scanned, settled, touched, with_repeats
from fareframe.llm.scratch import ship, written

LENGTH = 200
UNIT = Unit(by_word=False, width=LENGTH, gram=64)
#: Batches into which one corpus is cut. Each batch adds a level; more batches need less space at once, but read more.
#: From three on, levels are merged; the fourth is scanned with levels of two sizes.
BATCHES = 4


class SuffixLevels:
    """Sorted sparse suffix arrays of sizes in geometric progression.

    A new batch gets its own array, which is merge-scanned together with all levels for long matches, in either. Then
    it becomes a level; as long as the two last levels hold equally many batches, they are merged into one.
    """

    def __init__(self, unit: Unit = UNIT, name: str = "suffix-level"):
        self.unit, self.name = unit, name
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame, corpus: DataFrame, last: bool = False) -> list[DataFrame]:
        """Repeated windows that the batch brings, its own and the levels'. ``corpus`` holds all texts so far, the
        batch's included. With ``last`` the batch is scanned but not kept.
        """
        found = self.index(batch, last)
        return settled(found.where("kind = 0"), touched(found), corpus, self.unit, self.name)

    def index(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """The merge-scan of the batch and all levels (``scanned``), after which the batch is a level, unless ``last``."""
        new = entries(batch, self.unit)
        if not last:
            new = written(dealt(new), self.name)
        together = new
        for _, level in self.levels:
            together = together.unionByName(level.withColumn("state", F.col("state") + OLD))
        found = scanned(together, self.name)
        if not last:
            self.levels.append((1, new.where(F.col("state") != DECIDED)))
            self._merge()
        return found

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((n + m, written(dealt(a.unionByName(b)), self.name)))


def _strip(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in text_chunks(batches):
            lists = rows.column(rows.schema.get_field_index("at")).to_pylist()
            n_bytes, removed, spans, kept = np.diff(offs), [], [], []
            for i, at in enumerate(lists):
                text = data[offs[i] : offs[i + 1]]
                if at:
                    gone = covered(np.array(at, np.int64), len(text), width)
                    removed.append(int(gone.sum()))
                    spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]))
                    text = text[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(text.tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def drop_repeated_bytes(docs: DataFrame, unit: Unit = UNIT, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): texts without bytes of any ``unit.width``-byte repeat.

    A byte goes if a string of that length that covers it starts anywhere else too, in any document or the same one.
    All is judged on the input. ``kept`` need not be valid UTF-8, since repeats may begin within a character.

    Defined cases: null text is empty; a text shorter than the length loses nothing; rows that repeat, doc_id included,
    are copies of one another and go as such; rows without doc_id take part. Other columns are ignored. An empty table
    gives an empty result.
    """
    if batches < 1:
        raise ValueError("a corpus makes one batch at least")
    ship(docs.sparkSession)
    corpus = identified(docs)
    family = SuffixLevels(unit)
    whole, border = [], []
    for b in range(batches):
        batch = corpus.where(F.pmod("row", F.lit(batches)) == b) if batches > 1 else corpus
        found = family.index(batch, last=b == batches - 1)
        whole.append(found.where("kind = 0").select("row", "at"))
        border.append(touched(found) if b else found.where("kind > 0"))
    # An entry may stand at the border in several scans: texts are fetched, and windows compared, once for all.
    once = reduce(DataFrame.unionByName, border).groupBy("key", "row", "at").agg(F.max("kind").alias("kind"))
    found = settled(reduce(DataFrame.unionByName, whole), once, corpus, unit, family.name)
    rows = with_repeats(corpus, found).select("doc_id", "text", "at")
    return rows.mapInArrow(_strip(unit.width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """As ``drop_repeated_bytes``, with the SHA-256 of what is kept instead of its bytes."""
    out = drop_repeated_bytes(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

