"""Token counts by greedy longest match: a linear automaton that never builds the pieces."""

from __future__ import annotations

import base64
import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareframe.llm.arrays import same_pieces, text_chunks
from fareframe.llm.bpe import CACHED_PIECES, vocabulary
from fareframe.llm.pretokens import pieces
from fareframe.llm.scratch import ship


class Automaton:
    """A trie of the vocabulary whose nodes know where to go on a mismatch and how many tokens that completes.

    ``fail[v]`` is the node of what is left of v's string once its longest-match tokens are taken off its front, as far
    as needed to go on; ``popped[v]`` counts those tokens. Each byte moves down once, so a piece takes linear time.
    """

    def __init__(self, tokens: set[bytes]):
        self.next: list[dict[int, int]] = [{}]
        token = [False]
        for t in tokens:
            v = 0
            for c in t:
                u = self.next[v].get(c)
                if u is None:
                    u = self.next[v][c] = len(self.next)
                    self.next.append({})
                    token.append(False)
                v = u
            token[v] = bool(t)
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for c, u in self.next[v].items():
                queue.append(u)
                if token[u]:
                    self.fail[u], self.popped[u] = 0, 1
                    continue
                z, count = self.fail[v], self.popped[v]
                while z >= 0 and c not in self.next[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[u], self.popped[u] = self.next[z][c], count

    def count(self, piece: bytes) -> int:
        """Tokens of the greedy longest match, or -1 where some byte cannot be covered."""
        v = total = 0
        for c in piece:
            while c not in self.next[v]:
                if self.fail[v] < 0:
                    return -1
                total += self.popped[v]
                v = self.fail[v]
            v = self.next[v][c]
        while v:
            if self.fail[v] < 0:
                return -1
            total += self.popped[v]
            v = self.fail[v]
        return total


@functools.lru_cache(maxsize=4)
def automaton(table: bytes) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton({base64.b64decode(line.split()[0]) for line in table.splitlines()}), {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_tokens: pre-tokens of each whole text, and the tokens of their greedy longest match.

    A worker counts each different pre-token once (up to a fixed number that it remembers). Null text counts as empty:
    zero of both. A pre-token that the vocabulary cannot cover makes ``n_tokens`` null; the given byte-level
    vocabularies cover every text. Rows that repeat a doc_id each get their row. Other columns are ignored.
    """
    ship(docs.sparkSession)
    table = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, known = automaton(table.value)
        for rows, data, offs in text_chunks(batches):
            starts, ends, first = pieces(data, offs)
            at, which = same_pieces(data, starts, ends)
            raw = data.tobytes()
            if len(known) > CACHED_PIECES:
                known.clear()
            size = np.zeros(len(at), np.int64)
            for k, (s, e) in enumerate(zip(starts[at].tolist(), ends[at].tolist(), strict=True)):
                piece = raw[s:e]
                n = known.get(piece)
                if n is None:
                    n = known[piece] = auto.count(piece)
                size[k] = n
            per = size[which]
            total = np.diff(np.concatenate([[0], np.cumsum(per)])[first])
            bad = np.diff(np.concatenate([[0], np.cumsum(per < 0)])[first]) > 0
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(first), pa.int64()), pa.array(total, pa.int64(), mask=bad)],
                ["doc_id", "n_pieces", "n_tokens"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_pieces long, n_tokens long")
