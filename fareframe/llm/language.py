"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareframe.llm.arrays import mix, text_chunks
from fareframe.llm.pretokens import LETTER, classes, code_points
from fareframe.llm.scratch import extended, ship

DIM = 512
GRAM = 3
UNKNOWN = "und"
FOLDS = 5
_SCALE = 1 << 24
_BLOCK = 4096


@functools.cache
def _folded() -> np.ndarray:
    """Each code point's lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    at = np.flatnonzero(classes() == LETTER)
    out[at] = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in at.tolist()]
    return out


def letter_vectors(letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A random vector of +1 and -1 per letter, from its code point alone."""
    seeds = letters.astype(np.uint64)[:, None] * np.uint64(1 << 16) + np.arange(dim // 64, dtype=np.uint64)[None, :]
    bits = np.unpackbits(mix(seeds.ravel()).view(np.uint8)).reshape(len(letters), dim)
    return bits.astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Binds the letters of each n-gram: letter vectors, rotated by their place, multiplied."""
    letters = np.stack([(grams >> np.uint64(21 * k)) & np.uint64(0x1FFFFF) for k in range(GRAM)])
    known, which = np.unique(letters, return_inverse=True)
    base = letter_vectors(known, dim)
    which = which.reshape(letters.shape)
    out = base[which[0]]
    for k in range(1, GRAM):
        out = out * np.roll(base, k, axis=1)[which[k]]
    return out


def _numbered(letters: np.ndarray, m: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams, 21 bits a letter, and the number of each n-gram's own among them."""
    seen = np.zeros(0x110000, np.int64)
    seen[letters] = 1
    alphabet = np.flatnonzero(seen).astype(np.uint64)
    size = len(alphabet)
    if size**GRAM > 1 << 22:  # many scripts in one batch: by sorting
        gram = np.zeros(m, np.uint64)
        for k in range(GRAM):
            gram = (gram << np.uint64(21)) | letters[k : m + k]
        return np.unique(gram[whole], return_inverse=True)
    seen = np.cumsum(seen) - 1
    small = seen[letters]
    code = small[:m]
    for k in range(1, GRAM):
        code = code * size + small[k : m + k]
    code = code[whole]
    there = np.zeros(size**GRAM, np.int32)
    there[code] = 1
    codes = np.flatnonzero(there)
    known, rest = np.zeros(len(codes), np.uint64), codes
    for k in range(GRAM):
        known |= alphabet[rest % size] << np.uint64(21 * k)
        rest = rest // size
    return known, (np.cumsum(there) - 1)[code]


def document_vectors(data: np.ndarray, offs: np.ndarray, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The bundle (sum of n-gram vectors) of each document, and whether it has letters.

    Letters are lower-cased; any run of other characters, and either end of the text, is one blank.
    """
    n = len(offs) - 1
    cp, lead = code_points(data)
    cuts = np.searchsorted(lead, offs)
    letters = np.zeros(len(cp) + 2 * n, np.uint32)  # a blank at both ends of each text
    doc = np.repeat(np.arange(n), np.diff(cuts))
    letters[np.arange(len(cp)) + 2 * doc + 1] = _folded()[cp]
    owner = np.repeat(np.arange(n), np.diff(cuts) + 2)
    keep = letters != 0
    keep[1:] |= (letters[:-1] != 0) | (owner[1:] != owner[:-1])
    keep[:1] = True
    letters, owner = letters[keep].astype(np.uint64), owner[keep]
    has = np.zeros(n, bool)
    has[owner[letters != 0]] = True
    out = np.zeros((n, dim), np.float32)
    if len(letters) < GRAM:
        return out, has
    m = len(letters) - GRAM + 1
    whole = owner[:m] == owner[GRAM - 1 :]
    known, which = _numbered(letters, m, whole)
    owner = owner[:m][whole]
    order = np.argsort(which // _BLOCK, kind="stable") if len(known) > _BLOCK else slice(None)
    which, owner = which[order], owner[order]
    bounds = np.searchsorted(which // _BLOCK, np.arange(len(known) // _BLOCK + 2)) if len(known) > _BLOCK else [0, len(which)]
    for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        part = known[b * _BLOCK : (b + 1) * _BLOCK]
        if not len(part) or lo == hi:
            continue
        vectors = gram_vectors(part, dim).astype(np.float32)
        for a in range(0, n, 512):
            z = min(n, a + 512)
            mine = (owner[lo:hi] >= a) & (owner[lo:hi] < z)
            cell = (owner[lo:hi][mine] - a) * len(part) + (which[lo:hi][mine] - b * _BLOCK)
            counts = np.bincount(cell, minlength=(z - a) * len(part)).reshape(z - a, len(part))
            out[a:z] += counts.astype(np.float32) @ vectors
    return out, has


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Profiles:
    """Language names in order, and one unit vector each."""

    languages: tuple[str, ...]
    vectors: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, dim: int = DIM) -> Profiles:
    """Bundles the unit vectors of all labelled documents (``text``, ``lang``) into one profile per language.

    Every task adds up its documents in whole numbers, so the sums do not depend on the order; one row per task,
    language and dimension is combined in Spark. The driver receives one vector per language. Rows with a null text or
    lang, or without letters, teach nothing.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"]
            )

        for rows, data, offs in text_chunks(batches):
            vectors, has = document_vectors(data, offs, dim)
            whole = np.rint(_unit(vectors) * _SCALE).astype(np.int64)
            langs = np.array(rows.column(1).to_pylist(), object)
            for lang in set(langs[has]):
                sums[lang] = sums.get(lang, 0) + whole[has & (langs == lang)].sum(axis=0)
            if len(sums) > 256:
                yield out()
                sums.clear()
        yield out()

    sums = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, v array<long>")
    sums = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    vectors = np.array([[x["x"] for x in r["v"]] for r in rows], np.float64).reshape(len(rows), dim if rows else 0)
    return Profiles(tuple(r["lang"] for r in rows), _unit(vectors).astype(np.float32) if rows else vectors)


def predict(docs: DataFrame, profiles: Profiles, column: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``: the language of the nearest profile, and the cosine with it (0 at least).

    Null text, text without letters, and any text if nothing was learned, are ``und`` with score 0. A tie goes to the
    first language in order. Existing columns of these names are replaced, all others stay.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast((profiles.languages, profiles.vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, vectors = model.value
        for rows, data, offs in text_chunks(batches, column):
            n = len(offs) - 1
            best, score, has = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            if languages:
                bundle, has = document_vectors(data, offs, vectors.shape[1])
                cosine = _unit(bundle) @ vectors.T
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(n), best].astype(np.float64), 0.0, 1.0) * has
            names = [languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*rows.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, extended(docs, "lang_pred string, score double"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learned from the labelled rows that are not held out.

    A row without doc_id is not held out. Rows that repeat a doc_id each get their row; other columns are ignored. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")
