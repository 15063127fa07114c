"""Phrase collocations per language: best-first branch and bound over phrases, each wave counted in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareframe.llm.arrays import Spans, mix, text_buffers
from fareframe.llm.scratch import ship, written

LEAST = 100
LONGEST = 5
COUNTED = "lang string, phrase string, length int, f long, right boolean"
NODE = ["lang", "phrase", "length", "f", "n", "reached", "grown", "looked", "best", "missing", "state"]
TOP = 2000
UNKNOWN = "und"
#: Occurrences of the words opened first, as a share of the words of a language.
FIRST_SHARE = 0.25
CHUNK_BYTES = 4 << 20
SALTS = 64
#: Bits of the filter in front of the exact join: 16 a member within these, so 16 MB at most.
LEAST_BITS, MOST_BITS = 16, 27

FREQUENT, RIGHT, LEFT, EXACT, ACTIVE = range(5)
_KIND = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?\n\x0b\x0c\r"]] = True
#: 0 in words, 1 between them, 2 between pieces.
_KINDS = _CUT.astype(np.uint8) * np.uint8(2)
_KINDS[[0x20, 0x09]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]


# --- inside a task -------------------------------------------------------------------------------------------------


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(bytes, offsets, languages) of about ``CHUNK_BYTES``; a longer text is cut after a character that ends a piece."""
    for batch in batches:
        data, offs = text_buffers(batch.column("text"))
        langs, i = batch.column("lang"), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK_BYTES, side="right")) - 1)
            a, b = int(offs[i]), int(offs[j])
            while j == i + 1 and b - a > CHUNK_BYTES:
                ends = np.flatnonzero(_CUT[data[a : a + CHUNK_BYTES]])
                if not len(ends):
                    ends = np.flatnonzero(_CUT[data[a:b]])[:1]
                if not len(ends):
                    break
                to = a + int(ends[-1]) + 1
                yield data[a:to], np.array([0, to - a]), langs.slice(i, 1)
                a = to
            yield data[a:b], offs[i : j + 1] - a if j > i + 1 else np.array([0, b - a]), langs.slice(i, j - i)
            i = j


class _Words:
    """The words of a segment, numbered per language by an exact dictionary."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: pa.Array):
        data = _LOWER[data]
        kind = _KINDS[data]
        ink = kind == 0
        cut = np.zeros(len(data) + 1, bool)
        cut[offs] = True
        first = ink.copy()
        first[1:] &= ~ink[:-1] | cut[1:-1]
        last = ink.copy()
        last[:-1] &= ~ink[1:] | cut[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.n = n = len(starts)
        doc = np.repeat(np.arange(len(langs)), np.diff(np.searchsorted(starts, offs)))
        # A piece starts at the first word after a character that ends one, and with each text.
        new = np.zeros(n + 1, bool)
        new[np.searchsorted(starts, np.flatnonzero(kind == 2))] = True
        new[np.searchsorted(starts, offs)] = True
        stops = np.append(np.flatnonzero(new[1:n]) + 1, n)
        self.room = np.repeat(stops, np.diff(stops, prepend=0)) - np.arange(n)
        ends_at = np.zeros(n + 1, np.int64)
        np.cumsum(ends - starts, out=ends_at[1:])
        column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends_at.tobytes()), pa.py_buffer(data[ink].tobytes())])
        coded = column.dictionary_encode()
        self.dictionary = coded.dictionary.cast(pa.binary())
        spoken = langs.dictionary_encode()
        self.langs = spoken.dictionary
        size = max(1, len(self.dictionary))
        both = np.asarray(spoken.indices).astype(np.int64)[doc] * size + np.asarray(coded.indices) if n else np.zeros(0, np.int64)
        self.ids, kinds = pd.factorize(both)
        self.word, self.lang = kinds % size, kinds // size

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the language and the word of each id."""
        return _text_hashes(self.langs)[self.lang], _text_hashes(self.dictionary)[self.word]

    def rows(self, at: np.ndarray, length: int, counts: np.ndarray, right: bool = True) -> pa.RecordBatch:
        """Phrases of ``length`` words at the positions, with their counts; ``right`` if they extend a member."""
        parts = [self.dictionary.take(pa.array(self.word[self.ids[at + k]])) for k in range(length)]
        phrase = pc.binary_join_element_wise(*parts, b" ") if length > 1 else parts[0]
        lang = self.langs.take(pa.array(self.lang[self.ids[at]]))
        columns = [lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(at), length, np.int32)), pa.array(counts)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), right))], names=["lang", "phrase", "length", "f", "right"])


def _text_hashes(column: pa.Array) -> np.ndarray:
    data, offs = text_buffers(column)
    return Spans(data.astype(np.uint64) + np.uint64(1))(offs[:-1], offs[1:])


def _start(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(lang) + word)


def _bit(h: np.ndarray, kind: int, size: int) -> np.ndarray:
    return mix(h ^ _KIND[kind]) >> np.uint64(64 - size)


def _holds(bits: np.ndarray, h: np.ndarray, kind: int, size: int) -> np.ndarray:
    at = _bit(h, kind, size)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _grouped(ids: np.ndarray, at: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One position and the count of each different phrase at the positions."""
    codes = ids[at]
    for k in range(1, length):
        codes, _ = pd.factorize(codes * size + ids[at + k])
    codes, kinds = pd.factorize(codes)
    one = np.empty(len(kinds), np.int64)
    one[codes] = at
    return one, np.bincount(codes, minlength=len(kinds))


def _single_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for segment in _segments(batches):
        w = _Words(*segment)
        if w.n:
            yield w.rows(*_grouped(w.ids, np.arange(w.n), 1, 1)[:1], 1, np.bincount(w.ids))


def _phrases(filter_, size: int, lengths: dict[int, set[int]]):
    """Counts of the phrases that extend a member on the right or left by a frequent word, or are asked for themselves."""
    most = max([*(n + 1 for n in lengths[RIGHT] | lengths[LEFT]), *lengths[EXACT]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for segment in _segments(_spoken(b, bits, size) for b in batches):
            w = _Words(*segment)
            if not w.n:
                continue
            lang, word = w.hashes()
            of_id = _start(lang, word)
            frequent = _holds(bits, of_id, FREQUENT, size)[w.ids]
            h, at = of_id[w.ids], np.flatnonzero(frequent)
            for length in range(2, most + 1):
                at = at[w.room[at] >= length]
                at = at[frequent[at + length - 1]]
                longer = np.zeros(w.n, np.uint64)
                longer[at] = mix(h[at] + word[w.ids[at + length - 1]])
                wanted, right = np.zeros(len(at), bool), np.zeros(len(at), bool)
                if length - 1 in lengths[RIGHT]:
                    right = _holds(bits, of_id, RIGHT, size)[w.ids[at]] if length == 2 else _holds(bits, h[at], RIGHT, size)
                if length - 1 in lengths[LEFT]:
                    wanted |= _holds(bits, h[at + 1], LEFT, size)
                if length in lengths[EXACT]:
                    wanted |= _holds(bits, longer[at], EXACT, size)
                for mask, grows in ((right, True), (wanted & ~right, False)):
                    if mask.any():
                        one, counts = _grouped(w.ids, at[mask], length, len(w.word))
                        yield w.rows(one, length, counts, grows)
                h = longer

    return run


def _spoken(batch: pa.RecordBatch, bits: np.ndarray, size: int) -> pa.RecordBatch:
    """The rows of languages that the wave is about."""
    coded = batch.column("lang").dictionary_encode()
    active = _holds(bits, _start(_text_hashes(coded.dictionary), _text_hashes(pa.array([""]))), ACTIVE, size)
    return batch.filter(pa.array(active[np.asarray(coded.indices)]))


def _bit_positions(size: int):
    """(kind, lang, phrase) rows as numbers of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column("phrase"), " ")
            of_word = _text_hashes(words.flatten())
            offs = np.asarray(words.offsets) - words.offsets[0].as_py()
            sizes = np.diff(offs)
            h = _start(_text_hashes(batch.column("lang")), of_word[offs[:-1]])
            for k in range(1, int(sizes.max()) if len(sizes) else 0):
                more = np.flatnonzero(sizes > k)
                h[more] = mix(h[more] + of_word[offs[:-1][more] + k])
            kinds, bit = np.asarray(batch.column("kind")), np.zeros(len(h), np.int64)
            for kind in range(len(_KIND)):
                rows = kinds == kind
                bit[rows] = _bit(h[rows], kind, size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit)], names=["bit"])

    return run


# --- plans ---------------------------------------------------------------------------------------------------------


def _filter(members: DataFrame, size: int) -> np.ndarray:
    """The bits of the members, joined from bitmaps of 4 KB each."""
    bits = members.select("kind", "lang", "phrase").mapInArrow(_bit_positions(size), "bit long")
    shift = F.col("bit") + 1  # Spark's bitmaps start at 1
    maps = bits.groupBy(F.bitmap_bucket_number(shift).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(shift)).alias("m"))
    out = np.zeros(max((1 << size) // 8, 4096), np.uint8)
    for r in maps.collect():  # MOST_BITS / 8 bytes at most; an iterator would run a job for each partition
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)[: len(out)]
    return out


def _count(texts: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """lang, phrase, length, f, right of phrases of at least ``LEAST`` occurrences, among them all that the members ask for.

    Written, so that the filter can go.
    """
    spark = texts.sparkSession
    present = members.groupBy("kind", "length").count().collect()  # kinds x lengths rows
    total = sum(r["count"] for r in present)
    size = min(MOST_BITS, max(LEAST_BITS, (16 * total - 1).bit_length()))
    lengths = {kind: {r.length for r in present if r.kind == kind} for kind in (RIGHT, LEFT, EXACT)}
    sent = spark.sparkContext.broadcast(_filter(members, size))  # 16 MB at most
    found = texts.mapInArrow(_phrases(sent, size, lengths), COUNTED)
    found = found.groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f"), F.max("right").alias("right")).where(F.col("f") >= LEAST)
    found = written(found, name)
    sent.destroy()
    return found


def ratio(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exactly: products are decimals of 38 digits."""

    def digits(x: Column, p: int) -> Column:
        return x.cast(f"decimal({p},0)")

    return F.call_function("div", digits(a * 1000, 20) * digits(n, 18), digits(left, 19) * digits(right, 18))


def _bound(n: Column, f: Column) -> Column:
    """No extension of a phrase with count f scores above floor(1000 n / f): cut where the phrase ends, a <= r and l = f."""
    return F.floor(n.cast("decimal(22,0)") * 1000 / f).cast("long")


def _scored(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """Reached nodes that lack a count get their lowest cut ``best`` (score, k, l, r) and the parts still ``missing``.

    Where a part's count isn't known yet, the phrase's own stands for it, which no part's is below: then ``best`` is an
    upper bound.
    """
    due = F.col("reached") & F.col("state").isNull() & (F.coalesce(F.size("missing"), F.lit(1)) != 0)
    kept = [c for c in NODE if c not in ("best", "missing")]
    cuts = nodes.where(due).select(*kept, F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - length)")})
    known = nodes.select("lang", "phrase", "f").unionByName(words.select("lang", "phrase", "f"))
    part = known.select(F.col("lang").alias("pl"), F.col("phrase").alias("p"), F.col("f").alias("pf"))
    cuts = cuts.join(part, (F.col("lang") == F.col("pl")) & (F.col("first") == F.col("p")), "left").withColumnRenamed("pf", "l").drop("pl", "p")
    cuts = cuts.join(part, (F.col("lang") == F.col("pl")) & (F.col("rest") == F.col("p")), "left").withColumnRenamed("pf", "r").drop("pl", "p")
    score = ratio(F.col("f"), F.col("n"), F.coalesce("l", "f"), F.coalesce("r", "f"))
    lacks = F.array_compact(F.array(F.when(F.col("l").isNull(), F.col("first")), F.when(F.col("r").isNull(), F.col("rest"))))
    scored = cuts.groupBy(*kept).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"), F.flatten(F.collect_list(lacks)).alias("missing"))
    return nodes.where(~due).select(*NODE).unionByName(scored.select(*NODE))


def _covered(nodes: DataFrame) -> DataFrame:
    """The greatest count of a known phrase that is one word longer. By way of these a longer one with as many
    occurrences reaches every phrase inside it, since counts between two equal ones are equal."""
    ends = F.array(F.expr("substring_index(phrase, ' ', length - 1)"), F.expr("substring_index(phrase, ' ', 1 - length)"))
    inner = nodes.where("length > 2").select("lang", F.explode(ends).alias("phrase"), "f")
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("covered"))


def _best(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of each language; of each salt first, so that no task gets a language's rows whole."""
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def _judged(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """Nodes with their state: ``dropped``, ``kept`` once they are scored and checked on both sides, null before.

    A node is reached if its prefix was grown. One that was only counted as a part or an extension of another waits for
    that: if its first words aren't worth growing, no phrase that starts with them is worth scoring.
    """
    out = _scored(nodes, words).join(_covered(nodes), ["lang", "phrase"], "left")
    whole = (F.col("length") == LONGEST) | (F.col("grown") & F.col("looked"))
    state = F.when(100 * F.col("covered") >= 100 * F.col("f"), F.lit("dropped")).when((F.size("missing") == 0) & whole, F.lit("kept"))
    return out.withColumn("state", F.coalesce("state", state)).drop("covered")


def _floors(judged: DataFrame, top: int) -> DataFrame:
    """lang, floor: the score of the ``top``-th phrase kept, of languages that have so many."""
    ranked = _best(judged.where("state = 'kept'").select("lang", "phrase", F.col("best.score").alias("score")), [F.col("score").desc()], top)
    return ranked.where(F.col("rank") == top).select("lang", F.col("score").alias("floor"))


def _asked(judged: DataFrame, floors: DataFrame) -> DataFrame:
    """The judged nodes with what the next wave does for each: ``right``, ``left``, ``ask``."""
    out = judged.join(floors, "lang", "left")
    floor, live = F.coalesce("floor", F.lit(0)), F.col("reached") & F.col("state").isNull()
    short = F.col("length") < LONGEST
    hope = live & (F.col("best.score") >= floor)
    # A dropped phrase still has extensions.
    right = F.col("reached") & short & ~F.col("grown") & (_bound(F.col("n"), F.col("f")) >= floor)
    ask = F.when(hope, F.col("missing")).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"right": right, "left": hope & short & ~F.col("looked"), "ask": ask}).drop("floor")


def _turns(every: DataFrame) -> DataFrame:
    """lang, n, turn, upto: the languages, and the classes of counts (rarest first) that make up ``FIRST_SHARE`` of each."""
    langs = every.groupBy("lang").agg(F.sum("f").alias("n"))
    rows = every.where(F.col("f") >= LEAST).withColumn("class", F.floor(F.log2("f")).cast("int"))
    classes = rows.groupBy("lang", "class").agg(F.sum("f").alias("size")).join(langs, "lang")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    band = classes.withColumn("before", before).where(F.col("before") <= FIRST_SHARE * F.col("n")).groupBy("lang").agg(F.max("class").alias("upto"))
    return langs.join(band, "lang", "left").select("lang", "n", F.lit(0).alias("turn"), "upto")


def _ready(turns: DataFrame, members: DataFrame, floors: DataFrame) -> DataFrame:
    """Languages with words to open whose wave would be empty otherwise."""
    busy = members.where(F.col("kind") == ACTIVE).select("lang")
    return turns.where(F.col("turn") < 2).join(busy, "lang", "left_anti").join(floors, "lang", "left")


def _opened(ready: DataFrame, words: DataFrame) -> DataFrame:
    """The words that the next wave opens, as its members.

    Best bounds first: whatever is open below a word that was opened is rarer than any word that was not, so words wait
    until a language has nothing else to do. In the first turn they are whole classes of counts, rarest first, up to
    ``FIRST_SHARE`` of the language; in the second all others whose bound reaches the floor.
    """
    rows = words.drop("n").join(ready, "lang").withColumn("class", F.floor(F.log2("f")).cast("int"))
    now = F.when(F.col("turn") == 0, F.col("class") <= F.col("upto")).otherwise(F.col("class") > F.col("upto"))
    opened = rows.where(now & (_bound(F.col("n"), F.col("f")) >= F.coalesce("floor", F.lit(0))))
    return _with_active(opened.select(F.lit(RIGHT).alias("kind"), "lang", "phrase", F.lit(1).alias("length")))


def _after(turns: DataFrame, ready: DataFrame) -> DataFrame:
    on = turns.join(ready.select("lang", F.lit(1).alias("on")), "lang", "left")
    return on.select("lang", "n", (F.col("turn") + F.coalesce("on", F.lit(0))).alias("turn"), "upto")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases of two to five words.

    Texts (A-Z lowered) are split into pieces and words as the contract of ``op12`` says; a phrase lies within a piece.
    Its score is that of its lowest cut, floor(1000 a n / (l r)); a phrase goes if a longer one that holds it occurs as
    often. ``LEAST`` occurrences are needed.

    Phrases form a tree by their prefixes. No extension of a phrase with count f scores above 1000 n / f, so rare
    phrases are the promising ones. A wave takes the best open nodes of each language: at first its rarest words, about a
    quarter of all occurrences, then what grows from them, and other words when that is done. One pass over the texts
    counts their extensions by a word on the right; extensions on the left of phrases that may yet be dropped; and parts
    whose counts a score lacks. Then phrases are scored, dropped or settled, and the ``top``-th score of the settled ones
    becomes the floor: only nodes whose bound reaches it, ties included, stay open. The search ends when nothing is open,
    unscored or unchecked at the floor; a pass skips the texts of languages that are done. It emits only what it is asked
    for: a filter of fixed greatest size says which phrases those are; what it lets through by mistake is counted
    whole, which costs time and changes nothing. Words are numbered exactly in a task and phrases travel as text: no
    hash stands for a string.

    Defined cases: null text is empty; null lang is ``und``, together with a lang of that name; repeated rows count
    each; languages without candidates have no rows; doc_id and other columns are ignored; an empty table gives an empty
    result. A text longer than 4 MB is cut where a piece ends, so memory follows the longest piece.
    """
    ship(docs.sparkSession)
    texts = docs.where("text is not null").select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), "text")
    single = texts.mapInArrow(_single_words, COUNTED)
    every = written(single.groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "phrases-words")
    turns = written(_turns(every), "phrases-turns")
    words = written(every.where(F.col("f") >= LEAST).join(turns.select("lang", "n"), "lang"), "phrases-frequent")
    kinds = "lang string, phrase string, length int, f long, n long, reached boolean, grown boolean, looked boolean"
    best = "best struct<score: bigint, k: int, l: bigint, r: bigint>, missing array<string>, state string"
    nodes = docs.sparkSession.createDataFrame([], f"{kinds}, {best}")
    frequent = words.select(F.lit(FREQUENT).alias("kind"), "lang", "phrase", F.lit(1).alias("length"))
    wave, waiting = 0, not turns.isEmpty()
    while True:
        judged = written(_judged(nodes, words), f"phrases-judged-{wave}")
        floors = written(_floors(judged, top), f"phrases-floors-{wave}")
        asked = written(_asked(judged, floors), f"phrases-asked-{wave}")
        members = written(_members(asked), f"phrases-members-{wave}")
        if waiting:
            ready = written(_ready(turns, members, floors), f"phrases-ready-{wave}")
            if not ready.isEmpty():
                members = members.unionByName(written(_opened(ready, words), f"phrases-opened-{wave}"))
                turns = written(_after(turns, ready), f"phrases-turns-{wave}")
                waiting = not turns.where("turn < 2").isEmpty()
        if members.isEmpty():
            if waiting:
                continue
            break
        wave += 1
        found = _count(texts, members.unionByName(frequent), f"phrases-found-{wave}")
        nodes = written(_next(asked, found, turns), f"phrases-nodes-{wave}")
    final = judged.where("state = 'kept'").select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
    final = _best(final, [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    return final.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _next(asked: DataFrame, found: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes after a wave: what was done is noted, what was found is added; a phrase may be both."""
    old = asked.withColumns({"grown": F.col("grown") | F.col("right"), "looked": F.col("looked") | F.col("left")}).select(*NODE)
    new = found.join(turns.select("lang", "n"), "lang").withColumn("reached", F.col("right"))
    new = new.withColumns({"grown": F.lit(False), "looked": F.lit(False)}).drop("right")
    both = old.unionByName(new, allowMissingColumns=True)
    flags = [F.max(c).alias(c) for c in ("f", "n", "reached", "grown", "looked")]
    return both.groupBy("lang", "phrase", "length").agg(*flags, *[F.first(c, ignorenulls=True).alias(c) for c in ("best", "missing", "state")]).select(*NODE)


def _members(asked: DataFrame) -> DataFrame:
    """kind, lang, phrase, length of what a wave is about, less the words that it opens."""
    kinds = F.array_compact(F.array(F.when(F.col("right"), F.lit(RIGHT)), F.when(F.col("left"), F.lit(LEFT))))
    nodes = asked.select(F.explode(kinds).alias("kind"), "lang", "phrase", "length")
    parts = asked.select(F.lit(EXACT).alias("kind"), "lang", F.explode("ask").alias("phrase"))
    return _with_active(nodes.unionByName(parts.withColumn("length", F.size(F.split("phrase", " ")))))


def _with_active(members: DataFrame) -> DataFrame:
    """The different members, with one of kind ``ACTIVE`` for each of their languages."""
    active = F.struct(F.lit(ACTIVE).alias("kind"), F.lit("").alias("phrase"), F.lit(0).alias("length"))
    both = members.select("lang", F.explode(F.array(F.struct("kind", "phrase", "length"), active)).alias("m"))
    return both.select("m.kind", "lang", "m.phrase", "m.length").distinct()
