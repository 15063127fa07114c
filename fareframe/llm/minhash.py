"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareframe.llm.arrays import Spans, byte_values, mix, text_chunks, words
from fareframe.llm.components import connected_components
from fareframe.llm.scratch import ship, written

WIDTH = 5
BANDS, ROWS = 50, 5
PERCENT = 75
#: Signature agreement (of BANDS * ROWS registers) below which a pair of one bucket is not verified: more than five
#: standard deviations under the agreement of a pair that is just similar enough.
LEAST_AGREEMENT = 0.60
BLOCK = 1024
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct word-shingle hashes of each document, ASCII letters lower-cased."""
    starts, ends, first = words(data, offs)
    word = Spans(byte_values(lower=True)[data])(starts, ends)
    text = Spans(word)
    out = []
    at = np.arange(len(word) + 1)
    every = text(at[: max(0, len(word) - width + 1)], at[width:]) if len(word) >= width else None
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            out.append(text(at[a : a + 1], at[b : b + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash registers, one row of ``m`` 16-bit values per set; all rounds run over many elements at once.

    In round j every element draws a value in [j, j + 1) for the register that the j-th step of its own random
    permutation names. A later round's values are larger than all earlier ones, so a set is done as soon as all its
    registers are filled.
    """
    if m > 256:
        raise ValueError("permutations are held in bytes: at most 256 registers")
    n = len(sets)
    regs = np.full(n * m, _EMPTY)
    sizes = np.array([len(s) for s in sets], np.int64)
    elems = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    if len(elems):
        z = mix(elems)
        np.minimum.at(regs, owner * m + (((z & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64), z >> np.uint64(32))
    ends = np.cumsum(sizes)
    i = 0
    while i < n:  # blocks of whole sets, of about 32,768 elements
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 32768, side="right")))
        _later_rounds(regs[i * m : j * m], elems[ends[i] - sizes[i] : ends[j - 1]], owner[ends[i] - sizes[i] : ends[j - 1]] - i, m)
        i = j
    return (mix(regs) & np.uint64(0xFFFF)).astype(np.uint16).reshape(n, m)


def _later_rounds(regs: np.ndarray, elems: np.ndarray, owner: np.ndarray, m: int) -> None:
    open_ = (regs.reshape(-1, m) == _EMPTY).any(axis=1)
    keep = open_[owner]
    elems, owner = elems[keep], owner[keep]
    if not len(elems):
        return
    perm = np.tile(np.arange(m, dtype=np.uint8), (len(elems), 1))
    row = np.arange(len(elems))
    for j in range(m):
        z = mix(elems + np.uint64(j * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        k = j + (((z & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        here, there = perm[row, j].copy(), perm[row, k]
        perm[row, j], perm[row, k] = there, here
        if j:
            np.minimum.at(regs, owner * m + there, (z >> np.uint64(32)) | np.uint64(j << 32))
            open_ = (regs.reshape(-1, m) == _EMPTY).any(axis=1)
            keep = open_[owner]
            if not keep.all():
                elems, owner, perm = elems[keep], owner[keep], perm[keep]
                row = np.arange(len(elems))
                if not len(elems):
                    return


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row by its doc_id and text; never null."""
    known = F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(known, F.coalesce(F.concat(F.lit(":"), text.cast("string")), F.lit("")))))


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in text_chunks(batches):
        sets = shingle_sets(data, offs)
        sigs = signatures(sets)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0).cast(pa.int64()),
                rows.column(2),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([g.tobytes() if len(s) else None for s, g in zip(sets, sigs, strict=True)], pa.binary()),
            ],
            ["doc_id", "key", "n_shingles", "digest", "sig"],
        )


def _similar(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough, in whole numbers."""
    if not len(s) or not len(t):
        return False
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    both = int(np.count_nonzero(t[at] == s))
    return 100 * both >= PERCENT * (len(s) + len(t) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, is_member, node, text) in order: each hub's own row, then its members'; links out."""
    hub, salt, held = None, None, None
    for rows, data, offs in text_chunks(batches):
        sets = shingle_sets(data, offs)
        cols = [rows.column(i).to_pylist() for i in range(4)]
        a, b = [], []
        for h, g, member, node, s in zip(*cols, sets, strict=True):
            if not member:
                hub, salt, held = h, g, s
            elif h == hub and g == salt and 100 * min(len(s), len(held)) >= PERCENT * max(len(s), len(held)):
                if _similar(s, held):
                    a.append(node)
                    b.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; each text travels once per hub it is held against.

    A hub with very many members is dealt over several tasks, each with its own copy of the hub's text.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(64)))
    salted = pairs.groupBy("b", "salt").agg(F.count(F.lit(1)).alias("n"))
    salts = salted.groupBy("b").agg(F.sum("n").alias("n")).withColumn("k", F.least(F.lit(64), F.ceil(F.col("n") / 256)))
    pairs = pairs.join(salts.select("b", "k"), "b").select("a", "b", (F.col("salt") % F.col("k")).alias("salt"))
    members = pairs.select("b", "salt", F.lit(True).alias("member"), F.col("a").alias("node"))
    hubs = pairs.select("b", "salt").distinct().withColumns({"member": F.lit(False), "node": F.col("b")})
    wanted = members.unionByName(hubs).groupBy("node").agg(F.collect_list(F.struct("b", "salt", "member")).alias("to"))
    with_text = wanted.join(reps.select("node", "key"), "node").join(docs.select("key", "text"), "key")
    rows = with_text.select(F.explode("to").alias("t"), "node", "text").select("t.b", "t.salt", "t.member", "node", "text")
    rows = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "member")
    return written(rows.mapInArrow(_verify, "a long, b long"), name)


def _links_of_block(rows: pa.Table) -> tuple[list[int], list[int]]:
    """Links between the components of one bucket (or of one pair of its blocks): edges of a spanning forest.

    Signatures pick the pairs, full sets confirm them. A pair that agrees in several bands is left to the first one.
    """
    m = BANDS * ROWS
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, m)
    node, comp, n, mine = (rows.column(c).to_numpy() for c in ("node", "component", "n_shingles", "mine"))
    i, j, band = (rows.column(c)[0].as_py() for c in ("i", "j", "band"))
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    sets: dict[int, np.ndarray] = {}
    parent: dict[int, int] = {}

    def shingles(k: int) -> np.ndarray:
        if k not in sets:
            data = np.frombuffer((rows.column("text")[k].as_py() or "").encode(), np.uint8)
            sets[k] = shingle_sets(data, np.array([0, len(data)]))[0]
        return sets[k]

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    a, b = [], []
    for p in left.tolist():
        other = right[(comp[right] != comp[p]) & (100 * np.minimum(n[right], n[p]) >= PERCENT * np.maximum(n[right], n[p]))]
        if i == j:
            other = other[other > p]
        if not len(other):
            continue
        same = sig[other] == sig[p]
        good = same.sum(axis=1) >= LEAST_AGREEMENT * m
        other, same = other[good], same[good].reshape(-1, BANDS, ROWS).all(axis=2)
        for q in other[same.argmax(axis=1) == band].tolist():
            # The components of before are joined as well, so that each two of them meet in one link only.
            x, y = root(int(comp[p])), root(int(comp[q]))
            if x != y and _similar(shingles(p), shingles(q)):
                parent[max(x, y)] = min(x, y)
                a.append(int(max(node[p], node[q])))
                b.append(int(min(node[p], node[q])))
    return a, b


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (bucket, i, j), a block pair of one bucket at a time."""

    def out(part: pa.Table) -> pa.RecordBatch:
        a, b = _links_of_block(part) if part.num_rows > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        k = np.stack([held.column(c).to_numpy() for c in ("bucket", "i", "j")])
        start = 0
        for end in np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1:
            yield out(held.slice(start, end - start))
            start = end
        held = held.slice(start)
    if held is not None:
        yield out(held)


def _between_components(shared: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Links (a, b) between members of one bucket that ``found`` (node, component) leaves apart.

    Buckets whose members are all of one component are done. The others get their members' signatures and texts; a
    bucket of more than ``BLOCK`` members is dealt out as pairs of blocks. Pairs exist only inside a task.
    """
    placed = shared.join(found, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    split = split.where("lo < hi").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    cells = placed.join(split, "bucket").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    cells = cells.groupBy("node", "component").agg(F.collect_list(F.struct("bucket", "band", "mine", "k")).alias("cells"))
    cells = cells.join(reps, "node").join(docs.select("key", "text"), "key")
    rows = cells.select("node", "component", "n_shingles", "sig", "text", F.explode("cells").alias("c"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c.k") - 1))).select(
        "c.bucket", "c.band", F.least("c.mine", "other").alias("i"), F.greatest("c.mine", "other").alias("j"), "c.mine",
        "node", "component", "n_shingles", "sig", "text",
    )
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return written(rows.mapInArrow(_blocks, "a long, b long"), name)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, key (``row_key``), n_shingles, component_id, first: every row's group, and whether it stands for it.

    Sets are told apart by their digests and numbered in the order of (doc_id, key) of their first rows, so that texts
    that share a doc_id are sets of their own, and the least number of a component is that of its smallest doc_id.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    signed = written(
        docs.select("doc_id", "text", "key").mapInArrow(_sign, "doc_id long, key binary, n_shingles long, digest binary, sig binary"),
        "minhash-signatures",
    )
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("rep"), "key")).alias("least")
    sets = signed.where("digest is not null").groupBy("digest").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    sets = sets.select("digest", "least.rep", "least.key", "n_shingles", "sig").orderBy(F.col("rep").asc_nulls_last(), "key")
    every = written(sets.withColumn("node", F.monotonically_increasing_id()), "minhash-sets")
    reps = every.where("rep is not null")

    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(BANDS)])
    members = reps.select("node", F.posexplode(keys).alias("band", "bucket"))
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    shared = written(members.join(hubs.select("bucket", "hub"), "bucket"), "minhash-buckets")
    stars = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = _confirm(stars, reps, docs, "minhash-star-links")
    first = connected_components(links, "minhash-components")
    more = _between_components(shared, first, reps, docs, "minhash-block-links")
    final = connected_components(links.unionByName(more), "minhash-components-final")

    grouped = every.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("head"))
    heads = every.select(F.col("node").alias("head"), F.col("rep").alias("component"), F.col("key").alias("head_key"))
    out = signed.select("doc_id", "key", "n_shingles", "digest").join(grouped.join(heads, "head"), "digest", "left")
    return out.select(
        "doc_id", "key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("key") == F.col("head_key"), F.lit(True)).alias("first"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents with Jaccard >= 0.75 on 5-word shingles.

    1. One pass gives every document its set size, the digest of its set and its SuperMinHash signature.
    2. Documents of equal sets collapse to the smallest doc_id; only these representatives go on, each by a number
       of its own.
    3. Every band's bucket links its members to one hub. Links are confirmed on the full sets and joined by union-find.
    4. Buckets that still hold several components compare them, in blocks: signatures pick the pairs, full sets confirm
       them, and only links that join components leave the task. So no link between different texts rests on the
       choice of the hub, and neither copies nor the members of a bucket are ever expanded into pairs.

    With 50 bands of 5 registers a pair at exactly 0.75 is missed with probability below 2e-6.

    Defined cases: null or blank text has an empty set and links with nothing; a text of fewer words is one shingle;
    rows that repeat a doc_id each get a row (if their texts differ, each is judged by its own set); a row without
    doc_id links through equal sets only and has a null ``component_id`` and ``kept`` true unless a set equal to its
    own has a doc_id. Other columns are ignored. An empty table gives an empty result.
    """
    component = F.col("component_id")
    return judged(docs).select("doc_id", "n_shingles", component, F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))
