"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry, by ball k-means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareframe.llm.scratch import extended, ship, written
from fareframe.sources.lake import scratch_dir

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Scaled components are held within this, so that squared distances of whole vectors fit in 64 bits.
MOST = 1 << 27
VECTOR, SUMS = 0, 1


def bounds(width: int, parts: int = PARTS) -> np.ndarray:
    """First components of the parts, and the width; equal parts where it divides."""
    return np.arange(parts + 1) * width // parts


def distances(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``x`` (ties to the lower one) and its squared distance, from a guess ``start``.

    Rows with the same guess form a ball about that entry, as wide as its farthest row. Another entry matters only if
    it is less than two radii away: those are the ball's neighbours. By the triangle inequality a row keeps its entry
    against another one if it is closer to it than half the distance between the two. So the rows inside half the
    distance to the first neighbour, the stable core, are done without any further distance, and each neighbour, in
    order of distance, is measured only against the rows in the rings beyond half of its own. Whole numbers throughout:
    4 d(row, entry)^2 is compared with d(entry, neighbour)^2, and equality is still measured, for ties.
    """
    code, dist = start.astype(np.int64), distances(x, book[start])
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(book) + 1))
    for i in range(len(book)):
        ball = order[cuts[i] : cuts[i + 1]]
        if not len(ball):
            continue
        ball = ball[np.argsort(-dist[ball], kind="stable")]
        reach = 4 * dist[ball]  # falling: a ring is a prefix
        by_distance = np.argsort(between[i], kind="stable")
        neighbours = by_distance[(between[i][by_distance] <= reach[0]) & (by_distance != i)]
        best, at = dist[ball].copy(), np.full(len(ball), i)
        for j in neighbours:
            ring = int(np.searchsorted(-reach, -between[i, j], side="right"))
            d = distances(x[ball[:ring]], book[j])
            closer = (d < best[:ring]) | ((d == best[:ring]) & (j < at[:ring]))
            best[:ring][closer] = d[closer]
            at[:ring][closer] = j
        code[ball], dist[ball] = at, best
    return code, dist


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), width).astype(np.int64)


def _assigned(books, width: int, sums: bool):
    """A pass over (vec_id, label, q, codes): rows with new codes and errors, then sums of what each entry got."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, cut = books.value, bounds(width)
        totals = [np.zeros((len(b), b.shape[1]), np.int64) for b in book]
        counts = [np.zeros(len(b), np.int64) for b in book]
        schema = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            schema = _arrow_schema(batch.schema)
            q = _matrix(batch.column("q"), width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, PARTS).copy()
            error = np.zeros(n, np.int64)
            for k in range(PARTS):
                x = q[:, cut[k] : cut[k + 1]]
                code, dist = nearest(x, book[k], codes[:, k])
                codes[:, k] = code
                error += dist
                if sums:
                    counts[k] += np.bincount(code, minlength=len(book[k]))
                    np.add.at(totals[k], code, x)
            yield _batch(schema, n, VECTOR, vec_id=batch.column("vec_id"), label=batch.column("label"), q=batch.column("q"),
                         codes=pa.array([r.tobytes() for r in codes], pa.binary()), error=pa.array(error))
        if schema is not None and sums:
            found = [(k, e) for k in range(PARTS) for e in np.flatnonzero(counts[k]).tolist()]
            yield _batch(schema, len(found), SUMS, part=pa.array([k for k, _ in found], pa.int32()),
                         entry=pa.array([e for _, e in found], pa.int32()),
                         sums=pa.array([totals[k][e].tolist() for k, e in found], pa.list_(pa.int64())),
                         alike=pa.array([int(counts[k][e]) for k, e in found], pa.int64()))

    return run


def _row_type(vectors: DataFrame) -> T.StructType:
    ids = [T.StructField("row_kind", T.IntegerType()), vectors.schema["vec_id"], vectors.schema["label"]]
    return T.StructType([*ids, *T.StructType.fromDDL("q binary, codes binary, error long, part int, entry int, sums array<long>, alike long").fields])


def _arrow_schema(given: pa.Schema) -> pa.Schema:
    kinds = [("row_kind", pa.int32()), ("vec_id", given.field("vec_id").type), ("label", given.field("label").type), ("q", pa.binary())]
    kinds += [("codes", pa.binary()), ("error", pa.int64()), ("part", pa.int32()), ("entry", pa.int32())]
    return pa.schema([*kinds, ("sums", pa.list_(pa.int64())), ("alike", pa.int64())])


def _batch(schema: pa.Schema, rows: int, kind: int, **columns: pa.Array) -> pa.RecordBatch:
    columns["row_kind"] = pa.array(np.full(rows, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as whole numbers, packed; rows with a component that is null or not finite go."""
    for batch in batches:
        column = batch.column("embedding").cast(pa.list_(pa.float64()))
        offsets, values = np.asarray(column.offsets), np.asarray(column.values.fill_null(float("nan")))
        sizes = np.diff(offsets)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        keep = np.flatnonzero((bad[offsets[1:]] == bad[offsets[:-1]]) & (sizes > 0))
        q = np.floor(np.clip(np.where(np.isfinite(values), values, 0.0), -MOST / SCALE, MOST / SCALE) * SCALE).astype(np.int32)
        kept = batch.take(pa.array(keep))
        rows = [q[offsets[i] : offsets[i + 1]].tobytes() for i in keep.tolist()]
        yield pa.RecordBatch.from_arrays(
            [kept.column("vec_id"), kept.column("label"), pa.array(rows, pa.binary())], names=["vec_id", "label", "q"]
        )


class Codebooks:
    """Entries of each part position: a list of whole-number arrays, one row per entry."""

    def __init__(self, entries: list[np.ndarray], width: int):
        self.entries, self.width = entries, width

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.entries for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Codebooks]:
    """(rows, codebooks) of vectors (vec_id, embedding, label): vec_id, label, codes (binary, a byte a part), error.

    Components are scaled to whole numbers and cut into ``PARTS`` parts. Each part position has a codebook, which starts
    as the vectors of the smallest vec_ids and is moved ``rounds`` times to the means of what each entry gets, rounded
    down; then all vectors are coded by the last one. Each round is one pass: a task takes its rows from the guess of
    the round before (``nearest``), writes them with their new codes, and adds up what each entry got. Only those
    sums, at most parts x entries rows a task, are combined, and only parts x entries rows reach the driver. Rows stay
    in the task that read them; nothing else is shuffled. Every row is coded in every round, none is sampled.
    When a round leaves the codebooks as they are, all later rounds would too, and they are not run.

    Defined cases: rows whose embedding is null, empty or holds a null, NaN or infinite component go. The width is that
    of the vector of the smallest vec_id; rows of another width go. Where the parts don't divide the width, part k holds
    the components from floor(k * width / parts) on. Null vec_ids stand last among the smallest ones; of equal vec_ids
    the vector of least bytes stands first. With fewer rows than entries there are so many entries. Components beyond
    +-32,768 count as that, so that sums of squares stay exact. Repeated rows count each. Other columns are ignored; an
    empty table gives an empty result and empty codebooks.
    """
    spark = vectors.sparkSession
    ship(spark)
    chosen = vectors.select("vec_id", "embedding", "label").where("embedding is not null")
    packed = written(chosen.mapInArrow(_packed, extended(chosen.select("vec_id", "label"), "q binary")), "codes-packed")
    first = packed.orderBy(F.col("vec_id").asc_nulls_last(), "q").select(F.length("q").alias("size")).first()
    if first is None:
        return packed.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), Codebooks([], 0)
    width = first.size // 4
    same = packed.where(F.length("q") == first.size)
    seeds = same.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()
    cut = bounds(width)
    table = np.stack([np.frombuffer(r.q, np.int32) for r in seeds]).astype(np.int64)
    books = [table[:, cut[k] : cut[k + 1]].copy() for k in range(PARTS)]
    rows = same.withColumn("codes", F.lit(bytes(PARTS)))
    for turn in range(rounds + 1):
        last = turn == rounds
        sent = spark.sparkContext.broadcast(books)
        done = rows.select("vec_id", "label", "q", "codes").mapInArrow(_assigned(sent, width, sums=not last), _row_type(rows))
        out = _written_by_kind(done, f"codes-{turn}")
        rows = out.where(F.col("row_kind") == VECTOR)
        if last:
            break
        moved = _moved(books, out.where(F.col("row_kind") == SUMS))
        if all(np.array_equal(a, b) for a, b in zip(books, moved, strict=True)):
            break
        books = moved
    return rows.select("vec_id", "label", "codes", "error"), Codebooks(books, width)


def _written_by_kind(df: DataFrame, name: str) -> DataFrame:
    """Written in one folder per kind of row, so that a reader of the sums opens no file of vectors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.partitionBy("row_kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Each entry at the mean of its rows, rounded down; entries without rows stay."""
    exact = sums.select("part", "entry", "alike", F.posexplode("sums").alias("at", "x"))
    exact = exact.groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("alike").alias("alike"))
    moved = [b.copy() for b in books]
    for r in exact.collect():  # parts x entries x components of a part
        moved[r.part][r.entry, r["at"]] = int(r.x) // int(r.alike)
    return moved


def hex_code(codes: Column) -> Column:
    return F.lower(F.hex(codes))


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector kept.

    Errors are added up per label before they are shuffled, and joined back as one row per label: Spark broadcasts them
    if they are few, else splits a label that holds many rows. A label's sum beyond 64 bits is null.
    """
    rows, books = encode(vectors)
    totals = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "l")
    out = rows.join(totals, F.col("label").eqNullSafe(F.col("l")))
    return out.select("vec_id", hex_code(F.col("codes")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
