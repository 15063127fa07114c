"""From raw documents to token ids: language, repeated lines, near duplicates, source mix, encoding."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareframe.llm import bpe, language, line_runs, minhash, mixing
from fareframe.llm.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
VOCABULARY = "byte_bpe_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: those without text or letters. A null lang becomes the predicted one.

    The profiles are learned from all labelled documents at hand. Without any label nothing can be told apart: every
    document with letters stays, and its lang stays null. Labels that are there are left alone.
    """
    own = docs.columns
    profiles = language.learn(docs)
    if not profiles.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # By place, so that no column of the documents clashes with those of the prediction.
    places = [f"c{i}" for i in range(len(own))]
    tagged = language.predict(docs.toDF(*places), profiles, column=places[own.index("text")])
    known = tagged.where(F.col("lang_pred") != language.UNKNOWN)
    filled = {"lang": F.coalesce(F.col(places[own.index("lang")]), F.col("lang_pred"))}
    return known.select(*[filled.get(c, F.col(p)).alias(c) for c, p in zip(own, places, strict=True)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of repeated line runs; a document that loses all its text goes."""
    out = line_runs.drop_repeated_runs(docs)
    whole = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return whole.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the smallest doc_id.

    Rows are judged by their own texts. Different texts under one doc_id are documents of their own, and where they are
    near duplicates of each other that of the smallest ``minhash.row_key`` stays. Rows without doc_id link through equal
    sets only: they go if an equal set has a doc_id, else the one of the smallest key stays. Of rows that agree in doc_id
    and text the least by its columns in their order stays. Text without words links with nothing.
    """
    kept = minhash.judged(docs).where("first").select("key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), minhash.row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return rows.join(kept, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of what the ids decode to, one row per document taken."""
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs.select("doc_id", "text"), path, offsets=False, proof="decoded_sha256")
    return encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
