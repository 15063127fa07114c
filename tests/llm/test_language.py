import zlib

import pytest
from brute import awkward, table
from pyspark.sql import functions as F

from fareframe.llm import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, docs):
    got = language.identify(docs)
    joined = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(joined) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in joined) / len(joined) > 0.98
    assert got.count() == docs.count()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] and 0 <= r["score"] <= 1 for r in got.collect())


def test_held_out_labels_and_sources_teach_nothing(spark, docs):
    changed = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(df).collect())
    assert key(docs) == key(changed)


def test_awkward_documents(spark):
    rows = awkward(["!!! 123 ... 456", "日本語のテキスト", "a"])
    got = language.identify(table(spark, rows)).collect()
    assert len(got) == len(rows)
    pred = {r["doc_id"]: r for r in got}
    for r in rows:
        if r[0] is not None:
            letters = any(c.isalpha() for c in r[1] or "")
            assert (pred[r[0]]["lang_pred"] == "und") == (not letters)
            assert letters or pred[r[0]]["score"] == 0


def test_nothing_learned_and_empty(spark):
    rows = [(*r[:2], None, *r[3:]) for r in awkward()]
    assert {(r["lang_pred"], r["score"]) for r in language.identify(table(spark, rows)).collect()} == {("und", 0.0)}
    assert language.identify(table(spark, [])).collect() == []


def test_other_columns_stay(spark):
    df = table(spark, awkward()).withColumn("score", F.lit("mine"))
    out = language.predict(df, language.learn(df))
    assert out.columns == [*[c for c in df.columns if c != "score"], "lang_pred", "score"]
    assert out.where("kept = 3").count() == df.count()
