import shutil
import subprocess
import sys

import corpus_pipeline
import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from brute import awkward, drop_lines, near_groups, sha, table
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fareframe.llm import bpe, language, mixing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark):
    """What goes into each stage and what comes out of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs.collect())
    return out


def test_language_stage(spark, staged):
    given, kept = staged[0], staged[1]
    gone = {r["doc_id"] for r in given} - {r["doc_id"] for r in kept}
    assert gone == {r["doc_id"] for r in given if not any(c.isalpha() for c in r["text"] or "")}
    assert sorted(kept) == sorted(r for r in given if r["doc_id"] not in gone)


def test_line_stage(staged):
    given, kept = staged[1], {r["doc_id"]: r for r in staged[2]}
    lines, gone = drop_lines([(r["doc_id"], r["text"]) for r in given])
    for r in given:
        text = "\n".join(lines[r["doc_id"]])
        if gone[r["doc_id"]] and not text.strip(" \t\n\r\f\v"):
            assert r["doc_id"] not in kept
        else:
            k = kept[r["doc_id"]]
            assert (k["text"], k["lang"], k["source"], k["n_chars"]) == (text, r["lang"], r["source"], len(text))


def test_near_stage(staged):
    given = sorted(staged[2])
    first = near_groups([r["text"] for r in given])
    assert sorted(staged[3]) == [r for i, r in enumerate(given) if first[i] == i]


def test_near_stage_decides_per_row(spark):
    """Null and repeated doc_ids: no text goes that is no near duplicate of one that stays."""
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"}
    near = {c: t + " tail" for c, t in text.items()}
    rows = [
        (1, text["a"]), (5, near["a"]), (5, text["b"]), (7, near["b"]),  # 5 holds a near duplicate of 1 and b's first text
        (8, text["c"]), (8, near["c"]), (9, text["d"]), (9, text["d"]),  # near and equal texts under one doc_id
        (None, text["e"]), (None, text["e"].upper()), (None, text["f"]), (None, text["a"]),  # only the last has an equal with doc_id
        (3, text["g"]), (3, text["g"] + " x y z"),
    ]
    docs = table(spark, [(d, t, "en", "ba"[i % 2], len(t), "r", 1, "d", 2, "s", 3, "i") for i, (d, t) in enumerate(rows)])
    got = corpus_pipeline.near_dedup(spark, docs.repartition(5), SF).collect()
    again = corpus_pipeline.near_dedup(spark, docs.repartition(2).orderBy("text"), SF).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    have = sorted((r["doc_id"] or 0, r["text"].split()[0].lower()) for r in got)
    assert have == [(0, "e0"), (0, "f0"), (1, "a0"), (3, "g0"), (5, "b0"), (8, "c0"), (9, "d0")]
    assert [r["source"] for r in got if r["doc_id"] == 9] == ["a"]  # of equal rows the least


def test_mix_stage(spark, staged):
    docs = spark.createDataFrame(staged[3], spark.read.parquet(f"{SF}/documents.parquet").schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs).collect()}
    assert sorted(staged[4]) == sorted(r for r in staged[3] for _ in range(copies[r["doc_id"]]))


def test_encoding_stage(staged):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.coder(f.read()).ranks
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"], reference.encode_ordinary(r["text"]), sha(r["text"])) for r in staged[4])
    assert sorted((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in staged[5]) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in staged[5])


def test_stages_on_awkward_documents(spark):
    docs = table(spark, awkward())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-awkward")
        assert i == 4 or docs.columns == columns
    empty = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, SF), "test-empty")
        assert empty.count() == 0


def test_language_stage_without_labels(spark):
    """Documents with letters stay, whatever they are written in; nothing is said of their language."""
    rows = [(*r[:2], None, *r[3:]) for r in awkward()]
    kept = corpus_pipeline.language_id(spark, table(spark, rows), SF).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, kept), key=key) == sorted((r for r in rows if any(c.isalpha() for c in r[1] or "")), key=key)
    assert language.UNKNOWN == "und"


def test_language_stage_fills_missing_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang"))).withColumn("score", F.lit("own")).withColumn("lang_pred", F.lit(1))
    out = corpus_pipeline.language_id(spark, hidden, SF)
    assert out.columns == hidden.columns and out.where("score <> 'own' or lang_pred <> 1").count() == 0
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r.lang for r in out.collect()}
    assert all(got[i] == truth[i] for i in got if i % 4)
    filled = [got[i] == truth[i] for i in got if i % 4 == 0]
    assert len(filled) > 200 and sum(filled) > 0.97 * len(filled)


def test_registered(spark):
    names = entry.queries()
    for n in range(1, 14):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if k.startswith("op")])
def test_queries_agree_with_sql(spark, name):
    sys.path.insert(0, "tools")
    import check_oracle

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = check_oracle.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_repository_works_without_these_folders(tmp_path):
    root = entry.__file__.rsplit("/", 1)[0]
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 110 and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
