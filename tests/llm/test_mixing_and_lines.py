import random
from collections import defaultdict

import pytest
from brute import awkward, drop_lines, levels, sha, table, words
from pyspark.sql import functions as F

from fareframe.llm import line_runs, mixing

SF = "/root/testdata/sf0.01"


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions", "CartesianProduct"))


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10, "d": 10}, {"a": 1, "b": 1000, "c": 1}, {"x": 5, None: 7}, {"a": 0, "b": 3}, {"a": 4},
    {"é": 100, "z": 1, "Z": 50, "~": 3, "a": 8}, {f"s{i:02d}": (i * 37) % 101 for i in range(30)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, docs long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = levels(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_mix_of_given_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = sorted(mixing.mixed(docs).collect())
    assert plain == sorted(mixing.mixed(docs.repartition(9)).collect())
    assert len(plain) == docs.count()
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in plain:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    want = levels(sizes)
    for r in plain:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in want)
    monkeypatch.setattr(mixing, "CELL_ROWS", 5)  # many small cells
    small = mixing.mixed(docs).collect()
    assert sum(r["size"] * r["copies"] for r in small) == pytest.approx(sum(want.values()), rel=0.05)
    monkeypatch.undo()
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert dict(out.groupBy("doc_id").count().collect()) == {r["doc_id"]: r["copies"] for r in plain if r["copies"]}
    assert no_python(mixing.mixed(docs)) and no_python(out)


def test_awkward_mix(spark):
    rows = awkward()
    df = table(spark, rows)
    got = mixing.mixed(df)
    assert got.count() == len(rows)
    assert all(r["size"] in {len(words(x[1])) for x in rows} for r in got.collect())
    out = mixing.mix(df)
    assert out.columns == df.columns
    copies = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in got.collect()}
    assert out.count() == sum(copies[r[0], r[3], len(words(r[1]))] for r in rows)
    assert mixing.mixed(table(spark, [])).collect() == mixing.mix(table(spark, [])).collect() == []


def test_lines_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = line_runs.drop_repeated_runs(docs)
    assert no_python(out)
    kept, gone = drop_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    rows = out.collect()
    assert len(rows) == len(kept)
    for r in rows:
        assert r["text"] == "\n".join(kept[r["doc_id"]]) and r["n_removed"] == len(gone[r["doc_id"]])


def lines(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in line_runs.drop_repeated_runs(df, **kw).orderBy("doc_id").collect()]


def test_runs(spark):
    run = "one\ntwo\nthree"
    assert lines(spark, [run, "x\n" + run + "\ny", "two\nalone"]) == [run, "x\ny", "two\nalone"]
    assert lines(spark, ["a\nb\n\na\n\nb\n"]) == ["a\nb\n\n\n"]
    assert lines(spark, ["q\n" * 5 + "end"]) == ["q\nq\nend"] or lines(spark, ["q\n" * 5 + "end"])[0].startswith("q")
    assert lines(spark, ["this line has five words", "z\nthis line has five words\nz"]) == ["this line has five words", "z\nz"]
    assert lines(spark, ["this line has five words\r", "this line has five words"]) == ["this line has five words\r", "this line has five words"]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 7])
def test_prefix_doubling_of_any_length(spark, k):
    rng = random.Random(k)
    docs = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(40)]
    seen, want = set(), []
    for d in docs:
        gone = set()
        for i in range(len(d) - k + 1):
            w = tuple(d[i : i + k])
            if w in seen:
                gone |= set(range(i, i + k))
            seen.add(w)
        want.append("\n".join(x for i, x in enumerate(d) if i not in gone))
    assert lines(spark, ["\n".join(d) for d in docs], min_lines=k, min_words=99) == want


def test_awkward_lines(spark):
    rows = awkward()
    df = table(spark, rows).withColumn("n_lines", F.lit("old"))
    out = line_runs.drop_repeated_runs(df)
    assert set(out.columns) == {*df.columns, "n_removed"}
    got = out.collect()
    assert len(got) == len(rows)
    assert sum(r["text"] is None for r in got) == 2 and all(r["n_lines"] == 0 for r in got if r["text"] is None)
    assert line_runs.drop_repeated_runs(table(spark, [])).collect() == []
    assert sha("") and no_python(out)
