import numpy as np
import pytest
from brute import awkward, sha, table

from fareframe.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"


def check(rows, got):
    rows = sorted(({"doc_id": d, "text": t or ""} for d, t in rows), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"]))
    got = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    want = []
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(r["text"]) // 4
        edited = r["text"][: len(r["text"]) - k] + after["text"][:k]
        want.append((str(r["doc_id"]), len(r["text"]), sha(edited), *map(one, (r["text"], edited))))
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got)
    for i, r in enumerate(got):
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def one(text):
    raw = text.encode()
    return fp.fingerprints(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    got = fp.edited_fingerprints(docs).collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    by_id = {r["doc_id"]: r for r in got}
    for r in got:
        follower = by_id.get(r["doc_id"] + 1, by_id[min(by_id)])
        assert r["near_next"] == fp.likeness(r["fingerprint"], follower["fingerprint"])
    long = [r for r in got if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.65
    assert np.mean([r["near_next"] for r in long]) < 0.1


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_awkward_documents(spark, parts):
    rows = awkward()
    check([r[:2] for r in rows], fp.edited_fingerprints(table(spark, rows).repartition(parts)).collect())


def test_single_and_empty(spark):
    row = [r for r in awkward() if r[1]][:1]
    got = fp.edited_fingerprints(table(spark, row)).collect()
    check([row[0][:2]], got)
    assert got[0]["near_next"] == 1.0
    assert fp.edited_fingerprints(table(spark, [])).collect() == []


def test_equal_stretches_are_cut_alike_at_any_offset():
    rng = np.random.default_rng(0)
    letters = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared = letters(4000)
    a, b = (fp.phrase_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in (letters(37) + shared, letters(1001) + shared))
    assert len(np.intersect1d(a, b)) > 0.8 * len(a)


def test_neighbouring_labels_differ():
    s = np.random.default_rng(0).integers(0, 1 << 62, 5000).astype(np.uint64)
    first = np.zeros(5000, bool)
    first[[0, 70, 71]] = True
    label = fp.toss(s, first)
    assert label.max() < 6
    assert (label[1:] != label[:-1])[~first[1:] & (np.arange(1, 5000) > 76)].all()
    assert (label[100:] == fp.toss(s[90:], np.arange(4910) == 0)[10:]).all()


def test_runs_of_one_character():
    assert one("a" * 10_000) == one("a" * 10_000) != one("a" * 9_999)
    assert one("") == ""
