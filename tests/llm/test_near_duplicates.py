import random

import numpy as np
import pytest
from brute import awkward, made_to_collide, near_groups, shingles, table

from fareframe.llm import minhash
from fareframe.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def check(spark, rows):
    rows = [r for r in rows if r[0] is not None]
    got = by_id(minhash.near_duplicates(table(spark, rows)))
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0])
    first = near_groups([t for _, t in docs])
    for (doc_id, text), f in zip(docs, first, strict=True):
        r = got[doc_id]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingles(text)), docs[f][0], docs[f][0] == doc_id)


def test_awkward_documents(spark):
    check(spark, awkward())


def test_texts_made_to_collide(spark):
    x, y = made_to_collide(1024)
    check(spark, awkward([x, y, " ".join(x), " ".join(y), f"{x} p q r s", f"{y} p q r s"]))


def test_rows_without_id_and_repeats_keep_their_row(spark):
    rows = awkward()
    out = minhash.near_duplicates(table(spark, rows)).collect()
    assert len(out) == len(rows)
    lone = [r for r in out if r["doc_id"] is None]
    assert sorted((r["component_id"] is None, r["kept"]) for r in lone) == [(False, False), (True, True)]


def test_texts_under_one_id_are_judged_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(d, t, None, None, None, "", 0, "", 0, "", 0, "") for d, t in [(1, a), (5, a + " tail"), (5, b), (7, b + " tail")]]
    out = minhash.near_duplicates(table(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out) == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False)]


def test_empty_table(spark):
    assert minhash.near_duplicates(table(spark, [])).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    got = by_id(minhash.near_duplicates(docs))
    first = near_groups([r["text"] for r in rows])
    assert [got[r["doc_id"]]["component_id"] for r in rows] == [rows[f]["doc_id"] for f in first]


def test_template_with_many_distinct_fillings(spark, monkeypatch):
    """Long chains of edits and unlinked documents in the same buckets, split over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    start = [rng.choice(vocabulary) for _ in range(120)]
    texts, now = [], list(start)
    for _ in range(60):
        now[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(now))
    half = start[:75]
    texts += [" ".join(half + [rng.choice(vocabulary) for _ in range(45)]) for _ in range(60)]
    rng.shuffle(texts)
    check(spark, [(i, t, None, None, None, "", 0, "", 0, "", 0, "") for i, t in enumerate(texts)])


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    sets = [np.sort(a), np.sort(np.concatenate([a[:600], rng.integers(0, 1 << 62, 400).astype(np.uint64)])), a[:3], np.zeros(0, np.uint64)]
    g = minhash.signatures(sets)
    assert g.shape == (4, minhash.BANDS * minhash.ROWS)
    assert abs((g[0] == g[1]).mean() - 600 / 1400) < 0.1
    assert (g[0] == minhash.signatures([sets[0]])[0]).all()
    assert (minhash.signatures(sets[2:3]) != 0).any()


def test_every_register_is_the_least_over_the_elements():
    s = np.arange(40, dtype=np.uint64)
    parts = np.stack([minhash.signatures([s[:20]])[0], minhash.signatures([s[20:]])[0]])
    whole = minhash.signatures([s])[0]
    assert ((whole == parts[0]) | (whole == parts[1])).all()


@pytest.mark.parametrize("edges", [[], [(i + 1, i) for i in range(200)], [(0, i) for i in range(1, 300)], [(5, 5), (None, 3), (9, 7), (7, 8), (2, 9)]])
def test_components(spark, edges):
    random.Random(0).shuffle(edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    want = {}
    for a, b in (e for e in edges if None not in e and e[0] != e[1]):
        group = {a, b} | {x for x in want if want[x] in (want.get(a, a), want.get(b, b))}
        want |= dict.fromkeys(group, min(want.get(x, x) for x in group))
    assert got == want
