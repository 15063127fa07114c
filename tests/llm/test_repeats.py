import random
import re

import pytest
from brute import WORD, awkward, repeated, sha, table

from fareframe.llm import repeats, substrings, suffix_index
from fareframe.llm.repeats import Unit

SF = "/root/testdata/sf0.001"


def passages(rng, n=80):
    shared = ["".join(rng.choice("abcde fgh\n") for _ in range(rng.choice([180, 199, 200, 201, 450]))) for _ in range(5)]
    out = []
    for _ in range(n):
        own = ["".join(rng.choice("abcdefghij \né") for _ in range(rng.randint(0, 300))) for _ in range(2)]
        out.append(own[0] + rng.choice(shared) + own[1])
    return [*out, "z" * 700, "ab" * 400, "ab" * 90, *out[:3]]


def rows_of(texts):
    return [(i, t, None, None, None, "", 0, "", 0, "", 0, "") for i, t in enumerate(texts)]


def check_bytes(df, got, width=200):
    rows = df.select("doc_id", "text").collect()
    raw = [(r["text"] or "").encode() for r in rows]
    want = {}
    for r, x, gone in zip(rows, raw, repeated(raw, width), strict=True):
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[r["doc_id"], x] = (len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone, strict=True) if not g))
    got = got.collect()
    assert len(got) == len(rows)
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(want[r["doc_id"], x] for r, x in zip(rows, raw, strict=True))
    for r in got:
        assert any(k[0] == r["doc_id"] and v == (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for k, v in want.items())


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_bytes_over_batches(spark, batches):
    df = table(spark, [*rows_of(passages(random.Random(2)))])
    check_bytes(df, suffix_index.drop_repeated_bytes(df, batches=batches))


def test_awkward_bytes(spark):
    df = table(spark, awkward())
    check_bytes(df, suffix_index.drop_repeated_bytes(df))


def test_crowded_keys_are_dealt_out_by_window(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_ROWS", 2)
    df = table(spark, rows_of(passages(random.Random(4))))
    check_bytes(df, suffix_index.drop_repeated_bytes(df, batches=1))


def test_short_windows(spark):
    rng = random.Random(5)
    df = table(spark, rows_of(["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]))
    unit = Unit(by_word=False, width=12, gram=3)
    check_bytes(df, suffix_index.drop_repeated_bytes(df, unit), 12)


def test_levels_grow_geometrically(spark):
    corpus = repeats.identified(table(spark, rows_of(passages(random.Random(6), 20))))
    family = suffix_index.SuffixLevels()
    sizes = []
    for b in range(4):
        family.add(corpus.where(f"pmod(row, 4) = {b}"), corpus)
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4]]


def check_words(df, got, width=35):
    rows = [r for r in df.select("doc_id", "text").collect()]
    seqs = [tuple(WORD.findall(r["text"] or "")) for r in rows]
    want = []
    for r, s, gone in zip(rows, seqs, repeated(seqs, width), strict=True):
        want.append((str(r["doc_id"]), len(s), sum(gone), " ".join(w for w, g in zip(s, gone, strict=True) if not g)))
    got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_words(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "GROUP_ROWS", crowd)
    rng = random.Random(7)
    shared = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(n)) for n in (34, 35, 36, 90)]
    own = lambda: " \n é".join(f"q{rng.randint(0, 200)}" for _ in range(rng.randint(0, 60)))
    texts = [own() + " " + rng.choice(shared) + "\t" + own() for _ in range(60)] + ["go " * 100, "go " * 30]
    df = table(spark, [*awkward(), *[(1000 + i, *r[1:]) for i, r in enumerate(rows_of(texts))]])
    check_words(df, substrings.drop_repeated_words(df))


def test_given_documents_and_digests(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check_words(df, substrings.drop_repeated_words(df))
    kept = {r["doc_id"]: r for r in suffix_index.digests(df).collect()}
    raw = [(r["doc_id"], r["text"].encode()) for r in df.collect()]
    for (doc_id, x), gone in zip(raw, repeated([x for _, x in raw], 200), strict=True):
        assert kept[doc_id]["kept_sha256"] == sha(bytes(b for b, g in zip(x, gone, strict=True) if not g))


def test_empty_tables(spark):
    assert suffix_index.digests(table(spark, [])).count() == substrings.digests(table(spark, [])).count() == 0


def test_the_default_merges_levels_and_tells_what_a_batch_brings(spark, monkeypatch):
    merged, tables = [], []
    plain, settle = suffix_index.SuffixLevels._merge, suffix_index.settled

    def merge(self):
        plain(self)
        merged.append([n for n, _ in self.levels])

    def kept(whole, border, *rest):
        tables.append(border)
        return settle(whole, border, *rest)

    monkeypatch.setattr(suffix_index.SuffixLevels, "_merge", merge)
    monkeypatch.setattr(suffix_index, "settled", kept)
    df = table(spark, rows_of(passages(random.Random(9))))
    check_bytes(df, suffix_index.drop_repeated_bytes(df))
    assert [2] in merged and [2, 1] in merged
    assert len(tables) == 1 and tables[0].groupBy("key", "row", "at").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError):
        suffix_index.drop_repeated_bytes(df, batches=0)


def test_added_batches_bring_all_repeats(spark):
    df = table(spark, rows_of(passages(random.Random(10), 40)))
    corpus = repeats.identified(df)
    family, found = suffix_index.SuffixLevels(), []
    for b in range(4):
        found += family.add(corpus.where(f"pmod(row, 4) = {b}"), corpus.where(f"pmod(row, 4) <= {b}"))
    rows = repeats.with_repeats(corpus, found).select("doc_id", "text", "at")
    got = rows.mapInArrow(suffix_index._strip(200), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    check_bytes(df, got)
