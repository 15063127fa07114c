import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from brute import awkward, made_to_collide, sha, table

from fareframe.llm import arrays, bpe, token_counts

PATH = P.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as f:
        return bpe.coder(f.read())


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def noise(n=1500):
    rng = random.Random(1)
    parts = ["'", "s", "re", "ll", "ve", "d", "m", "t", " ", "  ", "\n", "\t", " ", "\x85", "\x1c", "é", "中", "1", "½", "٣", "!", "…", "'S", "😀", "á", "Ᲊ", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def check(df, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect() if r["doc_id"] is not None}
    for r in bpe.digests(df, PATH).collect():
        if r["doc_id"] is not None:
            ids = reference.encode_ordinary(texts[r["doc_id"]])
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == sha(b"".join(i.to_bytes(4, "little") for i in ids))
            assert r["decoded_sha256"] == sha(texts[r["doc_id"]])


def test_ids_agree_with_the_library(spark, reference):
    check(table(spark, awkward([*noise(), "ab" * 4000, " " * 3000, "'" * 500])), reference)


def test_texts_made_to_collide(spark, reference):
    check(table(spark, awkward([t for n in (1024, 4096) for t in (*made_to_collide(n), " ".join(made_to_collide(n)))])), reference)


def test_pieces_are_compared_by_bytes(monkeypatch):
    class Blind(arrays.Spans):
        def __call__(self, starts, ends):
            return np.zeros(len(starts), np.uint64)

    monkeypatch.setattr(arrays, "Spans", Blind)
    raw, starts, ends = b"abcabxabcqqabx", np.array([0, 3, 6, 9, 11]), np.array([3, 6, 9, 11, 14])
    at, which = arrays.same_pieces(np.frombuffer(raw, np.uint8), starts, ends)
    assert len(at) == 3
    assert [raw[starts[at[w]] : ends[at[w]]] for w in which] == [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def test_hashes_are_exact_residues():
    p = int(arrays.PRIME)
    rng = np.random.default_rng(3)
    a, b = (np.concatenate([[p - 1, 0], rng.integers(0, p, 500)]).astype(np.uint64) for _ in range(2))
    assert arrays.times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    values = rng.integers(0, 2**64 - 1, 90_000, dtype=np.uint64)
    twice = arrays.Spans(np.concatenate([values, values]))
    assert twice(np.array([5]), np.array([80_000])) == twice(np.array([90_005]), np.array([170_000]))
    assert twice(np.array([5]), np.array([80_000])) != twice(np.array([6]), np.array([80_001]))


def test_given_documents(spark, reference):
    check(spark.read.parquet(f"{SF}/documents.parquet"), reference)


def test_round_trip_and_offsets(spark, coder):
    df = table(spark, awkward())
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert [c for c in out.columns if c not in df.columns] == ["offsets", "decoded"]
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        if r["text"] is None:
            assert r["ids"] is None and r["decoded"] is None
            continue
        raw = r["text"].encode()
        assert bytes(r["decoded"]) == raw
        ends = [*r["offsets"], len(raw)][1:]
        assert all(coder.ranks[raw[a:b]] == i for a, b, i in zip(r["offsets"], ends, r["ids"], strict=True))


def test_empty_table(spark):
    assert bpe.digests(table(spark, []), PATH).count() == bpe.encode(table(spark, []), PATH).count() == 0
    assert token_counts.token_counts(table(spark, []), PATH).count() == 0


def greedy(piece, tokens, longest):
    n = i = 0
    while i < len(piece):
        i = next(j for j in range(min(len(piece), i + longest), i, -1) if piece[i:j] in tokens)
        n += 1
    return n


def test_greedy_counts(spark, coder, reference):
    import regex

    df = table(spark, awkward(noise(300)))
    longest = max(map(len, coder.ranks))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect() if r["doc_id"] is not None}
    rows = token_counts.token_counts(df, PATH).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r["doc_id"] is not None:
            # The pattern library here knows older letters, so pieces come from the checked cutter's own texts.
            pieces = [p for p in regex.findall(P.PATTERN, texts[r["doc_id"]].replace("Ᲊ", "q"))]
            if "Ᲊ" not in texts[r["doc_id"]]:
                assert r["n_pieces"] == len(pieces)
                assert r["n_tokens"] == sum(greedy(p.encode(), coder.ranks, longest) for p in pieces)


def test_uncovered_bytes():
    auto = token_counts.Automaton({b"ab", b"abc", b"b", b"cd"})
    assert [auto.count(x) for x in (b"", b"ab", b"abcd", b"abab", b"abb", b"a", b"abx", b"acd")] == [0, 1, -1, 2, 2, -1, -1, -1]
