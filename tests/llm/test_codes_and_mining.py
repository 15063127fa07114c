"""Vector codes, collocations and secret scans against plain single-machine versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fareframe.llm import collocations, secret_scan, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, q string, codes int, error string, part int, row_kind string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "q", 1, "e", 2, "k") for i, v, label in rows], VECTORS)


def plain_codes(rows, rounds=6, entries=16, parts=8):
    """{position in rows: (code, error)} and the digest of the final entries."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    step = len(kept[0][1]) // parts
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for k in range(parts):
        xs = [v[k * step : (k + 1) * step] for _, v in kept]
        book = [list(x) for x in xs[:entries]]
        for turn in range(rounds + 1):
            found = [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book)) for x in xs]
            if turn < rounds:
                for j in range(len(book)):
                    own = [x for x, (_, c) in zip(xs, found, strict=True) if c == j]
                    if own:
                        book[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
        for p, (d, j) in enumerate(found):
            codes[p] += f"{j:02x}"
            errors[p] += d
        books += [x for e in book for x in e]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return list(zip([i for i, _ in kept], codes, errors, strict=True)), digest


def some_vectors(n, width, seed, spread=0.2):
    r = random.Random(seed)
    heads = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(7)]
    return [[h + r.gauss(0, spread) for h in r.choice(heads)] for _ in range(n)]


def test_codes_equal_plain_k_means(spark):
    rows = [(i * 5 % 301, v, [None, 1, 2, 2][i % 4]) for i, v in enumerate(some_vectors(301, 16, 5))]
    rows += [(1000, None, 1), (1001, [1.0, None] * 8, 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] * 16, None), (1004, [], 3)]
    rows += [(2000 + i, rows[5][1], 9) for i in range(40)]  # repeated vectors
    want, digest = plain_codes(rows)
    got = vector_codes.coded(vectors(spark, rows).repartition(5)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.code, r.error) for r in got] == want
    assert {r.codebooks_sha256 for r in got} == {digest}
    label = {i: k for i, _, k in rows}
    sums = defaultdict(int)
    for r in got:
        sums[label[r.vec_id]] += r.error
    assert all(r.label_error == sums[label[r.vec_id]] for r in got)


def test_codes_of_few_equal_and_large_vectors(spark):
    few = [(3, [0.5] * 8, None), (1, [0.5] * 8, None), (None, [-0.25] * 8, None)]
    got = vector_codes.coded(vectors(spark, few)).collect()
    assert sorted((r.vec_id or 0, r.code, r.error) for r in got) == [(0, "02" * 8, 0), (1, "00" * 8, 0), (3, "00" * 8, 0)]
    assert {r.label_error for r in got} == {0}
    large = [(1, [3e38] + [0.0] * 7, 1), (2, [1.0] * 8, 1), (3, [0.0] * 9, 1)]  # held at 32,768; another width goes
    assert {r.vec_id: r.error for r in vector_codes.coded(vectors(spark, large)).collect()} == {1: 0, 2: 0}
    none = vector_codes.coded(vectors(spark, []))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_uneven_parts(spark):
    rows = [(i, v, 1) for i, v in enumerate(some_vectors(60, 11, 3))]
    got = vector_codes.coded(vectors(spark, rows)).collect()
    assert len(got) == 60 and all(len(r.code) == 16 for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_balls_give_the_nearest_entry(seed):
    r = np.random.default_rng(seed)
    book = r.integers(-6, 7, (16, 3))
    book[5] = book[2]  # equal entries: the lower one
    x = r.integers(-6, 7, (500, 3))
    code, dist = vector_codes.nearest(x, book, r.integers(0, 16, 500))
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()


def plain_phrases(rows, least=100, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(brute.LOWER)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
            n[lang or "und"] += len(words)
    out = defaultdict(list)
    covered = Counter()
    for (lang, p), c in f.items():
        if c >= least:
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        covered[lang, p[i:j]] = max(covered[lang, p[i:j]], c)
    for (lang, p), a in f.items():
        if a >= least and len(p) > 1 and covered[lang, p] < a:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    rows = []
    for lang, found in out.items():
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(rows)


def speech(seed, n):
    """Words by Zipf, phrases that occur whole, repeated texts, and marks between."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeÄß") for _ in range(r.randint(1, 5))) for _ in range(60)]
    fixed = [[r.choice(vocabulary) for _ in range(r.randint(2, 7))] for _ in range(12)]
    for i in range(n):
        words = []
        while len(words) < 40:
            words += r.choice(fixed) if r.random() < 0.4 else [vocabulary[min(59, int(r.paretovariate(0.7)))]]
        marks = "".join(w + r.choice([" "] * 9 + ["\t", ". ", ",", ": ", "\n", "  ", "\r\n", " "]) for w in words)
        yield r.choice(["en", "en", "en", None, "und", "de"]), marks.title() if i % 3 else marks


@pytest.mark.parametrize(("seed", "top"), [(1, 2000), (2, 25), (3, 3)])
def test_collocations_equal_plain_counts(spark, seed, top):
    rows = [*speech(seed, 300), *[("en", "same text here. same text here")] * 120, ("fr", "too few words"), ("en", None), ("en", "")]
    docs = brute.table(spark, [(i, t, lang, "s", 1, "r", 1, "d", 2, "s", 3, "i") for i, (lang, t) in enumerate(rows)]).repartition(4)
    got = collocations.collocations(docs, top=top).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, top=top)


def test_collocations_of_nothing_and_of_awkward_texts(spark):
    assert collocations.collocations(brute.table(spark, [])).collect() == []
    rows = [(None, "a b " * 3000, "xx"), *[(i, r[1], r[2]) for i, r in enumerate(brute.awkward())]]
    docs = brute.table(spark, [(i, t, lang, *[None] * 9) for i, t, lang in rows])
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == plain_phrases([(lang, t) for _, t, lang in rows])


def test_long_texts_are_cut_where_pieces_end(spark, monkeypatch):
    rows = [(lang, t) for lang, t in speech(9, 200)]
    joined = [("en", ". ".join(t for _, t in rows)), ("en", "x y z " * 200)]
    docs = brute.table(spark, [(i, t, lang, *[None] * 9) for i, (lang, t) in enumerate(joined)])
    batch = docs.select("lang", "text").toArrow().to_batches()
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 500)
    pieces = list(collocations._segments(iter(batch)))
    assert len(pieces) > 20 and max(len(p[0]) for p in pieces) <= 1200
    counts = Counter()
    for b in collocations._single_words(iter(batch)):
        for r in b.to_pylist():
            counts[r["phrase"]] += r["f"]
    assert counts == Counter(w for _, t in joined for w in re.findall("[^ \t.,;:!?\n-\r]+", t.translate(brute.LOWER)))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for kind, pattern in ((3, "[0-9A-Fa-f]{20,}"), (4, "[A-Za-z0-9+/_-]{20,}")):
        for m in re.finditer(pattern, text):
            s = m[0].lower() if kind == 3 else m[0]
            most = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))
            if most >= [3.0, 3.9][kind - 3] - 1e-6 and not any(re.search(p, m[0]) for p in secret_scan.ALLOWED):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def secret_texts():
    r = random.Random(4)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    low, token = "0123456789abcdef", secret_scan.ALPHABETS["entropy_token"]
    texts = [
        "password=token:abcdefgh", "token=a secret=abcdefgh", "TOKEN=secret=abcdef", """my api_key": 'abc.def-g' x""", "apikey  =  =====", "passwd:12345 passwd:123456",
        "AKIA" + "B" * 15, "AKIA" + "B" * 16, "xAKIAAKIA" + "0" * 20 + "akia", "AKIA AKIA12", "f" * 23, "f" * 24 + "g" + "0a" * 12, "\U0001f600é " + pick(low, 40) + "\n" + pick(low, 30),
        "ſecret=abcdefgh toKen=abcdefgh", "0123456789abcdef0123456789abcdef", "12345" * 9, "123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
        "a_very_long_name_in_small_letters/and/a/path", "EXAMPLE" + pick(token, 30), "secret" * 30, "secret=" * 400, "x" * 19, pick(low.upper(), 21),
    ]
    texts += [f"see {pick(token, r.randint(18, 60))}, {pick(low, r.randint(18, 30))}; secret {r.choice([':', '= ', ''])}{pick(token, r.randint(3, 9))}" for _ in range(60)]
    return [*texts, None, "", " ".join(texts) * 30]


def test_secrets_equal_plain_scan(spark):
    rows = [*brute.awkward(secret_texts())]
    got = secret_scan.find(brute.table(spark, rows).repartition(3)).collect()
    names = sorted((repr(r[0]), str(plain_spans(r[1]))) for r in rows)
    assert sorted((repr(r.doc_id), str([(s.start, s.kind, s.end) for s in r.spans])) for r in got) == names
    told = {(r.doc_id, r.spans): r for r in secret_scan.report(secret_scan.find(brute.table(spark, rows))).collect()}
    for row in rows:
        spans = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(row[1])]
        r = told[row[0], ",".join(spans)]
        base = [x for x in spans if not x.startswith("entropy")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in secret_scan.BASE)
        assert r.base_sha256 == brute.sha(",".join(base))
    assert secret_scan.report(secret_scan.find(brute.table(spark, []))).collect() == []


def test_window_sums_follow_the_counts(spark):
    r = random.Random(8)
    alphabet = secret_scan.ALPHABETS["entropy_hex"]
    texts = ["".join(r.choice(alphabet[: r.randint(1, 16)]) for _ in range(r.randint(1, 90))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secret_scan.least_window(F.col("t"), alphabet).alias("w"))
    table = secret_scan.weights()
    for t, w in df.collect():
        sums = [sum(table[c] for c in Counter(t[i : i + 20]).values()) for i in range(len(t) - 19)]
        assert w == (min(sums) if sums else None)


def test_a_text_with_very_many_matches(spark):
    text = "token=abcdef " * 40_000
    got = secret_scan.find(brute.table(spark, [(1, text, *[None] * 10)])).collect()[0].spans
    assert len(got) == 40_000 and got[-1].end == len(text) - 1


def test_the_filter_takes_a_few_jobs_whatever_the_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    members = spark.createDataFrame([(k, "en", f"w{i} x", 2) for i in range(300) for k in (1, 2)], "kind int, lang string, phrase string, length int")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("one filter", "")
        bits = collocations._filter(members, 20)
    finally:
        spark.sparkContext.setJobGroup("", "")
        for k, v in old.items():
            spark.conf.set(k, v)
    assert 0 < np.unpackbits(bits).sum() <= 600
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("one filter")) < 8
