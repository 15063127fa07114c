"""Plain single-machine versions of what the operators compute, and awkward documents."""

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, digest string, at int, size string, kept int, ids string"


def awkward(extra=()):
    """Null, empty, tiny, repeated and long texts, ties, a row without id, and columns that clash with internal names."""
    long = " ".join(f"w{i % 97}x{i % 89}" for i in range(6000))
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood where no one lives at all today"
    texts = [
        None, "", " \n\t ", "one", "One", "one two three four", base, base.upper(), base + " tail", "x " + base, long,
        long + " changed end", "ÄÖ   straße 東京 don't 'll 12½\r\n\r\n", "a\nb\na\nb\na\nb", "\n\n\n", base + "\n" + base, *extra,
    ]
    langs = ["en", None, "de"]
    rows = [(i * 3 + 1, t, langs[i % 3], [None, "a", "b"][i % 3], len(t) if t else None, "r", 1, "d", 2, "s", 3, "i") for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, base, "en", "a", 5, "r", 1, "d", 2, "s", 3, "i"), (None, None, None, None, None, "r", 1, "d", 2, "s", 3, "i")]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def near_groups(texts):
    """For each text, the index of the first one of its component."""
    sets = [shingles(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    both = Counter((a, b) for ids in holders.values() for k, b in enumerate(ids) for a in ids[:k])
    return roots(len(texts), [p for p, c in both.items() if 100 * c >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - c)])


def repeated(seqs, width):
    """Marks of the units that a window covers which occurs more than once."""
    count = Counter(s[i : i + width] for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        gone = bytearray(len(s))
        for i in range(len(s) - width + 1):
            if count[s[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append(gone)
    return out


def drop_lines(docs, min_words=5):
    """{doc_id: (lines kept, lines removed)} for (doc_id, text) pairs: runs of two lines or one long line, later copies."""
    seen, gone = set(), {}
    for doc_id, text in sorted(docs):
        lines = text.split("\n")
        ink = [i for i, x in enumerate(lines) if re.search(r"[^ \t\n\r\f\v]", x)]
        gone[doc_id] = set()
        for p, i in enumerate(ink):
            single = (lines[i],)
            if len(re.split(r"[ \t\n\r\f\v]+", lines[i].strip(" "))) >= min_words:
                if single in seen:
                    gone[doc_id].add(i)
                seen.add(single)
            if p + 1 < len(ink):
                pair = (lines[i], lines[ink[p + 1]])
                if pair in seen:
                    gone[doc_id] |= {i, ink[p + 1]}
                seen.add(pair)
    return {d: [x for i, x in enumerate(t.split("\n")) if i not in gone[d]] for d, t in docs}, gone


def levels(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing again and again: {source: size} -> {source: target}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            open_.remove(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def made_to_collide(n):
    """Two texts that agree in every polynomial hash modulo 2^64 with an odd base."""
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    return x, y
