"""Secrets in texts: three fixed patterns, and strings of high entropy in a sliding window. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareframe.llm.scratch import written


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api"))) + "_?" + _either_case("key")
VALUE = r"[A-Za-z0-9+/_.=-]+"
#: Patterns of the base kinds and of the candidates for entropy, in the order in which kinds are listed.
PATTERNS = {
    "assign": rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?{VALUE}""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "entropy_hex": r"[0-9A-Fa-f]{20,}",
    "entropy_token": r"[A-Za-z0-9+/_-]{20,}",
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
LEAST_VALUE = 6
#: Characters in a window; the shortest candidate has one window.
WINDOW = 20
#: Bits a character from which a window counts as random, by class of characters.
BITS = {"entropy_hex": 3.0, "entropy_token": 3.9}
ALPHABETS = {"entropy_hex": "0123456789abcdef", "entropy_token": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"}
#: Candidates that hold one of these are no secrets: numbers, words and slugs, UUIDs, alphabets in order, placeholders.
ALLOWED = (
    r"^[0-9]+$",
    r"^[A-Za-z]+$",
    r"^[a-z/_-]+$",
    r"^[A-Z/_-]+$",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"0123456789|1234567890|abcdefghij|ABCDEFGHIJ",
    r"[xX]{6}|[eE][xX][aA][mM][pP][lL][eE]|[sS][aA][mM][pP][lL][eE]|[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR]",
)
_UNIT = 1 << 20


def weights(window: int = WINDOW) -> list[int]:
    """n log2 n in units of 2^-20 for n of 0 to the window: whole numbers, so that sums agree in any order."""
    return [round(n * math.log2(n) * _UNIT) if n else 0 for n in range(window + 1)]


def most_weight(kind: str, window: int = WINDOW) -> int:
    """The greatest sum of ``weights`` over a window's characters at which its entropy reaches the limit of the kind.

    With n_c of each character, the entropy is log2 w - sum(n_c log2 n_c) / w.
    """
    return math.floor(window * (math.log2(window) - BITS[kind]) * _UNIT)


def least_window(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The least sum of ``weights`` over the windows of a string; null if it is shorter than a window.

    The counts of a window are kept as it moves: one character enters, one leaves, and the sum changes by theirs alone.
    """
    table = F.array(*[F.lit(x).cast("long") for x in weights(window)])

    def weight(n: Column) -> Column:
        return F.coalesce(F.get(table, n), F.lit(0).cast("long"))

    def slide(codes: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            out = F.when(a["at"] >= window, F.coalesce(F.get(codes, a["at"] - window), F.lit(-1))).otherwise(F.lit(-1))
            n_in, n_out = F.coalesce(F.get(a["n"], x), F.lit(0)), F.coalesce(F.get(a["n"], out), F.lit(0))
            change = F.when(x == out, F.lit(0).cast("long")).otherwise(
                weight(n_in + 1) - weight(n_in) + F.when(out >= 0, weight(n_out - 1) - weight(n_out)).otherwise(F.lit(0).cast("long"))
            )
            counts = F.transform(a["n"], lambda v, k: v + F.when(k == x, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
            total = a["sum"] + change
            least = F.when(a["at"] + 1 >= window, F.least(a["least"], total)).otherwise(a["least"])
            return F.struct((a["at"] + 1).alias("at"), counts.alias("n"), total.alias("sum"), least.alias("least"))

        start = F.struct(
            F.lit(0).alias("at"), F.array(*[F.lit(0)] * len(alphabet)).alias("n"),
            F.lit(0).cast("long").alias("sum"), F.lit(1 << 62).cast("long").alias("least"),
        )
        return F.aggregate(codes, start, step, lambda a: F.when(a["at"] >= window, a["least"]))

    # A transform over one value binds the codes, which a lambda would else compute anew for each character.
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return F.get(F.transform(F.array(codes), slide), F.lit(0))


def _counts(kind: str, hit: Column, allowed: Sequence[str]) -> Column:
    """Whether a match of the kind's pattern is reported."""
    if kind == "assign":
        value = F.regexp_extract(hit, rf"""["']?\x20*[:=]\x20*["']?({VALUE})$""", 1)
        return F.length(value) >= LEAST_VALUE
    if kind not in BITS:
        return F.lit(True)
    folded = F.lower(hit) if kind == "entropy_hex" else hit
    harmless = F.lit(False)
    for pattern in allowed:
        harmless = harmless | hit.rlike(pattern)
    return F.when(harmless, False).otherwise(F.coalesce(least_window(folded, ALPHABETS[kind]) <= most_weight(kind), F.lit(False)))


def _matches(kind: str, text: Column, allowed: Sequence[str]) -> Column:
    """Each match as its kind, its place among those of the kind, the code points since the one before, its own, and
    whether it is reported."""
    both = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hit"))
    both = F.filter(both, lambda z: z["hit"].isNotNull())
    return F.transform(
        both,
        lambda z, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("size"),
            _counts(kind, z["hit"], allowed).alias("counts"),
        ),
    )


def find(docs: DataFrame, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """doc_id, spans: an array of (start, kind, end) per row, by start and then by kind; places are code points.

    Kinds are numbered as in ``KINDS``. The first three are fixed patterns; for ``assign`` all matches are taken from
    left to right first, and those whose value has fewer than six characters are dropped afterwards. The other two are
    maximal strings of 20 and more characters of one class that hold a window of 20 characters with an entropy of at
    least 3.0 (hexadecimal digits, in either case) or 3.9 bits (letters, digits and ``+/_-``), unless a pattern of the
    allow list occurs in them. A string may be reported by several kinds.

    A text is read once; only matches leave the scan, as numbers. Their places are running sums per row, and the rows
    with matches are dealt out by row, so memory follows the number of matches of one text.

    Defined cases: null and empty texts have no spans; every row counts for itself, repeated rows and null doc_ids too;
    other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[_matches(kind, text, allowed) for kind in KINDS])
    # Written, so that a row's number stays the same when a part is computed again.
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found")), "secret-matches")
    quiet = rows.where(F.size("found") == 0)
    loud = rows.where(F.size("found") > 0).repartition("row").select("row", "doc_id", F.explode("found").alias("m")).select("row", "doc_id", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    loud = loud.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    span = F.when(F.col("counts"), F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))
    spans = loud.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return spans.select("doc_id", "spans").unionAll(quiet.select("doc_id", none.alias("spans")))


def report(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return spans.select("doc_id", *[of(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
