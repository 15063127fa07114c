"""One registered query per operator, with production parameters over its whole table, and the SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareframe.llm import (
    bpe,
    collocations,
    embeddings,
    fingerprints,
    language,
    line_runs,
    minhash,
    mixing,
    secret_scan,
    substrings,
    suffix_index,
    token_counts,
    vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("op1_near_duplicates")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(documents(spark, sf), public_tokenizers.path(VOCABULARY))


@query("op3_token_counts")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf), public_tokenizers.path(VOCABULARY))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_index.digests(documents(spark, sf))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS x FROM d),
ink AS (
  SELECT doc_id, i, x, len(regexp_split_to_array(trim(x), '\s+')) >= 5 AS long,
         row_number() OVER w AS p, lead(x) OVER w AS y, lead(i) OVER w AS j
  FROM l WHERE regexp_matches(x, '\S') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, p) AS nth FROM ink WHERE y IS NOT NULL),
ones AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS nth FROM ink WHERE long),
gone AS (
  SELECT doc_id, i FROM ones WHERE nth > 1 UNION SELECT doc_id, i FROM pairs WHERE nth > 1
  UNION SELECT doc_id, j FROM pairs WHERE nth > 1),
kept AS (
  SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS text, count(*) AS n
  FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(d.lines) - coalesce(n, 0), 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op5_line_runs", OP5_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    out = line_runs.drop_repeated_runs(documents(spark, sf))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(documents(spark, sf))


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.digests(documents(spark, sf))


@query("op8_fingerprints")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf))


@query("op9_embedding_duplicates")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source),
w AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS cap FROM s),
r AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
lam AS (SELECT *, max(CASE WHEN rate * w <= cap THEN rate END) OVER () AS lam FROM r),
t AS (
  SELECT source, source_size, least(cap, coalesce(lam * w, cap)) AS target,
         CASE WHEN source_size > 0 THEN least(cap, coalesce(lam * w, cap)) / source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5(coalesce(source, '') || ':mix'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM lam),
h AS (
  SELECT d.*, md5(doc_id::VARCHAR || ':mix') AS h,
         CAST(least(8, greatest(0, ceil(log2(docs / 20000.0::DOUBLE) / 4))) AS INTEGER) AS digits
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (
  SELECT *, row_number() OVER (
    PARTITION BY source ORDER BY floor(log2(size + 1.0::DOUBLE) * 8 + 1e-9), substr(h, 1, digits), size, h, doc_id) AS place FROM h)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, t.source_size, t.target,
       CAST(p.size * (floor(place * t.rate + t.u) - floor((place - 1) * t.rate + t.u)) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


@query("op10_mixing", OP10_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    out = mixing.mixed(documents(spark, sf))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _op11_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """A round is a join of all parts with their position's entries; all rounds stand one after another."""
    nearest = """{a} AS (
  SELECT v.r, v.k, arg_min(b.e, (dist(v.x, b.x), b.e)) AS e, min(dist(v.x, b.x)) AS d
  FROM v JOIN {b} b USING (k) GROUP BY v.r, v.k)"""
    move = """{c} AS (
  SELECT b.k, b.e, coalesce(m.x, b.x) AS x FROM {b} b LEFT JOIN (
    SELECT k, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (
      SELECT v.k, a.e, i, CAST(sum(v.x[i]) AS DOUBLE) AS s, count(*) AS n
      FROM v JOIN {a} a USING (r, k), range(1, len(v.x) + 1) t(i) GROUP BY v.k, a.e, i)
    GROUP BY k, e) m USING (k, e))"""
    steps = [nearest.format(a=f"a{t}", b=f"b{t}") + (",\n" + move.format(c=f"b{t + 1}", b=f"b{t}", a=f"a{t}") if t < rounds else "") for t in range(rounds + 1)]
    table = ",\n".join(steps).replace("dist(v.x, b.x)", "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))")
    return f"""
WITH q AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, k, q[k * (len(q) // {parts}) + 1 : (k + 1) * (len(q) // {parts})] AS x FROM q, range({parts}) t(k)),
b0 AS (SELECT k, r - 1 AS e, x FROM v WHERE r <= {entries}),
{table},
books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b{rounds}),
coded AS (
  SELECT r, string_agg(lower(printf('%02x', CAST(e AS INTEGER))), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN q USING (r), books
"""


@query("op11_vector_codes", _op11_sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.coded(spark.read.parquet(f"{sf}/embeddings.parquet"))


OP12_SQL = r"""
WITH w AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
x AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM w),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM x),
g AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places, range(1, 6) t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
langs AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f FROM g WHERE f >= 100),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS rest, j
  FROM c, range(1, 5) t(j) WHERE j < c.k),
scored AS (
  SELECT cuts.*, h.f AS l, r.f AS r, n, CAST((1000::HUGEINT * a * n) // (h.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts JOIN c h ON h.lang = cuts.lang AND h.phrase = head JOIN c r ON r.lang = cuts.lang AND r.phrase = rest
  JOIN langs ON langs.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(f) AS covered
  FROM c, range(2, 5) s(m), range(1, 5) t(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * covered < 100 * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf))


def _op13_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    kinds = secret_scan.KINDS
    scans = " UNION ALL ".join(
        f"SELECT r, {i} AS kind, generate_subscripts(regexp_extract_all(t, {quoted(p)}), 1) AS nth, unnest(regexp_extract_all(t, {quoted(p)})) AS hit, "
        f"unnest(string_split_regex(t, {quoted(p)})[:-2]) AS gap FROM d WHERE regexp_matches(t, {quoted(p)})"
        for i, p in enumerate(secret_scan.PATTERNS.values())
    )
    limits = ", ".join(f"({kinds.index(k)}, {secret_scan.most_weight(k)})" for k in secret_scan.BITS)
    table = str(secret_scan.weights())
    allowed = " OR ".join(f"regexp_matches(hit, {quoted(p)})" for p in secret_scan.ALLOWED)
    value = quoted(rf"""["']?\x20*[:=]\x20*["']?({secret_scan.VALUE})$""")
    names = "[" + ", ".join(quoted(k) for k in kinds) + "]"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secret_scan.BASE))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY nth) AS e FROM ({scans})),
limits(kind, most) AS (VALUES {limits}),
candidate AS (SELECT DISTINCT kind, hit, CASE WHEN kind = 3 THEN lower(hit) ELSE hit END AS s FROM m WHERE kind >= 3 AND NOT ({allowed})),
letters AS (
  SELECT kind, hit, i, unnest(string_split(substr(s, i, {secret_scan.WINDOW}), '')) AS ch
  FROM (SELECT *, unnest(range(1, length(s) - {secret_scan.WINDOW} + 2)) AS i FROM candidate)),
windows AS (
  SELECT kind, hit, i, sum({table}[n + 1]) AS weight
  FROM (SELECT kind, hit, i, ch, count(*) AS n FROM letters GROUP BY ALL) GROUP BY kind, hit, i),
random AS (SELECT DISTINCT kind, hit FROM windows JOIN limits USING (kind) WHERE weight <= most),
spans AS (
  SELECT r, kind, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM m
  WHERE CASE WHEN kind = 0 THEN length(regexp_extract(hit, {value}, 1)) >= {secret_scan.LEAST_VALUE}
             WHEN kind < 3 THEN true ELSE (kind, hit) IN (SELECT (kind, hit) FROM random) END),
told AS (
  SELECT r, {counts},
         string_agg(concat_ws(':', {names}[kind + 1], s, e), ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
         string_agg(concat_ws(':', {names}[kind + 1], s, e), ',' ORDER BY s, kind) AS spans FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scan.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
"""


@query("op13_secrets", _op13_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.report(secret_scan.find(documents(spark, sf)))
