"""Registered queries of the corpus operators over the given tables, and their
DuckDB SQL.  Each applies its operator with production parameters to the whole
table and derives the fixed result columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (blob_ledger, decontaminate, jaccard_join, langid, license, line_dedup, max_sketch, merkle, packing, quality,
               substring_dedup, url_filter, warc)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Word classes as DuckDB patterns.
ALNUM_SQL = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
BLANK_SQL = r"'[^\x20\x09-\x0D]+'"
#: Lower-cases A-Z only.
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return deco


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, {ALNUM_SQL}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER_SQL}, {ALNUM_SQL}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) AS t(i)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k FROM d, ks WHERE len(w) >= k), unnest(range(1, len(w) - k + 2)) AS t(i)),
m AS (SELECT doc_id, k, i, item FROM dw JOIN bw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p
      FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"),
                       decontaminate.contaminated().alias("contaminated"))


_RULES_SQL = " + ".join(f"CASE WHEN {cond} THEN {1 << bit} ELSE 0 END" for bit, _, cond in quality.RULES)
_V = quality.POLICIES[quality.CURRENT]


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {BLANK_SQL}) AS w FROM documents),
tri AS (SELECT doc_id, i, w[i:i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY 1),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, {BLANK_SQL}) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks
      FROM d LEFT JOIN rw USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, CAST({_RULES_SQL} AS BIGINT) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       (failed_rules & {_V.mask(_V.reject)}) = 0 AND bit_count(failed_rules & {_V.mask(_V.weak)}) <= {_V.allowed} AS kept,
       failed_rules
FROM f""")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    rows = quality.apply_policy(rows, quality.CURRENT).withColumn("base_ok", quality.BASE.keeps(F.col("failed_rules")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("base_ok")).alias("base_failed"), (F.col("kept") & F.col("base_ok")).alias("kept"),
                       "failed_rules")


@query(f"""
WITH ln AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS l
            FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, pos, l FROM ln WHERE regexp_matches(l, {BLANK_SQL})),
w AS (SELECT doc_id, pos AS p0, lead(pos) OVER o AS p1, l AS l0, lead(l) OVER o AS l1 FROM c
      WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, p0, p1 FROM (SELECT *, row_number() OVER (PARTITION BY l0, l1 ORDER BY doc_id, p0) AS rn
          FROM w WHERE p1 IS NOT NULL) WHERE rn > 1),
alone AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY doc_id, pos) AS rn
          FROM c WHERE len(regexp_extract_all(l, {BLANK_SQL})) >= {line_dedup.SINGLE}) WHERE rn > 1),
gone AS (SELECT doc_id, p0 AS pos FROM later UNION SELECT doc_id, p1 FROM later UNION SELECT doc_id, pos FROM alone),
k AS (SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
        coalesce(string_agg(l, chr(10) ORDER BY ln.pos) FILTER (WHERE gone.pos IS NULL), '') AS t
      FROM ln LEFT JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(t) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=("n_lines", "n_removed"), single=line_dedup.SINGLE)
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, {BLANK_SQL}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b USING (s) GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""")
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


@query()
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_filter.judge(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust", "suspicion")


@query()
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {BLANK_SQL}) AS w FROM documents),
p AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM p) WHERE c > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM hit),
lst AS (SELECT r, list(i) AS x FROM gone GROUP BY 1),
k AS (SELECT doc_id, w, coalesce(len(x), 0) AS n_removed, d.r FROM d LEFT JOIN lst USING (r)),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM
  (SELECT d.r, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d) u ANTI JOIN gone USING (r, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM k LEFT JOIN left_over USING (r)""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = langid.identify(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "held_out", "lang_pred", "score")


@query("""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(s, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to, true AS intact FROM k""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archived(table(spark, sf_dir, "pages"))
    return rows.select(F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"),
                       F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "intact")


def _found_sql(no: int, rule: blob_ledger.Rule) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {no} AS no, '{rule.kind}' AS kind, {rule.least} AS least, generate_subscripts(m, 1) AS i,
  unnest(m) AS x, unnest(g) AS v, unnest(s[1:len(m)]) AS gap
  FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {rule.group}) AS g,
        string_split_regex(t, {pattern}) AS s FROM d)"""


_BASE_KINDS = ("assign", "access", "hex")


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found_sql(no, r) for no, r in enumerate(blob_ledger.RULES))}),
p AS (SELECT *, CAST(sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, no ORDER BY i) AS BIGINT) AS e FROM f),
s AS (SELECT doc_id, no, kind, e - length(x) AS b, kind || ':' || (e - length(x)) || ':' || e AS span FROM p WHERE length(v) >= least),
g AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
        string_agg(span, ',' ORDER BY b, no) FILTER (no < 3) AS base, string_agg(span, ',' ORDER BY b, no) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)""")
def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blob_ledger.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = blob_ledger.spelled(of(*_BASE_KINDS))
    return rows.select("doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in _BASE_KINDS],
                       F.sha2(base.cast("binary"), 256).alias("base_sha256"), blob_ledger.spelled(F.col("spans")).alias("spans"))


_TERMS_SQL = f"regexp_extract_all({LOWER_SQL}, " + r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(f"""
WITH t AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, c),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM dl, c),
q AS (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _merkle_sql(levels: int) -> str:
    """Trees of up to 16 ** levels leaves, one common table expression a level; a
    tree's root stays as it is on the levels above it."""
    def field(c, text=None):
        v = text or f"CAST({c} AS VARCHAR)"
        return f"coalesce(strlen({v}) || ':' || {v}, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def of(text):
        return "sha256(" + " || ".join(field(c, text if c == "text" else None) for c in merkle.FIELDS) + ")"
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

    def level(k, a, tree):
        """Nodes of level k + 1, and of level k with the digests beside each."""
        over = f"OVER (PARTITION BY {tree}, p // 16 ORDER BY p ROWS BETWEEN"
        return f"""{a}s{k} AS (SELECT {tree}, p, size, d,
  CASE WHEN size > 1 THEN coalesce(string_agg(d, '') {over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
  CASE WHEN size > 1 THEN coalesce(string_agg(d, '') {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {a}{k}),
{a}{k + 1} AS (SELECT {tree}, p // 16 AS p, (any_value(size) + 15) // 16 AS size,
  CASE WHEN any_value(size) > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE any_value(d) END AS d FROM {a}{k} GROUP BY {tree}, p // 16)"""

    def path(k, a, b, at, tree):
        """Folded digest and proof of every leaf after level k."""
        return f"""{b}{k + 1} AS (SELECT x.* EXCLUDE (f, w), CASE WHEN s.size > 1 THEN sha256(s.l || f || s.r) ELSE f END AS f, w || s.l || s.r AS w
  FROM {b}{k} x JOIN {a}s{k} s ON s.{tree} = x.{tree} AND s.p = x.{at} // {16 ** k})"""
    n = range(levels)
    return f"""WITH h AS (SELECT doc_id, coalesce('v' || source, 'n') AS tree, {of("text")} AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN {of(lower)} ELSE {of("text")} END AS shown FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS q, count(*) OVER (PARTITION BY tree) AS size FROM h),
a0 AS (SELECT tree, q AS p, size, leaf AS d FROM g),
{", ".join(level(k, "a", "tree") for k in n)},
top AS (SELECT 0 AS one, tree, d, row_number() OVER (ORDER BY tree) - 1 AS q, count(*) OVER () AS size FROM a{levels}),
b0 AS (SELECT one, q AS p, size, d FROM top),
{", ".join(level(k, "b", "one") for k in n)},
x0 AS (SELECT doc_id, leaf, tree, q, shown AS f, '' AS w FROM g),
{", ".join(path(k, "a", "x", "q", "tree") for k in n)},
y0 AS (SELECT x.doc_id, x.leaf, x.f, x.w, t.one, t.q, t.d AS subroot FROM x{levels} x JOIN top t USING (tree)),
{", ".join(path(k, "b", "y", "q", "one") for k in n)}
SELECT doc_id, leaf, subroot, b.d AS root, sha256(w) AS proof_sha256, f AS folded_root, f = b.d AS verified
FROM y{levels}, b{levels} b"""


@query(_merkle_sql(5))
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = merkle.manifest(docs, altered=(tampered, {"text": merkle.lowered()}), keep=["doc_id"])
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("proof"))).alias("proof_sha256"),
                       "folded_root", "verified")
