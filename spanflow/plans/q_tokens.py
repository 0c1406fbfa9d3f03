"""Step 2 queries: spans, lines, labels, named tokens, span text, comment
stripping, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexing import HTML_COMMENT, is_blank, pieces, strip_comments as strip
from ..functions.scalars import span_text as span
from ..operators.kernel import named_tokens as named
from ..operators.rowspans import aligned, lines, tokens
from ..operators.tokens import label_tokens, token_table
from .common import PIECE_PATTERN, T, sql_label, sql_str, sql_tokens
from .registry import query


def doc_tokens(spark, sf, with_lines=False, with_label=False):
    """Tokens with those of a document together, for windows over them."""
    return token_table(T(spark, sf, "documents").select("doc_id", "text"),
                       with_lines=with_lines, with_label=with_label)


def doc_pieces():
    return F.filter(pieces(F.col("text")), lambda p: ~is_blank(p))


@query("token_spans", f"SELECT doc_id, idx, text, char_start, char_end FROM ({sql_tokens()})")
def token_spans(spark, sf):
    return tokens(T(spark, sf, "documents"), with_lines=False)


@query("line_offsets", """
SELECT doc_id, (i - 1)::INTEGER AS line_no,
       coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset,
       length(line)::INTEGER AS length
FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def line_offsets(spark, sf):
    return lines(T(spark, sf, "documents"))


@query("token_labels", f"SELECT doc_id, idx, {sql_label()} AS label FROM ({sql_tokens()})")
def token_labels(spark, sf):
    return label_tokens(tokens(T(spark, sf, "documents"), with_lines=False)).select("doc_id", "idx", "label")


@query("label_histogram", f"SELECT {sql_label()} AS label, count(*) AS n FROM ({sql_tokens()}) GROUP BY 1")
def label_histogram(spark, sf):
    # no positions, so no window: tokens are counted where the documents are read
    t = T(spark, sf, "documents").select(F.explode(doc_pieces()).alias("text"))
    return label_tokens(t).groupBy("label").agg(F.count("*").alias("n"))


@query("named_tokens", f"""
SELECT doc_id, count(*) AS n_named FROM ({sql_tokens()}) WHERE {sql_label()} <> text GROUP BY doc_id""")
def named_tokens(spark, sf):
    # counted before the shuffle, which carries one row a document
    t = T(spark, sf, "documents").select("doc_id", F.explode(doc_pieces()).alias("text"))
    return named(label_tokens(t)).groupBy("doc_id").agg(F.count("*").alias("n_named"))


@query("span_text", """
SELECT doc_id, substr(l[1], 6) || substr(l[2], 1, 5) AS span
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) >= 2""")
def span_text(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", span(F.col("text"), 0, 5, 1, 5).alias("span"))
    return d.filter(F.col("span").isNotNull())


@query("strip_comments", f"""
SELECT page_id, length(html)::BIGINT AS len_before,
       length(array_to_string(list_filter(string_split(regexp_replace(html, {sql_str(HTML_COMMENT)}, '', 'g'), chr(10)),
                                          lambda x: NOT regexp_full_match(x, '[ \\t\\r\\f]*')), chr(10)))::BIGINT AS len_after
FROM pages""")
def strip_comments(spark, sf):
    p = T(spark, sf, "pages")
    return p.select("page_id", F.length("html").cast("long").alias("len_before"),
                    F.length(strip(F.col("html"), "html")).cast("long").alias("len_after"))


@query("align_tokens", f"""
WITH a AS ({sql_tokens()}),
     b AS ({sql_tokens(pattern=PIECE_PATTERN)}),
     ab AS (SELECT a.doc_id, a.idx, unnest(generate_series(a.char_start // 64, greatest(a.char_end - 1, a.char_start) // 64)) AS bucket, a.char_start AS s, a.char_end AS e FROM a),
     bb AS (SELECT b.doc_id, b.idx, unnest(generate_series(b.char_start // 64, greatest(b.char_end - 1, b.char_start) // 64)) AS bucket, b.char_start AS s, b.char_end AS e FROM b)
SELECT ab.doc_id, ab.idx, coalesce(string_agg(bb.idx::VARCHAR, ',' ORDER BY bb.idx), '') AS piece_ids
FROM ab LEFT JOIN bb ON ab.doc_id = bb.doc_id AND ab.bucket = bb.bucket AND ab.s < bb.e AND bb.s < ab.e
     AND ab.bucket = greatest(ab.s, bb.s) // 64
GROUP BY ab.doc_id, ab.idx""")
def align_tokens(spark, sf):
    al = aligned(T(spark, sf, "documents"))
    return al.select("doc_id", "idx", F.array_join(F.col("piece_ids").cast("array<string>"), ",").alias("piece_ids"))
