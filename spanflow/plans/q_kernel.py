"""Step 1 queries: wrap, guards, keys, resume, split, limits, quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_split, sql_u32
from ..functions.scalars import WRAP_PREFIX, WRAP_SUFFIX, config_name, wrap_code
from ..operators import kernel as K
from .common import SUPPORTED_LANGS, T, sql_str
from .registry import query

_wrap_sql = f"{sql_str(WRAP_PREFIX)} || text || {sql_str(WRAP_SUFFIX)}".replace("\n", "' || chr(10) || '")


@query("wrap_text", f"""
SELECT doc_id, length({_wrap_sql})::BIGINT AS wrapped_len, md5({_wrap_sql}) AS wrapped_md5
FROM documents""")
def wrap_text(spark, sf):
    w = wrap_code(F.col("text"))
    return T(spark, sf, "documents").select("doc_id", F.length(w).cast("long").alias("wrapped_len"),
                                            F.md5(w).alias("wrapped_md5"))


_langs_sql = ", ".join(sql_str(x) for x in SUPPORTED_LANGS)


@query("lang_guard", f"""
SELECT lang, count(*) FILTER (WHERE lang IN ({_langs_sql})) AS accepted,
       count(*) FILTER (WHERE lang NOT IN ({_langs_sql}) OR lang IS NULL) AS rejected
FROM documents GROUP BY lang""")
def lang_guard(spark, sf):
    ok, bad = K.split_supported(T(spark, sf, "documents").select("doc_id", "lang"), "lang", SUPPORTED_LANGS)
    both = ok.withColumn("_ok", F.lit(True)).unionByName(bad.drop("reject_reason").withColumn("_ok", F.lit(False)))
    return both.groupBy("lang").agg(F.count_if("_ok").alias("accepted"), F.count_if(~F.col("_ok")).alias("rejected"))


@query("config_key", """
SELECT 'orderstatus-' || o_orderstatus || '-orderpriority-' || o_orderpriority AS config_key, count(*) AS n
FROM orders GROUP BY 1""")
def config_key(spark, sf):
    o = T(spark, sf, "orders")
    key = config_name(F.col("o_orderstatus"), F.col("o_orderpriority"), names=("orderstatus", "orderpriority"))
    return o.groupBy(key.alias("config_key")).agg(F.count("*").alias("n"))


@query("pending_orders", """
SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def pending_orders(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey")
    done = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.pending(o, done, ["o_orderkey"])


@query("split_counts", f"""
SELECT CASE WHEN {sql_u32("'42:' || doc_id")} % 100 < 50 THEN 0 ELSE 1 END AS split, lang, count(*) AS n
FROM documents GROUP BY ALL""")
def split_counts(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "lang").withColumn("split", hash_split("doc_id", 42, 50))
    return d.groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("first_docs", """
SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 501""")
def first_docs(spark, sf):
    return K.first_docs(T(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"], 501)


@query("quarantine_counts", f"""
SELECT lang, count(*) FILTER (WHERE NOT bad) AS n_ok, count(*) FILTER (WHERE bad) AS n_skipped
FROM (SELECT lang, text IS NULL OR NOT regexp_matches(text, '[^ \\t\\n\\r\\f]') OR contains(text, chr(65533))
               OR NOT regexp_matches(text, '\\p{{L}}{{4}}') AS bad FROM documents) GROUP BY lang""")
def quarantine_counts(spark, sf):
    d = T(spark, sf, "documents")
    err = (F.when(F.col("text").isNull() | ~F.col("text").rlike(r"[^ \t\n\r\f]"), F.lit("no text"))
            .when(F.contains("text", F.lit("\ufffd")), F.lit("undecodable"))
            .when(~F.col("text").rlike(r"\p{L}{4}"), F.lit("no words")))
    return K.quarantine_counts(d.select("lang", "text"), err, ["lang"])
