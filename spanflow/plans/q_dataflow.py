"""Step 6 queries: data flow on access tables made from the test tables.

``acc`` = events as accesses: var = user_id, order (ts, event_id), a ``view``
defines, every other event uses.  Hot users are cut into hourly chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataflow as D
from ..operators.rowspans import first_occurrences
from ..operators.scan import group_positions
from .common import T
from .q_lists import list_chunk
from .registry import query

def hour():
    """Chunk of the event order: its hour (monotone in (ts, event_id))."""
    return F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)


def events_acc(spark, sf):
    return T(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")


def reaching(spark, sf):
    e = events_acc(spark, sf)
    return D.reaching_defs(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view",
                           idx="event_id", chunk=hour(), name="def_id")


_reach_sql = """
SELECT user_id, event_id AS use_id, def_id, event_type FROM (
  SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
              OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id
  FROM events)"""


@query("reaching_defs", f"SELECT user_id, use_id, def_id FROM ({_reach_sql}) WHERE event_type <> 'view' AND def_id IS NOT NULL")
def reaching_defs(spark, sf):
    r = reaching(spark, sf)
    return r.filter((F.col("event_type") != "view") & F.col("def_id").isNotNull()) \
            .select("user_id", F.col("event_id").alias("use_id"), "def_id")


@query("first_occurrence_edges", """
SELECT doc_id, text, src, idx AS dst FROM (
  SELECT doc_id, idx, text, min(idx) OVER (PARTITION BY doc_id, text) AS src FROM (""" + __import__(
    "spanflow.plans.common", fromlist=["sql_tokens"]).sql_tokens() + """)
  WHERE regexp_full_match(text, '[\\p{L}\\p{M}_][\\p{L}\\p{M}\\p{N}_]*')) WHERE idx > src""")
def first_occurrence_edges(spark, sf):
    return first_occurrences(T(spark, sf, "documents"), definer=r"^[\p{L}\p{M}_][\p{L}\p{M}\p{N}_]*$")


LIST_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]

_pos_sql = """(SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::BIGINT AS pos
              FROM lineitem)"""


def lineitem_acc(spark, sf):
    """lineitem as statements: statement = order, the first row (list order)
    is the assigned name (def), the others are the values."""
    li = T(spark, sf, "lineitem").select("l_orderkey", *LIST_ORDER)
    p = group_positions(li, ["l_orderkey"], LIST_ORDER, "pos", chunk=list_chunk())
    return p.withColumn("role", F.when(F.col("pos") == 0, "def").otherwise("value"))


@query("assignment_edges", f"""
SELECT a.l_orderkey, b.pos AS src, a.pos AS dst FROM {_pos_sql} a JOIN {_pos_sql} b
  ON a.l_orderkey = b.l_orderkey AND a.pos = 0 AND b.pos > 0""")
def assignment_edges(spark, sf):
    e = D.statement_edges(lineitem_acc(spark, sf).withColumnRenamed("pos", "idx"), ["l_orderkey"], "role", "idx")
    return e.filter(F.col("src").isNotNull())


@query("definition_edges", """
SELECT o_orderkey, l_linenumber AS src_line, l_partkey AS src_part, l_suppkey AS src_supp
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def definition_edges(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_orderkey"))
    li = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("src_line"),
                                         F.col("l_partkey").alias("src_part"), F.col("l_suppkey").alias("src_supp"))
    # definition with or without initial values: source-less declarations are kept; written as an
    # inner join + unmatched orders so that AQE can split a hot order on the lineitem side
    return D.outer_as_inner(o, li, ["o_orderkey"])


@query("update_edges", """
SELECT l_orderkey, count(*) AS n_members, count(*) * count(*) AS n_edges FROM lineitem GROUP BY l_orderkey""")
def update_edges(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", F.struct(*LIST_ORDER).alias("idx"))
    return D.update_edges(li, ["l_orderkey"], "idx").select("l_orderkey", "n_members", "n_edges")


_zip_sql = """
WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, turn FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, turn FROM conversations WHERE role = 'assistant'),
     nu AS (SELECT conv_id, count(*) AS n FROM u GROUP BY 1), na AS (SELECT conv_id, count(*) AS n FROM a GROUP BY 1),
     eq AS (SELECT nu.conv_id FROM nu JOIN na ON nu.conv_id = na.conv_id AND nu.n = na.n)
SELECT u.conv_id, u.ord, u.turn AS src, a.turn AS dst, false AS whole FROM u JOIN eq USING (conv_id)
  LEFT JOIN a ON a.conv_id = u.conv_id AND a.ord = u.ord
UNION ALL
SELECT u.conv_id, u.ord, u.turn AS src, NULL::BIGINT AS dst, true AS whole FROM u WHERE conv_id NOT IN (SELECT conv_id FROM eq)"""


@query("zip_assign", _zip_sql)
def zip_assign(spark, sf):
    c = T(spark, sf, "conversations").select("conv_id", "turn", "role")
    # ordinals per side; a long conversation is cut into chunks of 1,000 turns
    chunk = F.floor(F.col("turn") / 1000)
    sides = group_positions(c.filter(F.col("role").isin("user", "assistant")), ["conv_id", "role"], ["turn"], "ord", chunk=chunk)
    counts = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_left"),
                                      F.count_if(F.col("role") == "assistant").alias("n_right"))
    return D.zip_sides(sides, ["conv_id"], F.col("role") == "user", "ord", "turn", counts=counts)


@query("merge_entries", """
SELECT l_partkey, l_returnflag, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS sources
FROM lineitem GROUP BY 1, 2""")
def merge_entries(spark, sf):
    li = T(spark, sf, "lineitem").select("l_partkey", "l_returnflag", F.col("l_suppkey").cast("string").alias("s"))
    m = D.merge_entries(li, ["l_partkey", "l_returnflag"], "s")
    return m.select("l_partkey", "l_returnflag", F.array_join("sources", ",").alias("sources"))


@query("merge_branches", """
SELECT user_id, string_agg(d::VARCHAR, ',' ORDER BY d) AS defs FROM (
  SELECT DISTINCT user_id, arg_max(event_id, (ts, event_id)) AS d FROM events GROUP BY user_id, event_type)
GROUP BY user_id""")
def merge_branches(spark, sf):
    e = events_acc(spark, sf)
    # one variable per user; each event type is a branch; no base state
    m = D.merge_branches(e.withColumn("var", F.lit("x")), ["user_id"], "var", "event_type",
                         "event_id", ["ts", "event_id"])
    return m.select("user_id", F.array_join(F.col("defs").cast("array<string>"), ",").alias("defs"))


_loop_sql = """
SELECT DISTINCT conv_id, use_turn, def_turn FROM (
  SELECT conv_id, turn AS use_turn, role,
         last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS)
           OVER (PARTITION BY conv_id ORDER BY pass, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_turn
  FROM (SELECT c.*, p.pass FROM conversations c, (VALUES (0), (1)) p(pass) WHERE role <> 'system'))
WHERE role = 'user' AND def_turn IS NOT NULL"""


@query("loop_edges", _loop_sql)
def loop_edges(spark, sf):
    c = T(spark, sf, "conversations").filter(F.col("role") != "system").select("conv_id", "turn", "role")
    u = D.unroll_loops(c.withColumn("loop", F.col("conv_id")), "loop", 2)
    chunk = F.col("pass") * 1_000_000_000 + F.floor(F.col("turn") / 1000)   # monotone in (pass, turn)
    r = D.reaching_defs(u, ["conv_id"], ["pass", "turn"], F.col("role") == "assistant", idx="turn",
                        chunk=chunk, name="def_turn")
    return r.filter((F.col("role") == "user") & F.col("def_turn").isNotNull()) \
            .select("conv_id", F.col("turn").alias("use_turn"), "def_turn").distinct()


@query("dfg_pruned", f"""
WITH r AS ({_reach_sql})
SELECT user_id, use_id AS event_id, def_id AS src FROM r WHERE def_id IS NOT NULL
UNION ALL
SELECT user_id, use_id AS event_id, def_id AS src FROM r
WHERE def_id IS NULL AND use_id IN (SELECT def_id FROM r WHERE def_id IS NOT NULL)""")
def dfg_pruned(spark, sf):
    r = reaching(spark, sf).select("user_id", "event_id", F.col("def_id").alias("src"))
    return D.prune_dangling(r, ["user_id"], "event_id", "src")


@query("edge_texts", f"""
SELECT r.use_id AS dst, r.def_id AS src, d.event_type AS src_event_type, u.event_type AS dst_event_type, r.user_id
FROM ({_reach_sql}) r JOIN events u ON u.event_id = r.use_id JOIN events d ON d.event_id = r.def_id
WHERE r.event_type <> 'view' AND r.def_id IS NOT NULL""")
def edge_texts(spark, sf):
    r = reaching(spark, sf).filter((F.col("event_type") != "view") & F.col("def_id").isNotNull())
    edges = r.select("user_id", F.col("def_id").alias("src"), F.col("event_id").alias("dst"))
    ev = T(spark, sf, "events").select("user_id", F.col("event_id").alias("idx"), "event_type")
    return D.resolve_edges(edges, ev, ["user_id"], "idx", ["event_type"])
