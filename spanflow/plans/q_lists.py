"""Step 4 queries: lists and numbers over lineitem/part/customer/embeddings,
and the numeric dataset generators (samples = orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import OPS, compare_op, flatten_matrix, number_words as words, sigmoid_threshold, signed_log
from ..functions.scalars import split_statements as split_stmts
from ..operators.generate import Config, gen_compare, gen_numeric, generate
from ..operators.kernel import first_n_per_group as first_n
from ..operators.lists import argmax, argmax_onehot as onehot, group_max_flags, group_sum_log, pad_groups
from .common import (T, r6, sql_draw_float, sql_draw_int, sql_number_words, sql_signed_log, sql_str)
from .registry import query

LIST_KEY = ["l_orderkey"]
LIST_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def list_chunk():
    """Chunks of a (possibly hot) order along its list order: (line number,
    part key / 1000) never decreases along (line number, part, supplier)."""
    return F.struct(F.col("l_linenumber"), F.floor(F.col("l_partkey") / 1000).alias("pk"))


@query("max_multihot", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       (l_quantity = max(l_quantity) OVER (PARTITION BY l_orderkey))::INTEGER AS is_max
FROM lineitem""")
def max_multihot(spark, sf):
    li = T(spark, sf, "lineitem").select(*LIST_KEY, *LIST_ORDER, "l_quantity")
    return group_max_flags(li, LIST_KEY, "l_quantity").drop("l_quantity")


@query("row_sum_log", f"""
SELECT l_orderkey, round(sum(l_quantity), 6) AS row_sum, round({sql_signed_log('sum(l_quantity)')}, 6) AS row_sum_log
FROM lineitem GROUP BY l_orderkey""")
def row_sum_log(spark, sf):
    g = group_sum_log(T(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), LIST_KEY, "l_quantity")
    return g.select("l_orderkey", r6(F.col("row_sum")).alias("row_sum"), r6(F.col("row_sum_log")).alias("row_sum_log"))


@query("signed_log", f"SELECT c_custkey, round({sql_signed_log('c_acctbal')}, 6) AS slog FROM customer")
def signed_log_q(spark, sf):
    return T(spark, sf, "customer").select("c_custkey", r6(signed_log(F.col("c_acctbal"))).alias("slog"))


@query("argmax_onehot", """
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS argmax,
       array_to_string(list_transform(range(len(embedding)),
           lambda i: CASE WHEN i = list_position(embedding, list_max(embedding)) - 1 THEN 1 ELSE 0 END), ',') AS onehot
FROM embeddings""")
def argmax_onehot(spark, sf):
    e = T(spark, sf, "embeddings")
    return e.select("vec_id", argmax(F.col("embedding")).alias("argmax"),
                    F.array_join(onehot(F.col("embedding")).cast("array<string>"), ",").alias("onehot"))


@query("pad_lists", """
WITH sizes AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
     mx AS (SELECT max(n) AS L FROM sizes)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::BIGINT AS pos,
       l_quantity AS l_quantity, false AS is_pad FROM lineitem
UNION ALL
SELECT l_orderkey, unnest(generate_series(n, L - 1))::BIGINT AS pos, 0.0 AS l_quantity, true AS is_pad
FROM sizes, mx""")
def pad_lists(spark, sf):
    li = T(spark, sf, "lineitem").select(*LIST_KEY, *LIST_ORDER, "l_quantity")
    return pad_groups(li, LIST_KEY, LIST_ORDER, "l_quantity", 0.0, chunk=list_chunk())


@query("first_n_per_group", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank
  FROM lineitem) WHERE rank <= 3""")
def first_n_per_group(spark, sf):
    li = T(spark, sf, "lineitem").select(*LIST_KEY, *LIST_ORDER)
    return first_n(li, LIST_KEY, LIST_ORDER, 3).withColumn("rank", F.col("rank").cast("long"))


@query("number_words", f"SELECT p_partkey, p_size, {sql_number_words('p_size')} AS words FROM part")
def number_words(spark, sf):
    return T(spark, sf, "part").select("p_partkey", "p_size", words(F.col("p_size")).alias("words"))


_OP_COLS = {"<": "lt", ">": "gt", ">=": "ge", "<=": "le", "==": "eq"}


@query("compare_ops", "SELECT p_partkey, " + ", ".join(
    f"p_size {op if op != '==' else '='} p_retailprice / 30 AS {c}" for op, c in _OP_COLS.items()) + " FROM part")
def compare_ops(spark, sf):
    p = T(spark, sf, "part")
    rhs = F.col("p_retailprice") / 30
    return p.select("p_partkey", *[compare_op(F.col("p_size"), F.lit(op), rhs).alias(c) for op, c in _OP_COLS.items()])


@query("threshold", """
SELECT label, round(sum(len(list_filter(embedding, lambda x: 1.0 / (1.0 + exp(-x)) > 0.5)))::DOUBLE
                    / sum(len(embedding)), 6) AS share
FROM embeddings GROUP BY label""")
def threshold(spark, sf):
    e = T(spark, sf, "embeddings")
    pos = F.size(F.filter("embedding", lambda x: sigmoid_threshold(x)))
    return e.groupBy("label").agg(r6(F.sum(pos) / F.sum(F.size("embedding"))).alias("share"))


@query("flatten_vectors", """
SELECT vec_id, len(embedding)::INTEGER AS n_dims,
       round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) AS checksum FROM embeddings""")
def flatten_vectors(spark, sf):
    e = T(spark, sf, "embeddings")
    # each row's vector as a token x dim matrix (rows of 4), flattened again
    starts = F.sequence(F.lit(1), F.size("embedding"), F.lit(4))
    rows = e.select("vec_id", "embedding", starts.alias("at"))
    rows = rows.withColumn("matrix", F.transform("at", lambda i: F.slice("embedding", i, F.lit(4))))
    flat = flatten_matrix(F.col("matrix"))
    return rows.select("vec_id", F.size(flat).alias("n_dims"),
                       F.round(F.aggregate(F.transform(flat, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0),
                                           lambda a, b: a + b), 4).alias("checksum"))


@query("split_statements", r"""
SELECT conv_id, turn, len(parts)::INTEGER AS n_statements, parts[1] AS first_statement FROM (
  SELECT conv_id, turn, list_transform(string_split(text, '.'),
         lambda s: regexp_replace(s, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')) AS parts FROM conversations)""")
def split_statements(spark, sf):
    c = T(spark, sf, "conversations")
    parts = split_stmts(F.col("text"), ".")
    return c.select("conv_id", "turn", F.size(parts).alias("n_statements"), F.element_at(parts, 1).alias("first_statement"))


# --- generators: samples are the orders --------------------------------------
LIST_CONFIGS = [Config(0.0, 100.0, 0, 5, "ints", "list_maximum"), Config(0.0, 1.0, 0, 5, "floats", "list_maximum"),
                Config(0.0, 99.0, 0, 5, "words", "list_maximum"), Config(1.0, 50.0, 0, 5, "negatives", "list_maximum")]
DECODE_CONFIG = Config(0.0, 1000.0, 0, 1, "ints", "decoding")
ADD_CONFIG = Config(0.0, 100.0, 0, 5, "ints", "addition")
COMPARE_CONFIG = Config(0.0, 20.0, 0, 3, "var+comparative_int", "logic")


def _samples(spark, sf):
    return T(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"))


def sql_values(cfg: Config, m: int) -> tuple[str, str]:
    """(nums, texts) DuckDB list expressions for one sample (column sample_id)."""
    key = lambda i: f"{sql_str(cfg.name + ':')} || sample_id || ':' || {i}"
    if cfg.type == "floats":
        nums = f"list_transform(range({m}), lambda i: {sql_draw_float(cfg.min, cfg.max, key('i'))})"
        return nums, f"list_transform({nums}, lambda x: printf('%.6f', x))"
    lo, hi = (int(cfg.min), int(cfg.max)) if cfg.type != "negatives" else (-int(cfg.max), -int(cfg.min))
    nums = f"list_transform(range({m}), lambda i: {sql_draw_int(lo, hi, key('i'))})"
    if cfg.type == "words":
        return nums, f"list_transform({nums}, lambda x: {sql_number_words('x')})"
    return nums, f"list_transform({nums}, lambda x: x::VARCHAR)"


def _sql_list_max(cfg):
    nums, texts = sql_values(cfg, cfg.m)
    return (f"SELECT {sql_str(cfg.name)} AS config_name, o_orderkey AS sample_id, array_to_string({texts}, ' ') AS inps, "
            f"array_to_string(list_transform(nums, lambda x: (x = list_max(nums))::INTEGER), ',') AS y_vec "
            f"FROM (SELECT o_orderkey, o_orderkey AS sample_id, {nums} AS nums FROM orders)")


def _joined(df, arr_cols):
    out = df
    for c in arr_cols:
        out = out.withColumn(c, F.array_join(F.col(c).cast("array<string>"), "," if c.startswith("y_") else " "))
    return out


@query("gen_list_max", "\nUNION ALL\n".join(_sql_list_max(c) for c in LIST_CONFIGS))
def gen_list_max(spark, sf):
    s = _samples(spark, sf)
    out = None
    for cfg in LIST_CONFIGS:
        df = _joined(gen_numeric(s, cfg), ["inps", "y_vec"])
        out = df if out is None else out.unionByName(df)
    return out


def _sql_scalar_gen(cfg, label):
    nums, texts = sql_values(cfg, cfg.m)
    return (f"SELECT {sql_str(cfg.name)} AS config_name, sample_id, array_to_string({texts}, ' ') AS inps, "
            f"round({label}, 6) AS y_num FROM (SELECT o_orderkey AS sample_id, {nums} AS nums FROM orders)")


@query("gen_decoding", _sql_scalar_gen(DECODE_CONFIG, sql_signed_log("nums[1]")))
def gen_decoding(spark, sf):
    df = _joined(gen_numeric(_samples(spark, sf), DECODE_CONFIG), ["inps"])
    return df.withColumn("y_num", r6(F.col("y_num")))


@query("gen_addition", _sql_scalar_gen(ADD_CONFIG, sql_signed_log("list_sum(nums)")))
def gen_addition(spark, sf):
    df = _joined(gen_numeric(_samples(spark, sf), ADD_CONFIG), ["inps"])
    return df.withColumn("y_num", r6(F.col("y_num")))


def _sql_compare(cfg):
    key = lambda *p: sql_str(cfg.name + ":") + " || sample_id || " + " || ".join(f"':' || {x}" for x in p)
    x = sql_draw_int(int(cfg.min), int(cfg.max), key("'X'"), inclusive=True)
    y = sql_draw_int(int(cfg.min), int(cfg.max), key("'Y'"), inclusive=True)
    ops = "[" + ", ".join(sql_str(o) for o in OPS) + "]"
    op_i = f"{ops}[{sql_draw_int(0, len(OPS), key(sql_str('op'), 'i'))} + 1]"
    cmp = ("CASE o WHEN '<' THEN x < y WHEN '>' THEN x > y WHEN '>=' THEN x >= y "
           "WHEN '<=' THEN x <= y WHEN '==' THEN x = y END")
    return f"""
SELECT {sql_str(cfg.name)} AS config_name, sample_id,
       'X = ' || x || ' ; Y = ' || y || ' ; ' || array_to_string(list_transform(ops, lambda o: 'X ' || o || ' Y'), ' ; ') AS inps,
       array_to_string(list_transform(ops, lambda o: {cmp}), ',') AS y_bools
FROM (SELECT sample_id, x, y, list_transform(range({cfg.m}), lambda i: {op_i}) AS ops
      FROM (SELECT o_orderkey AS sample_id, {x} AS x, {y} AS y FROM orders))"""


@query("gen_compare", _sql_compare(COMPARE_CONFIG))
def gen_compare_q(spark, sf):
    df = gen_compare(_samples(spark, sf), COMPARE_CONFIG)
    return df.select("config_name", "sample_id", F.array_join("inps", " ").alias("inps"),
                     F.array_join(F.col("y_bools").cast("array<string>"), ",").alias("y_bools"))


ALL_CONFIGS = LIST_CONFIGS + [DECODE_CONFIG, ADD_CONFIG, COMPARE_CONFIG,
                              Config(0.0, 0.0, 0, 4, "bool_simple", "logic"), Config(0.0, 0.0, 0, 4, "bool", "logic"),
                              Config(-9.0, 9.0, 0, 4, "algebraic_int", "logic"),
                              Config(-9.0, 9.0, 0, 4, "algebraic_float", "logic"),
                              Config(-9.0, 9.0, 0, 4, "var+algebraic_int", "logic"),
                              Config(0.0, 9.0, 0, 1, "var_bool", "logic")]


@query("gen_all", "SELECT task, type, count(*) AS n FROM orders, (VALUES " + ", ".join(
    f"({sql_str(c.task)}, {sql_str(c.type)})" for c in ALL_CONFIGS) + ") AS c(task, type) GROUP BY task, type")
def gen_all(spark, sf):
    g = generate(_samples(spark, sf), ALL_CONFIGS)
    return g.groupBy("task", "type").agg(F.count("*").alias("n"))
