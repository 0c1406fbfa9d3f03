"""Step 7 queries: vectors, pooling, metrics and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_split, sql_u32
from ..operators import metrics as M
from ..operators import probes as P
from ..operators import solver as S
from ..operators.generate import Config, gen_numeric, generate
from ..operators.kernel import drop_constant_targets, spread
from ..operators.numeric import numeric_probes
from ..operators.rowspans import aligned
from ..operators.vectors import hash_text_vectors, pool, token_vectors
from .common import PIECE_PATTERN, T, keys, r6, sql_signed_log, sql_str, sql_tokens
from .q_lists import sql_values
from .q_structure import PROSE_FLAGS, doc_flags_sql
from .registry import query

DIMS, LAYERS = 16, 3
_split_sql = lambda k: f"CASE WHEN {sql_u32(repr('42:') + ' || ' + k)} % 100 < 50 THEN 0 ELSE 1 END"


def doc_vectors(spark, sf):
    d = spread(T(spark, sf, "documents").select("doc_id", "text"))
    return hash_text_vectors(d, "doc_id", "text", dims=DIMS, layers=LAYERS)


@query("hash_vectors", f"""
WITH t AS ({sql_tokens()}),
n AS (SELECT doc_id, idx, text, lead(text, 1) OVER w AS n1, lead(text, 2) OVER w AS n2 FROM t
      WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
g AS (SELECT doc_id, 1 AS layer, text AS g FROM n
      UNION ALL SELECT doc_id, 2, text || ' ' || n1 FROM n WHERE n1 IS NOT NULL
      UNION ALL SELECT doc_id, 3, text || ' ' || n1 || ' ' || n2 FROM n WHERE n2 IS NOT NULL),
h AS (SELECT doc_id, layer, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM g),
c AS (SELECT doc_id, layer, h % {DIMS} AS bucket, sum(CASE WHEN (h // {DIMS}) % 2 = 0 THEN 1 ELSE -1 END) AS v
      FROM h GROUP BY ALL),
cells AS (SELECT doc_id, layer, b AS bucket FROM (SELECT DISTINCT doc_id FROM t), range(1, {LAYERS + 1}) l(layer), range({DIMS}) r(b))
SELECT cells.doc_id, cells.layer::INTEGER AS layer, string_agg(coalesce(c.v, 0)::VARCHAR, ',' ORDER BY cells.bucket) AS vec
FROM cells LEFT JOIN c USING (doc_id, layer, bucket) GROUP BY cells.doc_id, cells.layer""")
def hash_vectors(spark, sf):
    v = doc_vectors(spark, sf)
    return v.select("doc_id", "layer", F.array_join(F.col("vec").cast("array<string>"), ",").alias("vec"))


def _sql_piece_vec(p):
    return " || ',' || ".join(f"(('0x' || substr(md5({p}), {1 + 2 * i}, 2))::INTEGER - 128)::VARCHAR" for i in range(4))


@query("token_piece_vectors", f"""
WITH a AS ({sql_tokens()}), b AS ({sql_tokens(pattern=PIECE_PATTERN)}),
ab AS (SELECT a.doc_id, a.idx, unnest(generate_series(a.char_start // 64, greatest(a.char_end - 1, a.char_start) // 64)) AS bucket, a.char_start AS s, a.char_end AS e FROM a),
bb AS (SELECT b.doc_id, b.idx, b.text, unnest(generate_series(b.char_start // 64, greatest(b.char_end - 1, b.char_start) // 64)) AS bucket, b.char_start AS s, b.char_end AS e FROM b)
SELECT ab.doc_id, ab.idx, string_agg({_sql_piece_vec('bb.text')}, '|' ORDER BY bb.idx) AS vecs
FROM ab JOIN bb ON ab.doc_id = bb.doc_id AND ab.bucket = bb.bucket AND ab.s < bb.e AND bb.s < ab.e
     AND ab.bucket = greatest(ab.s, bb.s) // 64
GROUP BY ab.doc_id, ab.idx""")
def token_piece_vectors_q(spark, sf):
    tv = aligned(T(spark, sf, "documents"), with_texts=True).where(F.size("pieces") > 0)
    flat = F.array_join(F.transform(token_vectors("pieces"), lambda v: F.array_join(v.cast("array<string>"), ",")), "|")
    return tv.select("doc_id", "idx", flat.alias("vecs"))


_pool_sql = """
SELECT label, (i - 1)::INTEGER AS dim, round({agg}(x::DOUBLE), 6) AS value
FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i"""


@query("pool_sum", _pool_sql.format(agg="sum"))
def pool_sum(spark, sf):
    p = pool(T(spark, sf, "embeddings").select("label", "embedding"), ["label"], "embedding", "sum")
    return p.select("label", "dim", r6(F.col("value")).alias("value"))


@query("pool_mean", _pool_sql.format(agg="avg"))
def pool_mean(spark, sf):
    p = pool(T(spark, sf, "embeddings").select("label", "embedding"), ["label"], "embedding", "mean")
    return p.select("label", "dim", r6(F.col("value")).alias("value"))


def _labels(spark, sf):
    return T(spark, sf, "labels").withColumn("pred", 1 - F.col("toxic"))


@query("exact_match_accuracy", "SELECT round(100.0 * avg((quality = 1 - toxic)::DOUBLE), 6) AS accuracy FROM labels")
def exact_match_accuracy(spark, sf):
    return M.accuracy_pct(_labels(spark, sf), "quality", "pred").select(r6(F.col("accuracy")).alias("accuracy"))


@query("probe_accuracy", f"""
SELECT {_split_sql('doc_id')} AS split, round(avg((quality = 1 - toxic)::DOUBLE), 6) AS accuracy FROM labels GROUP BY 1""")
def probe_accuracy(spark, sf):
    d = _labels(spark, sf).withColumn("split", hash_split("doc_id"))
    return M.score(d, "quality", "pred", ["split"]).select("split", r6(F.col("accuracy")).alias("accuracy"))


@query("confusion_matrix", """
WITH l AS (SELECT DISTINCT x FROM (SELECT quality AS x FROM labels UNION SELECT toxic FROM labels)),
     c AS (SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2)
SELECT a.x AS actual, p.x AS predicted, coalesce(c.n, 0) AS n FROM l a, l p
LEFT JOIN c ON c.actual = a.x AND c.predicted = p.x""")
def confusion_matrix(spark, sf):
    return M.confusion(T(spark, sf, "labels"), "quality", "toxic")


@query("balanced_weights", """
SELECT quality, count(*) AS n_c, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight
FROM labels GROUP BY quality""")
def balanced_weights(spark, sf):
    w = M.balanced_weights(T(spark, sf, "labels"), "quality")
    return w.select("quality", "n_c", r6(F.col("weight")).alias("weight"))


@query("nonconstant_targets", f"""
SELECT source FROM (SELECT *, {_split_sql('doc_id')} AS split FROM labels JOIN documents USING (doc_id))
GROUP BY source HAVING count(DISTINCT quality) FILTER (split = 0) > 1""")
def nonconstant_targets(spark, sf):
    d = T(spark, sf, "labels").join(T(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    d = d.withColumn("split", hash_split("doc_id"))
    return drop_constant_targets(d, ["source"], "quality", split_col="split").select("source").distinct()


@query("mse_by_group", """
SELECT l_returnflag, round(avg(pow(l_extendedprice - 1000 * l_quantity, 2)), 1) AS mse FROM lineitem GROUP BY 1""")
def mse_by_group(spark, sf):
    li = T(spark, sf, "lineitem").withColumn("yhat", 1000 * F.col("l_quantity"))
    return M.mse(li, "l_extendedprice", "yhat", ["l_returnflag"]).select("l_returnflag", F.round("mse", 1).alias("mse"))


@query("linear_fit", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1""")
def linear_fit(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
                                          F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"))


@query("standardize", f"""
WITH p AS (SELECT *, {_split_sql('p_partkey')} AS split FROM part),
     s AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp
           FROM p WHERE split = 0)
SELECT p_partkey, round((p_size - ms) / CASE WHEN ss = 0 THEN 1 ELSE ss END, 6) AS p_size_z,
       round((p_retailprice - mp) / CASE WHEN sp = 0 THEN 1 ELSE sp END, 6) AS p_retailprice_z FROM p, s""")
def standardize(spark, sf):
    p = T(spark, sf, "part").withColumn("split", hash_split("p_partkey"))
    z = M.standardize(p, ["p_size", "p_retailprice"], F.col("split") == 0)
    return z.select("p_partkey", r6(F.col("p_size_z")).alias("p_size_z"), r6(F.col("p_retailprice_z")).alias("p_retailprice_z"))


# --- probes ----------------------------------------------------------
# The SQL twins hold what no solver decides: rows of each half, row sums of the
# confusion matrices, and that fits converged to a loss no constant has.

def _wide(res):
    """Solver-free columns of a long result table."""
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    return res.groupBy("key", "layer").agg(
        value("n_train").cast("long").alias("n_train"), value("n_test").cast("long").alias("n_test"),
        (value("confusion_0_0") + value("confusion_0_1")).cast("long").alias("n_negative"),
        (value("confusion_1_0") + value("confusion_1_1")).cast("long").alias("n_positive"),
        ((value("confusion_0_0") + value("confusion_1_1")) / value("n_test") == value("accuracy")).alias("accuracy_agrees"),
        (value("converged") == 1).alias("converged"), (value("beats_constant") == 1).alias("beats_constant"))


_TRUTHS = "true AS accuracy_agrees, true AS converged, true AS beats_constant"


@query("probe_logistic", f"""
WITH e AS (SELECT label, {_split_sql('vec_id')} AS split FROM embeddings), k AS (SELECT DISTINCT label AS class FROM e)
SELECT 'label=' || class AS key, 0::INTEGER AS layer, count(*) FILTER (split = 0) AS n_train, count(*) FILTER (split = 1) AS n_test,
       count(*) FILTER (split = 1 AND label <> class) AS n_negative, count(*) FILTER (split = 1 AND label = class) AS n_positive, {_TRUTHS}
FROM e, k GROUP BY class""")
def probe_logistic(spark, sf):
    """M1 per target class of the embeddings (one-vs-rest), one layer."""
    e = T(spark, sf, "embeddings").withColumn("split", hash_split("vec_id"))
    classes = [r[0] for r in e.select("label").distinct().orderBy("label").collect()]      # one row a class
    samples = e.select(F.lit(0).alias("layer"), "split", F.col("embedding").alias("x"),
                       F.array(*[(F.col("label") == c).cast("int") for c in classes]).alias("ys"))
    return _wide(S.logistic_probes(samples, [f"label={c}" for c in classes]))


def _order_samples(spark, sf):
    return keys(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("sample_id"))


ADDITION, MAXIMUM = Config(0.0, 100.0, 0, 5, "ints", "addition"), Config(0.0, 100.0, 0, 5, "ints", "list_maximum")


def _least_squares_sql(rows: str, n: int) -> str:
    """DuckDB: mean squared residual of ``y`` on split 1 after least squares on ``x1..xn`` of
    split 0: columns are centred, then each in turn is taken out of those after it."""
    cols = [f"x{i}" for i in range(1, n + 1)] + ["y"]
    steps = ["s0 AS (SELECT split, " + ", ".join(f"{c} - avg({c}) FILTER (split = 0) OVER () AS {c}" for c in cols) + f" FROM ({rows}))"]
    for i in range(n):
        rest, x = cols[i + 1:], cols[i]
        steps.append(f"b{i} AS (SELECT " + ", ".join(
            f"sum({c} * {x}) FILTER (split = 0) / sum({x} * {x}) FILTER (split = 0) AS b_{c}" for c in rest) + f" FROM s{i})")
        steps.append(f"s{i + 1} AS (SELECT split, " + ", ".join(f"{c} - b_{c} * {x} AS {c}" for c in rest) + f" FROM s{i}, b{i})")
    return "WITH " + ", ".join(steps) + f" SELECT avg(y * y) AS mse, count(*) AS n_test FROM s{n} WHERE split = 1"


def _numbers_sql(cfg):
    return f"SELECT {_split_sql('sample_id')} AS split, {sql_values(cfg, cfg.m)[0]} AS nums FROM (SELECT o_orderkey AS sample_id FROM orders)"


_addition_rows = ("SELECT split, " + ", ".join(f"nums[{i}]::DOUBLE AS x{i}" for i in range(1, ADDITION.m + 1))
                  + f", {sql_signed_log('list_sum(nums)')} AS y FROM ({_numbers_sql(ADDITION)})")


@query("probe_addition", f"SELECT {sql_str(ADDITION.name)} AS config_name, round(mse, 6) AS mse, n_test "
                         f"FROM ({_least_squares_sql(_addition_rows, ADDITION.m)})")
def probe_addition(spark, sf):
    """M3: the addends as 1-d token vectors, padded, flattened, least squares."""
    g = gen_numeric(_order_samples(spark, sf), ADDITION).withColumn("split", hash_split("sample_id"))
    g = g.withColumn("x", F.flatten(F.transform("inps", lambda t: F.array(t.cast("double")))))
    _, s = P.linear_probe(g, "x", "y_num")
    return s.select(F.lit(ADDITION.name).alias("config_name"), r6(F.col("mse")).alias("mse"), "n_test")


@query("probe_multi", f"""
SELECT {sql_str(MAXIMUM.name)} AS config_name, round(avg((len(list_filter(nums, lambda x: x = list_max(nums))) > 1)::INTEGER), 6) AS tie_share,
       count(*) AS n_test, true AS converged, true AS above_majority FROM ({_numbers_sql(MAXIMUM)}) WHERE split = 1""")
def probe_multi(spark, sf):
    """M4: list maximum, one logistic probe per position; exact matches are more
    than the share of the commonest label."""
    g = gen_numeric(_order_samples(spark, sf), MAXIMUM).withColumn("split", hash_split("sample_id"))
    samples = g.select(F.lit(0).alias("layer"), "split", F.transform("inps", lambda t: t.cast("double")).alias("x"), F.col("y_vec").alias("ys"))
    commonest = g.filter(F.col("split") == 1).groupBy("y_vec").agg(F.count("*").alias("n")) \
        .agg((F.max("n") * 100.0 / F.sum("n")).alias("majority")).withColumn("layer", F.lit(0))
    r = S.exact_match_probe(samples).join(commonest, "layer")
    return r.select(F.lit(MAXIMUM.name).alias("config_name"), r6(F.col("tie_share")).alias("tie_share"), "n_test", "converged",
                    (F.col("accuracy") > F.col("majority")).alias("above_majority"))


def flag_probes(spark, sf):
    """M5: every (flag, layer) probe on hashed document vectors; constant
    targets are skipped (P7); results in long format."""
    from .q_structure import doc_flag_table
    flags = doc_flag_table(spark, sf).withColumn("split", hash_split("doc_id"))
    samples = doc_vectors(spark, sf).join(flags, "doc_id").select(
        "layer", "split", F.col("vec").alias("x"), F.array(*[F.col(f).cast("int") for f in PROSE_FLAGS]).alias("ys"))
    return S.logistic_probes(samples, list(PROSE_FLAGS))


_flag_rows = " UNION ALL ".join(f"SELECT '{f}' AS key, {_split_sql('doc_id')} AS split, {f} AS flag FROM ({doc_flags_sql})"
                                for f in PROSE_FLAGS)


@query("probe_summary", f"""
SELECT key, layer::INTEGER AS layer, count(*) FILTER (split = 0) AS n_train, count(*) FILTER (split = 1) AS n_test,
       count(*) FILTER (split = 1 AND NOT flag) AS n_negative, count(*) FILTER (split = 1 AND flag) AS n_positive, {_TRUTHS}
FROM ({_flag_rows}), range(1, {LAYERS + 1}) l(layer) GROUP BY key, layer
HAVING count(DISTINCT flag) FILTER (split = 0) > 1""")
def probe_summary(spark, sf):
    return _wide(flag_probes(spark, sf))


@query("probe_scores")
def probe_scores(spark, sf):
    """The whole result table: accuracies and confusion matrices."""
    return flag_probes(spark, sf).select("key", "layer", "metric", r6(F.col("value")).alias("value"))


# --- numeric probing, end to end ---------------------------------------
NUMERIC = [Config(0.0, 100000.0, 0, 2, "ints", "addition"), Config(0.0, 100000.0, 0, 1, "negatives", "decoding"),
           Config(0.0, 100000.0, 0, 3, "ints", "list_maximum")]
NUM_DIMS = 4


def _mean_columns(text: str, layer: int, width: int, first: int = 1) -> str:
    """DuckDB: mean of the vectors of a token's pieces, as columns x1.."""
    ps = f"regexp_extract_all({text}, {sql_str(PIECE_PATTERN)}, 1)"
    at = lambda d: f"(('0x' || substr(md5('{layer}:' || p), {1 + 2 * d}, 2))::INTEGER - 128)"
    return ", ".join(f"list_avg(list_transform({ps}, lambda p: {at(d)}))::DOUBLE AS x{first + d}" for d in range(width))


def _numeric_sql(cfg, layer):
    nums, _ = sql_values(cfg, cfg.m)
    rows = f"SELECT {_split_sql('sample_id')} AS split, {nums} AS nums FROM (SELECT o_orderkey AS sample_id FROM orders)"
    # a sign is a token of its own, and the same in every sample
    cells = ", ".join(_mean_columns(f"abs(nums[{i + 1}])::VARCHAR", layer, NUM_DIMS, 1 + i * NUM_DIMS) for i in range(cfg.m))
    tokens = cfg.m * (2 if cfg.type == "negatives" else 1)
    head = f"SELECT {sql_str(cfg.name)} AS config_name, {layer}::INTEGER AS layer, {tokens * NUM_DIMS}::BIGINT AS inputs"
    if cfg.task == "list_maximum":
        return f"{head}, count(*) AS n_test, NULL::DOUBLE AS mse, true AS converged FROM ({rows}) WHERE split = 1"
    y = sql_signed_log("list_sum(nums)")
    fitted = _least_squares_sql(f"SELECT split, {cells}, {y} AS y FROM ({rows})", cfg.m * NUM_DIMS)
    return f"{head}, n_test, round(mse, 6) AS mse, NULL::BOOLEAN AS converged FROM ({fitted})"


@query("numeric_probe", " UNION ALL ".join(_numeric_sql(c, k) for c in NUMERIC for k in (0, 1)))
def numeric_probe(spark, sf):
    """M6 for numbers: samples, tokens, aligned means, flattened inputs, probes; the squared
    errors are those of least squares in SQL; of the list maxima the twin holds the rows, the width and that the fits converged."""
    res = numeric_probes(generate(_order_samples(spark, sf), NUMERIC), tasks=[c.task for c in NUMERIC], layers=2, dims=NUM_DIMS, steps=8)
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    wide = res.groupBy(F.col("key").alias("config_name"), "layer").agg(
        value("inputs").cast("long").alias("inputs"), value("n_test").cast("long").alias("n_test"), r6(value("mse")).alias("mse"),
        (value("converged") == 1).alias("converged"))
    return wide
