from pyspark.sql import Window
from pyspark.sql import functions as F

from spanflow.operators.scan import group_positions, last_before


def _skewed(spark):
    # key 0 holds most rows (a hot key); chunks = blocks of 100 in the order
    df = spark.range(5000).select((F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(0)).alias("k"),
                                  (F.col("id") * 7919 % 5003).alias("o"),
                                  F.when(F.col("id") % 11 == 0, F.col("id")).alias("v"))
    return df


def test_positions_match_window(spark):
    df = _skewed(spark)
    got = group_positions(df, ["k"], ["o"], "pos", chunk=(F.col("o") / 100).cast("long"))
    ref = df.withColumn("pos2", (F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1).cast("long"))
    j = got.join(ref, ["k", "o"])
    assert j.count() == 5000 and j.filter(F.col("pos") != F.col("pos2")).count() == 0


def test_last_before_matches_window(spark):
    df = _skewed(spark)
    got = last_before(df, ["k"], ["o"], "v", "lv", chunk=(F.col("o") / 100).cast("long"))
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("lv2", F.last("v", ignorenulls=True).over(w))
    j = got.join(ref.select("k", "o", "lv2"), ["k", "o"])
    assert j.count() == 5000 and j.filter(~F.col("lv").eqNullSafe(F.col("lv2"))).count() == 0


def test_salted_top_n_matches_window(spark):
    from spanflow.operators.kernel import first_n_per_group
    df = _skewed(spark)
    got = first_n_per_group(df, ["k"], ["o"], 5).select("k", "o", "rank")
    w = Window.partitionBy("k").orderBy("o")
    ref = df.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("k", "o", "rank")
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_group_max_and_padding(spark):
    from spanflow.operators.lists import group_max_flags, pad_groups
    df = spark.createDataFrame([(1, 1, 3.0), (1, 2, 7.0), (1, 3, 7.0), (2, 1, 5.0)], "g int, o int, v double")
    flags = {(r.g, r.o): r.is_max for r in group_max_flags(df, ["g"], "v").collect()}
    assert flags == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (2, 1): 1}
    pads = sorted((r.g, r.pos, r.v, r.is_pad) for r in pad_groups(df, ["g"], ["o"], "v", 0.0, chunk="o").collect())
    assert pads == [(1, 0, 3.0, False), (1, 1, 7.0, False), (1, 2, 7.0, False),
                    (2, 0, 5.0, False), (2, 1, 0.0, True), (2, 2, 0.0, True)]


def test_reaching_defs_with_chunks_matches_sql(spark):
    from spanflow.operators.dataflow import reaching_defs
    ev = spark.range(3000).select((F.col("id") % 3).alias("u"), F.col("id").alias("t"),
                                  (F.col("id") % 7 == 0).alias("is_def"))
    got = reaching_defs(ev, ["u"], ["t"], F.col("is_def"), idx="t", chunk=(F.col("t") / 50).cast("long"))
    w = Window.partitionBy("u").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    ref = ev.withColumn("d2", F.last(F.when(F.col("is_def"), F.col("t")), ignorenulls=True).over(w))
    j = got.join(ref, ["u", "t"])
    assert j.count() == 3000 and j.filter(~F.col("def_idx").eqNullSafe(F.col("d2"))).count() == 0
