from pyspark.sql import functions as F

from spanflow.operators import dataflow as D

ACC = "doc_id int, block int, loop_id int, stmt_id int, role string, var string, idx int"


def test_golden_dataflow_edges(spark):
    rows = [(0, 0, None, 0, "value", "10", 31), (0, 0, None, 0, "def", "a", 29), (0, 1, 1, 1, "use", "a", 35),
            (0, 1, 1, 2, "use", "a", 42), (0, 1, 1, 2, "value", "1", 44), (0, 1, 1, 2, "def", "a", 40)]
    edges = sorted((r.src, r.dst) for r in D.dataflow_edges(spark.createDataFrame(rows, ACC)).collect())
    assert edges == sorted([(31, 29), (29, 35), (40, 35), (42, 40), (44, 40), (29, 42), (40, 42)])


def test_branch_merge_policies(spark):
    # x = 1 (def 1); if (c) x = 2 (def 5) else x = 3 (def 9); use of x
    states = spark.createDataFrame([(0, "x", "then", 5, 5), (0, "x", "else", 9, 9)],
                                   "doc_id int, var string, branch string, idx int, pos int")
    base = spark.createDataFrame([(0, "x", 1)], "doc_id int, var string, idx int")
    with_else = D.merge_branches(states, ["doc_id"], "var", "branch", "idx", ["pos"], base, True, D.JAVA)
    assert with_else.first().defs == [5, 9]
    always = D.merge_branches(states, ["doc_id"], "var", "branch", "idx", ["pos"], base, True, D.GO)
    assert always.first().defs == [1, 5, 9]
    no_else = D.merge_branches(states.filter("branch = 'then'"), ["doc_id"], "var", "branch", "idx", ["pos"],
                               base, False, D.JAVA)
    assert no_else.first().defs == [1, 5]


def test_untouched_branch_keeps_base_state(spark):
    # x = 1 (def 1); if (c) { x = 2 (def 5) } else { y = 3 (def 9) }: x after = {1, 5}, y = {9}
    states = spark.createDataFrame([(0, "x", "then", 5, 5), (0, "y", "else", 9, 9)],
                                   "doc_id int, var string, branch string, idx int, pos int")
    base = spark.createDataFrame([(0, "x", 1)], "doc_id int, var string, idx int")
    got = {r.var: r.defs for r in D.merge_branches(states, ["doc_id"], "var", "branch", "idx", ["pos"], base,
                                                   True, D.JAVA).collect()}
    assert got == {"x": [1, 5], "y": [9]}
    assert spark.range(1).select(D.union_positions(F.array(F.lit(5), F.lit(1)), F.array(F.lit(1), F.lit(3)))).first()[0] == [1, 3, 5]


def test_for_loop_second_pass_after_init(spark):
    # for (i = 0 [def 1, init]; i < n [use 2]; i++ [use 3, def 4]) { }
    rows = [(0, 0, 1, 0, "def", "i", 1, True), (0, 0, 1, 1, "use", "i", 2, False), (0, 0, 1, 2, "use", "i", 3, False),
            (0, 0, 1, 2, "def", "i", 4, False)]
    acc = spark.createDataFrame(rows, ACC + ", init boolean")
    e = sorted((r.src, r.dst) for r in D.dataflow_edges(acc, policy=D.GO, init_col="init").collect()
               if r.src is not None)
    assert (1, 2) in e and (4, 2) in e and (1, 3) in e and (3, 4) in e


def test_entry_merge(spark):
    e = spark.createDataFrame([("x", 7, "comesFrom", 5), ("x", 7, "comesFrom", 1)],
                              "code string, idx int, rel string, src int")
    assert D.merge_entries(e, ["code", "idx", "rel"], "src").first().sources == [1, 5]


def test_prune_and_zip(spark):
    e = spark.createDataFrame([(0, 1, None), (0, 2, 1), (0, 3, None)], "d int, idx int, src int")
    kept = sorted(r.idx for r in D.prune_dangling(e, ["d"], "idx", "src").collect())
    assert kept == [1, 2]
    left = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "k int, o int, v string")
    right = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 0, "p"), (1, 1, "q")], "k int, o int, v string")
    z = {(r.k, r.src): (r.dst, r.whole) for r in D.zip_assign(left, right, ["k"], "o", "v").collect()}
    assert z == {(0, "a"): ("x", False), (0, "b"): ("y", False), (1, "c"): (None, True)}


def test_update_edges_are_factorized(spark):
    acc = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4)], "stmt int, idx int")
    r = {x.stmt: (x.n_members, x.n_edges) for x in D.update_edges(acc, ["stmt"]).collect()}
    assert r == {0: (3, 9), 1: (1, 1)}


def test_outer_as_inner_equals_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, l string")
    right = spark.createDataFrame([(1, 10), (1, 11), (3, 30), (4, 40)], "k int, r int")
    got = sorted(tuple(r) for r in D.outer_as_inner(left, right, ["k"]).select("k", "l", "r").collect())
    exp = sorted(tuple(r) for r in left.join(right, "k", "left").select("k", "l", "r").collect())
    assert got == exp


def test_chunked_edges_equal_one_window(spark):
    """A variable used in many blocks (one of them NULL) and in loops."""
    rows = [(d, b, "l" if b == 3 else None, (b or 0) * 10 + k, "def" if (k + (b or 0)) % 3 == 0 else "use", v, (b or 0) * 100 + 2 * k + n)
            for d in (1, 2) for b in (None, 1, 2, 3, 4) for k in range(5) for n, v in enumerate("xy")]
    acc = spark.createDataFrame(rows, "doc_id long, block int, loop_id string, stmt_id int, role string, var string, idx int")
    whole, cut = (sorted(D.dataflow_edges(acc, chunk=c).collect()) for c in (None, "block"))
    assert whole == cut and len(whole) > 40
