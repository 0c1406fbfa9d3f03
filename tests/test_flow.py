"""Accesses of Java text and composed data flow against a walk of the program that
repeats every loop pass and copies every branch's state."""
import random

import pytest
from pyspark.sql import functions as F

from spanflow.operators.dataflow import JAVA, Policy
from spanflow.operators.flow import JAVA_FLOW, code_accesses, flow_edges
from spanflow.plans import q_flow


class Program:
    """A random program: its tokens, and a tree of statements over token numbers."""

    def __init__(self, seed):
        self.r, self.tok = random.Random(seed), []
        self.tree = self.body(self.r.randint(2, 6), 0)

    def put(self, *words):
        self.tok += words
        return len(self.tok) - 1

    def name(self):
        return self.put(self.r.choice("abcdxy"))

    def expr(self):
        """Uses, as token numbers, and all values."""
        uses, values = [], []
        for k in range(self.r.randint(1, 3)):
            if k:
                self.put(self.r.choice("+-*"))
            if self.r.random() < 0.3:
                values.append(self.put(str(self.r.randint(0, 9))))
            else:
                uses.append(self.name())
                values.append(uses[-1])
        return uses, values

    def body(self, n, depth):
        return [self.statement(depth) for _ in range(n)]

    def block(self, depth):
        if self.r.random() < 0.4:
            return [self.statement(depth + 1)]
        self.put("{")
        out = self.body(self.r.randint(0, 3), depth + 1)
        self.put("}")
        return out

    def statement(self, depth):
        kinds = ["set", "set", "use", "inc", "decl", "bare"] + (["if", "if", "while", "for", "each", "do", "plain"] if depth < 4 else [])
        kind = self.r.choice(kinds)
        if kind in ("set", "decl"):
            if kind == "decl":
                self.put(self.r.choice(["int", "Foo"]))
            t = self.name()
            self.put("=")
            uses, values = self.expr()
            self.put(";")
            return "set", t, uses, values
        if kind == "bare":
            self.put("int")
            t = self.name()
            self.put(";")
            return "set", t, [], []
        if kind == "use":
            self.put("this", ".")
            f = self.put("call")
            self.put("(")
            uses, _ = self.expr()
            self.put(")", ";")
            return "use", [f, *uses]
        if kind == "inc":
            t = self.name()
            self.put("++", ";")
            return "inc", t
        if kind in ("if", "while"):
            self.put(kind, "(")
            uses, _ = self.expr()
            self.put(")")
            if kind == "while":
                return "loop", [("use", uses)], self.block(depth), True
            # a branch that may swallow an else has braces
            self.put("{")
            then = self.body(self.r.randint(0, 2), depth + 1)
            self.put("}")
            other = None
            if self.r.random() < 0.5:
                self.put("else")
                other = self.block(depth)
            return "if", uses, then, other
        if kind == "do":
            self.put("do", "{")
            inner = self.body(self.r.randint(0, 2), depth + 1)
            self.put("}", "while", "(")
            uses, _ = self.expr()
            self.put(")", ";")
            return "seq", [*inner, ("use", uses)]
        if kind == "each":
            self.put("for", "(", "Foo")
            t = self.name()
            self.put(":")
            v = self.name()
            self.put(")")
            return "loop", [("set", t, [v], [v])], self.block(depth), True
        self.put("for", "(")
        if kind == "for":
            self.put("int")
        t = self.name()
        self.put("=", "0")
        zero = len(self.tok) - 1
        self.put(";")
        uses, _ = self.expr()
        self.put(";")
        u = self.name()
        self.put("++", ")")
        return "seq", [("set", t, [], [zero]), ("loop", [("use", uses), ("inc", u)], self.block(depth), kind == "for")]

    def edges(self, policy):
        out = set()

        def use(i, state):
            var = self.tok[i]
            if var in state:
                out.update((s, i) for s in state[var])
            else:
                state[var] = {i}

        def go(stmts, state):
            for s in stmts:
                if s[0] == "set":
                    for u in s[2]:
                        use(u, state)
                    out.update((v, s[1]) for v in s[3])
                    state[self.tok[s[1]]] = {s[1]}
                elif s[0] == "use":
                    for u in s[1]:
                        use(u, state)
                elif s[0] == "inc":
                    out.add((s[1], s[1]))
                    state[self.tok[s[1]]] = {s[1]}
                elif s[0] == "seq":
                    go(s[1], state)
                elif s[0] == "loop":
                    for _ in range(policy.passes if s[3] else 1):
                        go(s[1] + s[2], state)
                else:
                    ends, then = [], dict(state)
                    go([("use", s[1])] + s[2], then)
                    ends.append(then)
                    if s[3] is not None:
                        ends.append(dict(state))
                        go(s[3], ends[-1])
                    if s[3] is None or policy.include_base == "always":
                        ends.append(dict(state))
                    state.clear()
                    for e in ends:
                        for k, v in e.items():
                            state[k] = state.get(k, set()) | v
        go(self.tree, {})
        return out


@pytest.mark.parametrize("policy", [JAVA_FLOW, JAVA, Policy(passes=1), Policy(passes=4)])
def test_flow_of_random_programs(spark, policy):
    programs = [Program(s) for s in range(150)]
    docs = spark.createDataFrame([(i, " ".join(p.tok)) for i, p in enumerate(programs)], "doc_id long, text string").repartition(4)
    got = {i: set() for i in range(len(programs))}
    rows = flow_edges(code_accesses(docs), policy=policy, chunk=7).collect()
    for r in rows:
        got[r.doc_id].add((r.src, r.dst))
    assert len(rows) == sum(map(len, got.values()))
    for i, p in enumerate(programs):
        assert got[i] == p.edges(policy), " ".join(p.tok)


# --- fixed values: the golden method and its edges; the parser numbers one token more before the body ---
METHOD = """public void reduce(UTF8 key, Iterator<UTF8> values,
                            OutputCollector<UTF8, UTF8> output, Reporter reporter) throws IOException 
        {
            int a = 10;
            while (a > 0) {
                a = a - 1;
            }
        }
        """
EDGES = [(31, 29), (29, 35), (40, 35), (42, 40), (44, 40), (29, 42), (40, 42)]
# ---------------------------------------------------------------------------------------------------------


def edges_of(spark, code, policy=JAVA_FLOW):
    docs = spark.createDataFrame([(0, code)], "doc_id long, text string")
    return sorted((r.src, r.dst) for r in flow_edges(code_accesses(docs), policy=policy).collect())


def test_golden_edges_from_the_text(spark):
    assert edges_of(spark, METHOD) == sorted((s - 1, d - 1) for s, d in EDGES)


def test_branches_and_unbound_names(spark):
    for policy in (JAVA, JAVA_FLOW):
        assert edges_of(spark, "x = 1 ; if ( c ) x = 2 ; f ( x ) ;", policy) == [(0, 14), (2, 0), (8, 14), (10, 8)]
    both = "x = 1 ; if ( c ) x = 2 ; else x = 3 ; f ( x ) ;"
    assert edges_of(spark, both, JAVA) == [(2, 0), (8, 19), (10, 8), (13, 19), (15, 13)]
    assert edges_of(spark, both, JAVA_FLOW) == [(0, 19), (2, 0), (8, 19), (10, 8), (13, 19), (15, 13)]
    assert edges_of(spark, "f ( x ) ; g ( x , x ) ;") == [(2, 7), (2, 9)]


@pytest.mark.parametrize("code, targets, values, typed", [
    ("Map<String, List<X>> m = new HashMap<String, List<X>>(n);", "m", "HashMap String List X n", "Map String List X HashMap String List X"),
    ("a.b[i] = (Foo) c.d(e) ;", "a b i", "Foo c d e", "Foo"),
    ("int p, q = 2, r;", "p q r", "2", ""),
    ("x += y = z ;", "x y", "y z z", ""),
    ("++ this.n ; m[k]-- ;", "n m k", "n m k", ""),
    ("for (Foo t : list) { }", "t", "list", ""),
    ("r = () -> { if (a) b = null; }; q = r;", "b r q", "null a b null r", ""),
    ("if (a < b && c > d) e = true;", "e", "", ""),
    ("Foo[] f = { g, 'h', \"i\" }; Bar.Baz x;", "f x", "g 'h' \"i\"", "Foo Bar Baz"),
])
def test_statements(spark, code, targets, values, typed):
    rows = code_accesses(spark.createDataFrame([(0, code)], "doc_id long, text string")).collect()
    of = {k: sorted(r["var"] for r in rows if r.role == k) for k in ("def", "value", "see")}
    assert of["def"] == sorted(targets.split()) and of["value"] == sorted(values.split())
    assert of["see"] == sorted(typed.split() if "for (Foo" not in code else [])


def test_accesses_of_awkward_documents(spark):
    rows = [(1, None), (2, ""), (3, "}}} ) ] else = ++ ; ( { if ("), (4, "if ( a ) { for ( ; ; ) { while ( b ) { c = a ; } } } else ; d"), (None, "x = 1;"),
            (5, "{ " * 3000 + "x = 1 ; f ( x ) ;"), (6, "if ( c ) " * 300 + "x = 1 ;"), (7, "f ( a" + " , a" * 4000 + " ) ;")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    acc = code_accesses(docs)
    inner = {r["var"]: r for r in acc.where("doc_id = 4 and pos is not null").collect()}
    assert inner["c"].loop is not None and inner["c"].branch is not None and inner["d"].region == 0 and inner["d"].loop is None
    n = {r.doc_id: r["count"] for r in flow_edges(acc.where("doc_id != 6"), chunk=1000).groupBy("doc_id").count().collect()}
    assert n == {4: 3, 5: 2, 7: 4000}
    assert acc.where("doc_id = 6").agg(F.max(F.size("path"))).first()[0] == 300
    assert flow_edges(code_accesses(docs.limit(0))).count() == 0


def test_template_edges_are_those_of_the_walk(spark):
    """The edges that the SQL twin states a part, and the number of tokens."""
    for p in q_flow.PARTS:
        assert set(edges_of(spark, p.code)) >= set(p.edges)


def test_accesses_come_in_few_batches_from_many_tasks(spark, tmp_path):
    """A small file of many keys is read in one task; its texts are made and walked in many, a batch for many documents."""
    from spanflow.operators import flow
    from spanflow.plans.q_flow import java_flow_files
    spark.range(1, 400, 1, 1).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    files = java_flow_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert len({r[0] for r in files.selectExpr("spark_partition_id()").distinct().collect()}) > 1
    cols = flow._columns()
    for code in ("a = b ;", "while ( c ) { d ( ) ; }"):
        flow._add(cols, *flow.walk(code.split()), code.split())
    assert len({len(cols[c]) for c in cols if c != "regions"}) == 1 and cols["var"] == ["b", "a", "b", "c", "d"]
