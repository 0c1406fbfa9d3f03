"""Queries on the data flow of source code.

The code is a template over customers: a part is in a customer's file if the key is divisible
by its number.  Each part has names of its own, and some set the shared ``s``, which
is read at the end.  The SQL twins know each part's accesses and edges and add up the tokens
before it; they read no code.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import functions as F

from ..operators.flow import code_accesses, flow_edges
from .common import keys, sql_str
from .registry import query


class Part(NamedTuple):
    divisor: int
    code: str                            # words between blanks are tokens
    accesses: str                        # role, token, @statement, B in a branch, L in a loop
    edges: list[tuple[int, int]]         # (source, target) within the part
    sets: tuple[int, ...] = ()           # tokens that set s
    kills: bool = False                  # whether every way through the part sets s


BEGIN, END = Part(1, "int s = 0 ;", "d1@2 v3@2", [(3, 1)]), Part(1, "use ( s ) ;", "u0 u2", [])
PARTS = [
    Part(2, "int a0 = 1 ; while ( a0 > 2 ) { a0 = a0 - 3 ; }", "d1@2 v3@2 u7L u14L d12@13L v14@13 v16@13",
         [(3, 1), (1, 7), (12, 7), (14, 12), (16, 12), (1, 14), (12, 14)]),
    Part(3, "s = 5 ;", "d0@1 v2@1", [(2, 0)], (0,), True),
    Part(4, "if ( c2 ) s = 6 ;", "u2B d4@5B v6@5", [(6, 4)], (4,)),
    Part(5, "if ( c3 ) { s = 7 ; } else if ( d3 ) { s = 8 ; } else { s = 9 ; }", "u2B d5@6B v7@6 u13B d16@17B v18@17 d23@24B v25@24",
         [(7, 5), (18, 16), (25, 23)], (5, 16, 23)),
    Part(6, "for ( int i4 = 0 ; i4 < 1 ; i4 ++ ) { while ( d4 ) { e4 = e4 + i4 ; } }",
         "d3@4 v5@4 u7L d11@12L v11@12 u17L u22L u24L d20@21L v22@21 v24@21",
         [(5, 3), (3, 7), (11, 7), (11, 11), (17, 17), (22, 20), (24, 20), (20, 22), (11, 24)]),
    Part(7, "g5 ( h5 ) ; h5 = g5 ; if ( k5 ) { h5 ++ ; } m5 ( h5 ) ;", "u0 u2 u7 d5@6 v7@6 u11B d14@15B v14@15 u18 u20",
         [(0, 7), (7, 5), (14, 14), (5, 20), (14, 20)]),
    Part(8, "do { m6 += 1 ; } while ( m6 < 9 ) ; T6 < m6 > n6 , o6 = m6 ;", "d2@3 v4@3 u9 s14 s16 d18@18 u22 d20@21 v22@21",
         [(4, 2), (2, 9), (2, 16), (22, 20), (2, 22)]),
    Part(9, "for ( T7 t7 : l7 ) { s = t7 . f7 ; }", "u5L d3@4L v5@4 u10L u12L d8@9L v10@9 v12@9",
         [(5, 3), (5, 5), (3, 10), (10, 8), (12, 8), (12, 12)], (8,), True),
    Part(10, "p8 -- ; q8 = r8 = p8 + p8 ; if ( q8 ) if ( r8 ) s = q8 ;",
         "d0@1 v0@1 u7 u9 d5@6 v7@6 v9@6 d3@4 v5@4 v7@4 v9@4 u13B u17B u21B d19@20B v21@20",
         [(0, 0), (7, 5), (9, 5), (0, 7), (0, 9), (5, 3), (7, 3), (9, 3), (3, 13), (5, 17), (21, 19), (3, 21)], (19,)),
]


def java_flow_files(spark, sf):
    parts = [F.when(F.col("c_custkey") % p.divisor == 0, p.code + " ").otherwise("") for p in PARTS]
    return keys(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit(BEGIN.code + " "), *parts, F.lit(END.code)).alias("text"))


def _values(rows) -> str:
    def one(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else sql_str(x) if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def _accesses(p: int, part: Part):
    """(part, token, role, text, statement, in a branch, in a loop)"""
    for a in part.accesses.split():
        role, idx, stmt = re.match(r"([a-z])(\d+)(?:@(\d+))?", a).groups()
        yield (p, int(idx), {"d": "def", "u": "use", "s": "see", "v": "value"}[role], part.code.split()[int(idx)],
               int(stmt) if stmt else None, a.endswith("B"), a.endswith("L"))


_ON = f"""part AS (SELECT * FROM {_values([(i, p.divisor, len(p.code.split())) for i, p in enumerate(PARTS)])} AS v(p, d, n)),
chosen AS (SELECT c_custkey AS k, p, n FROM customer JOIN part ON c_custkey % d = 0),
placed AS (SELECT k, p, {len(BEGIN.code.split())} + coalesce(sum(n) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
       FROM chosen),
tail AS (SELECT c_custkey AS k, {len(BEGIN.code.split())} + coalesce(sum(n), 0) AS off FROM customer LEFT JOIN chosen ON k = c_custkey GROUP BY 1)"""


@query("dfg_edges", f"""WITH {_ON},
edge AS (SELECT * FROM {_values([(i, *e) for i, p in enumerate(PARTS) for e in p.edges])} AS v(p, src, dst)),
live AS (SELECT * FROM {_values([(i, at, p.kills) for i, p in enumerate(PARTS) for at in p.sets])} AS v(p, tok, kills)),
defs AS (SELECT k, p, off + tok AS tok, kills FROM placed JOIN live USING (p) UNION ALL SELECT c_custkey, -1, 1, true FROM customer),
reach AS (SELECT k, tok FROM (SELECT *, max(p) FILTER (kills) OVER (PARTITION BY k) AS last FROM defs) WHERE p >= last)
SELECT doc_id, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM (
  SELECT k AS doc_id, off + src AS src, off + dst AS dst FROM placed JOIN edge USING (p)
  UNION ALL SELECT k, tok, off + 2 FROM reach JOIN tail USING (k) UNION ALL SELECT c_custkey, 3, 1 FROM customer)""")
def dfg_edges(spark, sf):
    return flow_edges(code_accesses(java_flow_files(spark, sf)))


_OWN = [r for p, part in enumerate(PARTS) for r in _accesses(p, part)]
_BEGIN, _END = [r[1:] for r in _accesses(0, BEGIN)], [r[1:] for r in _accesses(0, END)]


@query("code_accesses", f"""WITH {_ON},
own AS (SELECT * FROM {_values(_OWN)} AS v(p, idx, role, var, stmt, in_branch, in_loop)),
head AS (SELECT * FROM {_values(_BEGIN)} AS v(idx, role, var, stmt, in_branch, in_loop)),
last AS (SELECT * FROM {_values(_END)} AS v(idx, role, var, stmt, in_branch, in_loop))
SELECT doc_id, CAST(off + idx AS INTEGER) AS idx, role, var, CAST(off + stmt AS INTEGER) AS stmt, in_branch AND role != 'value' AS in_branch,
       in_loop AND role != 'value' AS in_loop FROM (
  SELECT k AS doc_id, off, own.* EXCLUDE (p) FROM placed JOIN own USING (p)
  UNION ALL SELECT c_custkey, 0, head.* FROM customer, head UNION ALL SELECT k, off, last.* FROM tail, last)""")
def code_accesses_query(spark, sf):
    return code_accesses(java_flow_files(spark, sf)).select(
        "doc_id", "idx", "role", "var", "stmt", F.col("branch").isNotNull().alias("in_branch"), F.col("loop").isNotNull().alias("in_loop"))
