"""Data flow on access tables (C5-C8: J3-J8, W3-W5, A5, A6, P9).

An *access table* is any log of reads and writes:
``(doc_id, block, loop_id, stmt_id, role, var, idx)`` with ``role`` in
{def, use, value}.  A lexed, statement-split program gives one; so does an
event log (var = user, def = one event type).  The per-language syntax-tree
walks of the reference become parameters (see ``Policy``).

Nothing here emits all pairs of a group: use->def edges are as-of lookups
(one definition per use), statement edges pair each source with its
statement's target(s), and the all-to-all update relation is returned in
factorized form (members + count) rather than as n^2 rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import last_before


@dataclass(frozen=True)
class Policy:
    """Per-language data-flow parameters (replaces seven tree walkers)."""
    include_base: str = "if_no_else"      # or "always" (Go, PHP, JavaScript)
    else_from: str = "base"               # "base" | "current"
    passes: int = 2                       # loop bodies are walked twice
    second_pass_from: str = "all"         # or "after_init" (for-loop update part)


JAVA = Policy()
PYTHON = Policy()
GO = Policy(include_base="always", second_pass_from="after_init")


def reaching_defs(acc: DataFrame, by: list[str], order: list[str], is_def: Column, idx: str = "idx",
                  chunk: Column | str | None = None, name: str = "def_idx") -> DataFrame:
    """Each row gets the ``idx`` of the latest definition strictly
    before it within ``by`` (an as-of lookup; no join)."""
    d = acc.withColumn("_defv", F.when(is_def, F.col(idx)))
    return last_before(d, by, order, "_defv", name, chunk=chunk).drop("_defv")


def first_occurrence_edges(tokens: DataFrame, by: list[str], key: str = "text", idx: str = "idx",
                           definer: Column | None = None) -> DataFrame:
    """The first occurrence of a name (among rows where ``definer`` holds)
    defines it; every later occurrence links to it.  ``(by, key, src, dst)``.
    A window keyed by (doc, name): on a doc-partitioned token table it needs
    no shuffle."""
    t = tokens if definer is None else tokens.filter(definer)
    w = Window.partitionBy(*by, key)
    t = t.withColumn("src", F.min(idx).over(w))
    return t.filter(F.col(idx) > F.col("src")).select(*by, key, "src", F.col(idx).alias("dst"))


def statement_edges(acc: DataFrame, stmt: list[str], role: str = "role", idx: str = "idx") -> DataFrame:
    """Within a statement every source (value or use) flows into the
    statement's definition(s).  A definition without sources keeps a row with
    a NULL source (declaration without value).  Statements in real code have
    one or two targets, so this is linear in the accesses."""
    targets = acc.filter(F.col(role) == "def").select(*stmt, F.col(idx).alias("dst"))
    sources = acc.filter(F.col(role).isin("use", "value")).select(*stmt, F.col(idx).alias("src"))
    return outer_as_inner(targets, sources, stmt).select(*stmt, "src", "dst")


def outer_as_inner(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left LEFT JOIN right`` written as an inner join plus the unmatched
    left rows.  AQE can split a hot key of *either* side of an inner join
    (of a left outer join only the left side), and the unmatched rows come
    from an anti join against the distinct right keys (deduplicated
    map-side, so a hot key is one row per task there)."""
    matched = left.join(right, keys, "inner")
    alone = left.join(right.select(*keys).distinct(), keys, "left_anti")
    for f in right.schema.fields:
        if f.name not in keys:
            alone = alone.withColumn(f.name, F.lit(None).cast(f.dataType))
    return matched.unionByName(alone.select(*matched.columns))


def update_edges(acc: DataFrame, stmt: list[str], idx: str = "idx") -> DataFrame:
    """``i++`` - every access of the statement feeds every other one,
    itself included.  Returned factorized: one row per statement with its
    member count and edge count n^2; the members are the statement's own
    access rows.  Neither the n^2 edges nor a member list (the whole group)
    is ever materialized."""
    return acc.groupBy(*stmt).agg(F.count("*").alias("n_members")) \
              .withColumn("n_edges", F.col("n_members") * F.col("n_members"))


def zip_assign(left: DataFrame, right: DataFrame, keys: list[str], ord_col: str, val: str,
               counts: DataFrame | None = None) -> DataFrame:
    """``a, b = x, y``: pair by ordinal when both sides have the same
    count; otherwise each left is paired with the whole right side (one row
    per left with ``dst`` NULL and ``whole`` = true)."""
    sides = (left.select(*keys, ord_col, val, F.lit(True).alias("_left"))
             .unionByName(right.select(*keys, ord_col, val, F.lit(False).alias("_left"))))
    return zip_sides(sides, keys, F.col("_left"), ord_col, val, counts)


def zip_sides(sides: DataFrame, keys: list[str], is_left: Column, ord_col: str, val: str,
              counts: DataFrame | None = None) -> DataFrame:
    """J7 on one table of both sides (ordinals are unique per statement and
    side): an aggregate on (statement, ordinal) pairs them, and one per
    statement decides the mode (``counts`` = ``(keys, n_left, n_right)`` if
    the caller has it from a cheaper source)."""
    if counts is None:
        counts = sides.groupBy(*keys).agg(F.count_if(is_left).alias("n_left"), F.count_if(~is_left).alias("n_right"))
    mode = counts.select(*keys, (F.col("n_left") != F.col("n_right")).alias("whole"))
    pairs = (sides.groupBy(*keys, ord_col)
             .agg(F.max(F.when(is_left, F.col(val))).alias("src"), F.max(F.when(~is_left, F.col(val))).alias("_d"),
                  F.count_if(is_left).alias("_n")).filter("_n > 0"))
    return pairs.join(mode, keys).select(*keys, ord_col, "src", F.when(~F.col("whole"), F.col("_d")).alias("dst"), "whole")


def merge_entries(entries: DataFrame, key: list[str], src_col: str, out: str = "sources") -> DataFrame:
    """A5: duplicate entries with the same key merge into one, with the
    sorted distinct union of their sources (``collect_set`` deduplicates
    map-side, so a hot key ships at most its distinct sources)."""
    return entries.groupBy(*key).agg(F.sort_array(F.collect_set(src_col)).alias(out))


def union_positions(a, b) -> Column:
    """Sorted distinct union of two position lists."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.sort_array(F.array_union(a, b))


def merge_branches(states: DataFrame, scope: list[str], var: str, branch: str, idx: str, order: list[str],
                   base: DataFrame | None = None, has_else: bool = True, policy: Policy = JAVA,
                   branches: DataFrame | None = None, branch_order: str | None = None) -> DataFrame:
    """The live definitions of each variable after an if/else.

    ``states``: definitions inside the branches ``(scope, var, branch, idx,
    order...)``; ``base``: definitions live before the branch ``(scope, var,
    idx)`` (several rows per variable allowed); ``branches``: the branches of
    each scope (default: those seen in ``states``).  Per (variable, branch)
    the state at the branch's end is its last definition there; a variable
    the branch does not touch keeps the state it entered with - the pre-branch
    state (``else_from='base'``) or the state left by the earlier branches
    (``'current'``, ordered by ``branch_order``).  The pre-branch state is
    added once more when there is no else (``include_base='if_no_else'``) or
    always.  Result: ``(scope, var, defs)`` sorted distinct.  Work per
    variable is bounded by the number of branches."""
    last = (states.groupBy(*scope, var, branch)
                  .agg(F.max_by(F.col(idx), F.struct(*order)).alias("_d")))
    br = (branches if branches is not None else states.select(*scope, branch)).select(*scope, branch).distinct()
    vars_ = states.select(*scope, var)
    if base is not None:
        vars_ = vars_.unionByName(base.select(*scope, var))
    grid = vars_.distinct().join(br, scope)                   # variables x branches of their scope
    per = grid.join(last, [*scope, var, branch], "left")
    if policy.else_from == "current" and branch_order:
        w = Window.partitionBy(*scope, var).orderBy(branch_order).rowsBetween(Window.unboundedPreceding, 0)
        per = per.withColumn("_d", F.last("_d", ignorenulls=True).over(w))
    taken = per.filter(F.col("_d").isNotNull()).select(*scope, var, F.col("_d").alias(idx))
    parts = taken
    if base is not None:
        b = base.select(*scope, var, idx)
        untouched = per.filter(F.col("_d").isNull()).select(*scope, var).distinct().join(b, [*scope, var])
        parts = parts.unionByName(untouched)
        if policy.include_base == "always" or (policy.include_base == "if_no_else" and not has_else):
            parts = parts.unionByName(b)
    return parts.groupBy(*scope, var).agg(F.sort_array(F.collect_set(idx)).alias("defs"))


def unroll_loops(acc: DataFrame, loop_col: str, passes: int = 2, init_col: str | None = None,
                 policy: Policy | None = None) -> DataFrame:
    """Rows inside a loop are repeated ``passes`` times (column ``pass``)
    so a use early in the body sees the definitions of the previous
    iteration; rows outside loops get pass 0.  With ``second_pass_from=
    'after_init'`` the loop's initialisation rows (``init_col``) run once."""
    passes = policy.passes if policy is not None else passes
    reps = F.when(F.col(loop_col).isNotNull(), F.sequence(F.lit(0), F.lit(passes - 1))).otherwise(F.array(F.lit(0)))
    if policy is not None and policy.second_pass_from == "after_init" and init_col:
        reps = F.when(F.coalesce(F.col(init_col), F.lit(False)), F.array(F.lit(0))).otherwise(reps)
    return acc.withColumn("pass", F.explode(reps))


def dataflow_edges(acc: DataFrame, doc: str = "doc_id", passes: int = 2, policy: Policy | None = None,
                   init_col: str | None = None, chunk: Column | str | None = "block") -> DataFrame:
    """C5-C8 together on an access table ``(doc_id, block, loop_id, stmt_id,
    role, var, idx)``: statement edges (J4/J5) plus use edges from the
    reaching definition over unrolled loops (W5 + W3): ``(doc_id, src, dst)``,
    statement edges as a bag, use edges once each.  ``chunk`` never decreases
    along the order (block, pass, ...): a variable with very many accesses is
    cut there and spread (see ``scan``)."""
    st = statement_edges(acc, [doc, "stmt_id"]).filter(F.col("src").isNotNull()).select(doc, "src", "dst")
    u = unroll_loops(acc.filter(F.col("role").isin("use", "def")), "loop_id", passes, init_col, policy)
    u = u.withColumn("_isdef", (F.col("role") == "def").cast("int"))
    r = reaching_defs(u, [doc, "var"], ["block", "pass", "stmt_id", "_isdef", "idx"], F.col("role") == "def",
                      chunk=chunk)
    uses = r.filter((F.col("role") == "use") & F.col("def_idx").isNotNull()) \
            .select(doc, F.col("def_idx").alias("src"), F.col("idx").alias("dst")).distinct()
    return st.unionByName(uses)


def prune_dangling(entries: DataFrame, key: list[str], idx: str, src: str) -> DataFrame:
    """Keep entries that have a source or are some entry's source."""
    used = entries.filter(F.col(src).isNotNull()).select(*key, F.col(src).alias(idx)).distinct()
    has_src = entries.filter(F.col(src).isNotNull())
    is_used = entries.filter(F.col(src).isNull()).join(used, [*key, idx], "left_semi")
    return has_src.unionByName(is_used)


def resolve_edges(edges: DataFrame, tokens: DataFrame, key: list[str], idx: str = "idx",
                  cols: list[str] | None = None) -> DataFrame:
    """Attach the token rows of both end points (two equi joins)."""
    cols = cols or ["text"]
    s = tokens.select(*key, F.col(idx).alias("src"), *[F.col(c).alias(f"src_{c}") for c in cols])
    d = tokens.select(*key, F.col(idx).alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in cols])
    return edges.join(s, [*key, "src"], "left").join(d, [*key, "dst"], "left")
