"""Merkle dataset manifest by time-forward processing.

Rows are leaves of one tree a group (source), whose roots are the leaves of one tree over
the groups in order.  A node's label is (tree, level, place in its level).

Upward sweep, level by level: every node sends its digest to its parent's label.  The
messages go through an external priority queue, which in Spark is an exchange by
ranges of labels that sorts (and spills) within each range; a parent takes its at most
``ARITY`` messages from the queue in order and hashes them.  Every level's runs of
siblings are written.  Reversed sweep, from the root down: every node gets a suffix,
the siblings of its ancestors, and sends it, with its own siblings in front, to its children.
A suffix is one pair (digests left, digests right of the path) a level, so
that it serves as the proof and to fold any leaf up to a root again.

Places within a group come from one exchange by ranges of (group, id, leaf): row
numbers within a range, plus the number of the group's rows in the ranges before
(one row a range and group).  No group is collected or sorted in one task.

A leaf hashes its fields in order, each ``-`` if NULL, else UTF-8 bytes, ``:``, value
(:func:`leaf`).  Digests are lower-case hex.

Defined cases: NULL groups form one group, the first; NULL ids come first within a
group; rows of equal group and id go by digest, and equal rows are as many leaves; a lone
leaf is its tree's root; an empty table gives an empty manifest; empty and long
texts are hashed whole; further columns are carried along, whatever their names,
unless they are named like a result column, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

ARITY = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RESULTS = ["leaf", "subroot", "root", "proof", "folded_root", "verified"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    def one(c):
        v = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string").cast("binary"), F.lit(b":"), v.cast("binary")), F.lit(b"-"))
    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def numbered(nodes: DataFrame, by: list[str], name: str) -> DataFrame:
    """``place`` and ``size``: each row's number in its tree and the tree's number of rows,
    in the order of (tree, *by), without one task a tree."""
    order = ["tree", *by]
    ranged = nodes.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
    # rows of one range are numbered as they were sorted; written, so that no lost task numbers them anew
    at = F.monotonically_increasing_id()
    rows = stored(ranged.withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))).withColumn("part", F.shiftright(at, 33).cast("int")), name)
    parts = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return rows.join(parts, ["tree", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _by_place(a: Column, b: Column) -> Column:
    return F.signum(a["place"] - b["place"]).cast("int")


def sweep_up(nodes: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """Nodes (tree, place, size, digest, load) -> the levels, lowest first: written tables
    (tree, place, size, digest, kids) of the parents with their runs of children."""
    levels, rows = [], nodes
    while (rows.agg(F.max("size").alias("m")).first().m or 0) > 1:
        messages = rows.where(F.col("size") > 1).select(
            "tree", F.floor(F.col("place") / arity).cast("bigint").alias("parent"), "size",
            F.struct("place", "digest", "load").alias("kid"))
        queue = messages.repartitionByRange("tree", "parent").sortWithinPartitions("tree", "parent", "kid.place")
        runs = queue.groupBy("tree", "parent").agg(
            F.ceil(F.first("size") / arity).cast("bigint").alias("size"), F.array_sort(F.collect_list("kid"), _by_place).alias("kids"))
        level = runs.select("tree", F.col("parent").alias("place"), "size",
                            digest(F.array_join("kids.digest", "")).alias("digest"), "kids")
        levels.append(stored(level, f"{name}{len(levels)}"))
        rows = levels[-1].select("tree", "place", "size", "digest", F.lit(None).cast("string").alias("load"))
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """The roots (tree, digest, load) that each level holds, the nodes' own first."""
    lone = F.col("size") == 1
    return [nodes.where(lone).select("tree", "digest", "load")] + [
        r.where(lone).select("tree", "digest", F.lit(None).cast(nodes.schema["load"].dataType).alias("load")) for r in levels]


def sweep_down(levels: list[DataFrame], given: list[DataFrame], name: str) -> DataFrame:
    """``given[k]``: what the roots at level k get (tree, place, suffix, news) -> what
    the children of the lowest level get: (tree, place, digest, load, suffix, news)."""
    above = given[-1]
    for k in range(len(levels) - 1, -1, -1):
        runs = levels[k].select("tree", "place", "kids").join(above, ["tree", "place"])
        kids = runs.select("tree", "kids", "suffix", "news", F.posexplode("kids").alias("slot", "kid"))
        def joined(part):
            return F.array_join(F.transform(part, lambda x: x["digest"]), "")
        step = F.struct(joined(F.slice("kids", F.lit(1), F.col("slot"))).alias("left"),
                        joined(F.slice("kids", F.col("slot") + 2, F.greatest(F.size("kids") - F.col("slot") - 1, F.lit(0)))).alias("right"))
        got = kids.select("tree", F.col("kid.place").alias("place"), F.col("kid.digest").alias("digest"),
                          F.col("kid.load").alias("load"), F.concat(F.array(step), F.col("suffix")).alias("suffix"), "news")
        if k:
            above = stored(got.select("tree", "place", "suffix", "news").unionByName(given[k]), f"{name}{k}")
    return got


def proof(suffix: Column) -> Column:
    """All siblings from leaf to root, left to right."""
    return F.array_join(F.transform(suffix, lambda s: F.concat(s["left"], s["right"])), "")


def fold(start: Column, suffix: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(suffix, start, lambda d, s: digest(F.concat(s["left"], d, s["right"])))


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "source", fields: list[str] | None = None,
             altered: tuple[Column, dict[str, Column]] | None = None, arity: int = ARITY, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with leaf, subroot, root, proof (an array of siblings left and right a
    level), folded_root and verified.  ``altered``: a condition and new values of fields
    of the rows to be verified with these."""
    fields = fields or FIELDS
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    own = leaf([quoted(c) for c in fields])
    if altered:
        other = leaf([altered[1].get(c, quoted(c)) for c in fields])
        shown = F.when(F.coalesce(altered[0], F.lit(False)), other)
    else:
        shown = F.lit(None).cast("string")
    # the label of a group's tree orders like the group, NULL first
    tree = F.coalesce(F.concat(F.lit("v"), quoted(group).cast("string")), F.lit("n"))
    load = F.struct(shown.alias("shown"), F.struct(*[quoted(c) for c in kept]).alias("own"))
    nodes = docs.select(tree.alias("tree"), quoted(doc_id).alias("id"), own.alias("digest"), load.alias("load"))
    # written before it is sampled for ranges: the texts are read and hashed once
    nodes = numbered(stored(nodes, "digests"), ["id", "digest"], "leaves").select("tree", "place", "size", "digest", "load")
    levels = sweep_up(nodes, arity, "run")
    found = tops(nodes, levels)
    # the groups' roots are the leaves of the tree of groups
    roots = found[0].select("tree", "digest")
    for f in found[1:]:
        roots = roots.union(f.select("tree", "digest"))
    roots = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], "subroots")
    roots = roots.select("tree", "place", "size", "digest", F.col("group").alias("load"))
    upper = sweep_up(roots, arity, "upper")
    ends = [t.select("tree", F.lit(0).cast("bigint").alias("place"), F.array().cast(_STEP).alias("suffix"),
                     F.col("digest").alias("news"), "digest", "load") for t in tops(roots, upper)]
    whole = ends[0].select("load", "digest", "suffix", "news")
    if upper:
        below = sweep_down(upper, [e.select("tree", "place", "suffix", "news") for e in ends], "upper_suffix")
        whole = whole.union(below.select("load", "digest", "suffix", "news"))
    news = stored(whole.select(F.col("load").alias("tree"), F.lit(0).cast("bigint").alias("place"), "suffix",
                               F.struct(F.col("digest").alias("subroot"), F.col("news").alias("root")).alias("news")), "subroot_news")
    given = [news.join(f.select("tree"), "tree", "left_semi").select("tree", "place", "suffix", "news") for f in found]
    rows = nodes.where(F.col("size") == 1).join(given[0], ["tree", "place"]).select(
        "tree", "place", "digest", "load", "suffix", "news")
    if levels:
        rows = rows.unionByName(sweep_down(levels, given, "suffix"))
    out = rows.select(*[F.col("load.own").getField(c).alias(c) for c in kept], F.col("digest").alias("leaf"), "news.subroot", "news.root",
                      F.col("suffix").alias("proof"),
                      fold(F.coalesce("load.shown", "digest"), F.col("suffix")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: str = "text") -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(quoted(text), _UPPER, _LOWER)
