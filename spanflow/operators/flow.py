"""Data flow of source code: accesses from tokens (C5), composed through branches
and loops at any depth (C6-C8).

:func:`code_accesses` gives one row an access, with the regions (loops, branches)
around it.  :func:`flow_edges` composes them.  What a region does to a variable is a small
summary: the definitions that leave it (``gens``), whether what came in is gone
(``kill``), and what leaves if nothing came in (``first``: an unbound name is
bound by its first use).  Summaries are combined level by level up the tree of regions; then
the definitions that come into each region are pushed down it.  Both directions
are aggregates and joins by (document, region, variable): a loop costs no
unrolling, whatever its passes and nesting, since a region changes what came in only by
``gens | (in unless kill)``, so that its second pass is a fixed point.

The hot key is a variable with very many accesses in one region: the scan for the last
kill is cut into chunks of the walk (:mod:`.scan`), everything else is a partial
aggregate or a join that Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.lexing import is_blank, is_comment, pieces
from ..functions.statements import walk
from ..session import checkpoint_dir
from .dataflow import Policy, statement_edges
from .kernel import spread
from .scan import last_before

#: The walk of the reference takes the state before a Java ``if`` once more at its ``else``.
JAVA_FLOW = Policy(include_base="always")
#: Accesses of one document that a task scans at a time.
CHUNK = 100_000
#: Accesses of a batch that goes back (more only for a longer document).
OUT_ROWS = 1 << 13

_REGION = "struct<region: int, kind: string, at: int, fork: int, ways: int>"
_ACCESS = f"pos int, idx int, var string, role string, stmt int, path array<{_REGION}>"


def code_accesses(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """C5 input, from Java text: ``(doc, pos, idx, var, role, stmt, region, branch, loop, path)``.

    ``idx`` numbers the tokens as :func:`.tokens.token_table` does.  Roles: ``use``, ``see`` (the
    name of a type: read, never bound) and ``def``, in the order ``pos`` in which the program is walked, and
    ``value`` (no ``pos``): a token whose value goes to the targets, the ``def`` rows, of its ``stmt``.
    ``path`` holds the regions around, outermost first; ``region``, ``branch`` and ``loop`` are the innermost ones (0 and
    NULL outside).  A document is one row, split where it is read: no shuffle.  NULL and
    empty texts have no accesses; ``doc`` must tell documents apart, and rows without it are left out."""
    tokens = F.filter(pieces(F.col(text), "java"), lambda p: ~is_blank(p) & ~is_comment(p, "java"))
    rows = spread(docs.where(F.col(doc).isNotNull())).select(F.col(doc).alias("doc"), tokens.alias("tokens"))
    key = rows.schema["doc"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc {key}, {_ACCESS}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols, last = [], _columns(), batch.num_rows - 1
            for row, tok in enumerate(batch.column(1).to_pylist()):
                if tok:
                    _add(cols, *walk(tok), tok)
                    at += [row] * (len(cols["idx"]) - len(at))
                if at and (len(at) >= OUT_ROWS or row == last):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *_arrays(cols, arrow)], schema=arrow)
                    at, cols = [], _columns()
    acc = rows.mapInArrow(run, schema).withColumnRenamed("doc", doc)
    return acc.select("*", *_innermost())


def _columns() -> dict[str, list]:
    return {c: [] for c in ("pos", "idx", "var", "role", "stmt", "regions", "ends")}


def _add(cols: dict[str, list], events: list[tuple], values: list[tuple], tok: list[str]) -> None:
    """The accesses of one document; ``ends`` are those of the paths in ``regions``."""
    regions = cols["regions"]
    if events:
        pos, idx, role, stmt, paths = zip(*events)
        for c, v in (("pos", pos), ("idx", idx), ("role", role), ("stmt", stmt)):
            cols[c] += v
        for path in paths:
            regions += path
            cols["ends"].append(len(regions))
    cols["pos"] += [None] * len(values)
    cols["idx"] += [i for _, i in values]
    cols["role"] += ["value"] * len(values)
    cols["stmt"] += [s for s, _ in values]
    cols["ends"] += [len(regions)] * len(values)
    cols["var"] += [tok[i] for i in cols["idx"][len(cols["var"]):]]


def _arrays(cols: dict[str, list], arrow: pa.Schema) -> list[pa.Array]:
    plain = [pa.array(cols[c], arrow.field(c).type) for c in ("pos", "idx", "var", "role", "stmt")]
    region = arrow.field("path").type.value_type
    parts = list(zip(*cols["regions"])) or [()] * region.num_fields
    # the number of ways is that at the end of the walk
    parts[-1] = [w[0] for w in parts[-1]]
    structs = pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, region)], fields=list(region))
    return [*plain, pa.ListArray.from_arrays(pa.array([0, *cols["ends"]], pa.int32()), structs, type=arrow.field("path").type)]


def _innermost() -> list[Column]:
    def of(kind):
        return F.element_at(F.filter("path", lambda r: r["kind"] == kind)["region"], -1)
    last = F.when(F.size("path") > 0, F.element_at("path", -1)["region"]).otherwise(0)
    return [last.alias("region"), *[F.when(F.size(F.filter("path", lambda r: r["kind"] == k)) > 0, of(k)).alias(k) for k in ("branch", "loop")]]


def _kept(df: DataFrame) -> DataFrame:
    """A level, written to the shared checkpoint folder: the next ones do not repeat it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _summaries(items: DataFrame, doc: str) -> DataFrame:
    """What each region does to each variable, from its items in order."""
    by = [doc, "region", "var"]
    first = F.struct("pos", F.col("first").alias("ids"))
    per = (items.withColumn("gen", F.explode_outer("gens")).groupBy(*by, "own")
           .agg(F.collect_set("gen").alias("gens"), F.min(F.when(F.col("first").isNotNull(), first)).alias("f"), F.first("path").alias("path")))
    # the last kill and what is defined behind it leave the region
    all_ = (per.groupBy(*by).agg(F.max_by("gens", F.coalesce("own", F.lit(-1))).alias("gens"), F.max("own").isNotNull().alias("kill"),
                                 F.min("f").alias("f"), F.first("path").alias("path")))
    out = F.when(F.col("kill") | F.col("f").isNull(), F.col("gens")).otherwise(F.array_union("f.ids", "gens"))
    return all_.select(*by, "path", "gens", "kill", F.when(F.col("f").isNotNull(), out).alias("first"),
                       F.col("f.pos").alias("bound_at"), F.col("f.ids").alias("bound"))


def _as_items(summaries: DataFrame, doc: str, policy: Policy) -> DataFrame:
    """Regions as items of the regions around them: a loop as it is, the branches of a fork as one."""
    el = F.element_at("path", -1)
    rows = summaries.select(doc, "var", F.slice("path", 1, F.size("path") - 1).alias("path"), el.alias("el"), "gens", "kill", "first")
    rows = rows.select("*", F.col("el.at").alias("pos"), F.col("el.fork").alias("gate"), F.col("el.kind").alias("kind"), F.col("el.ways").alias("ways"))
    base = {"always": F.lit(True), "if_no_else": F.col("ways") == 1}[policy.include_base]
    forks = rows.where("kind = 'branch'").groupBy(doc, "var", "gate", "pos", "ways").agg(
        F.first("path").alias("path"), F.array_distinct(F.flatten(F.collect_list("gens"))).alias("gens"), F.count_if("kill").alias("kills"),
        F.array_distinct(F.flatten(F.collect_list("first"))).alias("first"), F.count("first").alias("n"))
    forks = forks.select(doc, "var", "path", "pos", "gate", F.lit("branch").alias("kind"), "gens",
                         (~base & (F.col("kills") == F.col("ways"))).alias("kill"), F.when(F.col("n") > 0, F.col("first")).alias("first"))
    return rows.where("kind = 'loop'").select(doc, "var", "path", "pos", "gate", "kind", "gens", "kill", "first").unionByName(forks)


def flow_edges(acc: DataFrame, doc: str = "doc_id", policy: Policy = JAVA_FLOW, chunk: int = CHUNK) -> DataFrame:
    """C5-C8 composed: ``(doc, src, dst)``, each edge once, from :func:`code_accesses`.

    A use gets every definition that reaches it in some pass over the loops around it; an
    unbound name is bound by its first use; the targets of a statement get its values.  ``policy``:
    whether the state before a fork joins that after it (``include_base``), and whether loops
    run again (``passes``).  Entries without sources (P9) give no edge."""
    if policy.else_from != "base" or policy.include_base not in ("always", "if_no_else"):
        raise ValueError(f"no such walk: {policy}")
    none = F.array().cast("array<int>")
    is_def, binds = F.col("role") == "def", F.col("role").isin("def", "use")
    # the walk of the texts, once for events and statements
    acc = _kept(acc.select(doc, "pos", "idx", "var", "role", "stmt", "path"))
    events = acc.where(F.col("pos").isNotNull()).select(
        doc, "var", "path", "pos", F.lit(None).cast("int").alias("gate"), F.lit(None).cast("string").alias("kind"), "idx", "role",
        F.when(is_def, F.array("idx")).otherwise(none).alias("gens"), is_def.alias("kill"), F.when(binds, F.array("idx")).alias("first"))
    depth = events.agg(F.max(F.size("path"))).first()[0]
    statements = statement_edges(acc, [doc, "stmt"]).where(F.col("src").isNotNull()).select(doc, "src", "dst")
    if depth is None:
        return statements.distinct()
    levels, summaries, inner = {}, {}, None
    for d in range(depth, -1, -1):
        items = events.where(F.size("path") == d)
        if inner is not None:
            items = items.unionByName(inner, allowMissingColumns=True)
        items = items.withColumn("region", F.element_at("path", -1)["region"] if d else F.lit(0))
        items = last_before(items.withColumn("killed", F.when(F.col("kill"), F.col("pos"))), [doc, "region", "var"], ["pos"], "killed", "seg",
                            chunk=F.floor(F.col("pos") / chunk))
        # the last kill before an item, and the one that its own definitions come with
        levels[d] = _kept(items.withColumn("own", F.when(F.col("kill"), F.col("pos")).otherwise(F.col("seg"))).drop("killed"))
        summaries[d] = _kept(_summaries(levels[d], doc))
        inner = _as_items(summaries[d], doc, policy) if d else None
    edges, entry = [statements], None
    for d in range(depth + 1):
        context = summaries[d].select(doc, "region", "var", "bound_at", "bound", "path")
        if d:
            context = context.withColumn("gate", F.element_at("path", -1)["fork"]).join(entry, [doc, "gate", "var"])
        else:
            context = context.withColumns({"came": none, "unbound": F.lit(True)})
        context = context.select(doc, "region", "var", "bound_at", "bound", "came", "unbound")
        items = levels[d].where((F.col("role").isin("use", "see")) | F.col("kind").isNotNull())
        # what came into the region and was not killed, and the use that bound the name
        bound = F.col("unbound") & (F.col("pos") > F.col("bound_at"))
        open_ = items.where(F.col("seg").isNull()).join(context, [doc, "region", "var"])
        outer = open_.select(doc, "var", "idx", "gate", "kind", F.explode(F.when(bound, F.array_union("came", "bound")).otherwise(F.col("came"))).alias("src"))
        gens = levels[d].where(F.size("gens") > 0).select(
            doc, "region", "var", F.coalesce("own", F.lit(-1)).alias("seg_"), F.col("pos").alias("at"), F.explode("gens").alias("src"))
        near = items.withColumn("seg_", F.coalesce("seg", F.lit(-1))).join(gens, [doc, "region", "var", "seg_"]).where(F.col("at") < F.col("pos"))
        reach = outer.unionByName(near.select(doc, "var", "idx", "gate", "kind", "src"))
        edges.append(reach.where(F.col("kind").isNull()).select(doc, "src", F.col("idx").alias("dst")))
        if d < depth:
            got = reach.where(F.col("kind").isNotNull()).groupBy(doc, "gate", "var").agg(F.collect_set("src").alias("got"))
            still = open_.where(F.col("kind").isNotNull()).select(doc, "gate", "var", (F.col("unbound") & ~F.coalesce(bound, F.lit(False))).alias("free"))
            entry = items.where(F.col("kind").isNotNull()).select(doc, "gate", "var", "kind", "gens", "first") \
                .join(got, [doc, "gate", "var"], "left").join(still, [doc, "gate", "var"], "left")
            free, came = F.coalesce("free", F.lit(False)), F.coalesce("got", none)
            if policy.passes > 1:
                # a loop's later passes begin with what leaves its body
                again = F.array_union(F.col("gens"), F.when(free, F.coalesce("first", none)).otherwise(none))
                came = F.when(F.col("kind") == "loop", F.array_union(came, again)).otherwise(came)
            entry = _kept(entry.select(doc, "gate", "var", came.alias("came"), free.alias("unbound")))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()
