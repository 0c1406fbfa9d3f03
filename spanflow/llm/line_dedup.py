"""Line deduplication by winnowing over line hashes.

A text's content lines (those with a word) are hashed.  Of every ``run``
consecutive content lines the smallest hash is selected: these minima are the
fingerprints, and two places that share ``run`` lines are guaranteed to share
one.  Positions of fingerprints are joined; those found at two places or more are
extended both ways, to the windows that they are the minimum of.  Each is joined with the
first place of its lines, and the lines of every later window go; longer runs are the
union of their windows.

With ``single``, one line of at least so many words is a run as well, so that it goes
wherever it repeats, between whatever lines; shorter lines (headings, list items,
greetings) only go with a neighbour.

Places are ordered by document id (NULL first), then text key, then line.  Only
DataFrame functions are used: no Python on the executors.

Defined cases: rows of equal id and text are one document and get the same
result; blank lines are never matched and never removed; texts with fewer than
``run`` content lines (and no single line that is a run), empty and NULL texts stay as
they are; a text all of whose
lines go is ''; an empty table stays empty; other columns are carried along.  A
third of all lines may be equal: hot hashes are pre-aggregated before their
shuffle and the join back is one that Spark splits (one row per key on the other
side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, stored, text_key

RUN = 2
#: Words of a line that the query and the pipeline take for a run of its own.
SINGLE = 8
_WORD = r"[^\x20\x09-\x0D]"


def _key(docs: DataFrame, doc_id: str, text: str):
    return text_key(quoted(doc_id), quoted(text))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN,
                 single: int | None = None, lines: bool = True) -> DataFrame:
    """The selected lines of every document: ``print`` (the line's hash) and ``place``; with
    ``lines`` also doc, id, the content lines up to ``run - 1`` before and after (position and
    digest), and ``of``: for each window around, whether this line is its minimum, and
    whether the line is a run of its own."""
    line = F.transform(F.split(quoted(text), "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    hashed = F.transform(F.filter(line, lambda x: x["line"].rlike(_WORD)), lambda x: F.struct(
        F.xxhash64(x["line"]).alias("h"), x["pos"].alias("pos"),
        *([F.unhex(F.md5(x["line"].cast("binary"))).alias("d")] if lines else []),
        *([] if single is None else [x["line"].rlike(_at_least(single)).alias("long")])))
    rows = docs.select(_key(docs, doc_id, text).alias("doc"), quoted(doc_id).alias("id"), hashed.alias("lines"))
    rows = rows.where(F.size("lines") >= (run if single is None else 1))
    # the line itself, and its neighbours: the same array, shifted
    reach = range(1 - run, run)
    none = F.transform(F.slice("lines", 1, run - 1), lambda x: F.lit(None).cast(rows.schema["lines"].dataType.elementType))
    shifted = {j: F.col("lines") if j == 0 else F.slice("lines", F.lit(j + 1), F.size("lines")) if j > 0
               else F.concat(F.slice(none, 1, -j), F.col("lines")) for j in reach}
    zipped = F.arrays_zip(*[a.alias(_name(j)) for j, a in shifted.items()])
    at = {j: F.col(f"w.{_name(j)}") for j in reach}
    w = rows.select("doc", "id", F.explode(zipped).alias("w")).where(at[0].isNotNull())

    def lowest(first: int):
        window = [at[j] for j in range(first, first + run)]
        order = [F.struct(x["h"].alias("h"), x["pos"].alias("pos")) for x in window]
        low = F.array_min(F.array(*order))["pos"] == at[0]["pos"]
        return F.coalesce(window[0].isNotNull() & window[-1].isNotNull() & low, F.lit(False))
    of = {_name(a): lowest(a) for a in range(1 - run, 1)}
    if single is not None:
        of["own"] = at[0]["long"]
    w = w.select("doc", "id", "w", F.struct(*[c.alias(n) for n, c in of.items()]).alias("of"))
    w = w.where(" OR ".join(f"of.{n}" for n in of))
    cols = [at[0]["h"].alias("print"), F.xxhash64("doc", at[0]["pos"]).alias("place")]
    if lines:
        cols += ["doc", "id", "of", *[F.struct(at[j]["pos"].alias("pos"), at[j]["d"].alias("d")).alias(_name(j)) for j in reach]]
    return w.select(*cols)


def _name(j: int) -> str:
    return f"back{-j}" if j < 0 else f"ahead{j}"


def _at_least(words: int) -> str:
    """Matches lines of so many words or more; reads no further than the last of them."""
    blank = r"[\x20\x09-\x0D]"
    return rf"^{blank}*+(?:{_WORD}++{blank}++){{{words - 1}}}{_WORD}"


def _windows(matched: DataFrame, run: int, single: int | None) -> DataFrame:
    """Matched positions, extended both ways to the windows that they are the minimum of."""
    def window(first: int, last: int):
        lines = [F.col(_name(j)) for j in range(first, last + 1)]
        return F.struct(F.array(*[x["pos"] for x in lines]).alias("positions"),
                        F.unhex(F.md5(F.concat(*[x["d"] for x in lines]))).alias("key"))
    made = [F.when(F.col(f"of.{_name(a)}"), window(a, a + run - 1)) for a in range(1 - run, 1)]
    if single is not None:
        made.append(F.when(F.col("of.own"), window(0, 0)))
    w = matched.select("doc", "id", F.explode(F.array(*made)).alias("w")).where("w IS NOT NULL")
    return w.select("doc", "id", F.get("w.positions", F.lit(0)).alias("start"), "w.positions", "w.key")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN,
                   single: int | None = None) -> DataFrame:
    """doc and the sorted positions of its lines that repeat an earlier run.  Only
    fingerprints are shuffled; the windows at those that meet are written once."""
    shared = (fingerprints(docs, doc_id, text, run, single, lines=False)
              .groupBy("print").agg(F.min("place").alias("a"), F.max("place").alias("b"))
              .where(F.col("a") != F.col("b")).select("print"))
    matched = fingerprints(docs, doc_id, text, run, single).join(shared, "print", "left_semi")
    seeds = stored(_windows(matched, run, single), "line_windows")
    place = F.struct("id", "doc", "start")
    first = (seeds.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where(~F.col("first").eqNullSafe(F.col("last"))).select("key", "first"))
    later = seeds.join(first, "key").where(~place.eqNullSafe(F.col("first")))
    return (later.select("doc", F.explode("positions").alias("pos"))
            .groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("gone")))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN,
                counts: tuple[str, str] | None = None, single: int | None = None) -> DataFrame:
    """``docs`` whose texts have lost the later repeated runs; ``counts`` names
    columns for the lines before and the lines removed."""
    doc, gone, lines, kept = (fresh(n, docs.columns) for n in ("doc_", "gone_", "lines_", "kept_"))
    repeated = repeated_lines(docs, doc_id, text, run, single).select(F.col("doc").alias(doc), F.col("gone").alias(gone))
    rows = docs.withColumn(doc, _key(docs, doc_id, text)).join(repeated, doc, "left")
    rows = rows.withColumn(lines, F.split(quoted(text), "\n"))
    rows = rows.withColumn(kept, F.when(F.col(gone).isNotNull(), F.array_except(
        F.sequence(F.lit(0), F.size(lines) - 1), gone)))
    joined = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    new = F.when(F.col(gone).isNull(), quoted(text)).otherwise(joined)
    cols = [new.alias(c) if c == text else quoted(c) for c in docs.columns if c not in (counts or ())]
    if counts:
        n = F.when(quoted(text).isNull(), 0).otherwise(F.size(lines))
        cols += [n.cast("bigint").alias(counts[0]), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(counts[1])]
    return rows.select(*cols)
