"""N-gram Jaccard join with a token-group matrix.

1. Documents with equal shingle sets become one representative.
2. *Signatures.*  The token space is cut into m parts, where m is larger than the
   number of tokens in which two sets of that size may differ and still be similar:
   similar sets agree on a whole part, so they share its signature.  Common
   passages do not: the rest of the part differs.  A part without a token says
   nothing, so it has no signature: m has parts to spare for those.
3. *Groups.*  Every representative that shares a signature joins the group of the
   most central document it shares one with (the one whose signatures are the
   most frequent), and its distance to that centre is computed.  Within a group,
   members are dealt by distance band and hash into blocks of bounded size.
4. *Matrix.*  The matrix holds each block's union of signatures.  A document is a
   query to a block if it shares as many signatures with that union as a similar
   set of its size must, and if the bands allow a link: the Jaccard distance is a
   metric, so members whose distances to the centre differ by more than the limit
   are not similar, and members within the limit are linked through the centre.
   Where a block is met, its union of shingles bounds every query's overlap once more;
   only for queries that still qualify are the members opened and counted exactly.
5. Links between different texts that are not yet connected are returned from each
   block as a spanning forest, and components are labelled in Spark.

No pair of documents is emitted that is not a link, no group is collected
whole, and nothing is collected to the driver.  Shingles are 64-bit hashes.

Defined cases: NULL and empty texts have no shingles and link with nothing; equal
rows are copies; documents with NULL ids take part, their component is the smallest
non-NULL id in it; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, annotate, blank_words, fresh, mix64, quoted, stored, text_key

SHINGLE = 3
#: Similar: PERCENT * union <= 100 * intersection.
PERCENT = 90
#: Tokens in a block, about: bounds the rows that are opened at once.
BLOCK_TOKENS = 1 << 16
#: Bytes of texts or tokens that a task works on at once (a single row may be more).
SLICE_BYTES = 4 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(words: list[bytes], hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one
    shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    if n < k:
        s = np.array([n], np.uint64)
        for j in range(n):
            s = mix64(s * _A + h[j:j + 1])
        return s
    s = h[:n - k + 1]
    for j in range(1, k):
        s = mix64(s * _A + h[j:n - k + 1 + j] * _B)
    return np.unique(s)


class Signatures:
    """Part signatures of a shingle set, for one similarity limit."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]

    def _reach(self, full) -> None:
        while not full():  # a class spans the ratio limit ** -4
            s = self.edges[-1]
            self.edges.append(max(s + 1, int(s * (100 / self.percent) ** 4)))

    def schemes(self, n: int) -> list[tuple[int, int, int]]:
        """(scheme, parts, largest size): a scheme holds the pairs whose larger set
        is in its class; a set is also in the next one if a similar set may be."""
        self._reach(lambda: self.edges[-1] > n)
        c = bisect_right(self.edges, n) - 1
        out = [c] + ([c + 1] if n * 100 // self.percent >= self.edges[c + 1] else [])
        self._reach(lambda: len(self.edges) > out[-1] + 1)
        return [(k, self.parts(self.edges[k + 1] - 1), self.edges[k + 1] - 1) for k in out]

    def parts(self, top: int) -> int:
        """One more than two similar sets of the size may differ in, and as many as the
        larger ones are likely to leave empty."""
        m = 2 * top * (100 - self.percent) // (100 + self.percent) + 2
        empty = m * math.exp(-top / m)
        return m + math.ceil(empty + 3 * math.sqrt(empty))

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The signatures (the lowest bit is that of the scheme), and how many of
        each parity a similar set shares at least (0: no such scheme)."""
        mixed, out, needs, n = mix64(tokens), [], [0, 0], len(tokens)
        for scheme, m, top in self.schemes(n):
            part = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            sums, which = np.add.reduceat(mixed, first), part[first]
            made = [mix64(sums ^ mix64(which + np.uint64(scheme << 40)))]
            other = max(n, min(top, n * 100 // self.percent))
            differ = (n + other) * (100 - self.percent) // (100 + self.percent)
            # of the parts that a similar set agrees on, no more than this set's empty ones are empty
            need = len(which) - differ
            if need < 1:
                # two sets of this kind may agree on empty parts only, so theirs have signatures;
                # with any other set such a set shares the part which that one needs
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), which)
                made.append(mix64(mix64(empty + np.uint64(scheme << 40)) + _B))
            out += [(x & ~np.uint64(1)) | np.uint64(scheme & 1) for x in made]
            needs[scheme & 1] = max(1, need)
        return np.unique(np.concatenate(out)), needs


def shingle_rows(docs: DataFrame, text: str, keep: list[str], k: int, percent: int | None) -> DataFrame:
    """The kept columns with n_shingles and set_key (NULL for an empty set), and
    either the signatures or, without a limit, the shingles."""
    last = [("tokens", "binary")] if percent is None else [("signatures", "array<bigint>"), ("needs", "array<int>")]

    def make():
        hashes, sign = WordHashes(), Signatures(percent or PERCENT)

        def work(cols):
            out = [[] for _ in range(2 + len(last))]
            for t in cols[0]:
                s = shingle_set(blank_words(t.lower()) if t else [], hashes, k)
                raw = s.astype("<u8").tobytes()
                out[0].append(len(s))
                out[1].append(hashlib.md5(raw).digest() if len(s) else None)
                if percent is None:
                    out[2].append(raw)
                else:
                    signatures, needs = sign(s) if len(s) else (s, [0, 0])
                    out[2].append(signatures.view(np.int64))
                    out[3].append(needs)
            return out
        return work
    return annotate(docs, [quoted(text)], [("n_shingles", "bigint"), ("set_key", "binary"), *last], make, keep, most=SLICE_BYTES)


def _overlap(rows: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    def make():
        def work(cols):
            return [[len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), True))
                     for x, y in zip(*cols)]]
        return work
    return annotate(rows, [F.col(a), F.col(b)], [("overlap", "bigint")], make, keep, most=SLICE_BYTES)


def _open_blocks(percent: int):
    """Links between unconnected documents of two blocks (or within one).  Beside the rows
    of a block, what is held grows with its tokens, not with members times tokens."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in (0, 1):
            own = pdf[pdf.side == side].sort_values("rid")
            sides.append((own.rid.to_numpy(), own.star.to_numpy(), [np.frombuffer(x, "<u8") for x in own.tokens]))
        same = not len(sides[1][0])
        if same:
            sides[1] = sides[0]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        (rid_a, star_a, a), (rid_b, star_b, b) = sides
        size_a = np.array([len(s) for s in a])
        # the first block by token: ``owner`` holds the members of each, ``held`` of them from ``first``
        tokens = np.concatenate(a)
        order = np.argsort(tokens, kind="stable")
        owner = np.repeat(np.arange(len(a)), size_a)[order]
        union, first, held = np.unique(tokens[order], return_index=True, return_counts=True)
        links = []
        for j, s in enumerate(b):
            at = np.minimum(np.searchsorted(union, s), len(union) - 1)
            at = at[union[at] == s]
            if 100 * len(at) < percent * len(s):
                continue
            # members are opened: one entry for each token that one has in common with the query
            n = held[at]
            entry = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            inter = np.bincount(owner[entry], minlength=len(a))
            for i in np.flatnonzero(100 * inter >= percent * (size_a + len(s) - inter)):
                x, y = root(int(star_a[i])), root(int(star_b[j]))
                if x != y:
                    parent[x] = y
                    links.append((int(rid_a[i]), int(rid_b[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    return run


def connected(edges: DataFrame) -> DataFrame:
    """rid, label: the smallest node reachable over the edges (a, b), for every
    node of an edge.  Smallest neighbour labels with pointer jumping; each round
    is written to the shared folder."""
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("rid"), F.least("a", "b").alias("label")),
                    "labels")
    while True:
        seen = both.join(labels.select(F.col("rid").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        new = labels.join(seen, labels.rid == seen.a).select("rid", F.col("label").alias("old"), F.least("label", "low").alias("via"))
        jump = new.select(F.col("rid").alias("via"), F.col("via").alias("next"))
        step = stored(new.join(jump, "via").select("rid", "old", F.least("via", "next").alias("label")), "labels")
        labels = step.select("rid", "label")
        if step.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def _first(id_: str, doc: str):
    """The document of the smallest id (id, doc); without any id, that of the
    smallest key."""
    return F.min(F.struct(F.col(id_).isNull().alias("no_id"), F.col(id_).alias("id"), F.col(doc).alias("doc"))).alias("first")


def _parities():
    """Signatures of each parity, beside what is needed of them."""
    odd = F.col("sig").bitwiseAND(F.lit(1).cast("bigint"))
    return F.sum(1 - odd).alias("even"), F.sum(odd).alias("odd"), F.first("needs").alias("needs")


def _enough(rows: DataFrame) -> DataFrame:
    return rows.where(((F.col("needs")[0] > 0) & (F.col("even") >= F.col("needs")[0]))
                      | ((F.col("needs")[1] > 0) & (F.col("odd") >= F.col("needs")[1])))


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE,
          percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, representatives, links): doc key, id, n_shingles and set_key of
    each document; rid, set_key and first document (id, doc) of each set; links (a, b)
    between representatives that connect all that are similar."""
    identity = text_key(quoted(doc_id), quoted(text))
    rows = docs.select(identity.alias("doc"), quoted(doc_id).alias("id"), quoted(text).cast("string").alias("text"))
    marked = shingle_rows(rows, "text", ["doc", "id"], k, percent)
    marked = stored(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    # a set's representative is a row of ``marked``, which alone holds the signatures
    reps = (marked.where(F.col("set_key").isNotNull()).groupBy("set_key")
            .agg(F.min(F.struct("doc", "row", "needs")).alias("one"), _first("id", "doc"), F.first("n_shingles").alias("n")))
    reps = stored(reps.select(F.col("one.row").alias("rid"), "set_key", "first", "n", F.col("one.doc").alias("doc"),
                              F.col("one.needs").alias("needs")), "reps")
    # each document has a signature once, and only what is shared gets its other columns: few bytes are shuffled
    signed = marked.where(F.col("set_key").isNotNull()).select(F.col("row").alias("rid"), "signatures")
    postings = signed.join(reps.select("rid"), "rid").select("rid", F.explode("signatures").alias("sig"))
    # counted where they are dealt out: one exchange, and no second one to ask for the counts
    shared = postings.withColumn("held", F.count("*").over(Window.partitionBy("sig"))).where(F.col("held") > 1)
    contested = stored(shared.join(reps.select("rid", "n", "needs"), "rid"), "contested")

    # a document that shares fewer signatures than with a similar one is linked with nothing
    votes = _enough(contested.groupBy("rid").agg(F.sum("held").alias("votes"), *_parities()))
    # groups: the centre is the document whose signatures are held by the most
    voted = stored(contested.join(votes.select("rid", "votes"), "rid").select("sig", "rid", "n", "votes"), "voted")
    top = voted.groupBy("sig").agg(F.max(F.struct("votes", "rid")).alias("top"))
    home = (voted.join(top, "sig").groupBy("rid").agg(F.max("top").alias("top"), F.first("n").alias("n"))
            .select("rid", "n", F.col("top.rid").alias("home")))
    need = home.select("rid").join(reps.select("rid", "doc"), "rid").select("rid", "doc")
    again = docs.select(identity.alias("doc"), quoted(text).cast("string").alias("text")).join(need, "doc")
    tokens = shingle_rows(again, "text", ["rid"], k, None).dropDuplicates(["rid"]).select("rid", "tokens")
    members = stored(home.join(tokens, "rid"), "members")

    # distance to the centre, in bands as wide as the limit
    centre = members.select(F.col("rid").alias("home"), F.col("tokens").alias("other"), F.col("n").alias("m"))
    near = _overlap(members.join(centre, "home"), "tokens", "other", ["rid", "home", "n", "m"])
    union = F.col("n") + F.col("m") - F.col("overlap")
    near = near.withColumn("band", F.when(100 * F.col("overlap") >= percent * union, 0).otherwise(
        F.ceil((100 * (union - F.col("overlap"))).cast("double") / (union * (100 - percent)).cast("double")) - 1).cast("int"))
    near = near.withColumn("star", F.when(F.col("band") == 0, F.col("home")).otherwise(F.col("rid")))
    sizes = near.groupBy("home", "band").agg((F.floor(F.sum("n") / BLOCK_TOKENS) + 1).alias("blocks"))
    near = near.join(sizes, ["home", "band"])
    placed = stored(near.select("rid", "home", "band", "star", F.xxhash64(
        "home", "band", F.pmod(F.xxhash64("rid"), F.col("blocks"))).alias("block")), "placed")

    # token-group matrix over signatures: which block holds which, in how many stars
    held = stored(contested.select("sig", "rid", "needs").join(placed, "rid"), "held")
    matrix = held.groupBy("sig", "block").agg(F.first("home").alias("g_home"), F.first("band").alias("g_band"),
                                              F.min("star").alias("s0"), F.max("star").alias("s1"))
    asked = held.join(matrix.withColumnRenamed("block", "g"), "sig").where(
        (F.col("g") < F.col("block")) & ((F.col("s0") != F.col("s1")) | (F.col("s0") != F.col("star")))
        & ((F.col("home") != F.col("g_home")) | (F.abs(F.col("band") - F.col("g_band")) <= 1)))
    met = _enough(asked.groupBy("rid", "g").agg(*_parities())).select("rid", F.col("g").alias("block"))
    met = stored(met.join(members.select("rid", "n"), "rid"), "met")
    parts = met.groupBy("block").agg((F.floor(F.sum("n") / (4 * BLOCK_TOKENS)) + 1).alias("parts"))
    met = met.join(parts, "block").select("block", "rid", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"))
    own = placed.groupBy("block").agg(F.min("star").alias("s0"), F.max("star").alias("s1")).where("s0 != s1")
    rounds = met.select("block", "part").distinct().union(own.select("block", F.lit(-1)))
    sides = (placed.select("block", "rid", "star").join(rounds, "block").select("block", "part", F.lit(0).alias("side"), "rid", "star")
             .union(met.join(placed.select("rid", "star"), "rid").select("block", "part", F.lit(1), "rid", "star")))
    opened = sides.join(members.select("rid", "tokens"), "rid").select("block", "part", "side", "rid", "star", "tokens")
    found = opened.groupBy("block", "part").applyInPandas(_open_blocks(percent), "a long, b long")
    stars = placed.where((F.col("band") == 0) & (F.col("rid") != F.col("home"))).select(F.col("rid").alias("a"), F.col("home").alias("b"))
    return marked.select("doc", "id", "n_shingles", "set_key"), reps, stars.union(found)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE,
            percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc key, id, n_shingles and ``first``, the
    document (id, doc) of the smallest id that links reach, by key where none has an
    id (NULL without shingles)."""
    marked, reps, edges = links(docs, doc_id, text, k, percent)
    labels = connected(edges)
    reps = reps.select("rid", "set_key", "first.id", "first.doc").join(labels, "rid", "left").withColumn(
        "label", F.coalesce("label", "rid"))
    lowest = reps.groupBy("label").agg(_first("id", "doc"))
    sets = reps.join(lowest, "label").select("set_key", "first")
    return marked.join(sets, "set_key", "left").select("doc", "id", "n_shingles", "set_key", "first")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE,
               percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the smallest
    id that links reach."""
    own = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("first.id"))
    return classes(docs, doc_id, text, k, percent).select(F.col("id").alias(doc_id), "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE,
             percent: int = PERCENT, keep_nulls: bool = True) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id (of
    several texts with that id, the one of the smallest key).  Documents are told
    apart by id and text, so another text under an id that goes stays; of rows of
    equal id and text one stays.  Rows without shingles stay, and those without an id
    unless ``keep_nulls`` is False: then they come after all ids, by key."""
    found = classes(docs, doc_id, text, k, percent)
    gone_as, row_as = fresh("gone_", docs.columns), fresh("row_", docs.columns)
    member = F.col("set_key").isNotNull() & (F.col("id").isNotNull() if keep_nulls else F.lit(True))
    gone = found.where(member & (F.col("doc") != F.col("first.doc"))).select(F.col("doc").alias(gone_as)).distinct()
    thinned = F.coalesce(quoted(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if keep_nulls:
        thinned = thinned & quoted(doc_id).isNotNull()
    # of equal rows the one whose other columns hash lowest, so that a second run keeps the same
    whole = F.struct(*[quoted(c) for c in docs.columns])
    rows = (docs.where(thinned).groupBy(text_key(quoted(doc_id), quoted(text)).alias(gone_as))
            .agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(row_as)).join(gone, gone_as, "left_anti"))
    rows = rows.select(*[F.col(row_as).getField(c).alias(c) for c in docs.columns])
    return rows.unionByName(docs.where(~thinned))
