"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Pieces of equal length are interchangeable, so the packing is decided on the
histogram of lengths: at most ``capacity`` rows, whatever the number of documents.

* Large pieces (above a third of the capacity) fit at most two to a bin: the
  longest left is matched with the longest left that still fits beside it.
* Small pieces go, longest first, into the tightest gap that takes them; new bins
  open only when no gap does.

The plan is a list of intervals "pieces of length L, ranks a to b, go to bins
from s on, at offset o".  Its size depends on the capacity only.  Spark numbers
the pieces within each length (in buckets, so that a length that a third of the
pieces share is spread) and every task places its own pieces by the plan.

Defined cases: a NULL or empty text is one piece that holds the end token alone;
NULL ids and repeated rows are packed as documents of their own; an empty table
gives an empty packing.  Only a document longer than the capacity is cut.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import annotate, quoted, stored

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers (about 200 bytes each).
REMEMBERED = 1_500_000
#: Pieces numbered by one task.
BUCKET_ROWS = 200_000


class WordTokenizer:
    """Token ids of a text, as bytes of little-endian unsigned 32-bit numbers.

    For a tokenizer that drops white space and never joins what it separates:
    then a text's ids are those of its words one after another, and a word's ids
    can be remembered.  Splitting and A-Z lower-casing are done on ASCII
    characters only, everything else is left to the tokenizer."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.seen: dict[bytes, bytes] = {}

    def words(self, text: bytes) -> list[bytes]:
        return (text if b"<|" in text else text.lower()).split()

    def learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.seen))
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = list(words)
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            got = self.encode([w.decode() for w in part], add_special_tokens=False)
            self.seen.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, got))

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        split = [self.words(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.seen.__getitem__, s)) for s in split]


_LOADED: dict[str, WordTokenizer] = {}


def loaded(tokenizer: str) -> WordTokenizer:
    """One per worker.  ``tokenizer`` is a file's path, or the name of a public
    vocabulary file that every worker has installed."""
    if tokenizer not in _LOADED:
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers
            path = public_tokenizers.path(tokenizer)
        _LOADED[tokenizer] = WordTokenizer(path)
    return _LOADED[tokenizer]


PIECE = [("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("ids", "binary")]


def pieces(docs: DataFrame, text: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY,
           tokenizer: str = TOKENIZER, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: the kept columns, piece,
    start, length and crc32 of its ids (and the ids, little-endian)."""
    fields = PIECE if with_ids else PIECE[:-1]
    last = np.array([end], "<u4").tobytes()

    def make():
        tok = loaded(tokenizer)

        def work(cols):
            out = [[] for _ in range(len(fields) + 1)]
            todo, size, first = [], 0, 0

            def flush():
                for row, ids in enumerate(tok.ids(todo), first):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        values = (row, k, at // 4, len(part) // 4, zlib.crc32(part), part)
                        for c, v in zip(out, values):
                            c.append(v)

            for t in cols[0]:
                todo.append(t)
                size += len(t or b"")
                if size > 4 << 20:
                    flush()
                    first, todo, size = first + len(todo), [], 0
            flush()
            return out
        return work
    return annotate(docs, [quoted(text)], fields, make, docs.columns if keep is None else keep, explode=True)


class _Gaps:
    """Groups of equal bins by what is left in them; finds the tightest."""

    def __init__(self, capacity: int):
        self.of: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
        self.sizes: list[int] = []

    def add(self, gap: int, contents: tuple, count: int) -> None:
        if count:
            if not self.of[gap]:
                self.sizes.insert(bisect_right(self.sizes, gap), gap)
            self.of[gap].append((contents, count))

    def tightest(self, need: int):
        at = bisect_right(self.sizes, need - 1)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        contents, count = self.of[gap].pop()
        if not self.of[gap]:
            del self.sizes[at]
        return gap, contents, count


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Groups of equal bins: (((length, copies), ...), number of bins)."""
    left = {n: c for n, c in histogram.items() if c}
    gaps = _Gaps(capacity)
    large = sorted(n for n in left if 3 * n > capacity)
    while large:  # the longest with the longest that fits beside it
        a = large[-1]
        at = bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b is None or (b == a and left[a] == 1):
            # alone, unless a shorter one still fits beside the odd one out
            if b == a and at > 0:
                b, at = large[at - 1], at - 1
                gaps.add(capacity - a - b, ((a, 1), (b, 1)), 1)
                left[b] -= 1
                if not left[b]:
                    large.pop(at)
            else:
                gaps.add(capacity - a, ((a, 1),), left[a])
            left[a] = 0
            large.pop()
            continue
        n = left[a] // 2 if a == b else min(left[a], left[b])
        gaps.add(capacity - a - b, ((a, 2),) if a == b else ((a, 1), (b, 1)), n)
        left[a] -= n
        left[b] -= n
        large = [x for x in large if left[x]] if not (left[a] and left[b]) else large
    for s in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        n = left[s]
        while n:
            gap, contents, count = gaps.tightest(s) or (capacity, (), -(-n // (capacity // s)))
            k = gap // s
            full = min(count, n // k)
            gaps.add(gap - k * s, (*contents, (s, k)), full)
            n -= full * k
            if full < count and n:  # fewer than k are left: one bin more
                gaps.add(gap - n * s, (*contents, (s, n)), 1)
                full, n = full + 1, 0
            if contents:
                gaps.add(gap, contents, count - full)
    return sorted((g for groups in gaps.of.values() for g in groups), key=lambda g: (g[0], g[1]), reverse=True)


def intervals(bins: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, copies a bin, first bin, offset) by rank."""
    out, taken, base = defaultdict(list), defaultdict(int), 0
    for contents, count in bins:
        offset = 0
        for length, copies in contents:
            out[length].append((taken[length], copies, base, offset))
            taken[length] += copies * count
            offset += copies * length
        base += count
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Append sequence_id and offset to stored pieces (read twice)."""
    spark = found.sparkSession
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(intervals(plan_bins(counts, capacity)))
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    identity = [quoted(c) for c in found.columns if c not in ("ids",)]
    rows = found.withColumn("bucket_", F.pmod(F.xxhash64(*identity), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket_").agg(F.count("*").alias("n_"))
    before = sizes.withColumn("before_", F.sum("n_").over(Window.partitionBy("length").orderBy("bucket_")) - F.col("n_"))
    # equal rows are interchangeable: any order among them places them all
    rank = F.row_number().over(Window.partitionBy("length", "bucket_").orderBy(*identity)) - 1
    ranked = (rows.withColumn("rank_", rank).join(before.drop("n_"), ["length", "bucket_"])
              .withColumn("rank_", F.col("rank_") + F.col("before_")))

    def make():
        table = plan.value

        def work(cols):
            lengths, ranks = np.array(cols[0], np.int64), np.array(cols[1], np.int64)
            bins, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                own, t = np.nonzero(lengths == n)[0], table[n]
                row = t[np.searchsorted(t[:, 0], ranks[own], "right") - 1]
                nth = ranks[own] - row[:, 0]
                bins[own] = row[:, 2] + nth // row[:, 1]
                offsets[own] = row[:, 3] + nth % row[:, 1] * n
            return [bins.tolist(), offsets.tolist()]
        return work
    return annotate(ranked, [F.col("length"), F.col("rank_")], [("sequence_id", "bigint"), ("offset", "bigint")], make,
                    found.columns)


def pack(docs: DataFrame, text: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY,
         tokenizer: str = TOKENIZER, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset; with
    ``with_ids`` also their token ids.  A column of ``docs`` named like one of
    these is left out."""
    own = {n for n, _ in PIECE} | {"sequence_id", "offset", "bucket_", "rank_", "before_"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own and (keep or c != text)]
    return place(stored(pieces(docs, text, kept, capacity, tokenizer, end, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, in order (needs ``with_ids``).  A sequence has
    at most ``capacity`` tokens, so a row is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
            .select("sequence_id", "n_tokens", joined.alias("ids")))


def bins_used(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    return sum(count for _, count in plan_bins(histogram, capacity))
