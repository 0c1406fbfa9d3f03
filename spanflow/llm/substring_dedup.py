"""Exact substring deduplication by level-wise doubling.

Windows of ``words`` consecutive words that occur more than once are found from
short to long: lengths double (18, 35 for 35 words; 18, 36, 72, 100 for 100) and
only windows whose parts of the length before were repeated go on to the next; it
ends when none is left.

* At the shorter lengths one witness speaks for each full window: the smallest
  hash of the short windows inside it.  Equal full windows have equal witnesses, so
  one whose witness occurs once occurs once itself.  Witnesses are about a tenth of
  all positions.
* At full length the surviving windows themselves are counted.

Equal texts are counted first: one of them takes part for all, with their number as
its weight.  Rows are dealt out once, by text key and id, so that copies spread, and
every level reuses that exchange.  A level's windows are made and shuffled once and counted where
they arrive: texts are not split again to ask for the counts.

Hashes of windows have 64 bits at the short lengths (a collision only costs work)
and 96 at full length.

Defined cases: NULL and empty texts have no words; texts shorter than the window
keep everything; repeated rows are copies of each other, so their windows are
repeated; NULL ids are kept; an empty table stays empty; other columns are carried
along, those named like a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, annotate, blank_words, fresh, mix64, quoted, stored

WORDS = 35
#: Words of the windows that are looked at first.
SHORTEST = 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def levels(words: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from short to full, each at most twice the one before."""
    out = [min(words, shortest)]
    while out[-1] < words:
        out.append(min(words, 2 * out[-1]))
    return out


def window_hashes(h: np.ndarray, k: int, mult: np.uint64 = _A) -> np.ndarray:
    """Hashes of all windows of ``k``, by doubling: those of twice the length come
    from two neighbours."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, out = 1, mix64(h * mult + _B)
    while have < k:
        step = min(have, k - have)
        out = mix64(out[:len(out) - step] * mult + (out[step:] ^ _B))
        have += step
    return out


def witnesses(h: np.ndarray, k: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the k-windows, witness position of each full window)."""
    short = window_hashes(h, k)
    inside = words - k + 1
    n = len(short) - inside + 1
    if n <= 0:
        return short, np.zeros(0, np.int64)
    pos = np.arange(len(short))
    low, at, have = short, pos, 1
    while have < inside:  # sliding minimum by doubling, the leftmost of equals
        step = min(have, inside - have)
        left = low[:len(low) - step] <= low[step:]
        low, at = np.where(left, low[:len(low) - step], low[step:]), np.where(left, at[:len(at) - step], at[step:])
        have += step
    return short, at


def _emit(rows: list[int], arrays: list[list[np.ndarray]], counts: list[int]) -> list:
    which = np.repeat(np.array(rows, np.int64), counts) if rows else np.zeros(0, np.int64)
    return [which] + [np.concatenate(a) if a else [] for a in arrays]


def _candidates(texts: DataFrame, level: int, lengths: list[int], survivors: bool) -> DataFrame:
    """rid, weight, pos and hash of what the level has to count."""
    k, words = lengths[level], lengths[-1]
    full = k == words
    fields = [("pos", "int"), ("hash", "bigint")] + ([("hash2", "int")] if full else [])

    def make():
        hashes = WordHashes()

        def work(cols):
            rows, pos, one, two, counts = [], [], [], [], []
            for row, text in enumerate(cols[0]):
                split = blank_words(text)
                if len(split) < words:
                    continue
                h = hashes(split)
                n = len(h) - words + 1
                alive = np.ones(n, bool)
                if survivors:
                    kept = np.zeros(len(h), bool)
                    kept[np.array(cols[1][row], np.int64)] = True
                    alive = kept[witnesses(h, lengths[level - 1], words)[1]]
                if full:
                    at = np.flatnonzero(alive)
                    first = window_hashes(h, k)
                    two.append((window_hashes(h ^ _A, k, _B)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                else:
                    first, seen = witnesses(h, k, words)
                    at = np.unique(seen[alive])
                rows.append(row)
                counts.append(len(at))
                pos.append(at.astype(np.int32))
                one.append(first[at].view(np.int64))
            return _emit(rows, [pos, one] + ([two] if full else []), counts)
        return work
    inputs = [F.col("text")] + ([F.col("places")] if survivors else [])
    return annotate(texts, inputs, fields, make, ["rid", "weight"], explode=True)


def _repeated(found: DataFrame, last: bool) -> DataFrame:
    """rid, weight and the places of the windows that occur twice or more."""
    by = ["hash", "hash2"] if last else ["hash"]
    back = found.withColumn("w", F.sum("weight").over(Window.partitionBy(*by))).where("w > 1")
    # of texts with copies everything is repeated: at the last level nothing is asked
    back = back.where("weight = 1") if last else back
    return back.groupBy("rid").agg(F.first("weight").alias("weight"), F.collect_set("pos").alias("places"))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                     keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and ``kept``: the words that are left,
    joined by blanks, or with ``digest`` kept_sha256 of that."""
    lengths = levels(words)
    own = docs.columns if keep is None else keep
    key, tag = fresh("key", docs.columns), fresh("tag", docs.columns)
    body = quoted(text).cast("string")
    # a text's key is 64 bits and its tag 40 more
    keys = {key: F.xxhash64(body),
            tag: F.conv(F.substring(F.md5(F.coalesce(body, F.lit("")).cast("binary")), 1, 10), 16, 10).cast("bigint")}
    base = docs.select(keys[key].alias("key"), keys[tag].alias("tag"), F.xxhash64(quoted(doc_id)).alias("who"), body.alias("text"))
    copies = base.groupBy("key", "tag").agg(F.count("*").alias("copies"), F.min("who").alias("lead"))
    copies = stored(copies.withColumn("rid", F.monotonically_increasing_id()), "texts")
    # every level and the end read this one exchange: it must have the same columns in all.
    # The id takes part, so a text that a third of all rows hold is spread over the tasks
    copies = copies.withColumnRenamed("lead", "who")
    own_row = ["key", "tag", "who"]
    dealt = base.repartition(*[F.col(c) for c in own_row])
    weight = F.least(F.col("copies"), F.lit(2)).cast("int").alias("weight")
    texts = dealt.join(copies, own_row).select("key", "tag", "rid", weight, "text")
    places = None
    for level, _ in enumerate(lengths):
        src = texts
        if places is not None:
            found = copies.join(places, "rid").select(*own_row, "rid", "weight", "places")
            src = dealt.join(found, own_row)
        places = _repeated(_candidates(src, level, lengths, places is not None), level == len(lengths) - 1)
    found = copies.join(places.select("rid", "places"), "rid", "left").select(*own_row, "copies", "places")
    rows = dealt.join(found, own_row)
    fields = [("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256" if digest else "kept", "string")]

    def make():
        def work(cols):
            out = [[], [], []]
            for body, copied, starts in zip(*cols):
                split = blank_words(body)
                n = len(split)
                left, gone = split, 0
                if n >= words and copied > 1:
                    left, gone = [], n
                elif starts:
                    edge = np.zeros(n + 1, np.int64)
                    at = np.array(starts, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + words, -1)
                    inside = np.cumsum(edge[:n]) > 0
                    gone = int(inside.sum())
                    left = [split[i] for i in np.flatnonzero(~inside).tolist()]
                joined = b" ".join(left)
                out[0].append(n)
                out[1].append(gone)
                out[2].append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            return out
        return work
    done = annotate(rows, [F.col("text"), F.col("copies"), F.col("places")], fields, make, ["key", "tag"])
    # rows of equal id and text are led by all of them
    done = done.dropDuplicates(["key", "tag"]).withColumnsRenamed({"key": key, "tag": tag})
    made = {n for n, _ in fields}
    carried = docs.select(*[quoted(c) for c in own if c.lower() not in made], *[c.alias(n) for n, c in keys.items()])
    return carried.join(done, [key, tag]).drop(key, tag)
