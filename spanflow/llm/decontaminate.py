"""Benchmark decontamination by a broadcast hash set of test n-grams.

The windows of the test items (13 consecutive words; a shorter item is one
window) are hashed over word numbers, and the hash set goes to every task.  A
document's words are numbered by the benchmark's vocabulary, its windows of each
length hashed in one vector pass, looked up, and every hit is verified word by
word.  Documents are never shuffled.

What is broadcast is the benchmark, whose size is measured first: items are
dealt into blocks of at most ``block_bytes`` of text and every block is one scan,
the marks of the earlier blocks travelling with the document.  So the broadcast
is bounded whatever the benchmark's size, and no item is dropped.

Defined cases: NULL or empty texts have no words and are clean; an item without
words never occurs; equal items and items with NULL ids count as items of their
own id ('' for NULL); equal rows get equal results; an empty benchmark leaves
every document clean.  Texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, annotate, fresh, quoted, stored

WINDOW = 13
BLOCK_BYTES = 32 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items", "array<string>"),
          ("hit_runs", "array<int>")]


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (a ^ (a >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def _window_hashes(mixed: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(mixed) - k + 1, np.uint64)
    for j in range(k):
        h = h * _MULT + mixed[j:len(mixed) - k + 1 + j]
    return h


class TestIndex:
    """Windows of a block of test items: their hashes, words and items."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.of: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in alnum_words(text)]
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                self.of.setdefault(k, {}).setdefault(tuple(ids[i:i + k]), set()).add(item)
        self.hashes = {}
        for k, windows in self.of.items():
            flat = _mixed(np.array(list(windows), np.uint64).ravel()).reshape(-1, k)
            h = np.zeros(len(flat), np.uint64)
            for j in range(k):
                h = h * _MULT + flat[:, j]
            self.hashes[k] = np.unique(h)

    def scan(self, words: list[bytes], hit: np.ndarray, found: set[str]) -> None:
        """Mark the words inside verified windows and add their items."""
        n, get = len(words), self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, n)
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        mixed = _mixed(ids.astype(np.uint64))
        for k, table in self.hashes.items():
            if k > n:
                continue
            whole = np.nonzero(known[k:] == known[:-k])[0]
            if not len(whole):
                continue
            h = _window_hashes(mixed, k)[whole]
            at = np.searchsorted(table, h)
            at[at == len(table)] = 0
            for i in whole[table[at] == h].tolist():
                items = self.of[k].get(tuple(ids[i:i + k].tolist()))
                if items:
                    hit[i:i + k] = True
                    found |= items


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """Lists of (id, text) of at most ``block_bytes`` each.  Items are dealt by a
    hash of their id and text over as many blocks as the measured size asks
    for; a block that is still too large is an error, not cut."""
    size = F.coalesce(F.octet_length(quoted(text)), F.lit(0)) + 64
    total = benchmark.agg(F.sum(size).alias("b")).first().b or 0
    n = max(1, -(-2 * int(total) // block_bytes)) if total > block_bytes else 1
    rows = benchmark.select(F.coalesce(quoted(item_id).cast("string"), F.lit("")).alias("i"),
                            quoted(text).cast("binary").alias("t"))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        items = [(r.i, bytes(r.t) if r.t is not None else None) for r in part.toLocalIterator()]
        if sum(len(t or b"") for _, t in items) > 4 * block_bytes:
            raise ValueError("a block of test items exceeds its bound: raise block_bytes")
        yield items


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted as strings) and
    hit_runs (first word and number of words of each run of hit words)."""
    sc = docs.sparkSession.sparkContext
    kept = docs.columns if keep is None else keep
    runs, items_before = fresh("hit_runs", []), fresh("items", [])
    out, first = docs, True
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = sc.broadcast(block)

        def make(shared=shared, first=first):
            index = TestIndex(shared.value, window)

            def work(cols):
                got = [[] for _ in FIELDS]
                for row in range(len(cols[0])):
                    words = alnum_words(cols[0][row])
                    hit, found = np.zeros(len(words) + 1, bool), set()
                    if not first:
                        found |= set(cols[1][row])
                        for s, m in zip(cols[2][row][::2], cols[2][row][1::2]):
                            hit[s:s + m] = True
                    if words:
                        index.scan(words, hit, found)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8)])))
                    flat = edge.copy()
                    flat[1::2] -= edge[::2]
                    for c, v in zip(got, (len(words), int(hit.sum()), len(found), sorted(found), flat.tolist())):
                        c.append(v)
                return got
            return work
        inputs = [quoted(text)] + ([] if first else [F.col(items_before), F.col(runs)])
        carried = list(kept) if text in kept else [*kept, text]
        out = annotate(out, inputs, FIELDS, make, carried)
        if not first:  # one scan and one index at a time
            out = stored(out, "decontaminate")
        first = False
    names = [n for n, _ in FIELDS]
    return out.select(*[quoted(c) for c in kept if c.lower() not in names], *names)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The rule: some word is hit, and the hit words are 5 % or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def items_digest(items: str = "items"):
    return F.sha2(F.array_join(F.col(items), ",").cast("binary"), 256)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    taken = {n for n, _ in FIELDS}
    renamed = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in taken}
    rows = mark(docs.withColumnsRenamed(renamed), benchmark, renamed.get(text, text), **how)
    clean = rows.where(~contaminated())
    return clean.select(*[quoted(renamed.get(c, c)).alias(c) for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` whose texts have lost the characters from the first to the last
    word of each hit run (separators around a run stay)."""
    import re
    word = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    taken = {n for n, _ in FIELDS}
    renamed = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in taken}
    body = renamed.get(text, text)
    rows = mark(docs.withColumnsRenamed(renamed), benchmark, body, **how)

    def make():
        def work(cols):
            out = []
            for t, runs in zip(*cols):
                if not t or not runs:
                    out.append(t)
                    continue
                spans = [m.span() for m in word.finditer(t)]
                parts, at = [], 0
                for s, m in zip(runs[::2], runs[1::2]):
                    parts.append(t[at:spans[s][0]])
                    at = spans[s + m - 1][1]
                out.append(b"".join([*parts, t[at:]]))
            return [[x.decode() if x is not None else None for x in out]]
        return work
    done = annotate(rows, [quoted(body), F.col("hit_runs")], [(body, "string")], make)
    return done.select(*[quoted(renamed.get(c, c)).alias(c) for c in docs.columns])


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
