"""Ranked lexical search with hashed max-sketches.

Indexing folds every document into a sketch: each term's frequency goes to the
coordinate that the term hashes to, which keeps the maximum.  A term's impact grows with its
frequency, so impacts of a sketch are coordinatewise maxima whatever the collection's
statistics are, and the sum of a query's weights times the impacts at its terms'
coordinates is an upper bound of the document's score.  The index is one written table
of every row: id, text, number of terms, sketch; the same scan counts the collection.

A block of queries is looked up in a batch of sketches by one matrix product of whole
numbers.  Within a batch, each query's documents are rescored exactly, from their
words, in descending order of bounds, until the bound is below the query's threshold: its
k-th best exact score so far.  A first pass rescores ``SEEDS`` documents of every batch a
query, which gives all tasks a threshold to start from; the second pass is complete.

Terms are those of :func:`common.alnum_words`; weights and scores are those of the
module's :func:`weight` and :func:`impact`, in 64-bit integers.

Defined cases: NULL texts have no terms; documents and queries without terms, and
documents of score 0, are in no result; equal scores go by ascending id (NULL
first); rows of equal id are ranked each; an empty table or no query gives an empty
result.  Further columns are not read.  Queries are taken in blocks of
``BLOCK_TERMS`` terms at most, each a pass over the index; the vocabulary of all
queries is counted in one scan and is bounded by ``QUERY_BYTES`` (more is an error).
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, alnum_words, quoted, stored

TOP = 10
#: Coordinates of a sketch.
WIDTH = 4096
#: Documents a query that the first pass rescores in every batch.
SEEDS = 2
#: Rows of one matrix product.
BATCH = 512
#: Bytes of all queries, and terms of one block of queries.
QUERY_BYTES, BLOCK_TERMS, BLOCK_QUERIES = 64 << 20, 100_000, 512

_INDEX = "id bigint, text string, n bigint, sketch binary, term string, df bigint"
_FOUND = "query int, score bigint, id bigint"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n, n_docs: int, n_terms: int):
    return 25 + 75 * n * n_docs // n_terms


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def sketch(words: list[bytes], hashes: WordHashes, width: int) -> bytes:
    """Coordinates (u16) that are not 0, then their largest frequencies (u32)."""
    terms, tf = np.unique(hashes(words), return_counts=True)
    at = (terms % np.uint64(width)).astype(np.int64)
    order = np.lexsort((tf, at))
    at, tf = at[order], tf[order]
    last = np.flatnonzero(np.append(at[1:] != at[:-1], True))
    return at[last].astype("<u2").tobytes() + tf[last].astype("<u4").tobytes()


def unfold(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, coordinate and frequency of every entry of several sketches."""
    sizes = [len(s) // 6 for s in sketches]
    at = np.concatenate([np.frombuffer(s, "<u2", k) for s, k in zip(sketches, sizes)])
    tf = np.concatenate([np.frombuffer(s, "<u4", k, 2 * k) for s, k in zip(sketches, sizes)])
    return np.repeat(np.arange(len(sizes)), sizes), at.astype(np.int64), tf.astype(np.int64)


def _index(docs: DataFrame, doc_id: str, text: str, vocabulary: Broadcast, width: int) -> DataFrame:
    """One row a document, and rows (term, df) of the queries' terms a task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(_INDEX)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, wanted, df = WordHashes(), vocabulary.value, Counter()
        for b in batches:
            n, folded = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = alnum_words(t)
                n.append(len(words))
                folded.append(sketch(words, hashes, width) if words else None)
                df.update(wanted.intersection(words))
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(folded, pa.binary()),
                                              none.cast(pa.string()), none.cast(pa.int64())], schema=arrow)
        none = pa.nulls(len(df))
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.binary()),
             pa.array([t.decode() for t in df], pa.string()), pa.array(list(df.values()), pa.int64())], schema=arrow)
    body = F.make_valid_utf8(quoted(text).cast("string"))
    return docs.select(quoted(doc_id).cast("bigint").alias("id"), body.alias("text")).mapInArrow(run, schema)


class Block:
    """Some queries: (number, terms with repeats counted), and the weights of terms."""

    def __init__(self, queries: list[tuple[int, Counter]], weights: dict[bytes, int], width: int):
        self.queries, self.weights, self.width = queries, weights, width
        self.vocabulary = frozenset(t for _, q in queries for t in q)

    def matrix(self) -> np.ndarray:
        """Coordinates x queries: the weights of a query's terms at each coordinate."""
        hashes, m = WordHashes(), np.zeros((self.width, len(self.queries)))
        for j, (_, q) in enumerate(self.queries):
            for t, times in q.items():
                m[hashes[t] % self.width, j] += times * self.weights[t]
        # bounds of 2**53 and more are no longer whole numbers: round them up
        m[:, m.sum(axis=0) * 1e6 >= 2 ** 53] *= 1 + 1e-9
        return m


def _search(index: DataFrame, block: Broadcast, floor: Broadcast, n_docs: int, n_terms: int, top: int, seeds: int | None) -> DataFrame:
    """Each task's best (query, score, id); with ``seeds``, of so many a query and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        weights, matrix, start = b.weights, b.matrix(), floor.value
        least = np.array([start.get(q, 1) for q, _ in b.queries], float)
        best: list[list[tuple[int, float, int | None]]] = [[] for _ in b.queries]

        def rescore(rows, texts, norms, ids, bounds):
            seen: dict[int, dict[bytes, int]] = {}
            for j in np.flatnonzero((bounds >= least).any(axis=0)):
                col = bounds[:, j]
                order = np.flatnonzero(col >= least[j])
                order = order[np.argsort(-col[order], kind="stable")]
                for i in order if seeds is None else order[:seeds]:
                    if col[i] < least[j]:
                        break
                    got = seen.get(i)
                    if got is None:
                        found = Counter(filter(b.vocabulary.__contains__, alnum_words(texts[rows[i]].as_buffer().to_pybytes())))
                        got = seen[i] = {t: weights[t] * impact(tf, norms[i]) for t, tf in found.items()}
                    score = sum(times * got[t] for t, times in b.queries[j][1].items() if t in got)
                    if score < max(least[j], 1):
                        continue
                    own = ids[rows[i]].as_py()
                    entry = (score, math.inf if own is None else -own, own)  # an earlier id is better
                    heap = best[j]
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry[:2] > heap[0][:2]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == top:
                        least[j] = max(least[j], heap[0][0])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            n, folded = batch.column(2).to_numpy(), batch.column(3)
            for at in range(0, len(n), BATCH):
                rows = np.arange(at, min(at + BATCH, len(n)))
                norms = length_norm(n[rows], n_docs, n_terms)
                row, coord, tf = unfold([folded[int(r)].as_py() for r in rows])
                dense = np.zeros((len(rows), b.width))
                dense[row, coord] = impact(tf, norms[row])
                rescore([int(r) for r in rows], texts, norms.tolist(), ids, dense @ matrix)
        found = [(b.queries[j][0], s, i) for j, heap in enumerate(best) for s, _, i in heap]
        cols = list(zip(*found)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                         names=["query", "score", "id"])
    return index.mapInArrow(run, _FOUND)


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP, width: int = WIDTH, seeds: int = SEEDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every query row."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    names = quoted(item_id).alias("item"), F.make_valid_utf8(quoted(item_text).cast("string")).cast("binary").alias("t")
    if (queries.agg(F.sum(F.octet_length(quoted(item_text).cast("string"))).alias("b")).first().b or 0) > QUERY_BYTES:
        raise ValueError(f"more than {QUERY_BYTES} bytes of queries: search them in parts")
    items = [(r.item, Counter(alnum_words(bytes(r.t)))) for r in queries.select(*names).toLocalIterator() if r.t is not None]
    vocabulary = sc.broadcast(frozenset(t for _, q in items for t in q))
    table = stored(_index(docs, doc_id, text, vocabulary, width), "sketches")
    index = table.where(F.col("n") > 0).select("id", "text", "n", "sketch")
    sums = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = {r.term.encode(): r.df for r in table.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
    weights = {t: weight(sums.docs, df.get(t, 0)) for t in vocabulary.value}
    item_type = queries.schema[item_id].dataType.simpleString()
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    found = spark.createDataFrame([], _FOUND)
    for block in _blocks(items if sums.docs else []):
        shared = sc.broadcast(Block(block, {t: weights[t] for _, q in block for t in q}, width))
        first = _search(index, shared, sc.broadcast({}), sums.docs, sums.terms, top, seeds)
        # the k-th best of some exact scores is no more than that of all
        floor = first.withColumn("r", F.row_number().over(by_query)).where(F.col("r") == top)
        least = sc.broadcast({r.query: r.score for r in floor.toLocalIterator()})
        best = _search(index, shared, least, sums.docs, sums.terms, top, None)
        found = found.union(stored(best, "found"))
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= top)
    named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"query int, item {item_type}")
    return named.join(ranked, "query").select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def _blocks(items: list[tuple[object, Counter]]) -> Iterator[list[tuple[int, Counter]]]:
    block, size = [], 0
    for number, (_, q) in enumerate(items):
        if block and (size + len(q) > BLOCK_TERMS or len(block) == BLOCK_QUERIES):
            yield block
            block, size = [], 0
        if q:
            block.append((number, q))
            size += len(q)
    if block:
        yield block
