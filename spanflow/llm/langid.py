"""Language identification with hyperdimensional profiles.

Every letter of any script has a random vector of +1 and -1, drawn from a seeded hash of its
code point.  An n-gram's vector binds its letters: the vectors are rotated by their place and multiplied.
A text's vector bundles (sums) those of its n-grams, a language's prototype bundles the texts of
that language, and a text gets the language whose prototype has the largest cosine.

Bundles are sums of whole numbers, so they are the same however the texts are dealt: each task
sums its texts per language, Spark sums the tasks.  What reaches the driver is one vector of ``dim``
numbers a language (``max_langs`` languages, more are an error), whatever the number of documents and letters.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0, as
is everything when nothing can be learnt; bytes that are no UTF-8 are no letters; rows with a NULL language are predicted but
not learnt from; of equal cosines the smallest language name wins; equal texts get
equal results; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, quoted

N = 3
#: Bits of a code point in the code of an n-gram.
BITS = 21
DIM = 512
SEED = 20
MAX_LANGS = 512
#: N-grams whose vectors are made at once, and letters whose vectors a worker keeps.
AT_ONCE, LETTERS = 4096, 20_000


@cache
def letter_table() -> np.ndarray:
    """For each code point the letter it counts as (case folded), 0 where it is none."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])  # a few letters have two in lower case
    return table


def grams(text: bytes | None, table: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of a text: words with a gap (0) before and after."""
    if not text:
        return np.zeros(0, np.int64)
    s = table[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    s = np.concatenate([[0], s[(s != 0) | np.concatenate([[True], s[:-1] != 0])], [0]])
    if len(s) < N or not s.any():
        return np.zeros(0, np.int64)
    code = s[:len(s) - N + 1].copy()
    for j in range(1, N):
        code = (code << BITS) | s[j:len(s) - N + 1 + j]
    return code[s[1:len(s) - 1] != 0]  # n-grams around a gap tell nothing of a word


def letter_vector(letter: int, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """+1 and -1, int8, from a hash of the seed and the code point (0: the gap)."""
    bits = np.frombuffer(hashlib.shake_128(f"{seed}:{letter}".encode()).digest(-(-dim // 8)), np.uint8)
    return np.unpackbits(bits)[:dim].astype(np.int8) * 2 - 1


class Book:
    """Bundles n-grams; the vectors of the letters met are kept, rotated for each place."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self._clear()

    def _clear(self) -> None:
        self.row, self.used = np.full(0x110000, -1, np.int32), 0
        self.turned = [np.zeros((64, self.dim), np.int8) for _ in range(N)]

    def _rows(self, letters: np.ndarray) -> np.ndarray:
        new = np.unique(letters[self.row[letters] < 0])
        while self.used + len(new) > len(self.turned[0]):
            self.turned = [np.concatenate([t, np.zeros_like(t)]) for t in self.turned]
        for x in new:
            v = letter_vector(int(x), self.dim, self.seed)
            for j in range(N):
                self.turned[j][self.used] = np.roll(v, N - 1 - j)
            self.row[x] = self.used
            self.used += 1
        return self.row[letters]

    def bundle(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sum of the vectors of the n-grams ``codes``, each ``n`` times; whole numbers in doubles."""
        out = np.zeros(self.dim)
        for a in range(0, len(codes), AT_ONCE):
            part = codes[a:a + AT_ONCE]
            if self.used > LETTERS:
                self._clear()
            made = None
            for j in range(N):
                rows = self._rows((part >> (BITS * (N - 1 - j))) & ((1 << BITS) - 1))
                made = self.turned[j][rows] if made is None else made * self.turned[j][rows]
            out += n[a:a + AT_ONCE].astype(np.float64) @ made
        return out


def bundles(docs: DataFrame, lang: Column, text: str = "text", dim: int = DIM, seed: int = SEED, max_langs: int = MAX_LANGS) -> DataFrame:
    """(lang, place, n): the bundle of each language's texts, one row a place of the vector."""
    src = docs.select(lang.alias("lang"), quoted(text).cast("string").alias("text")).where("lang IS NOT NULL")

    def run(batches):
        table, book, total = letter_table(), Book(dim, seed), {}
        for b in batches:
            held: dict[str, list] = {}
            sizes: dict[str, int] = {}

            def add(x):
                codes, n = np.unique(np.concatenate(held.pop(x)), return_counts=True)
                total[x] = total.get(x, 0) + book.bundle(codes, n).astype(np.int64)
                sizes[x] = 0
            for x, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                codes = grams(t, table)
                if len(codes):
                    held.setdefault(x, []).append(codes)
                    sizes[x] = sizes.get(x, 0) + len(codes)
                    if sizes[x] > 1 << 20:
                        add(x)
            for x in list(held):
                add(x)
            if len(total) > max_langs:
                raise ValueError(f"more than {max_langs} languages to learn")
        for x, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "place", "n"])
    return src.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))


def prototypes(sums: DataFrame, dim: int = DIM, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """Language names in order and their unit prototypes."""
    rows = sums.limit(max_langs * dim + 1).toPandas()
    langs = sorted(rows.lang.unique())
    if len(rows) > max_langs * dim:
        raise ValueError(f"more than {max_langs} languages to learn")
    out = np.zeros((len(langs), dim))
    out[rows.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), rows.place.to_numpy(np.int64)] = rows.n.to_numpy(np.float64)
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, text: str = "text", keep: list[str] | None = None,
            dim: int = DIM, seed: int = SEED, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language of the largest cosine and that cosine (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, protos.T.astype(np.float64)))

    def make():
        names, across = shared.value
        table, book = letter_table(), Book(dim, seed)

        def work(cols):
            pred, score = [], []
            for t in cols[0]:
                codes = grams(t, table)
                if not len(codes) or not names:
                    pred.append("und")
                    score.append(0.0)
                    continue
                v = book.bundle(*np.unique(codes, return_counts=True))
                cosine = v @ across / max(float(np.linalg.norm(v)), 1e-12)
                best = int(np.argmax(cosine))
                pred.append(names[best])
                score.append(float(min(1.0, max(0.0, cosine[best]))))
            return [pred, score]
        return work
    return annotate(docs, [quoted(text)], [(out[0], "string"), (out[1], "double")], make, keep)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(quoted(doc_id).cast("string").cast("binary")) % folds == 0


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5,
             keep: list[str] | None = None) -> DataFrame:
    """Learn from the documents that are not held out, predict all of them."""
    test = F.coalesce(held_out(doc_id, folds), F.lit(False))
    learnt = F.when(~test, quoted(lang).cast("string"))
    langs, protos = prototypes(bundles(docs, learnt, text))
    return predict(docs.withColumn("held_out", test), langs, protos, text, None if keep is None else [*keep, "held_out"])
