"""Small helpers shared by the operators: Arrow column maps, word splitting on
UTF-8 bytes, and tables written to the shared folder.

Words are split on bytes because every separator of the two word classes is an
ASCII character: bytes of other characters are never touched, so the result is
that of the regular expression on the text, at the speed of ``bytes.split``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of A-Z lower-cased text: a byte is
#: mapped to itself, to its lower case, or to a blank.
_ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
               else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_ALNUM).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged."""
    return text.split() if text else []


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


Maker = Callable[[], Callable[[list], list]]


def annotate(df: DataFrame, inputs: list[Column], fields: list[tuple[str, str]], make: Maker,
             keep: list[str] | None = None, explode: bool = False, most: int | None = None) -> DataFrame:
    """Append columns computed by a Python function over Arrow batches.

    ``inputs`` are the columns that the function reads (strings are handed over
    as UTF-8 bytes).  ``make()`` is called once per task and returns a function
    from a list of input lists to a list of output lists or arrays, one per field.  With
    ``explode`` the function returns the row numbers first, and the kept
    columns are repeated by them.  A kept column whose name is also a field is
    replaced by the field.  With ``most`` a batch is handed over in pieces of about so
    many bytes, a row at least: for functions whose rows do not depend on each other.
    """
    names = {n.lower() for n, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    # own names within the map: those of columns may hold dots, or clash
    given = [f"in{i}" for i in range(len(inputs))]
    src = df.select(*[quoted(c).alias(f"own{i}") for i, c in enumerate(kept)], *[c.alias(n) for c, n in zip(inputs, given)])
    made = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType(src.schema.fields[:len(kept)] + [T.StructField(f"made{i}", f.dataType) for i, f in enumerate(made.fields)])
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches if most is None else (p for b in batches for p in pieces(b, most)):
            cols = []
            for n in given:
                c = b.column(b.schema.get_field_index(n))
                cols.append((c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist())
            out = work(cols)
            own = [b.column(i) for i in range(len(kept))]
            if explode:
                rows = pa.array(out[0], pa.int64())
                own, out = [c.take(rows) for c in own], out[1:]
            own += [pa.array(c, t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(own, names=[f.name for f in schema.fields])

    return src.mapInArrow(run, schema).toDF(*kept, *[n for n, _ in fields])


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in halves of halves, until one has ``most`` bytes or one row."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), most)
    yield from pieces(batch.slice(half), most)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts the lineage, and a
    lost executor costs nothing that was written.  The folder is the session's
    checkpoint folder; like checkpoints, its files live until it is cleared."""
    path = shared_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def text_key(*cols: Column) -> Column:
    """128-bit key of several nullable columns (NULL differs from every value).

    Equal rows have equal keys: operators treat rows of the same identity and
    text as one document."""
    parts = [F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"),
             F.lit(":"), c.cast("string"))) for c in cols]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(a: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift), wrapping."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return a ^ (a >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; a bounded number of words is remembered."""

    REMEMBERED = 400_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
