"""Rule bitmask ledger for document quality.

Every rule is evaluated once; the ledger stores one bit per failed rule beside
the measurements the rules read.  A policy is a version: a mask of rules that
reject alone, a mask of weaker rules and how many of those may fail.  Applying a
policy, or asking what it would do without one of its rules, only reads the
ledger: ablations group equal bit patterns first (at most two to the number of
rules) and work on their counts.

Defined cases: a NULL or empty text has zero measurements and fails the rules
on length; NULL ids are kept as they are; equal rows get equal ledger rows; an
empty table gives an empty ledger; further columns are carried along, except
those named like a measurement, which are replaced.  A text is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, blank_words, quoted

SYMBOLS = b"#*$%&|<>"
MEASURES = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
            ("n_repeat_words", "bigint"), ("n_lines", "bigint"), ("n_letters", "bigint"), ("n_upper", "bigint"),
            ("n_marks", "bigint")]

#: Bit, name, condition under which a document fails.  Bits are never reused.
RULES = [
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > 3 * n_words"),
    (3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    (4, "short_words", "2 * word_chars < 5 * n_words"),
    (5, "long_words", "word_chars > 15 * n_words"),
    (6, "few_letters", "2 * n_letters < word_chars"),
    (7, "upper_case", "2 * n_upper > word_chars"),
    (8, "shouting", "10 * n_marks > 3 * n_words"),
    (9, "some_symbols", "10 * n_symbols > n_words"),
    (10, "some_repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    (11, "some_repeated_words", "100 * n_repeat_words > 30 * n_words"),
]
BIT = {name: 1 << bit for bit, name, _ in RULES}


@dataclass(frozen=True)
class Policy:
    """``reject``: rules of which one failure rejects.  ``weak``: rules of which
    more than ``allowed`` failures reject."""

    version: str
    reject: tuple[str, ...]
    weak: tuple[str, ...] = ()
    allowed: int = 0

    def mask(self, names: tuple[str, ...]) -> int:
        return sum(BIT[n] for n in names)

    def without(self, rule: str) -> "Policy":
        return Policy(f"{self.version} without {rule}", tuple(r for r in self.reject if r != rule),
                      tuple(r for r in self.weak if r != rule), self.allowed)

    def keeps(self, bits: Column) -> Column:
        weak = F.bit_count(bits.bitwiseAND(F.lit(self.mask(self.weak)).cast("bigint")))
        return (bits.bitwiseAND(F.lit(self.mask(self.reject)).cast("bigint")) == 0) & (weak <= self.allowed)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", BASE.reject + ("symbols", "repeated_lines", "few_letters")),
    Policy("v2", BASE.reject + ("symbols", "repeated_lines", "short_words", "long_words", "few_letters", "upper_case",
                                "shouting"),
           ("some_symbols", "some_repeated_lines", "some_repeated_words"), 1),
)}
CURRENT = "v2"

_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) ** 3 < 1 << 62:
        key = pair[:-1] * len(ids) + a[2:]
    else:  # number the pairs first, so that the triple fits
        key = np.unique(pair, return_inverse=True)[1][:-1] * len(ids) + a[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.nonzero(count[back] > 1)[0]
    inside = np.zeros(n, bool)
    for j in range(3):
        inside[starts + j] = True
    return int(inside.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = blank_words(text)
    solid = text.translate(None, _BLANK)
    points = len(solid) if text.isascii() else len(solid.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    upper = len(solid) - len(solid.translate(None, _UPPER))
    ascii_letters = upper + len(solid) - len(solid.translate(None, _LOWER))
    other = 0 if text.isascii() else sum(c.isalpha() for c in solid.translate(None, bytes(range(128))).decode("utf-8", "replace"))
    return (len(words), points, len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeat_words(words), len(lines), ascii_letters + other, upper, text.count(b"!"))


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the measurements and ``failed_rules`` (one bit per rule)."""
    def make():
        def work(cols):
            rows = [measure(t) for t in cols[0]]
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in MEASURES]
        return work
    out = annotate(docs, [quoted(text)], MEASURES, make, keep)
    bits = sum((F.when(F.expr(cond), F.lit(1 << bit)).otherwise(0) for bit, _, cond in RULES), F.lit(0))
    return out.withColumn("failed_rules", bits.cast("bigint"))


def apply_policy(ledger_rows: DataFrame, policy: Policy | str = CURRENT, out: str = "kept") -> DataFrame:
    """Append the verdict of one policy version to ledger rows."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    return ledger_rows.withColumn(out, p.keeps(F.col("failed_rules")))


def failed_names(bits: Column) -> Column:
    """Names of the failed rules, in bit order."""
    names = [F.when(bits.bitwiseAND(F.lit(BIT[n]).cast("bigint")) != 0, F.lit(n)) for _, n, _ in RULES]
    return F.array_compact(F.array(*names))


def ablations(ledger_rows: DataFrame) -> DataFrame:
    """Per policy and rule of it: documents kept, and kept if the rule were
    dropped, from the counts of the bit patterns."""
    patterns = ledger_rows.groupBy("failed_rules").agg(F.count("*").alias("n"))
    cases = [(p, None) for p in POLICIES.values()] + [(p, r) for p in POLICIES.values() for r in p.reject + p.weak]
    case = F.explode(F.array(*[
        F.struct(F.lit(p.version).alias("policy"), F.lit(r).cast("string").alias("dropped_rule"),
                 p.keeps(F.col("failed_rules")).alias("kept"),
                 (p.without(r) if r else p).keeps(F.col("failed_rules")).alias("kept_without")) for p, r in cases]))
    return (patterns.select("n", case.alias("c")).groupBy("c.policy", "c.dropped_rule")
            .agg(F.sum(F.when(F.col("c.kept"), F.col("n")).otherwise(0)).alias("n_kept"),
                 F.sum(F.when(F.col("c.kept_without"), F.col("n")).otherwise(0)).alias("n_kept_without"),
                 F.sum("n").alias("n_docs")))


def keep_good(docs: DataFrame, text: str = "text", policy: Policy | str = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    taken = {n for n, _ in MEASURES} | {"failed_rules"}
    clash = [c for c in docs.columns if c.lower() in taken]
    renamed = {c: f"own_{i}_{c}" for i, c in enumerate(clash)}
    rows = ledger(docs.withColumnsRenamed(renamed), renamed.get(text, text))
    p = POLICIES[policy] if isinstance(policy, str) else policy
    kept = rows.where(p.keeps(F.col("failed_rules")))
    return kept.select(*[quoted(renamed.get(c, c)).alias(c) for c in docs.columns])
