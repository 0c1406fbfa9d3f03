"""Scalar column functions (F1-F14, P1, P3).  All are built-in Spark
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# English number words below 100, as the reference's number-to-words library
# spells them: units 0..19, then tens; 21 -> "twenty-one".
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
         "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
         "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
# Comparison operators of the comparative task.
OPS = ["<", ">", ">=", "<=", "=="]
# Wrapper that turns a code fragment into a class.
WRAP_PREFIX = "public class Test {\n"
WRAP_SUFFIX = "\n}"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signed_log(x) -> Column:
    """ln x for x>0, -ln(-x) for x<0, 0 at 0."""
    x = _c(x).cast("double")
    return F.when(x > 0, F.log(x)).when(x < 0, -F.log(-x)).otherwise(F.lit(0.0))


def number_words(n) -> Column:
    """integer in (-100, 100) to English words; NULL outside (the
    generator validates configs up front, T8)."""
    n = _c(n).cast("int")
    a = F.abs(n)
    units = F.array(*[F.lit(w) for w in UNITS])
    tens = F.array(*[F.lit(w) for w in TENS])
    below20 = F.element_at(units, a + 1)
    above = F.concat(F.element_at(tens, (a / 10).cast("int") + 1),
                     F.when(a % 10 != 0, F.concat(F.lit("-"), F.element_at(units, a % 10 + 1))).otherwise(F.lit("")))
    word = F.when(a < 20, below20).when(a < 100, above)
    return F.when(n < 0, F.concat(F.lit("minus "), word)).otherwise(word)


def join_tokens(arr) -> Column:
    """F3"""
    return F.array_join(_c(arr), " ")


def split_statements(e, sep: str = ";") -> Column:
    """split a program at ``sep`` (empty parts kept) and strip blanks
    (space, tab, newline, CR, form feed) from both ends of each part."""
    return F.transform(F.split(_c(e), _re_quote(sep), -1),
                       lambda s: F.regexp_replace(s, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""))


def _re_quote(s: str) -> str:
    import re
    return re.escape(s)


def span_text(code, l0, c0, l1, c1) -> Column:
    """text between (line l0, col c0) and (line l1, col c1), 0-based,
    end exclusive; interior newlines are dropped (lines are concatenated)."""
    lines = F.split(_c(code), "\n")
    l0, c0, l1, c1 = (_c(x) if not isinstance(x, int) else F.lit(x) for x in (l0, c0, l1, c1))
    first = F.element_at(lines, l0 + 1)
    last = F.element_at(lines, l1 + 1)
    same = F.substring(first, c0 + 1, c1 - c0)
    middle = F.array_join(F.slice(lines, l0 + 2, F.greatest(l1 - l0 - 1, F.lit(0))), "")
    multi = F.concat(F.substring(first, c0 + 1, F.length(first)), middle, F.substring(last, 1, c1))
    return F.when(F.size(lines) <= l1, F.lit(None).cast("string")) \
            .when(l0 == l1, same).otherwise(multi)


def sigmoid_threshold(x, t: float = 0.5) -> Column:
    """F8: sigmoid(x) > t."""
    return (F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x).cast("double")))) > F.lit(t)


def one_hot(k, n) -> Column:
    """array of n ints with a 1 at position k (0-based)."""
    k = _c(k) if not isinstance(k, int) else F.lit(k)
    n = _c(n) if not isinstance(n, int) else F.lit(n)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i == k).cast("int"))


def pad_right(arr, length, zero) -> Column:
    """append ``zero`` until the array has ``length`` elements."""
    arr = _c(arr)
    length = F.lit(length) if isinstance(length, int) else _c(length)
    zero = zero if isinstance(zero, Column) else F.lit(zero)
    return F.concat(arr, F.array_repeat(zero, F.greatest(length - F.size(arr), F.lit(0))))


def flatten_matrix(arr) -> Column:
    """token x dim matrix to one vector."""
    return F.flatten(_c(arr))


def compare_op(a, op, b) -> Column:
    """``a op b`` for the five comparison tokens; NULL for anything else."""
    a, b = _c(a), _c(b)
    op = _c(op) if not isinstance(op, str) or op not in OPS else F.lit(op)
    return (F.when(op == "<", a < b).when(op == ">", a > b).when(op == ">=", a >= b)
             .when(op == "<=", a <= b).when(op == "==", a == b))


def bool_text(b) -> Column:
    """F13"""
    return _c(b).cast("string")


def num_text(x) -> Column:
    """F14 number to text."""
    return _c(x).cast("string")


def text_num(s) -> Column:
    """F14 text to number; malformed text gives NULL, not an error."""
    return _c(s).try_cast("double")


def wrap_code(code, prefix: str = WRAP_PREFIX, suffix: str = WRAP_SUFFIX) -> Column:
    """Wrap a fragment in a class."""
    return F.concat(F.lit(prefix), _c(code), F.lit(suffix))


def plain_text(v) -> str:
    """A config value as a column cast to text spells it: one spelling of doubles
    for keys made from columns and from Python values."""
    if not isinstance(v, float) or v == 0 or 1e-3 <= abs(v) < 1e7 or v != v or v in (float("inf"), float("-inf")):
        return str(v)
    sign, digits, exp = Decimal(repr(v)).normalize().as_tuple()
    head, tail = str(digits[0]), "".join(map(str, digits[1:])) or "0"
    return f"{'-' * sign}{head}.{tail}E{exp + len(digits) - 1}"


CONFIG_FIELDS = ("min", "max", "n", "m", "type", "task")


def config_name(*cols, names=CONFIG_FIELDS) -> Column:
    """``k-v`` pairs joined by ``-`` in the order min, max, n, m, type, task."""
    parts = []
    for name, c in zip(names, cols):
        parts += [F.lit(name), _c(c).cast("string")]
    return F.concat_ws("-", *parts)
