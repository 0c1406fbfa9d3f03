"""Reads and writes of one Java file, from its tokens: the row-level helper of
:func:`spanflow.operators.accesses.code_accesses`.

There is no syntax tree.  Targets are found left of assignment operators and beside
``++`` and ``--``, values up to the end of the operator's bracket or statement, and
regions (loops, branches) from the words that open them and the end of their statement.
Everything is one pass over the tokens per step, with stacks in place of recursion.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

from .lexing import JAVA_KEYWORDS

# --- fixed values -----------------------------------------------------------
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
PRIMITIVES = frozenset("boolean byte char double float int long short void".split())
# Leaves that are no names but count among a statement's values.
VALUE_WORDS = frozenset("null void boolean".split())
# Words before the name of a type, and those whose types come in a list.
BEFORE_TYPE, TYPE_LISTS = frozenset("new extends implements throws instanceof".split()), frozenset("extends implements throws".split())
IN_GENERIC = frozenset(". , ? [ ] & @ extends super".split()) | PRIMITIVES
# Words whose parentheses are no cast.
HEADERS = frozenset("if while for switch catch synchronized try".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
# ----------------------------------------------------------------------------
_WORDS = frozenset(JAVA_KEYWORDS) | VALUE_WORDS


@lru_cache(1 << 15)
def is_name(t: str) -> bool:
    return (t[0].isalpha() or t[0] in "_$") and t not in _WORDS


@lru_cache(1 << 15)
def is_value(t: str) -> bool:
    return is_name(t) or t[0].isdigit() or t[0] == '"' or (t[0] == "'" and len(t) > 2) or t in VALUE_WORDS


class Shape:
    """Brackets, types, and the targets and values of every assignment and update."""

    def __init__(self, tok: list[str]):
        self.tok, n = tok, len(tok)
        self.match = [-1] * n                 # the other bracket
        self.generic: dict[int, int] = {}     # first <-> last token of a list of type arguments
        self.typed, self.declared = set(), set()
        self.silent: set[int] = set()         # tokens that are not walked as uses
        self.before: dict[int, list[int]] = defaultdict(list)  # statements whose targets are set before a token
        self.targets: dict[int, list[int]] = {}
        self.values: dict[int, list[int]] = {}
        self._brackets()
        self._types()
        self._statements()

    def _brackets(self) -> None:
        stack, angles = [], []
        for i, t in enumerate(self.tok):
            if t in OPEN:
                stack.append(i)
            elif t in CLOSE:
                while stack and OPEN[self.tok[stack[-1]]] != t:
                    stack.pop()
                if stack:
                    self.match[i] = stack.pop()
                    self.match[self.match[i]] = i
            if t == "<" and i and (is_name(self.tok[i - 1]) or self.tok[i - 1] in _WORDS or self.tok[i - 1] in ".{};"):
                angles.append(i)
            elif t[0] == ">" and set(t) == {">"}:
                for _ in t:
                    if angles:
                        a = angles.pop()
                        self.generic[a], self.generic[i] = i, a
            elif t not in IN_GENERIC and not is_name(t):
                angles.clear()

    def _chain(self, i: int) -> None:
        """A (qualified) type name that ends at token i."""
        while i >= 0 and is_name(self.tok[i]):
            self.typed.add(i)
            if i < 2 or self.tok[i - 1] != ".":
                return
            i -= 2

    def _types(self) -> None:
        tok, n = self.tok, len(self.tok)
        for a, z in self.generic.items():
            if a < z:
                self.typed.update(i for i in range(a + 1, z) if is_name(tok[i]))
                self._chain(a - 1)
        for i, t in enumerate(tok):
            if is_name(t) and i:
                k = i - 1
                while k > 0 and tok[k] == "]" and self.match[k] == k - 1:
                    k -= 2
                if tok[k] == "...":
                    k -= 1
                if k in self.generic and self.generic[k] < k:
                    k = self.generic[k] - 1
                if k >= 0 and (tok[k] in PRIMITIVES or is_name(tok[k])):
                    self.declared.add(i)
                    self._chain(k)
                if i + 2 < n and tok[i + 1] == "." and tok[i + 2] == "class":
                    self._chain(i)
            elif t in BEFORE_TYPE:
                k = i + 1
                while k < n and is_name(tok[k]):
                    self.typed.add(k)
                    k += 1
                    if k in self.generic:
                        k = self.generic[k] + 1
                    if k < n and (tok[k] == "." or tok[k] == "," and t in TYPE_LISTS):
                        k += 1
                    else:
                        break
            elif t == "(" and self.match[i] > i + 1 and not (i and (tok[i - 1] in HEADERS or is_name(tok[i - 1]) or tok[i - 1] in ")]>")):
                z = self.match[i]
                k = z - 1
                while k > i and tok[k] == "]" and self.match[k] == k - 1:
                    k -= 2
                plain = all(is_name(x) if (k - j) % 2 == 0 else x == "." for j, x in enumerate(tok[i + 1:k + 1], i + 1))
                after = tok[z + 1] if z + 1 < n else ";"
                if plain and (is_value(after) or after in ("new", "this", "!", "~", "true", "false")):
                    self._chain(k)

    def _back(self, i: int) -> int:
        """First token of the name, field or element that ends at token i."""
        first = i + 1
        while i >= 0:
            while i >= 0 and self.tok[i] in ")]" and self.match[i] >= 0:
                i = first = self.match[i]
                i -= 1
            if i < 0 or not (is_name(self.tok[i]) or self.tok[i] in ("this", "super")):
                return first
            first = i
            if i < 1 or self.tok[i - 1] != ".":
                return first
            i -= 2
        return first

    def _forth(self, i: int) -> int:
        """Last token of the name, field or element that begins at token i."""
        tok, n, last = self.tok, len(self.tok), i
        if tok[i] == "(" and self.match[i] > 0:
            last = self.match[i]
        while last + 1 < n:
            if tok[last + 1] in "([" and self.match[last + 1] > 0:
                last = self.match[last + 1]
            elif tok[last + 1] == "." and last + 2 < n and is_name(tok[last + 2]):
                last += 2
            else:
                break
        return last

    def _set(self, stmt: int, targets: range, values: range) -> None:
        self.targets[stmt] = [i for i in targets if is_value(self.tok[i])]
        self.values[stmt] = [i for i in values if is_value(self.tok[i])]
        self.silent.update(targets)

    def _statements(self) -> None:
        tok, n = self.tok, len(self.tok)
        levels: list[list[int]] = [[]]         # open assignments of each bracket
        declaring, opener = [False], [""]
        inside = 0                             # token after the type arguments we are in

        def end(z: int) -> None:
            for op in reversed(levels[-1]):
                self._set(op, range(self._back(op - 1), op), range(op + 1, z))
                self.before[z].append(op)
            levels[-1].clear()
        for i, t in enumerate(tok):
            if i in self.generic and self.generic[i] > i:
                inside = max(inside, self.generic[i] + 1)
            if t in OPEN:
                levels.append([])
                declaring.append(False)
                opener.append(t)
            elif t in CLOSE and len(levels) > 1:
                end(i)
                for s in (levels, declaring, opener):
                    s.pop()
            elif t == ";" or t == "," and i >= inside:
                end(i)
                declaring[-1] &= t == ","
            elif t in ASSIGN and i and self._back(i - 1) < i:
                levels[-1].append(i)
            elif t in ("++", "--"):
                if i and (is_name(tok[i - 1]) or tok[i - 1] in ")]"):
                    span, z = range(self._back(i - 1), i), i + 1
                elif i + 1 < n and (is_name(tok[i + 1]) or tok[i + 1] in ("this", "super", "(")):
                    z = self._forth(i + 1) + 1
                    span = range(i + 1, z)
                else:
                    continue
                self._set(i, span, span)
                self.before[z].append(i)
            elif t == ":" and opener[-1] == "(" and not levels[-1] and i and (i - 1) in self.declared:
                a = i - 1
                while a and tok[a] != "(":
                    a -= 1
                z = self.match[a]
                if a and tok[a - 1] == "for" and z > i:
                    self._set(i, range(i - 1, i), range(i + 1, z))
                    self.silent.update(range(a, i))
                    self.before[z].append(i)
            if i in self.declared and opener[-1] != "(":
                declaring[-1] = True
            if declaring[-1] and opener[-1] != "(" and is_name(t) and i + 1 < n and tok[i + 1] in ",;" and i >= inside \
                    and (i in self.declared or tok[i - 1] == ",") and not levels[-1]:
                self.targets[i], self.values[i] = [i], []
                self.silent.add(i)
                self.before[i + 1].append(i)
        while levels:
            end(n)
            levels.pop()


def walk(tok: list[str]) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Events (pos, token, role, stmt, regions) in the order a program is walked, with
    role ``use``, ``see`` (a type: read, never bound) or ``def``, and the (stmt, token)
    values of statements.  A region is a list [region, kind, at, fork, [ways]] with kind ``loop`` or ``branch``."""
    shape, n = Shape(tok), len(tok)
    events, path, frames, parens = [], [], [], [0]
    pos, made = 0, 0

    def emit(i, role, stmt=None):
        nonlocal pos
        events.append((pos, i, role, stmt, tuple(path)))
        pos += 1

    def leaf(i):
        for op in shape.before.get(i, ()):
            for x in shape.targets[op]:
                emit(x, "def", op)
        if i < n and i not in shape.silent and is_name(tok[i]):
            emit(i, "see" if i in shape.typed else "use")

    def span(a, b):
        for i in range(a, b + 1):
            leaf(i)

    def enter(kind, fork=None):
        nonlocal made, pos
        made += 1
        if fork is None:
            fork = [made, pos, [1]]
            made, pos = made + 1, pos + 1
        path.append((made, kind, fork[1], fork[0], fork[2]))
        return fork

    def ended(i):
        """A statement ends before token i: close what it was the body of."""
        while frames and frames[-1][0] != "{":
            kind, fork = frames[-1]
            if kind == "then" and i < n and tok[i] == "else":
                path.pop()
                fork[2][0] += 1
                enter("branch", fork)
                frames[-1] = ("else", fork)
                return i + 1
            leave()
            if kind == "do" and i + 1 < n and tok[i] == "while" and tok[i + 1] == "(" and shape.match[i + 1] > 0:
                z = shape.match[i + 1]
                span(i + 2, z)
                i = z + 1
                if i < n and tok[i] == ";":
                    leaf(i)
                    i += 1
        return i

    def leave():
        if frames.pop()[0] in ("then", "else", "loop"):
            path.pop()
    i = 0
    while i < n:
        t, z = tok[i], shape.match[i + 1] if i + 1 < n and tok[i + 1] == "(" else -1
        if t in ("if", "while", "for") and z > 0:
            leaf(i)
            if t == "if":
                frames.append(("then", enter("branch")))
                span(i + 2, z)
            elif t == "while":
                enter("loop")
                frames.append(("loop", None))
                span(i + 2, z)
            else:
                level, semis = 0, []
                for k in range(i + 2, z):
                    level += (tok[k] in OPEN) - (tok[k] in CLOSE)
                    if tok[k] == ";" and not level:
                        semis.append(k)
                init = semis[0] if semis else i + 1
                span(i + 2, init)
                # a classic for runs again from its condition on if it declares its variable
                if not semis or any(k in shape.declared for k in range(i + 2, init)):
                    enter("loop")
                    frames.append(("loop", None))
                else:
                    frames.append(("plain", None))
                span(init + 1, z)
            i = z + 1
            continue
        if t == "do":
            frames.append(("do", None))
        elif t == "{":
            before = tok[i - 1] if i else ""
            frames.append(("{", bool(parens[-1] or before in ("=", "->", "]", ",") or before == ")" and _creates(tok, shape, i - 1))))
            parens.append(0)
            leaf(i)
        elif t == "}":
            leaf(i)
            if any(f[0] == "{" for f in frames):
                while frames[-1][0] != "{":
                    leave()
                inner = frames.pop()[1]
                parens.pop()
                if not inner and not (i + 1 < n and tok[i + 1] in ("catch", "finally")):
                    i = ended(i + 1)
                    continue
        else:
            leaf(i)
            parens[-1] = max(parens[-1] + (t in "([") - (t in ")]"), 0)
            if t == ";" and not parens[-1]:
                i = ended(i + 1)
                continue
        i += 1
    leaf(n)
    return events, [(s, x) for s, xs in shape.values.items() for x in xs]


def _creates(tok: list[str], shape: Shape, close: int) -> bool:
    """Whether the parentheses that end here are those of a ``new``."""
    k = shape.match[close] - 1
    if k in shape.generic and shape.generic[k] < k:
        k = shape.generic[k] - 1
    while k > 1 and is_name(tok[k]) and tok[k - 1] == ".":
        k -= 2
    return k > 0 and is_name(tok[k]) and tok[k - 1] == "new"
