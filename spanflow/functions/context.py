"""Context of the tokens of one Java text (A1, A2, C3, C4): one walk, without a syntax tree.

:func:`java_context` gives what :func:`..operators.structure.java_context` gives by windows over a table of tokens:
what was last seen of the text, of a depth or of a level of brackets is kept by that depth or level, so unbalanced
brackets are treated alike too.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from .lexing import DECL_WORDS

# --- fixed values -----------------------------------------------------------
# Java words before the name of a type.
TYPE_WORDS = ("class", "interface", "enum")
# Java types that are keywords.
PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short", "void")
# ---------------------------------------------------------------------------

_TYPES, _DECLARING = frozenset(TYPE_WORDS), frozenset((*DECL_WORDS, "]", "new"))
_TYPED = frozenset(("]", ">", ">>", ">>>", *PRIMITIVES))
_MARKS, _ENDS, _CLOSING = frozenset(("new", "=", "(", "{", "}", ";")), frozenset("{};"), frozenset((">", ">>", ">>>"))
_VALUE = frozenset(("(", ",", "=", "]", "->"))


class Open(NamedTuple):
    """What a ``{`` opens: the kind of body, the name of a type, the parentheses around and the token before."""
    kind: str
    name: str
    parens: int
    before: str | None


class Member(NamedTuple):
    """A member of a type: its first token, its class and its depth."""
    idx: int
    name: str
    depth: int


def java_context(tokens: list[str], names: set[str]) -> Iterator[tuple[str, int, int, bool, bool, bool, str | None, Member | None]]:
    """``(text, depth before, depth after, do_tail, is_call, is_method_name, class, member)`` of each token; ``names``
    are those that are identifiers."""
    depth = parens = local = 0
    head, mark, declared, prev, prev_ident = "", None, "", None, False
    closed_new = closed_do = False
    opened = member = None                         # of the token before; of the text so far
    by_paren: dict[int, bool] = {}                 # whether the last "(" of a level belongs to a "new"
    opens: dict[int, Open] = {}                    # the last "{" of a level, and whether its type is local
    locals_: dict[int, bool] = {}
    bodies: dict[int, Open | None] = {}            # by the depth around: the body, a "do" without braces, the end of a
    pending: dict[int, bool] = {}                  # statement or member, and a "=" in a member
    ended: dict[int, bool] = {}
    assigned: dict[int, bool] = {}
    last = len(tokens) - 1
    for i, t in enumerate(tokens):
        after = tokens[i + 1] if i < last else None
        ident, before, old_head = t in names, depth, head
        if not (ident and prev == "." or t == "." and prev_ident):
            head = prev or ""
        opens_type, own, is_local, closes_do = None, None, None, False
        if t == "(":
            parens += 1
            by_paren[parens] = prev_ident and old_head == "new" or prev in _CLOSING and mark == "new"
            closes_new = False
        elif t == ")":
            closes_new = by_paren.get(parens, False)
            parens -= 1
        else:
            closes_new = False
            if t == "{":
                depth += 1
                kind = "type" if declared else "anonymous" if closed_new else "value" if prev in _VALUE else "block"
                opens_type = own = opens[depth] = Open(kind, declared, parens, prev)
            elif t == "}":
                own, is_local = opens.get(depth), locals_.get(depth, False)
                closes_do = own is not None and own.before == "do"
                depth -= 1
        outer = before if before < depth else depth
        do_tail = False
        if t == "while":
            ends = prev == ";" or prev == "}"
            do_tail = closed_do or ends and pending.get(outer, False)
            if ends:
                pending[outer] = False
        elif t == "do" and after != "{":
            pending[outer] = True
        first = prev == "{" and t != "}"
        if first:
            bodies[outer] = opened
        body = bodies.get(outer) if outer > 0 else None
        kind = body.kind if body is not None else ""
        in_class = kind == "type" or kind == "anonymous"
        start = in_class and (first or ended.get(outer, False))
        ended[outer] = t == ";" or t == "}" and own is not None and (own.kind == "type" or own.kind == "block")
        flat = body is not None and parens == body.parens
        if start:
            assigned[outer] = False
        elif flat and t == "=":
            assigned[outer] = True
        in_header = in_class and flat and not assigned.get(outer, False)
        cls = body.name if kind == "type" else None
        if opens_type is not None:
            is_local = locals_[depth] = opens_type.kind == "type" and kind not in ("", "type")
            local += is_local
        elif is_local:
            local -= 1
        if start and local <= 0 and kind == "type":
            member = Member(i, cls, before)
        call = name = False
        if ident and after == "(":
            call = not (in_header or prev_ident or head == "new" or head == "@" or prev in _DECLARING)
            name = (in_header and kind == "type" and (prev_ident or prev in _TYPED) and head != "@" and t != cls and prev != "record"
                    and local <= 0)
        yield t, before, depth, do_tail, call, name, cls, member
        if t in _ENDS:
            declared = ""
        elif after is not None and prev != "." and (t in _TYPES or t == "record" and after in names and i + 2 <= last
                                                    and tokens[i + 2] in ("(", "<")):
            declared = after
        if t in _MARKS:
            mark = t
        closed_new, closed_do, opened, prev, prev_ident = closes_new, closes_do, opens_type, t, ident
