"""Lexer patterns (F16), token labels (F15) and comment stripping.

A pattern's alternatives together match every character, so the pieces of
``regexp_extract_all`` tile the text and a running sum of piece lengths gives
exact character spans.  Character classes are written out: Java regex and
RE2 (the DuckDB oracle) agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Prose: runs of letters/marks/digits/underscore, runs of blanks, any other char.
PROSE_PATTERN = r"([\p{L}\p{M}\p{N}_]+|[ \t\n\r\f]+|[^\p{L}\p{M}\p{N}_ \t\n\r\f])"
# Sub-word pieces of at most 4 characters: the second tokenization for J2.
PIECE_PATTERN = r"([\p{L}\p{M}\p{N}_]{1,4}|[ \t\n\r\f]+|[^\p{L}\p{M}\p{N}_ \t\n\r\f])"
# Java source (loops over literals are possessive: a long literal must not use up
# the regex stack): comments, text blocks, string and char literals, numbers, identifiers,
# blanks, multi-character operators, then any single character.
JAVA_PATTERN = (
    r"(/\*[\s\S]*?\*/"
    r"|//[^\n]*"
    r'|"{3}[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"{3}'
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r"|0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?"
    r"|[0-9][0-9_]*(?:\.[0-9_]+)?(?:[eE][+-]?[0-9]+)?[fFdDlL]?"
    r"|[\p{L}_$][\p{L}\p{N}_$]*"
    r"|[ \t\n\r\f]+"
    r"|>>>=|<<=|>>=|>>>|\.\.\.|->|::|\+\+|--|&&|\|\||<<|>>|[-+*/%&|^!=<>]="
    r"|[\s\S])"
)
# Python source: comments, (triple-)quoted strings with prefixes, numbers,
# identifiers, blanks, multi-character operators, then any single character.
PYTHON_PATTERN = (
    r"(#[^\n]*"
    r'|(?:[rRbBuUfF]{0,2})(?:"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\'[^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+\')'
    r"|0[xXoObB][0-9a-fA-F_]+"
    r"|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9]+)?[jJ]?"
    r"|[\p{L}_][\p{L}\p{N}_]*"
    r"|[ \t\n\r\f]+"
    r"|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|[-+*/%&|^!=<>@]="
    r"|[\s\S])"
)
# Python keywords; True/False/None label as the parser's lowercase node types.
PYTHON_KEYWORDS = (
    "and as assert async await break class continue def del elif else except finally for from "
    "global if import in is lambda nonlocal not or pass raise return try while with yield").split()
PYTHON_CONSTANTS = {"True": "true", "False": "false", "None": "none"}
# Java reserved words plus the literals true/false; a token that is one of
# these is labelled with its own text (as the parser's anonymous nodes are).
JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do "
    "double else enum extends final finally float for goto if implements import instanceof "
    "int interface long native new package private protected public return short static "
    "strictfp super switch synchronized this throw throws transient try void volatile while "
    "true false").split()
# Primitive type and modifier words that can precede a declared name.
DECL_WORDS = ("boolean byte char double float int long short void public private protected "
              "static final abstract synchronized native").split()
WS_CLASS = r"^[ \t\n\r\f]"
# Decimal integers of Java: no leading zero, underscores between digits.
DECIMAL = r"^(0|[1-9][0-9_]*)[lL]?$"
# ---------------------------------------------------------------------------

PATTERNS = {"prose": PROSE_PATTERN, "pieces": PIECE_PATTERN, "java": JAVA_PATTERN, "python": PYTHON_PATTERN}


def pieces(text: Column, lang: str = "prose") -> Column:
    """Array of pieces tiling ``text``."""
    return F.regexp_extract_all(text, F.lit(PATTERNS[lang]), 1)


def is_blank(piece: Column) -> Column:
    return piece.rlike(WS_CLASS)


def is_comment(piece: Column, lang: str = "java") -> Column:
    if lang == "python":
        return piece.startswith("#")
    return piece.startswith("//") | (piece.startswith("/*") & piece.endswith("*/") & (F.length(piece) >= 4))


def python_label(text: Column) -> Column:
    """F15 for Python: the parser's leaf types; keywords and punctuation
    label themselves."""
    kw = F.array(*[F.lit(k) for k in PYTHON_KEYWORDS])
    const = F.create_map(*[x for k, v in PYTHON_CONSTANTS.items() for x in (F.lit(k), F.lit(v))])
    return (F.when(text.rlike(r"^(0[xXoObB][0-9a-fA-F_]+|[0-9][0-9_]*)$"), F.lit("integer"))
             .when(text.rlike(r"^[0-9]"), F.lit("float"))
             .when(text.rlike(r"^[rRbBuUfF]{0,2}[\"']"), F.lit("string"))
             .when(F.array_contains(kw, text), text)
             .when(const[text].isNotNull(), const[text])
             .when(text.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), F.lit("identifier"))
             .otherwise(text))


def token_label(text: Column) -> Column:
    """the leaf type of a token.  Keywords and punctuation label
    themselves; literals and identifiers get their node type.  Type names
    stay ``identifier`` (no parser: a documented difference)."""
    kw = F.array(*[F.lit(k) for k in JAVA_KEYWORDS])
    return (F.when(text.rlike(DECIMAL), F.lit("decimal_integer_literal"))
             .when(text.rlike(r"^0[xX]"), F.lit("hex_integer_literal"))
             .when(text.rlike(r"^0[bB][01_]+[lL]?$"), F.lit("binary_integer_literal"))
             .when(text.rlike(r"^0[0-7_]+[lL]?$"), F.lit("octal_integer_literal"))
             .when(text.rlike(r"^[0-9][0-9_]*(\.[0-9_]+)?([eE][+-]?[0-9]+)?[fFdD]?$"),
                   F.lit("decimal_floating_point_literal"))
             .when(text.startswith('"'), F.lit("string_literal"))
             .when(text.startswith("'") & (F.length(text) >= 3), F.lit("character_literal"))
             .when(text == "null", F.lit("null_literal"))
             .when(text.isin("void", "boolean"), F.concat(text, F.lit("_type")))
             .when(F.array_contains(kw, text), text)
             .when(text.rlike(r"^[\p{L}\p{M}\p{N}_$]+$"), F.lit("identifier"))
             .otherwise(text))


HTML_COMMENT = r"<!--[\s\S]*?-->"


def drop_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda l: l.rlike(r"[^ \t\r\f]")), "\n")


def strip_comments(code: Column, lang: str = "java") -> Column:
    """drop the comments among the lexer's pieces (a Java comment leaves one
    space), then blank lines.  ``html`` removes ``<!-- -->`` blocks; ``python``
    also drops triple-quoted strings that are a line's only content."""
    if lang == "html":
        return drop_blank_lines(F.regexp_replace(code, HTML_COMMENT, ""))
    own = pieces(code, lang)
    if lang == "python":
        before = F.concat(F.array(F.lit("\n")), own)
        after = F.concat(F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), F.array(F.lit("\n")))
        around = F.arrays_zip(own.alias("piece"), F.slice(before, F.lit(1), F.greatest(F.size(own), F.lit(1))).alias("before"),
                              after.alias("after"))
        triple = r"^[rRbBuUfF]{0,2}(\"\"\"|\'\'\')"
        kept = F.transform(around, lambda x: F.when(
            is_comment(x["piece"], lang) | (x["piece"].rlike(triple) & x["before"].rlike(r"\n[ \t]*$") & x["after"].rlike(r"^[ \t]*\n")),
            F.lit("")).otherwise(x["piece"]))
    else:
        kept = F.transform(own, lambda p: F.when(is_comment(p, lang), F.lit(" ")).otherwise(p))
    return drop_blank_lines(F.array_join(kept, ""))
