"""Formulas: LaTeX and MathML parsed into one canonical tree, written as a line, and signed.

A tree is a tuple: ("tok", text), ("row", parts...), ("frac", a, b), ("sqrt", a), ("root", a, n), ("sup", base, e),
("sub", base, i), ("subsup", base, i, e), ("matrix", rows of cells). Rows of one part are that part, rows inside rows
are spread out, digits side by side are one number. The line brackets fractions, powers and indices always, and a base wherever it is more than a token.

Malformed formulas (open braces or tags, missing arguments) and those nested deeper than ``DEEPEST`` give null.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of brackets; a formula on paper has a few.
DEEPEST = 150
#: Commands of LaTeX and their linear signs, then characters of MathML.
SIGNS = {"times": "*", "cdot": "*", "div": "/", "leq": "<=", "le": "<=", "geq": ">=", "ge": ">=", "neq": "!=", "ne": "!=", "pm": "+-"}
CHARACTERS = {"×": "*", "⋅": "*", "·": "*", "÷": "/", "≤": "<=", "≥": ">=", "≠": "!=", "±": "+-", "−": "-", "\u2061": "", "\u2062": "", "\u2063": "", "\u2064": ""}
_SKIPPED = {"left", "right", ",", ";", "!", ":", " ", "quad", "qquad", "displaystyle", "limits", "big", "Big"}
_WORDS = {"text", "mathrm", "mathbf", "mathit", "operatorname", "textbf"}

Tree = tuple


class Malformed(ValueError):
    pass


def row(parts: list[Tree]) -> Tree:
    """The canonical row of some parts."""
    if len(parts) == 1:  # rows are canonical
        return parts[0] if parts[0] != _NOTHING else ("row",)
    out: list[Tree] = []
    after_number = False
    for p in parts:
        for x in p[1:] if p[0] == "row" else (p,):
            if x[0] != "tok":
                after_number = False
                out.append(x)
            elif x[1]:
                number = _number(x[1])
                if number and after_number:
                    out[-1] = ("tok", out[-1][1] + x[1])
                else:
                    out.append(x)
                after_number = number
    return out[0] if len(out) == 1 else ("row", *out)


_NOTHING = ("tok", "")
_DIGITS = frozenset("0123456789.")


def _number(text: str) -> bool:
    return text[:1] in _DIGITS and not text.strip("0123456789.")


@lru_cache(1 << 16)
def _character(c: str) -> str:
    name = unicodedata.name(c, "")
    return CHARACTERS[c] if c in CHARACTERS else name.rsplit(" ", 1)[1].lower() if name.startswith("GREEK SMALL LETTER ") else name.rsplit(" ", 1)[1].capitalize() if name.startswith("GREEK CAPITAL LETTER ") else c


def _sign(text: str) -> str:
    """A token's text in the line."""
    return "".join((text if text.isascii() else "".join(map(_character, text))).split())


@lru_cache(1 << 16)
def _token(text: str) -> Tree:
    return ("tok", _sign(html.unescape(text)))


# LaTeX --------------------------------------------------------------------------------------------

#: Commands with their backslash, and single characters without white space.
_LATEX = re.compile(r"\\(?:[A-Za-z]+|.)|\S", re.S)
_MARKS = frozenset("{}^_&[]")
_STOPS = frozenset(["", "}", "&", "\\\\", "\\end"])
_NO_ARGUMENT = frozenset(["}", "&", "^", "_"])


class _Latex:
    """Recursive descent: row = (atom scripts)*; atom = token | group | command arguments."""

    def __init__(self, text: str) -> None:
        self.tokens: list[str] = _LATEX.findall(text)
        self.tokens.append("")  # the end
        self.at = self.depth = 0

    def take(self) -> str:
        t = self.tokens[self.at]
        if not t:
            raise Malformed("ends early")
        self.at += 1
        return t

    def whole(self) -> Tree:
        out = self.row("")
        if t := self.tokens[self.at]:
            raise Malformed(f"{t} is not open")
        return out

    def row(self, end: str) -> Tree:
        parts: list[Tree] = []
        tokens = self.tokens
        self.depth += 1
        if self.depth > DEEPEST:
            raise Malformed("too deep")
        while (t := tokens[self.at]) not in _STOPS and t != end:
            if t == "^" or t == "_":
                base = parts.pop() if parts else _NOTHING
                parts.append(self.scripts(base))
            elif len(t) == 1 and t not in _MARKS:
                self.at += 1
                parts.append(("tok", t if t.isascii() else _sign(t)))
            else:
                parts.append(self.atom())
        self.depth -= 1
        return row(parts)

    def scripts(self, base: Tree) -> Tree:
        got: dict[str, Tree] = {}
        while (mark := self.tokens[self.at]) == "^" or mark == "_":
            self.at += 1
            if mark in got:
                raise Malformed("two scripts")
            got[mark] = self.argument()
        return ("subsup", base, got["_"], got["^"]) if len(got) == 2 else ("sup", base, got["^"]) if "^" in got else ("sub", base, got["_"])

    def argument(self) -> Tree:
        while len(t := self.tokens[self.at]) > 1 and t[1:] in _SKIPPED:
            self.at += 1
        if t in _NO_ARGUMENT:
            raise Malformed("an argument is missing")
        return self.atom()

    def group(self) -> Tree:
        out = self.row("")
        if self.take() != "}":
            raise Malformed("a brace is open")
        return out

    def name(self) -> str:
        """The plain text of a group."""
        if self.take() != "{":
            raise Malformed("no group")
        out = ""
        while (t := self.take()) != "}":
            out += t[1:] if len(t) > 1 else t
        return out

    def atom(self) -> Tree:
        t = self.take()
        if t == "{":
            return self.group()
        if len(t) == 1:
            return ("tok", t if t.isascii() else _sign(t))
        text = t[1:]
        if text in _SKIPPED:
            if text in ("left", "right") and self.tokens[self.at] == ".":
                self.at += 1
            return _NOTHING
        if text in ("frac", "dfrac", "tfrac"):
            return ("frac", self.argument(), self.argument())
        if text == "sqrt":
            if self.tokens[self.at] == "[":
                self.at += 1
                n = self.row("]")
                if self.take() != "]":
                    raise Malformed("a bracket is open")
                return ("root", self.argument(), n)
            return ("sqrt", self.argument())
        if text in _WORDS:
            return ("tok", _sign(self.name()))
        if text == "begin":
            return self.matrix(self.name())
        return ("tok", SIGNS.get(text, text))

    def matrix(self, name: str) -> Tree:
        rows: list[tuple[Tree, ...]] = []
        cells: list[Tree] = []
        while True:
            cells.append(self.row(""))
            t = self.take()
            if t == "&":
                continue
            rows.append(tuple(cells))
            cells = []
            if t == "\\end":
                if self.name() != name:
                    raise Malformed("ends another")
                if len(rows) > 1 and rows[-1] == (("row",),):
                    rows.pop()  # after a last \\
                return ("matrix", *rows)
            if t != "\\\\":
                raise Malformed("a row is open")


# MathML -------------------------------------------------------------------------------------------

#: A token with its text comes as one; the alternatives behind are those of all tags.
_TAG = re.compile(r"<(m[ino])>([^<]*)</\1>|<!--.*?-->|<\?.*?\?>|<(/?)([A-Za-z][\w.:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|([^<]+)|(<)", re.S)
_TOKENS = {"mi", "mn", "mo", "mtext", "ms"}
_PARTS = {"mfrac": ("frac", 2), "mroot": ("root", 2), "msup": ("sup", 2), "msub": ("sub", 2), "msubsup": ("subsup", 3), "munder": ("sub", 2), "mover": ("sup", 2), "munderover": ("subsup", 3)}


def _mathml(text: str) -> Tree:
    """A stack of open elements; each becomes a tree when it is closed."""
    open_: list[tuple[str, str, list]] = [("", "", [])]
    for token, inside, closes, name, attributes, empty, outside, broken in _TAG.findall(text):
        if token:
            if len(open_) > DEEPEST:
                raise Malformed("too deep")
            open_[-1][2].append(_token(inside))
        elif name:
            tag = name if ":" not in name else name.rsplit(":", 1)[-1]
            if closes:
                name, attributes, parts = open_.pop()
                if name != tag or not open_:
                    raise Malformed(f"{tag} is not open")
                open_[-1][2].append(_element(name, attributes, parts))
            elif empty:
                open_[-1][2].append(_element(tag, attributes, []))
            else:
                if len(open_) > DEEPEST:
                    raise Malformed("too deep")
                open_.append((tag, attributes, []))
        elif outside:
            if open_[-1][0] in _TOKENS:
                open_[-1][2].append(("tok", _sign(html.unescape(outside))))
            elif outside.strip():
                raise Malformed("text outside a token")
        elif broken:
            raise Malformed("no tag")
    if len(open_) > 1:
        raise Malformed("a tag is open")
    return row(open_[0][2])


def _element(tag: str, attributes: str, parts: list[Tree]) -> Tree:
    if tag in _TOKENS:
        return ("tok", "".join(p[1] for p in parts))
    if tag in _PARTS:
        kind, n = _PARTS[tag]
        if len(parts) != n:
            raise Malformed(f"{tag} needs {n} parts")
        return (kind, *[p if p != _NOTHING else ("row",) for p in parts])
    if tag == "msqrt":
        return ("sqrt", row(parts))
    if tag == "mfenced":
        marks = dict(re.findall(r"(open|close|separators)\s*=\s*[\"']([^\"']*)[\"']", attributes))
        sep = marks.get("separators", ",")[:1]
        inner = [x for i, p in enumerate(parts) for x in ((("tok", sep), p) if i else (p,))]
        return row([("tok", marks.get("open", "(")), *inner, ("tok", marks.get("close", ")"))])
    if tag == "mtd":
        return ("cell", row(parts))
    if tag == "mtr":
        return ("cells", *(p[1] if p[0] == "cell" else p for p in parts))
    if tag == "mtable":
        return ("matrix", *(p[1:] if p[0] == "cells" else (p,) for p in parts))
    if tag == "semantics":
        return parts[0] if parts else ("row",)
    if tag in ("annotation", "annotation-xml", "mspace", "mphantom"):
        return ("row",)
    return row(parts)


# line and signature -------------------------------------------------------------------------------


def line(t: Tree) -> str:
    kind = t[0]
    if kind == "tok":
        return t[1]
    if kind == "row":
        return "".join([p[1] if p[0] == "tok" else line(p) for p in t[1:]])
    if kind == "frac":
        return f"({line(t[1])})/({line(t[2])})"
    if kind == "sqrt":
        return f"sqrt({line(t[1])})"
    if kind == "root":
        return f"root({line(t[2])},{line(t[1])})"
    if kind == "matrix":
        return "matrix(" + ";".join(",".join(line(c) for c in cells) for cells in t[1:]) + ")"
    base = line(t[1]) if t[1][0] in ("tok", "sqrt", "root", "matrix") or t[1] == ("row",) else f"({line(t[1])})"
    return f"{base}^({line(t[2])})" if kind == "sup" else f"{base}_({line(t[2])})" if kind == "sub" else f"{base}_({line(t[2])})^({line(t[3])})"


def to_line(text: str | None, notation: str) -> str | None:
    if text is None:
        return None
    try:
        return line(_Latex(text).whole() if notation == "latex" else _mathml(text))
    except Malformed:
        return None


def linear(formula: Column | str, notation: str) -> Column:
    """The line of a column of formulas ("latex" or "mathml"), a batch at a time; null where there is none. Several columns of
    a query go through one pass of Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([to_line(x, notation) for x in s], dtype=object)

    return run(F.col(formula) if isinstance(formula, str) else formula)
