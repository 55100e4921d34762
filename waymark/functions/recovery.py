"""A normal form of programs that don't parse.

Lines are cut into tokens without a grammar, and nested by their indents.  Of the statements of
a block those that parse stand as their renamed syntax trees, neighbours as one run; one that
doesn't is its first line's tokens, with names replaced, and its own block in the same form.
So two broken programs are alike if they differ only in names of variables and functions, in
blanks, comments and widths of indents.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Callable
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<join>\\\r?\n)|(?P<newline>\r?\n)|(?P<blank>[^\S\n]+)
    |(?P<string>[A-Za-z]{0,2}(?:'{3}(?:[^\\]|\\.)*?(?:'{3}|\Z)|"{3}(?:[^\\]|\\.)*?(?:"{3}|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)))
    |(?P<number>\d(?:[eE][+-]?\d|[\w.])*|\.\d(?:[eE][+-]?\d|\w)*)|(?P<name>[^\W\d]\w*)
    |(?P<operator>\*\*=?|//=?|>>=?|<<=?|[-+*/%&|^@=<>!:]=|->|.)""",
    re.VERBOSE | re.DOTALL,
)
_AHEAD = re.compile(r"(?:[^\S\n]*(?:\#[^\n]*)?\n)*([^\S\n]*)(\w*)")
#: Words that begin a statement and can't stand inside brackets at the start of a line.
_OPENING = frozenset("def class while return import from try with raise del global nonlocal pass break continue assert except finally elif".split())
_FOLLOWING = frozenset("elif else except finally".split())


class Line(NamedTuple):
    """One logical line: its physical lines, the width of its indent, and its (kind, token)s."""

    first: int
    last: int
    indent: int
    tokens: list[tuple[str, str]]


def logical_lines(code: str) -> list[Line]:
    """Logical lines of any text.  A bracket that stays open ends before a line that looks like
    a new statement: by its first word, or because it begins with a word no deeper than the statement
    or deeper after a colon."""
    out: list[Line] = []
    tokens: list[tuple[str, str]] = []
    first = row = depth = 0
    widths = [len(t[: len(t) - len(t.lstrip())].expandtabs()) for t in code.split("\n")]
    for m in _TOKEN.finditer(code + "\n"):
        kind, text = m.lastgroup, m[0]
        if kind == "newline":
            ahead = _AHEAD.match(code, m.end())
            width = len(ahead[1].expandtabs()) if ahead else 0
            opens = ahead and (ahead[2] in _OPENING or ahead[2] and width <= widths[first] or tokens and tokens[-1][1] == ":" and width > widths[first])
            if depth and not opens:
                row += 1
                continue
            if tokens:
                out.append(Line(first, row, widths[first], tokens))
            tokens, depth, row = [], 0, row + 1
        elif kind == "join":
            row += 1
        elif kind not in ("comment", "blank"):
            if not tokens:
                first = row
            tokens.append((kind, text.rstrip()))  # blanks end an open string only
            depth = max(0, depth + (text in "([{") - (text in ")]}")) if kind == "operator" else depth
            row += text.count("\n")
    return [*out, Line(first, len(widths) - 1, widths[first], tokens)] if tokens else out


def normal_form(code: str, rename: ast.NodeTransformer, variable: Callable[[str], str], function: Callable[[str], str]) -> list:
    """Nested lists of ["run", tree ...] and ["line", token ..., block]."""
    lines, source = logical_lines(code), code.split("\n")

    def tree(lo: int, hi: int) -> list[ast.stmt] | None:
        text = "\n".join(source[lines[lo].first : lines[hi - 1].last + 1])
        try:
            return ast.parse(f"if 1:\n{text}").body[0].body if lines[lo].indent else ast.parse(text).body
        except (SyntaxError, ValueError, MemoryError):
            return None

    def named(tokens: list[tuple[str, str]]) -> list[str]:
        """Tokens with names replaced, but for attributes, classes, imports and keywords of calls."""
        out: list[str] = []
        calls: list[bool] = []  # of each open bracket whether it follows what can be called
        head = tokens[0][1]
        for i, (kind, text) in enumerate(tokens):
            before, after = tokens[i - 1][1] if i else "", tokens[i + 1][1] if i + 1 < len(tokens) else ""
            if kind == "operator" and text in "([{":
                calls.append(text == "(" and i > 0 and (tokens[i - 1][0] == "name" and not keyword.iskeyword(before) or before in ")]"))
            elif kind == "operator" and text in ")]}" and calls:
                calls.pop()
            elif kind == "name" and not keyword.iskeyword(text) and before not in (".", "class") and head not in ("import", "from"):
                named = calls and calls[-1] and after == "=" and before in "(," and head not in ("def", "async")
                text = function(text) if before == "def" else text if named else variable(text)
            out.append(text)
        return out

    def statements(lo: int, hi: int) -> list[list[int]]:
        """Bounds of the statements of a block; one with its decorators and further clauses is a list of more."""
        out: list[list[int]] = []
        while lo < hi:
            end = lo + 1
            while end < hi and lines[end].indent > lines[lo].indent:
                end += 1
            decorated = bool(out) and lines[out[-1][-2]].tokens[0][1] == "@"
            if out and (decorated or lines[lo].tokens[0][1] in _FOLLOWING):
                out[-1].append(end)
            else:
                out.append([lo, end])
            lo = end
        return out

    def block(lo: int, hi: int) -> list:
        out: list = []

        def add(found: list[ast.stmt]) -> None:
            if not out or out[-1][0] != "run":
                out.append(["run"])
            out[-1].extend(ast.dump(rename.visit(node)) for node in found)

        for bounds in statements(lo, hi):
            if (found := tree(bounds[0], bounds[-1])) is not None:
                add(found)
                continue
            for a, b in zip(bounds[:-1], bounds[1:]):
                if len(bounds) > 2 and (found := tree(a, b)) is not None:
                    add(found)
                else:
                    out.append(["line", *named(lines[a].tokens), block(a + 1, b)])
        return out

    return block(0, len(lines))
