"""Top-level declarations of TypeScript and JavaScript, without a compiler.

A single pass tells code from strings, templates, regular expressions and comments, keeps
the nesting depth, and splits the text into top-level statements.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_OPEN, _CLOSE = "([{", ")]}"
_WORD = re.compile(r"[A-Za-z0-9_$]+")
#: After these words a slash begins a regular expression and a line can't end.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof await yield default extends".split())
_MODIFIERS = r"(?:@[\w.]+(?:\([^)]*\))?\s*|export\s+|default\s+|declare\s+|abstract\s+|async\s+)*"
_KINDS = (
    ("function", re.compile(_MODIFIERS + r"function\b\s*\*?\s*(?P<name>[\w$]+)?")),
    ("class", re.compile(_MODIFIERS + r"class\b(?:\s+(?!extends\b|implements\b)(?P<name>[\w$]+))?")),
    ("interface", re.compile(_MODIFIERS + r"interface\s+(?P<name>[\w$]+)")),
    ("type", re.compile(_MODIFIERS + r"type\s+(?P<name>[\w$]+)\s*(?:<|=)")),
    ("variable", re.compile(_MODIFIERS + r"(?:const(?!\s+enum\b)|let|var)\s+(?P<name>[\w$]+|\{[^}]*\}|\[[^\]]*\])")),
)
_EXPORTED = re.compile(r"(?:@[\w.]+(?:\([^)]*\))?\s*)*export\b")


class Unbalanced(ValueError):
    """Brackets, strings or comments that don't close."""


@dataclass(frozen=True)
class Declaration:
    kind: str
    name: str
    start: int  # 1-based line of the declaration itself
    end: int
    text: str  # with the comments before it
    exported: bool


def _skip_string(s: str, i: int) -> int:
    quote, i = s[i], i + 1
    while i < len(s):
        if s[i] == "\\":
            i += 2
            continue
        if s[i] == quote:
            return i + 1
        if s[i] == "\n":
            raise Unbalanced("string")
        i += 1
    raise Unbalanced("string")


def _skip_template(s: str, i: int) -> int:
    i += 1
    while i < len(s):
        if s[i] == "\\":
            i += 2
        elif s[i] == "`":
            return i + 1
        elif s.startswith("${", i):
            i = _skip_code(s, i + 2, "}")
        else:
            i += 1
    raise Unbalanced("template")


def _skip_regex(s: str, i: int) -> int:
    i, in_class = i + 1, False
    while i < len(s) and s[i] != "\n":
        if s[i] == "\\":
            i += 1
        elif s[i] == "[":
            in_class = True
        elif s[i] == "]":
            in_class = False
        elif s[i] == "/" and not in_class:
            return i + 1
        i += 1
    raise Unbalanced("regular expression")


def _skip_comment(s: str, i: int) -> int:
    if s.startswith("//", i):
        end = s.find("\n", i)
        return len(s) if end < 0 else end
    end = s.find("*/", i + 2)
    if end < 0:
        raise Unbalanced("comment")
    return end + 2


def _skip_code(s: str, i: int, until: str) -> int:
    """Past the ``until`` that closes the code from ``i``."""
    for kind, start, end in _lex(s, i):
        if kind == "close" and start < 0:
            return end
    raise Unbalanced(until)


def _lex(s: str, i: int = 0):
    """(kind, depth or start, end) of words, punctuation, brackets and gaps from ``i``."""
    depth, last, n = 0, "", len(s)
    while i < n:
        c = s[i]
        if c.isspace():
            yield ("line" if c == "\n" else "space"), depth, i + 1
            i += 1
            continue
        if s.startswith(("//", "/*"), i):
            i = _skip_comment(s, i)
            yield "comment", depth, i
            continue
        if c in "\"'":
            i, last = _skip_string(s, i), "value"
        elif c == "`":
            i, last = _skip_template(s, i), "value"
        elif c == "/" and (last in ("", "punct") or last in _BEFORE_VALUE):
            i, last = _skip_regex(s, i), "value"
        elif m := _WORD.match(s, i):
            i, last = m.end(), m[0] if m[0] in _BEFORE_VALUE else "value"
        elif c in _OPEN:
            depth, i, last = depth + 1, i + 1, "punct"
            yield "open", depth, i
            continue
        elif c in _CLOSE:
            depth, i, last = depth - 1, i + 1, "value"
            yield "close", depth, i
            if depth < 0:
                return
            continue
        else:
            i, last = i + 1, "punct"
        yield "token", depth, i


def _statements(s: str):
    """(begin with leading comments, begin, end) of top-level statements."""
    lead = begin = None
    end, at, previous, closed_block = 0, 0, "", False
    bracket: list[str] = []
    for kind, depth, stop in _lex(s):
        piece = s[at:stop]
        if depth < 0:
            raise Unbalanced("bracket")
        if kind == "open":
            bracket.append(piece)
        if kind == "close":
            if not bracket or _OPEN.index(bracket.pop()) != _CLOSE.index(piece):
                raise Unbalanced("bracket")
        if kind in ("space", "line", "comment"):
            at = stop
            continue
        gap = s[end:at]
        if begin is not None and depth == (1 if kind == "open" else 0) and previous not in ("open", ",") and (
                piece not in ".,;?:=+-*/%&|<>!^)]}([" or closed_block) and "\n" in gap and _ends(s[begin:end], closed_block, s[at:at + 40]):
            yield lead, begin, end
            begin = None
        if begin is None:
            lead, begin = end, at
        end, previous = stop, piece if piece == "," else kind
        closed_block = kind == "close" and depth == 0 and piece == "}"
        if depth == 0 and piece == ";":
            yield lead, begin, end
            begin = None
        at = stop
    if bracket:
        raise Unbalanced("bracket")
    if begin is not None:
        yield lead, begin, end


_CONTINUES = re.compile(r"(?:=>|[=+\-*/%&|<>?:^~!,.(]|\b(?:extends|implements|const|let|var|type|interface|class|function|export|default|async|declare|abstract|return|from|import|as|keyof|typeof|new))$")
_GOES_ON = re.compile(r"(?:extends|implements|from|as|satisfies|instanceof|in|of|else|catch|finally|while)\b")
_DECORATOR = re.compile(r"@[\w.]+(?:\([^)]*\))?$")


def _ends(so_far: str, closed_block: bool, follows: str) -> bool:
    """Whether a statement can end at a line break."""
    if _GOES_ON.match(follows) or _DECORATOR.match(so_far.strip()):
        return False
    if closed_block:
        return not follows.startswith((".", "?.", ",", "=>", "&&", "||", "??"))
    return not _CONTINUES.search(so_far.rstrip())


def declarations(source: str) -> list[Declaration]:
    """Top-level functions, classes, interfaces, type aliases and variables, in that order within a line."""
    found: list[Declaration] = []
    for lead, begin, end in _statements(source):
        body = source[begin:end]
        for kind, shape in _KINDS:
            if m := shape.match(body):
                fallback = "variable" if kind == "variable" else "anonymous"
                found.append(Declaration(kind, m["name"] or fallback, source.count("\n", 0, begin) + 1, source.count("\n", 0, end) + 1,
                                         source[lead:end], bool(_EXPORTED.match(body))))
                break
    rank = [k for k, _ in _KINDS]
    return sorted(sorted(found, key=lambda d: rank.index(d.kind)), key=lambda d: d.start)
