"""Ignore patterns in gitignore syntax, compiled once to regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_GLOB = re.compile(r"\\(.)|(\*\*/)|(/\*\*$)|(\*+)|(\?)|(\[!?\]?[^\]]*\])|(.)", re.S)


def _body(glob: str) -> str:
    def piece(m: re.Match) -> str:
        quoted, any_dirs, any_below, star, one, chars, plain = m.groups()
        if any_dirs:
            return "(?:[^/]+/)*"
        if any_below:
            return "/.+"
        if star:
            return "[^/]*"
        if one:
            return "[^/]"
        if chars:
            return "[^" + chars[2:] if chars.startswith("[!") else chars
        return re.escape(quoted or plain)

    return _GLOB.sub(piece, glob)


def compile_patterns(patterns: Iterable[str]) -> list[tuple[bool, str]]:
    """(ignores, regex on the relative path) in order; blank lines and comments vanish.

    A pattern with a slash before its end is anchored; one that ends in a slash fits
    directories only; what fits a directory fits all below it.
    """
    out = []
    for line in patterns:
        glob = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n\r"))
        if not glob or glob.startswith("#"):
            continue
        ignores = not glob.startswith("!")
        glob = glob if ignores else glob[1:]
        below_only = glob.endswith("/")
        glob = glob.rstrip("/") if below_only else glob
        anchored = "/" in glob
        head = "^" if anchored else "^(?:.*/)?"
        out.append((ignores, head + _body(glob.lstrip("/")) + ("/.+$" if below_only else "(?:/.*)?$")))
    return out


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """True where the last pattern that fits the relative path ignores it."""
    return reduce(lambda so_far, rule: F.when(path.rlike(rule[1]), F.lit(rule[0])).otherwise(so_far), compile_patterns(patterns), F.lit(False))


def is_ignored(path: str, patterns: Iterable[str]) -> bool:
    out = False
    for ignores, regex in compile_patterns(patterns):
        if re.match(regex, path):
            out = ignores
    return out


def watched(path: Column, index_dirs: Iterable[str], patterns: Iterable[str]) -> Column:
    """True for a relative path under an index directory that no pattern ignores."""
    under = reduce(lambda a, d: a | (path == d) | F.startswith(path, F.lit(f"{d}/")), index_dirs, F.lit(False))
    return under & ~F.startswith(path, F.lit("../")) & ~ignored(path, patterns)
