"""Secret scans: assignment-aware lexing of source and configuration text.

A lexer reads name-literal pairs: assignments and mappings of source text (with triple-quoted
and adjacent literals, subscripts and call arguments), lines like those of .env, INI,
properties and YAML files, whose values need no quotes, and elements and attributes of XML.
Constants are carried to the names that they reach, also from places further on, and
each literal is scored by how sensitive its target names are.
Three base patterns (assign, access, hex) are always reported as well.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, quoted

#: The base patterns, and the least length that each match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "named")
_ASSIGN_STEMS = ("passw", "secret", "token", "api")

#: Sensitivity of a name by the words in it.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 0.9, "secretkey": 1.0, "authkey": 0.9,
    "bearer": 0.7, "signingkey": 0.9, "encryptionkey": 0.9, "clientsecret": 1.0,
}
_STEMS = ("passw", "pwd", "passphrase", "secret", "token", "key", "credential", "bearer")
#: Values that stand for a secret without being one.
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%.*%|\{\{.*\}\}|changeme|example|placeholder|none|null|true|false|todo|redacted)$")
THRESHOLD = 0.5

#: A name; it is taken whole and begins where no other does, so that a run of names is looked at once.
_NAME = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_.-]{0,127}+"
_QUOTED = r'''"""(?:[^"\\]++|\\.|"(?!""))*+"""|\'\'\'(?:[^'\\]++|\\.|'(?!''))*+\'\'\'|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`'''
_STRING = rf"(?:[bBrRuUfF@$]{{1,2}}(?=[\"'])|@)?(?:{_QUOTED})"
_MORE = rf"(?:[\x20\t]*\+[\x20\t]*(?:{_STRING}|{_NAME})|[\x20\t]*(?:\\?\r?\n[\x20\t]*)?(?:{_STRING})(?![\x20\t]*[:=]))*"
_PAIR = re.compile(rf"""(?s)(?P<q>["']?)(?P<name>{_NAME})(?P=q)\]?(?:\s?:\s?[A-Za-z][A-Za-z<>\[\]]{{0,40}}(?=\s*=))?[\x20\t]*(?::=|=>|=(?!=)|:(?![:/]))[\x20\t]*(?:\((?=[\x20\t]*[\r\n]*[\x20\t]*["'])\s*)?(?P<value>(?:{_STRING}|{_NAME}){_MORE})""")
_ATOM = re.compile(rf"(?s)(?P<string>{_STRING})|(?P<name>{_NAME})")
#: An assignment of something that is neither a literal nor a name: the target no longer holds what it held.
_OTHER = re.compile(rf"(?m)(?P<name>{_NAME})[\x20\t]*=(?![=>~])[\x20\t]*(?=[^\s\"'`A-Za-z_@])")
#: Literals of which one is taken: those of a list, of a choice by a condition, and the one that stands in for a missing value.
_LIST = re.compile(rf"""(?s)(?P<q>["']?)(?P<name>{_NAME})(?P=q)[\x20\t]*(?::=|=>|=(?!=)|:(?![:/]))[\x20\t]*(?P<value>[\[({{][\s]*+(?:{_STRING})[\s]*+(?:,[\s]*+(?:{_STRING})[\s]*+)*+,?[\s]*+[\])}}])""")
_CHOICE = re.compile(rf"""(?P<name>{_NAME})[\x20\t]*(?::=|=(?!=)|:(?![:/]))[\x20\t]*(?P<value>[^\s"'`=;?|][^"'`\n;?|]{{0,120}}+\?[\x20\t]*(?:{_STRING})[\x20\t]*:[\x20\t]*(?:{_STRING}))""")
_DEFAULT = re.compile(rf"""(?m)(?P<name>{_NAME})[\x20\t]*(?::=|=(?!=))[\x20\t]*[^\s"'`=;][^\n;=]{{0,160}}?(?:\?\?|\|\||\bor\b)[\x20\t]*(?P<value>{_STRING})[\x20\t]*[;,)]?[\x20\t]*\r?$""")
_EITHER = re.compile(rf"""(?P<name>{_NAME})[\x20\t]*=(?!=)[\x20\t]*(?P<value>(?:{_STRING})[\x20\t]+if\b[^"'`\n]{{1,120}}?\belse[\x20\t]+(?:{_STRING}))""")
#: Calls: a setter's only argument, and a name given as a literal with the literal given to it.
_SETTER = re.compile(rf"(?s)\b(?P<name>(?:set|with|use|update|change|assign)_?(?-i:[A-Za-z0-9_]{{2,60}}))\([\x20\t]*(?P<value>{_STRING})[\x20\t]*\)")
_GIVEN = re.compile(rf"""(?s)[A-Za-z0-9_\])]\([\x20\t]*(?P<q>["'])(?P<name>{_NAME})(?P=q)[\x20\t]*,[\x20\t]*(?P<value>{_STRING})[\x20\t]*[,)]""")
#: XML: an element's text; a tag that gives a name in one attribute and its value in another.
_ELEMENT = re.compile(rf"<(?P<name>{_NAME})(?:\s[^<>]{{0,400}})?>\s*(?:<!\[CDATA\[)?(?P<value>[^<>\s]{{1,4096}}?)(?:\]\]>)?\s*</(?P=name)\s*>")
_TAG = re.compile(rf"""<{_NAME}\s(?=[^<>]{{0,400}}?\b(?:key|name|id)\s*=\s*(?P<q>["'])(?P<name>{_NAME})(?P=q))[^<>]{{0,400}}?\bvalue\s*=\s*(?P<r>["'])(?P<value>[^"'<>]{{1,4096}})(?P=r)""", re.I)
#: YAML: one line in a block of its own under a name.
_BLOCK = re.compile(rf"""(?m)^(?P<in>[\x20]*)(?:-[\x20]+)?(?P<q>["']?)(?P<name>{_NAME})(?P=q):[\x20\t]*[|>][+-]?[0-9]?[\x20\t]*\r?\n(?P=in)[\x20]+(?P<value>[^\s#][^\s]*)[\x20\t]*\r?$""")
#: A configuration line and its unquoted value, to the end of the line or a comment.
_BARE = re.compile(rf"""(?m)^[\x20\t]*(?:\[[^\]\r\n]{{1,80}}\][\x20\t]*)?(?:-[\x20\t]+|(?:export|set|setx|env|ENV|ARG)[\x20\t]+)?(?P<q>["']?)(?P<name>{_NAME})(?P=q)(?P<gap>[\x20\t]*)(?:(?P<is>=)(?![=>~])|:(?![:/=])(?![\x20\t]*[&*!|>%@\[{{]))(?P<after>[\x20\t]*)(?P<value>[^\s"'`#](?:[^\r\n\x20\t]|[\x20\t]+(?![\x20\t\r\n#;]|//|\Z))*)""")
_CALL = re.compile(r"[A-Za-z_$][\w.$]*(?:\([^()]*\)|\[[^\[\]]*\])[\w.$]*;?")
_QUOTED_LIST = re.compile(r"[\[({]\s*[\"'`]")
#: A path of plain words stands where a name says more than it holds (PWD).
_PATH = re.compile(r"(?:~|\.{1,2}|[A-Za-z]:)?(?:[/\\][a-z][a-z0-9._-]{0,40}){1,30}[/\\]?")
_REFERENCE = re.compile(rf"(\$?)(?:\{{({_NAME})\}}|({_NAME}))")
#: Signs that a text is a program, where an unquoted name is a reference and brackets are calls.
_CODE = re.compile(r"(?m)[;{(][\x20\t]*\r?$|^[\x20\t]*(?:def|class|func|fn|function|public|private|static|const|let|var|import|package|return)[\x20\t]+\S|^#include\b")
#: Words of schemas and switches that stand where a value would.
_WORD = re.compile(r"(?i)^(?:string|number|boolean|integer|object|binary|secretstr|required|optional|enabled|disabled|default|unknown|undefined|expired|invalid)[!?,;]?$")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


Part = tuple[int, int, str]  # start, end and value of a literal


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the literal) of the three base patterns, in order."""
    low, found = text.lower(), []
    if any(stem in low for stem in _ASSIGN_STEMS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


@functools.lru_cache(1 << 14)
def sensitivity(name: str) -> float:
    """0 to 1: how much a name promises a secret, by its words and pairs of words."""
    words = [w.lower() for part in re.split(r"[_.\-]", name) for w in _HUMPS.findall(part)]
    pairs = [a + b for a, b in zip(words, words[1:])]
    return max((WEIGHTS.get(w, 0.0) for w in (*words, *pairs)), default=0.0)


#: Characters of a value that is kept as such; a longer one is known by its sums and its ends.
_SHORT = 64


class Value:
    """A literal, or joined values: what its score needs, and where its literals lie.

    Values share what they are joined from, so a value that is used again and again costs its
    sums alone.  Characters beyond ASCII are counted in 128 classes, which bounds the sums.
    """

    __slots__ = ("counts", "head", "lines", "parts", "short", "size", "spaces", "tail")

    def __init__(self, parts: tuple[Value, Value] | tuple[int, int], size: int, counts: dict[int, int], spaces: int, lines: bool, head: str, tail: str, short: str | None):
        self.parts, self.size, self.counts, self.spaces, self.lines = parts, size, counts, spaces, lines
        self.head, self.tail, self.short = head, tail, short

    @classmethod
    def literal(cls, part: Part) -> Value:
        start, end, text = part
        counts: dict[int, int] = {}
        for c, n in Counter(text).items():
            kind = ord(c) if c < "\x80" else 128 | ord(c) & 127
            counts[kind] = counts.get(kind, 0) + n
        return cls((start, end), len(text), counts, sum(map(str.isspace, text)), "\n" in text, text[:2], text[-2:], text if len(text) <= _SHORT else None)

    def __add__(self, other: Value) -> Value:
        more, less = (self, other) if len(self.counts) >= len(other.counts) else (other, self)
        counts = more.counts.copy()
        for c, n in less.counts.items():
            counts[c] = counts.get(c, 0) + n
        short = self.short + other.short if self.short is not None and other.short is not None and self.size + other.size <= _SHORT else None
        return Value((self, other), self.size + other.size, counts, min(self.spaces + other.spaces, 2), self.lines or other.lines,
                     (self.head + other.head)[:2], (self.tail + other.tail)[-2:], short)

    def score(self) -> float:
        """0 to 1: how much a literal looks like a secret; placeholders, paths, prose and short values score 0."""
        if self.size < 6 or self.spaces > 1:
            return 0.0
        if self.short is not None:
            if _PLACEHOLDER.match(self.short) or _PATH.fullmatch(self.short):
                return 0.0
        elif not self.lines and any(self.head.startswith(a) and self.tail.endswith(b) for a, b in (("<", ">"), ("${", "}"), ("%", "%"), ("{{", "}}"))):
            return 0.0
        return min(1.0, 0.3 - sum((r := c / self.size) * math.log2(r) for c in self.counts.values() if c) / 5)

    def spans(self, told: set[int], held: list[Value]) -> list[tuple[int, int]]:
        """The places of its literals that weren't told before; ``held`` keeps what ``told`` names."""
        out, open_ = [], [self]
        while open_:
            v = open_.pop()
            if id(v) in told:
                continue
            told.add(id(v))
            held.append(v)
            if isinstance(v.parts[0], Value):
                open_ += v.parts
            else:
                out.append(v.parts)
        return out


def literal_score(value: str) -> float:
    """The score of a single literal."""
    return Value.literal((0, len(value), value)).score()


def bare_values(text: str) -> dict[int, tuple[str, tuple[int, int, str]]]:
    """By the place of the target name: the name, and its unquoted value as a literal (start, end, value)."""
    out, code = {}, _CODE.search(text) is not None
    for m in _BARE.finditer(text):
        name, value = m["name"], m["value"]
        if not m["is"] and re.search(r"\s", value) or _WORD.match(value) or _CALL.fullmatch(value) or _QUOTED_LIST.match(value):
            continue  # a colon and some words are prose
        shell = m["is"] and not m["gap"] and not m["after"] and name.isupper()
        if code and not shell and (_REFERENCE.fullmatch(value) or re.search(r"[()\[\]{}\s]|[;,]$", value)):
            continue
        out[m.start("name")] = name, (m.start("value"), m.end("value"), value)
    return out


def _literal(at: int, raw: str) -> Part:
    """The inside of a quoted literal that begins at ``at``."""
    lead = len(raw) - len(raw.lstrip("bBrRuUfF@$"))
    skip = 3 if raw[lead:lead + 3] in ('"""', "\'\'\'") and len(raw) >= lead + 6 else 1
    return at + lead + skip, at + len(raw) - skip, raw[lead + skip:len(raw) - skip]


def lex_pairs(text: str) -> list[tuple[str, list[Part | str], list[Part]]]:
    """Per assignment, in order: target name, literals and names on its right side, and its unquoted value if it may have one."""
    out, bare = {}, bare_values(text)
    for m in _PAIR.finditer(text):
        at = m.start("value")
        right = [_literal(at + x.start(), x["string"]) if x["string"] else x["name"] for x in _ATOM.finditer(m["value"])]
        _, value = bare.pop(m.start("name"), (None, None))
        out[m.start("name")] = m["name"], right, [value] if value and all(isinstance(x, str) for x in right) else []
    for place, (name, value) in bare.items():
        reference = _REFERENCE.fullmatch(value[2])
        variable = reference and reference[1] and reference[0].isupper()
        out[place] = name, [reference[2] or reference[3]] if reference else [], [] if variable else [value]
    for pattern in (_SETTER, _GIVEN):
        for m in pattern.finditer(text):
            out.setdefault(m.start("name"), (m["name"], [_literal(m.start("value"), m["value"])], []))
    if "<" in text:
        for pattern in (_ELEMENT, _TAG):
            for m in pattern.finditer(text):
                out[m.start("name")] = m["name"], [(m.start("value"), m.end("value"), m["value"])], []
    for m in _BLOCK.finditer(text):
        out[m.start("name")] = m["name"], [(m.start("value"), m.end("value"), m["value"])], []
    for m in _OTHER.finditer(text):
        out.setdefault(m.start("name"), (m["name"], [], []))
    pairs = [(k, out[k]) for k in sorted(out)]
    for pattern in (_LIST, _CHOICE, _EITHER, _DEFAULT):  # each literal is one value that the name may have
        for m in pattern.finditer(text):
            at = m.start("value")
            pairs += [(m.start("name"), (m["name"], [_literal(at + x.start(), x["string"])], [])) for x in _ATOM.finditer(m["value"]) if x["string"]]
    return [pair for _, pair in sorted(pairs, key=lambda p: p[0])]


def named_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants.

    A name stands for what it was given last; a name that was given nothing yet, for what it is
    given first further on.  Literals that are joined are scored together.
    """
    low = text.lower()
    if not any(stem in low for stem in _STEMS):
        return []
    pairs = lex_pairs(text)
    later: dict[str, int] = {}
    for k in range(len(pairs) - 1, -1, -1):
        if pairs[k][1] or pairs[k][2]:
            later[pairs[k][0]] = k
    known: dict[str, list[Value]] = {}
    ahead: dict[int, list[Value]] = {}
    literals: dict[tuple[int, int], Value] = {}

    def literal(part: Part) -> Value:
        if part[:2] not in literals:
            literals[part[:2]] = Value.literal(part)
        return literals[part[:2]]

    def value_of(k: int) -> list[Value]:
        """What the right side of pair ``k`` may be."""
        _, right, bare = pairs[k]
        joined: Value | None = None
        for x in right:
            values = [literal(x)] if not isinstance(x, str) else known[x] if x in known else ahead.get(later.get(x, -1), [])
            for v in values:
                joined = v if joined is None else joined + v
        out = [joined] if joined is not None else []
        if bare and not (out and (len(right) > 1 or _REFERENCE.fullmatch(bare[0][2]))):
            out.append(literal(bare[0]))  # not the name of a constant, nor a sum with one
        return out

    def look_ahead(k: int) -> None:
        """Values of the names on the right side of ``k`` that are given nothing before, each worked out once; a circle adds nothing."""
        open_, path = [k], set()
        while open_:
            at = open_[-1]
            if at not in path:
                path.add(at)
                open_ += {later[x] for x in pairs[at][1] if isinstance(x, str) and x not in known and later.get(x, -1) > k} - path - ahead.keys()
                continue
            open_.pop()
            if at != k and at not in ahead:
                ahead[at] = value_of(at)

    found: set[tuple[int, int]] = set()
    told: set[int] = set()
    held: list[Value] = []
    for k, (name, right, _) in enumerate(pairs):
        if any(isinstance(x, str) and x not in known for x in right):
            look_ahead(k)
        known[name] = values = value_of(k)
        weight = sensitivity(name)
        if weight:
            for v in values:
                if weight * v.score() >= threshold:
                    found.update(v.spans(told, held))
    return sorted(found)


def scan(text: str | None) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """(base spans, all spans) of a whole text; a named literal inside a base span isn't told again."""
    if not text:
        return [], []
    base = base_spans(text)
    extra, k, reach = [], 0, -1
    for s, e in named_spans(text):
        while k < len(base) and base[k][0] <= s:
            reach, k = max(reach, base[k][2]), k + 1
        if e > reach:
            extra.append((s, 3, e, s))
    return base, sorted(base + extra)


def tell(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def redact(text: str | None, mask: str = "[REDACTED]") -> str | None:
    """The text with every found secret replaced; names stay, overlapping spans merge."""
    spans = sorted((lit, e) for _, _, e, lit in scan(text)[1])
    if not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base digest and all spans of every whole text.

    Null and empty texts have no spans; repeated rows are each scanned; spans that start
    together are told in the order of their kinds; texts of any length are scanned whole; an
    empty table gives an empty one; other columns are ignored, whatever their names.
    """
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for text in batch.column(batch.schema.get_field_index("text")):
            base, every = scan(text.as_py())
            n = Counter(k for _, k, _, _ in base)
            rows.append((n[0], n[1], n[2], hashlib.sha256(tell(base).encode()).hexdigest(), tell(every)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    return map_texts(docs.select("doc_id", "text"), run, fields, keep=["doc_id"])


def redact_documents(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with secrets masked in ``text`` and, where the column exists, n_chars made to agree."""
    columns, sized = docs.columns, "n_chars" in docs.columns
    fields = [T.StructField("text", T.StringType())] + ([T.StructField("n_chars", T.LongType())] if sized else [])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        before = batch.column(batch.schema.get_field_index("text")).to_pylist()
        after = [redact(t, mask) for t in before]
        out = [pa.array(after, pa.string())]
        if sized:
            old = batch.column(batch.schema.get_field_index("n_chars")).to_pylist()
            out.append(pa.array([n if a == b else len(a) for a, b, n in zip(after, before, old, strict=True)], pa.int64()))
        return out

    return map_texts(docs, run, fields).select(*quoted(columns))
