"""Byte-pair encoding and decoding with a contiguous rank array.

Each word keeps its parts and the merge ranks of adjacent parts in two flat lists: the
smallest rank is found by a scan, one boundary is deleted, and the two neighbouring ranks
are refreshed.  Words beyond ``SHORT`` parts use a heap instead, with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Longest word, in parts, for the scanned array.
SHORT = 128
#: Words, and texts between spaces, that a generation remembers; a task remembers two, the one that fills and the one before.
CACHE_WORDS = 100_000
#: Control characters at which Python's own split parts and the tokenizer doesn't.
_NO_SPACE = re.compile(r"[\x1c-\x1f]")
_NEVER = 1 << 30
#: White space of the tokenizer's patterns; what this encoder reads of a file besides vocabulary, merges and special
#: tokens, as the file must state it (the pattern itself is taken from the file; its words hold no white space).
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The version of Unicode that the tables below complete.
UNICODE = "15.1.0"
_PLAIN = ("unk_token", "continuing_subword_prefix", "dropout")
#: Where the tokenizer library's Unicode tables are ahead of Python's 15.1.  Its letters and numbers are those of
#: version 16, its lower case is that of version 17 (code points, the last of a range, lower case of the first), and its
#: composition is that of an old version, to which the marks below are no marks: nothing composes or moves across them.
_LETTERS_16 = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
_NUMBERS_16 = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
_LOWER_17 = "1c89:1c8a a7cb:264 a7cc:a7cd a7ce:a7cf a7d2:a7d3 a7d4:a7d5 a7da:a7db a7dc:19b 10d50-10d65:10d70 16ea0-16eb8:16ebb"
_NO_MARKS = "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e 11839-1183a 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef 11930"


def _ranges(told: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (x.partition("-") for x in told.split())]


def _lower_table() -> dict[int, int]:
    out = {}
    for x in _LOWER_17.split():
        run, _, low = x.partition(":")
        for a, b in _ranges(run):
            out |= {c: int(low, 16) + c - a for c in range(a, b + 1)}
    return out


@lru_cache(1)
def unicode_classes() -> dict[str, str]:
    r"""The inside of the classes \p{L}, \p{N} and \s, as the tokenizer library has them; an error under a Python that knows other characters."""
    if unicodedata.unidata_version != UNICODE:
        raise RuntimeError(f"the tables here complete Unicode {UNICODE}, but this Python has {unicodedata.unidata_version}")
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in ranges:
            run = ranges[kind]
            if run and run[-1][1] == c - 1:
                run[-1][1] = c
            else:
                run.append([c, c])
    every = {"L": ranges["L"] + _ranges(_LETTERS_16), "N": ranges["N"] + _ranges(_NUMBERS_16)}
    inside = {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in sorted(map(tuple, run))) for k, run in every.items()}
    return {r"\p{L}": inside["L"], r"\p{N}": inside["N"], r"\s": _SPACE}


def word_pattern(data: dict) -> re.Pattern:
    """The pattern of a tokenizer file's words; a file that asks for anything else than is done here is refused."""
    steps = (data.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    split, model = steps[0], data["model"]
    told = {"normalizer": data.get("normalizer") == _NORMALIZER, "pre_tokenizer": len(steps) == 2 and steps[1] == _BYTE_LEVEL
            and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True) and "Regex" in split.get("pattern", {}),
            "decoder": data.get("decoder") is None, "post_processor": data.get("post_processor") is None,
            "model": model.get("type") == "BPE" and not any(model.get(k) for k in (*_PLAIN, "byte_fallback", "ignore_merges")),
            "added_tokens": not any(t.get(k) for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))}
    if wrong := [k for k, ok in told.items() if not ok]:
        raise ValueError(f"the tokenizer file's {', '.join(wrong)} can't be followed")
    pattern = split["pattern"]["Regex"]
    for name, inside in unicode_classes().items():
        pattern = pattern.replace(name, inside)
    return re.compile(pattern)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe(dict):
    """An encoder and decoder for word-end BPE files; as a dict it remembers texts between spaces, and the words in them.

    Maps such a text or word, normalised, to (ids as little-endian uint32, decoded text).
    """

    def __init__(self, spec: str):
        super().__init__()
        self.before: dict[str, tuple[bytes, str]] = {}
        data = json.loads(spec)
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        letters = _byte_letters()
        self.inner = [self.vocab.get(c, -1) for c in letters]
        self.final = [self.vocab.get(c + self.suffix, -1) for c in letters]
        self.words = word_pattern(data)
        self.lower = _lower_table()
        marks = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges(_NO_MARKS))
        self.barrier = re.compile(f"([{marks}])")
        self.far = re.compile("[\u07fd-\U0010ffff]")  # one range is tested fast
        self.newer = re.compile(f"[{marks}{''.join(map(chr, self.lower))}]")
        self.split = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    # -- one word ---------------------------------------------------------------------

    def _start(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return [i for i in ids if i >= 0]

    def word_ids(self, word: str) -> list[int]:
        """Token ids of one normalised word."""
        parts = self._start(word)
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        get, none = self.merges.get, (_NEVER, -1)
        ranks = [get(p, none)[0] for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            i = ranks.index(low)
            parts[i] = get((parts[i], parts[i + 1]))[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)[0]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)[0]
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        get, n = self.merges.get, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = get((a, b))[1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := get((parts[x], parts[y]))):
                    heapq.heappush(heap, (m[0], x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def _keep(self, text: str, value: tuple[bytes, str]) -> tuple[bytes, str]:
        if len(text) <= SHORT:
            if len(self) >= CACHE_WORDS:
                self.before = dict(self)
                self.clear()
            self[text] = value
        return value

    def forget(self) -> None:
        """Remember no word any more: a worker that has nothing to do shares its executor's memory with others."""
        self.clear()
        self.before = {}

    def _word(self, word: str) -> tuple[bytes, str]:
        if known := self.before.get(word):
            return self._keep(word, known)
        ids = self.word_ids(word)
        return self._keep(word, (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)))

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        if known := self.before.get(chunk):
            return self._keep(chunk, known)
        words = self.words.findall(chunk)
        if len(words) == 1:
            return self.get(words[0]) or self._word(words[0]) if words[0] != chunk else self._word(chunk)
        pairs = [p for w in words if (p := self.get(w) or self._word(w))[0]]
        return self._keep(chunk, (b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])))

    # -- whole texts --------------------------------------------------------------------

    def _normal(self, text: str) -> str:
        if self.far.search(text) and self.newer.search(text):
            text = "".join(x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(self.barrier.split(text)))
            return "".join(c.lower() for c in text.translate(self.lower))
        text = unicodedata.normalize("NFC", text)
        # lower-cased character by character: a sigma at a word's end stays an inner sigma
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def encode_both(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian uint32, decoded text) of a whole text; empty for null."""
        if not text:
            return b"", ""
        get, ids, said, at = self.__getitem__, [], [], 0
        marks = [*self.split.finditer(text)] if self.split else []
        for mark in [*marks, None]:
            piece = text[at:mark.start() if mark else len(text)]
            piece = self._normal(piece)  # no word holds a space
            pairs = list(map(get, piece.split())) if not _NO_SPACE.search(piece) else [self.__missing__(piece)]
            ids += [p[0] for p in pairs]
            said += [p[1] for p in pairs if p[0]]
            if mark:
                ids.append(struct.pack("<I", self.special[mark[0]]))
                said.append(mark[0])
                at = mark.end()
        return b"".join(ids), " ".join(said)

    def encode(self, text: str | None) -> list[int]:
        packed = self.encode_both(text)[0]
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by spaces, as a tokenizer file without a decoder gives; unknown ids vanish."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


@lru_cache(2)
def _loaded(spec: str) -> WordBpe:
    """The model of a file's text; it stays in the worker, the words it remembers go with the task."""
    return WordBpe(spec)


def encode_documents(docs: DataFrame, spec_path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; optionally the ids.

    The file is read on the driver and broadcast (a few MB, fixed by the vocabulary).  A null
    or empty text has no tokens and the digests of nothing; rows and ids repeat as they come;
    texts of any length are encoded whole; an empty table gives an empty one; other columns
    are ignored, whatever their names.
    """
    with open(spec_path, encoding="utf-8") as f:
        text = f.read()
    word_pattern(json.loads(text))
    spec = docs.sparkSession.sparkContext.broadcast(text)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        model, n, ids_hash, text_hash, ids = _loaded(spec.value), [], [], [], []
        for text in batch.column(batch.schema.get_field_index("text")):
            packed, said = model.encode_both(text.as_py())
            n.append(len(packed) // 4)
            ids_hash.append(hashlib.sha256(packed).hexdigest())
            text_hash.append(hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest())
            ids.append(packed)
        out = [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
        if with_ids:
            flat = pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(ids))])
            ends = pa.array([0, *n], pa.int64()).to_numpy().cumsum().astype("int32")
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
        return out

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return map_texts(docs.select("doc_id", "text"), run, fields, keep=["doc_id"], after=lambda: _loaded(spec.value).forget())
