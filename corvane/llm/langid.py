"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets x languages) is broadcast.  The texts of a batch become
one sparse matrix (a bucket for each gram, grouped by text); a product with the dense matrix
gathers the rows it touches and sums them by text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, held_out, map_texts, quoted, unused

UNDETERMINED = "und"
#: Code points per scoring slice: bounds memory for very long texts.
SLICE = 1 << 18
#: A closed set of labels is expected: one whose matrix is larger than this is an error, not a model.
MODEL_BYTES = 64 << 20
#: Numbers gathered from the matrix at once.
GATHERED = 1 << 22
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Per code point: the lower-case code point of a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0]) if low else c
    return out


def gram_counts(text: str, bits: int) -> tuple[np.ndarray, int]:
    """Counts of hashed 1- to 3-grams of letters by bucket, and the number of letters.

    Runs of other characters count as one space; n-grams never leave the text.
    """
    total, letters, tail = np.zeros(1 << bits, np.int64), 0, np.array([32], np.uint32)
    shift = np.uint32(32 - bits)
    for at in range(0, len(text), SLICE):
        raw = text[at:at + SLICE].encode("utf-32-le", "surrogatepass")
        low = _letters()[np.frombuffer(raw, np.uint32)]
        is_letter = low > 0
        letters += int(is_letter.sum())
        before = np.concatenate(([tail[-1] != 32], is_letter[:-1]))
        chars = np.where(is_letter, low, np.uint32(32))[is_letter | before]
        if at + SLICE >= len(text) and len(chars) and chars[-1] != 32:
            chars = np.append(chars, np.uint32(32))
        seq = np.concatenate((tail, chars))
        skip = len(tail)  # grams that end in an earlier slice are counted already
        hashed = seq * _MIX[0]
        h1 = hashed[skip:][chars != 32]
        h2 = (hashed[1:] ^ (seq[:-1] * _MIX[1]))[max(skip - 1, 0):]
        h3 = (hashed[2:] ^ (seq[1:-1] * _MIX[1]) ^ (seq[:-2] * _MIX[2]))[max(skip - 2, 0):]
        for salt, h in ((1, h1), (2, h2), (3, h3)):
            h = (h + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)) * _MIX[2]
            h ^= h >> np.uint32(15)
            total += np.bincount((h * _MIX[0]) >> shift, minlength=1 << bits)
        tail = seq[-2:]
    return total, letters


def gram_matrix(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The grams of several texts as rows of a sparse matrix: buckets of the 1-, 2- and 3-gram that end at each character, where each text begins, and letters by text.

    Counted as in ``gram_counts``: the texts stand in one sequence with a space between, which
    ends the text before.  Bucket ``1 << bits`` stands for no gram: a space alone, and the three
    characters around a text's beginning.
    """
    shift, none = np.uint32(32 - bits), 1 << bits
    raw = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _letters()[raw]
    is_letter = low > 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.minimum(edges, len(raw))
    letters = np.diff(np.concatenate(([0], np.cumsum(is_letter, dtype=np.int32)))[first])
    seq = np.full(int(keep.sum()) + 2, 32, np.uint32)
    kept = low[keep]
    seq[1:-1] = np.where(kept > 0, kept, np.uint32(32))
    starts = 1 + np.concatenate(([0], np.cumsum(keep, dtype=np.int32)))[first]
    if is_letter[-1:].any():  # the last text ends with the closing space
        starts[-1] += 1
    starts = np.maximum.accumulate(starts)
    hashed = seq * _MIX[0]
    before = seq * _MIX[1]
    pairs = hashed[1:] ^ before[:-1]
    out = []
    for salt, h in ((1, hashed), (2, np.concatenate(([0], pairs)).astype(np.uint32)), (3, np.concatenate(([0, 0], pairs[1:] ^ (seq[:-2] * _MIX[2]))).astype(np.uint32))):
        h = (h + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)) * _MIX[2]
        h ^= h >> np.uint32(15)
        out.append(((h * _MIX[0]) >> shift).astype(np.int64))
    out[0][seq == 32] = none
    out[2][starts[:-1][letters > 0]] = none
    return out, starts, letters


@dataclass(frozen=True)
class LanguageModel:
    """Languages, buckets and the log-probability matrix; size is buckets x languages x 4 bytes."""

    langs: tuple[str, ...]
    bits: int
    log_prob: np.ndarray
    log_prior: np.ndarray

    def _told(self, log: np.ndarray, letters: int) -> tuple[str, float]:
        if not letters:
            return UNDETERMINED, 0.0
        best = int(np.argmax(log))  # ties go to the first language by name
        return self.langs[best], float(1.0 / np.exp(log - log[best]).sum())

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, posterior); ``und`` with 0.0 for null or letterless text or without a model."""
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        counts, letters = gram_counts(text, self.bits)
        hit = np.flatnonzero(counts)
        return self._told(self.log_prior + counts[hit].astype(np.float64) @ self.log_prob[hit], letters)

    def _product(self, texts: list[str]) -> list[tuple[str, float]]:
        """Each text's row of the sparse matrix times the log-probabilities: rows are gathered by bucket and summed by text."""
        grams, starts, letters = gram_matrix(texts, self.bits)
        dense = np.vstack([self.log_prob, np.zeros((1, len(self.langs)), self.log_prob.dtype)])
        log = np.tile(self.log_prior.astype(np.float64), (len(texts), 1))
        live = np.flatnonzero(letters)
        step = max(1, GATHERED // len(self.langs))
        for s in range(1, len(grams[0]), step):
            e = min(s + step, int(starts[-1]))
            if e <= s:
                break
            sums = dense.take(grams[0][s:e], axis=0).astype(np.float64)
            sums += dense.take(grams[1][s:e], axis=0)
            sums += dense.take(grams[2][s:e], axis=0)
            here = live[np.searchsorted(starts[live], s, side="right") - 1:np.searchsorted(starts[live], e)]
            log[here] += np.add.reduceat(sums, np.maximum(starts[here] - s, 0), axis=0)
        return [self._told(log[k], int(letters[k])) for k in range(len(texts))]

    def score_batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``score`` of many texts: those that fit a slice are scored together, a longer one by itself in slices."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        held: list[int] = []
        size = 0
        for k, text in enumerate([*texts, None]):
            n = len(text) if text and self.langs else 0
            if held and (k == len(texts) or size + n > SLICE):
                for i, got in zip(held, self._product([texts[i] for i in held]), strict=True):
                    out[i] = got
                held, size = [], 0
            if n > SLICE:
                out[k] = self.score(text)
            elif n:
                held.append(k)
                size += n + 1
        return out


def fit(docs: DataFrame, *, docs_per_lang: int = 2000, bits: int = 15, alpha: float = 0.5) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang`` of rows that are not held out.

    The training sample is bounded: the ``docs_per_lang`` rows of each language whose hashed
    doc_id is smallest.  Counts come back as one vector of 2**bits numbers a language, which
    together are within MODEL_BYTES.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                         & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).limit((MODEL_BYTES >> bits + 2) + 1).collect()
    if len(counts) << bits + 2 > MODEL_BYTES:
        raise ValueError(f"more than {MODEL_BYTES >> bits + 2} language labels")
    sizes = F.broadcast(spark.createDataFrame([tuple(r) for r in counts], "lang string, _n long"))
    hashed = usable.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("_h")).join(sizes, "lang")
    # a hash below this bound leaves about half as many again as are wanted, so that the ranking sees few rows
    thinned = hashed.filter(F.col("_h") * F.col("_n") < F.lit(1.5 * docs_per_lang * (1 << 30)))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ids = thinned.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= docs_per_lang).select("doc_id").distinct()
    sample = usable.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi").repartition(max(1, min(8, len(counts))), "lang")

    def count(batches):
        sums: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = sums.setdefault(lang, [np.zeros(1 << bits, np.int64), 0])
                got[0] += gram_counts(text, bits)[0]
                got[1] += 1
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array(list(sums), pa.string()), "n": pa.array([v[1] for v in sums.values()], pa.int64()),
            "counts": pa.array([v[0].astype(np.int32).tobytes() for v in sums.values()], pa.binary())})

    parts = sample.select("lang", "text").mapInArrow(count, "lang string, n long, counts binary").collect()
    langs = tuple(sorted({r["lang"] for r in parts}))
    counts, n = np.zeros((len(langs), 1 << bits)), np.zeros(len(langs))
    for r in parts:
        k = langs.index(r["lang"])
        counts[k] += np.frombuffer(bytes(r["counts"]), np.int32)
        n[k] += r["n"]
    smooth = counts + alpha
    log_prob = np.ascontiguousarray((np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))).T, np.float32)
    return LanguageModel(langs, bits, log_prob, np.log(n / max(n.sum(), 1)) if len(langs) else n)


def annotate(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with language and score, from the whole text alone (clashing columns give way)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        got = shared.value.score_batch(batch.column(batch.schema.get_field_index("text")).to_pylist())
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

    return map_texts(docs, run, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])


def identify(docs: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; repeated rows and null ids stay as they are.

    Null, empty and letterless texts are ``und`` with 0.0, and so is all of a table without
    labels; an empty table gives an empty one.  A text of any length is scored whole, in
    slices; equal scores go to the language that is first by name; other columns are ignored,
    whatever their names.
    """
    model = fit(docs, **params)
    out = annotate(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, min_score: float = 0.5, **params) -> DataFrame:
    """The documents whose language is determined with posterior ``min_score`` or more."""
    columns = docs.columns
    lang, score = unused(columns, "_found_lang", "_found_score")
    out = annotate(docs, fit(docs, **params), (lang, score))
    return out.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).select(*quoted(columns))
