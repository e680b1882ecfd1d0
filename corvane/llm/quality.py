"""Quality scores by a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each visit fits a shallow tree to one
feature's (or one pair's) binned gradients and adds it to that term's lookup table.  A
text's score is the logistic of a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, held_out, map_texts

FEATURES = (
    "log_bytes", "letters", "upper", "digits", "space", "non_ascii", "stops", "commas", "pipes", "shouts", "symbols",
    "brackets", "quotes", "mean_word", "long_words", "distinct_words", "distinct_triples", "bare_symbols", "top_word",
    "log_lines", "mean_line", "repeated_lines", "shouted_words", "capitalised", "symbol_ends", "short_lines",
)
THRESHOLD = 0.3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CLASSES = {
    "upper": bytes(range(65, 91)), "digits": b"0123456789", "space": b" \t\r\n", "stops": b".?;:", "commas": b",", "pipes": b"|",
    "shouts": b"!", "symbols": b"#$%&*@^~+=_", "brackets": b"()[]{}<>/\\", "quotes": b"\"'`",
}


def features(text: str | None) -> list[float]:
    """The values of FEATURES for a whole text; all 0 for null or empty."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    counts, n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(raw)
    share = {k: counts[list(v)].sum() / n for k, v in _CLASSES.items()}
    high = counts[128:].sum() / n
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, m = max(len(words), 1), max(len(lines), 1)
    kinds: dict[str, int] = {}
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    triples = max(len(words) - 2, 1)
    values = {
        **share, "log_bytes": np.log1p(n), "letters": counts[_LETTER].sum() / n + high, "non_ascii": high,
        "mean_word": sum(map(len, words)) / w, "long_words": sum(len(x) > 20 for x in words) / w,
        "distinct_words": len(kinds) / w, "distinct_triples": len(set(zip(words, words[1:], words[2:]))) / triples,
        "bare_symbols": sum(k for x, k in kinds.items() if not any(map(str.isalnum, x))) / w, "top_word": max(kinds.values(), default=0) / w,
        "log_lines": np.log1p(m), "mean_line": np.log1p(len(text) / m), "repeated_lines": 1 - len(set(lines)) / m,
        "shouted_words": sum(k for x, k in kinds.items() if len(x) > 1 and x.isupper()) / w,
        "capitalised": sum(k for x, k in kinds.items() if x[0].isupper()) / w,
        "symbol_ends": sum(k for x, k in kinds.items() if x[-1] in "#$%&*@!|") / w, "short_lines": sum(len(x) < 30 for x in lines) / m,
    }
    return [float(values[k]) for k in FEATURES]


def _cut(grad: np.ndarray, hess: np.ndarray, penalty: float) -> tuple[float, int]:
    """Gain and place of the best single cut of ordered bins."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    left, right = g[:-1] ** 2 / (h[:-1] + penalty), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + penalty)
    gain = left + right - g[-1] ** 2 / (h[-1] + penalty)
    if not len(gain):
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """A tree of at most ``depth`` levels over ordered bins, as one value for each bin."""
    gain, at = _cut(grad, hess, penalty) if depth and len(grad) > 1 else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(grad), grad.sum() / (hess.sum() + penalty))
    return np.concatenate((_tree(grad[:at], hess[:at], depth - 1, penalty), _tree(grad[at:], hess[at:], depth - 1, penalty)))


def _pair_tree(grad: np.ndarray, hess: np.ndarray, penalty: float) -> np.ndarray:
    """The best cut along the first feature when each side may be cut along the second, as a table."""
    out = np.empty_like(grad)
    top_g, top_h = np.cumsum(grad, axis=0)[:-1], np.cumsum(hess, axis=0)[:-1]

    def gains(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        left_g, left_h, all_g, all_h = np.cumsum(g, axis=1), np.cumsum(h, axis=1), g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
        return (left_g ** 2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty)).max(axis=1)

    total = gains(top_g, top_h) + gains(grad.sum(axis=0) - top_g, hess.sum(axis=0) - top_h) if len(top_g) else np.zeros(0)
    at = int(np.argmax(total)) + 1 if len(total) else 0
    for rows in (slice(0, at), slice(at, None)):
        if grad[rows].size:
            out[rows] = _tree(grad[rows].sum(axis=0), hess[rows].sum(axis=0), 1, penalty)
    return out


@dataclass
class QualityModel:
    """Cut points and lookup tables; a few tens of KB whatever the corpus."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features, by additions of looked-up values."""
        at, logit = self.bins(x), np.full(len(x), self.base)
        for j, values in enumerate(self.tables):
            logit += values[at[:, j]]
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            logit += values[at[:, i] // 2, at[:, j] // 2]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8,
          rate: float = 0.1, penalty: float = 2.0) -> QualityModel:
    """Fit tables to rows ``x`` and 0/1 labels ``y``; one class or no rows give a constant."""
    rate_of_ones = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    model = QualityModel(float(np.log(rate_of_ones / (1 - rate_of_ones))))
    if len(y) < 20 or y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    at, size = model.bins(x), [len(c) + 1 for c in model.cuts]
    model.tables, logit = [np.zeros(s) for s in size], np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[:, j], g, size[j]), np.bincount(at[:, j], h, size[j]), 2, penalty)
            table += step
            logit += step[at[:, j]]
    half = at // 2
    wide = [(s + 1) // 2 for s in size]

    def flat(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(half[:, i] * wide[j] + half[:, j], v, wide[i] * wide[j]).reshape(wide[i], wide[j])

    g, h = slopes()
    gains = []
    for i, j in combinations(range(len(size)), 2):
        gg, hh = flat(i, j, g), flat(i, j, h)
        step = _pair_tree(gg, hh, penalty)
        gains.append((float((gg * step - hh * step * step / 2).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = rate * _pair_tree(flat(i, j, g), flat(i, j, h), penalty)
            table += step
            logit += step[half[:, i], half[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, **params) -> QualityModel:
    """Learn from labelled rows that are not held out.

    The sample is bounded: the ``max_rows`` labelled ids whose hash is smallest (all labels
    of an id must agree on its majority; a tie counts as 1).  Their features, about 200
    bytes a row, come to the driver; ids and labels are broadcast.
    """
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = (known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_label")

    def run(batches):
        for batch in batches:
            rows = [np.asarray(features(t.as_py()), np.float64).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary()), batch.column("_label")], names=["doc_id", "x", "y"])

    got = sorted((r["doc_id"], bytes(r["x"]), r["y"]) for r in texts.mapInArrow(run, "doc_id long, x binary, y int").collect())
    x = np.frombuffer(b"".join(r[1] for r in got), np.float64).reshape(-1, len(FEATURES))
    return boost(x, np.array([r[2] for r in got], float), **params)


def score_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and empty texts are scored from all-zero features; repeated rows stay, each scored;
    without labels, or with one kind of label only, every score is the same; of labels of one
    id the majority counts, and a tie is a 1; texts of any length are scored whole; an empty
    table gives an empty one; other columns are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **params))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index("text"))
        x = np.array([features(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
        score = model.value.score(x)
        return [pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    out = map_texts(docs.select("doc_id", "text"), run, fields, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
