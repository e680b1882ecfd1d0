"""Vector functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero or null."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are vectors of ``dim`` numbers, these rows as float64), straight from the Arrow buffer."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ok = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    flat = (vectors if pc.all(ok).as_py() else vectors.filter(ok)).flatten()
    return ok.to_numpy(zero_copy_only=False), pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)


def cosine_to(query: list[float]):
    """An Arrow UDF: cosine of each vector with one fixed query, one matrix product per batch; null for zero and misfit vectors."""
    q = np.asarray(query, np.float64)
    length = float(np.linalg.norm(q))

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), np.nan)
        if len(vectors) and length:
            ok, m = matrix(vectors, len(q))
            n = np.sqrt(np.einsum("ij,ij->i", m, m))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[ok] = np.where(n > 0, m @ q / (n * length), np.nan)
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    return score


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
