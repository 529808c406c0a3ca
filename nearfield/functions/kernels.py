"""Score kernels. Expressions fold left to right in double precision, so
results are the same in every plan; the NumPy kernels fold in that order too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DimMismatch, Metric


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_negative(a: Column, b: Column) -> Column:
    def square(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return -_sum(F.zip_with(a, b, square))


def normalized(v: Column) -> Column:
    """Unit length in single precision; a zero vector stays zero."""
    norm = F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    inv = F.when(norm == 0, F.lit(1.0)).otherwise(F.lit(1.0) / norm)
    # one element array: the norm is computed once for a row, not for each component
    return F.flatten(F.transform(F.array(inv), lambda s: F.transform(v, lambda x: (x.cast("double") * s).cast("float"))))


def stored(v: Column, metric: Metric) -> Column:
    """The form in which a collection keeps a vector."""
    return normalized(v) if metric == Metric.COSINE else v


def score(a: Column, b: Column, metric: Metric) -> Column:
    """Of stored vectors and a query in stored form."""
    if metric in (Metric.COSINE, Metric.DOT):
        return dot(a, b)
    if metric == Metric.L2:
        return l2_negative(a, b)
    raise ValueError(f"unsupported metric {metric}")


def np_normalized(v) -> np.ndarray:
    v = np.asarray(v, np.float32)
    total = 0.0
    for x in v.astype(np.float64):
        total += x * x
    inv = 1.0 / np.sqrt(total) if total else 1.0
    return (v.astype(np.float64) * inv).astype(np.float32)


def query_vector(q, dim: int, metric: Metric) -> list[float]:
    if len(q) != dim:
        raise DimMismatch(len(q), dim)
    v = np_normalized(q) if metric == Metric.COSINE else np.asarray(q, np.float32)
    return [float(x) for x in v]


def literal_vector(v) -> Column:
    """One array literal. An array of float columns would grow the plan by a
    node for each component."""
    return F.lit(np.asarray(v, np.float32)) if len(v) else F.array().cast("array<float>")


def np_scores(queries: np.ndarray, rows: np.ndarray, metric: Metric) -> np.ndarray:
    """(queries, rows) scores, folded component by component."""
    q, x = queries.astype(np.float64), np.ascontiguousarray(rows.T.astype(np.float64))
    out = np.zeros((len(q), x.shape[1]))
    for d in range(x.shape[0]):
        if metric == Metric.L2:
            delta = q[:, d, None] - x[d]
            out += delta * delta
        else:
            out += q[:, d, None] * x[d]
    return -out if metric == Metric.L2 else out


def np_pair_scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, metric: Metric, step: int = 1 << 16) -> np.ndarray:
    """Scores of the pairs (q[i], x[j]), folded as in ``np_scores``."""
    out = np.zeros(len(i))
    for at in range(0, len(i), step):
        a, b = np.ascontiguousarray(q[i[at : at + step]].T), np.ascontiguousarray(x[j[at : at + step]].T)
        for d in range(len(a)):
            u, v = a[d].astype(np.float64), b[d].astype(np.float64)
            out[at : at + step] += (u - v) * (u - v) if metric == Metric.L2 else u * v
    return -out if metric == Metric.L2 else out


def np_candidates(q: np.ndarray, x: np.ndarray, metric: Metric, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of every pair that may be among the k best
    of its query. A matrix product leaves out only what lies below the k-th
    best by more than its rounding error; the rest is scored by the fold."""
    if not (np.isfinite(q).all() and np.isfinite(x).all()):
        s = np_scores(q, x, metric)
        i, j = np.nonzero(~np.isnan(s) & (s > -np.inf))
        return i, j, s[i, j]
    if len(x) <= k:
        i, j = np.divmod(np.arange(len(q) * len(x)), max(1, len(x)))
        return i, j, np_pair_scores(q, x, i, j, metric)
    lengths = [np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) for v in (q, x)]
    plain = all(((n == 0) | ((n > 1e-6) & (n < 1e6))).all() for n in lengths)
    kind = np.dtype(np.float32 if plain else np.float64)
    s = q.astype(kind) @ x.astype(kind).T
    most = lengths[0] * lengths[1].max()
    if metric == Metric.L2:
        s = 2 * s - (lengths[1] ** 2).astype(kind)
        most = 2 * most + lengths[1].max() ** 2
    slack = 4 * (x.shape[1] + 4) * float(np.finfo(kind).eps) * most
    least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] - slack
    i, j = np.divmod(np.flatnonzero(s >= least[:, None].astype(kind)), len(x))
    return i, j, np_pair_scores(q, x, i, j, metric)
