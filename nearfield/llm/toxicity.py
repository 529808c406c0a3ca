"""Toxicity by non-negative positive-unlabelled learning.

Texts confirmed toxic are the positives; all other training texts are
unlabelled, toxic ones among them. A linear model over word features minimises
the non-negative risk

    prior * E_P[loss(+)]  +  max(0, E_U[loss(-)] - prior * E_P[loss(-)])

so unlabelled toxic texts don't teach the model that toxic words are harmless.
Features are the distinct words of a text (runs of letters) and their first
four to six bytes, which carry over to forms not seen in training; a feature
counts if it is in at least ``least`` of the positives, however many there
are, and beyond chance more likely than not comes with a toxic text: prior * P(feature | toxic) >
P(feature) / 2. Presence counts, not frequency, so a long text is no more
toxic for its length. Whole texts are scored.

Null and empty texts get the score of a text without features; repeated rows
equal scores; with no positive at all every score is 0. Ids, sources and
languages are never looked at, other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers
from .linear import sigmoid
from .tokens import LOWER, spans_hash

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings and the text of each (with repeats)."""
    low = LOWER[data]
    solid = np.r_[False, _LETTER[low], False]
    cut = np.zeros(len(solid), bool)
    cut[offsets + 1] = True
    solid_l = solid & (~np.r_[False, solid[:-1]] | cut)
    starts = np.flatnonzero(solid_l) - 1
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | cut[1:]))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    length = ends - starts
    h, of = [spans_hash(low, starts, length)], [doc]
    for k in (4, 5, 6):
        rows = length > k
        h.append(spans_hash(low, starts[rows], np.full(rows.sum(), k)) + np.uint64(k))
        of.append(doc[rows])
    return np.concatenate(h), np.concatenate(of)


def _place(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in the sorted ``keys`` of those of ``x`` that are among them."""
    if not len(keys):
        return np.zeros(0, np.int64)
    at = np.searchsorted(keys, x)
    return at[keys[np.minimum(at, len(keys) - 1)] == x]


def nn_pu(pos: list[np.ndarray], unl: list[np.ndarray], size: int, prior: float, steps: int = 500, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the logistic loss. Rows
    are lists of active features. Where the unlabelled part of the risk falls
    below zero, its gradient alone is followed backwards."""
    lens = np.array([len(r) for r in pos + unl])
    rows = np.repeat(np.arange(len(lens)), lens)
    cols = np.concatenate([np.zeros(0, np.int64), *pos, *unl]).astype(np.int64)
    n, p = len(lens), len(pos)
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + b
        s = sigmoid(z)
        below = np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0)  # loss of answering minus
        minus = below[p:].mean() - prior * below[:p].mean()
        g = np.zeros(n)
        if minus >= 0:
            g[:p] = prior * (s[:p] - 1) / p - prior * s[:p] / p
            g[p:] = s[p:] / (n - p)
        else:
            g[:p] = prior * s[:p] / p
            g[p:] = -s[p:] / (n - p)
        grad = np.r_[np.bincount(cols, g[rows], size) + l2 * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Toxicity:
    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = known, weights, bias

    @classmethod
    def fit(cls, positives: DataFrame, unlabelled: DataFrame, prior: float, text: str = "text", least: int = 3) -> Toxicity:
        """``positives`` and ``unlabelled`` are bounded samples of texts (the
        caller picks them); their distinct features go to the driver.
        ``prior``: the share of toxic texts, above 0 and at most 1."""

        def distinct(batches, keys=None):
            """The features of each text; with ``keys``, the places of those
            among them."""
            for batch in batches:
                data, offsets = text_buffers(batch.column(0))
                for lo, hi in slices(offsets, 4 << 20):
                    h, of = _features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    order = np.argsort(of, kind="stable")
                    cut = np.searchsorted(of[order], np.arange(hi - lo + 1))
                    own = [np.unique(h[order[i:j]]) for i, j in zip(cut[:-1], cut[1:])]
                    own = own if keys is None else [_place(keys, x).astype(np.int32) for x in own]
                    yield pa.RecordBatch.from_pydict({"f": pa.array([x.tobytes() for x in own], pa.binary())})

        def rows(df: DataFrame, kind, keys=None) -> list[np.ndarray]:
            held = df.select(F.col(text).alias("text")).mapInArrow(lambda batches: distinct(batches, keys), "f binary").toArrow()
            return [np.frombuffer(x, kind) for x in sorted(held.column("f").to_pylist())]

        pos = rows(positives, np.uint64)
        if not pos:
            return cls(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
        if not 0 < prior <= 1:
            raise ValueError(f"the share of toxic texts must be above 0 and at most 1, not {prior}")
        keys, df = np.unique(np.concatenate(pos), return_counts=True)
        keep = df >= least
        keys, df = keys[keep], df[keep]
        # of unlabelled texts only what positives have as well leaves the tasks
        unl = rows(unlabelled, np.int32, keys)
        seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *unl]), minlength=len(keys))
        # one standard error less than was counted: chance doesn't make a feature
        common = prior * (df - np.sqrt(df)) / len(pos) > 0.5 * (seen + 1) / max(1, len(unl))
        new = np.cumsum(common) - 1
        pos_at = [new[a[common[a]]] for a in (_place(keys, x) for x in pos)]
        unl_at = [new[a[common[a]]] for a in unl]
        w, b = nn_pu(pos_at, unl_at or [np.zeros(0, np.int64)], int(common.sum()), prior)
        return cls(keys[common], w, b)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(self.known):
            return sigmoid(np.full(n, self.bias))
        h, of = _features(data, offsets)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == h)
        both = np.unique(of[hit] * len(self.known) + at[hit])
        doc, col = both // len(self.known), both % len(self.known)
        return sigmoid(np.bincount(doc, self.weights[col], n) + self.bias)

    def predict(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """The columns ``keep`` and score."""
        held = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
        inner = held.schema["row"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                data, offsets = text_buffers(batch.column(1))
                for lo, hi in slices(offsets, 2 << 20):
                    s = self.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s)], names=["row", "score"])

        return held.mapInArrow(run, f"row {inner}, score double").select("row.*", "score")
