"""Language identification in two steps: family, then language.

A text's features are the shares of its hashed byte trigrams (letters only,
white space and punctuation as one space, A-Z lower-cased). Linear SVMs tell
every two families apart; within the winning family one-versus-one SVMs tell
its languages apart, most votes win and margins break ties. Whole texts are
scored; the models are fitted on a bounded sample: ``per_language`` texts at
most of each of the ``most_languages`` languages with the most texts.

``und`` (score 0) is predicted where a text is null or has no letter, and for
every text if no language could be learned. Repeated rows get equal answers;
ids, sources and other columns are never looked at. A language without a
known family is a family of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample, slices, text_buffers
from .linear import linear_svm, sigmoid

SIZE = 4096
#: Families of languages.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "baltic": "lt lv",
    "indic": "hi bn mr ur pa gu ne",
    "semitic": "ar he mt",
}
_FAMILY = {x: f for f, names in FAMILIES.items() for x in names.split()}
_FLAT = np.full(256, 32, np.uint8)
_FLAT[97:123] = np.arange(97, 123)
_FLAT[65:91] = np.arange(97, 123)
_FLAT[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each text, between spaces, and where texts begin."""
    n = len(offsets) - 1
    flat = np.full(len(data) + 2 * n, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
    flat[at] = _FLAT[data]
    a, b, c = (flat[k : len(flat) - 2 + k].astype(np.uint32) for k in range(3))
    h = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    real = (b != 32) | ((a != 32) & (c != 32))
    begin = offsets + 2 * np.arange(n + 1)
    inside = np.ones(len(h), bool)
    for k in (1, 2):  # no trigram across two texts
        inside[np.maximum(begin[1:-1] - k, 0)] = False
    keep = np.flatnonzero(real & inside)
    return h[keep].astype(np.int64), np.searchsorted(keep, begin)


def _shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    h, at = _trigrams(data, offsets)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(doc * SIZE + h, minlength=n * SIZE).reshape(n, SIZE).astype(np.float32)
    return counts / np.maximum(1, counts.sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Pair:
    one: str
    other: str
    weights: np.ndarray
    bias: float


def _duels(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Pair]:
    out = []
    for one, other in combinations(names, 2):
        rows = (y == one) | (y == other)
        w, b = linear_svm(x[rows], np.where(y[rows] == one, 1.0, -1.0).astype(np.float32))
        out.append(Pair(one, other, w, b))
    return out


def _vote(x: np.ndarray, names: list[str], duels: list[Pair]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the place of the winner in ``names``, and its confidence."""
    votes = np.zeros((len(x), len(names)))
    sure = np.ones((len(x), len(names)))
    for p in duels:
        i, j = names.index(p.one), names.index(p.other)
        q = sigmoid(4 * (x @ p.weights + p.bias))
        votes[:, i] += (q >= 0.5) + 1e-3 * q
        votes[:, j] += (q < 0.5) + 1e-3 * (1 - q)
        sure[:, i], sure[:, j] = np.minimum(sure[:, i], q), np.minimum(sure[:, j], 1 - q)
    best = votes.argmax(axis=1)
    return best, sure[np.arange(len(x)), best]


class LanguageId:
    def __init__(self, scale: np.ndarray, families: list[str], between: list[Pair], members: dict[str, list[str]], within: dict[str, list[Pair]]):
        self.scale, self.families, self.between, self.members, self.within = scale, families, between, members, within

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 800, most_languages: int = 64) -> LanguageId:
        """``docs``: labelled rows only. The rows of a language with the
        smallest hashes of the row are learned from; copies of a text are drawn
        each by itself where anything else differs, else once."""
        row = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]  # these can't be hashed
        rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(*row, F.lit(17)).alias("draw")).where("text is not null and lang is not null")
        names = sorted(r.lang for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_languages).collect())
        if not names:
            return cls(np.ones(SIZE, np.float32), [], [], {}, {})
        picked = sample(rows.where(F.col("lang").isin(names)), per_language, F.col("draw"), "lang").select("text", "lang")

        def features(batches):
            for batch in batches:
                data, offsets = text_buffers(batch.column(0))
                for lo, hi in slices(offsets, 1 << 20):
                    x = _shares(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    where = [np.flatnonzero(r) for r in x]
                    yield pa.RecordBatch.from_pydict({"lang": batch.column(1).slice(lo, hi - lo), "at": pa.array([w.astype(np.uint16).tobytes() for w in where], pa.binary()), "x": pa.array([r[w].astype(np.float32).tobytes() for r, w in zip(x, where)], pa.binary())})

        got = sorted((r.lang, bytes(r.at), bytes(r.x)) for r in picked.mapInArrow(features, "lang string, at binary, x binary").collect())
        x = np.zeros((len(got), SIZE), np.float32)
        for row, (_, at, v) in zip(x, got):
            row[np.frombuffer(at, np.uint16)] = np.frombuffer(v, np.float32)
        y = np.array([g[0] for g in got])
        # root mean square of a feature, floored: rare ones don't blow up
        scale = (1.0 / (np.sqrt((x * x).mean(axis=0)) + 1e-3)).astype(np.float32) / np.float32(SIZE**0.5)
        x *= scale
        names = sorted(set(y.tolist()))
        members: dict[str, list[str]] = {}
        for k in names:
            members.setdefault(_FAMILY.get(k.lower().split("-")[0], k), []).append(k)
        families = sorted(members)
        of = {k: f for f, ks in members.items() for k in ks}
        between = _duels(x, np.array([of[k] for k in y.tolist()]), families)
        return cls(scale, families, between, members, {f: _duels(x, y, ks) for f, ks in members.items()})

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = _shares(data, offsets) * self.scale
        family, sure = _vote(x, self.families, self.between)
        names = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, s = _vote(x[rows], self.members[f], self.within[f])
                names[rows] = np.array(self.members[f], object)[best]
                sure[rows] *= s
        return names.tolist(), sure

    def predict(self, docs: DataFrame, text: Column | None = None) -> DataFrame:
        """``docs`` with lang_pred and score (columns of those names are replaced)."""
        text = F.col("text") if text is None else text
        empty = docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
        if not self.families:
            return empty
        keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
        held = docs.select(F.struct(*keep).alias("row"), F.when(text.rlike("\\p{L}"), text).alias("text"))
        inner = held.schema["row"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                data, offsets = text_buffers(batch.column(1))
                names, score = [], []
                for lo, hi in slices(offsets, 1 << 20):
                    for a in range(lo, hi, 1024):
                        b = min(hi, a + 1024)
                        n, s = self.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                        names += n
                        score.append(s)
                none = np.diff(offsets) == 0
                score = np.concatenate(score) if score else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["und" if z else k for z, k in zip(none, names)], pa.string()), pa.array(np.where(none, 0.0, np.clip(score, 0, 1)))], names=["row", "lang_pred", "score"])

        return held.mapInArrow(run, f"row {inner}, lang_pred string, score double").select("row.*", "lang_pred", "score")
