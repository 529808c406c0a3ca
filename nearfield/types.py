"""Metrics, strategies, parameters and row types."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import types as T

#: Codes in catalogs and index files.
METRIC_CODES = {"cosine": 0, "l2": 1, "dot": 2}
STRATEGY_CODES = {"bruteforce": 0, "hnsw": 1, "ivf": 2}


class Metric(str, Enum):
    """Scores are higher for closer vectors; l2 is the negative squared distance."""

    COSINE = "cosine"
    L2 = "l2"
    DOT = "dot"

    @property
    def code(self) -> int:
        return METRIC_CODES[self.value]


class Strategy(str, Enum):
    BRUTEFORCE = "bruteforce"
    HNSW = "hnsw"
    IVF = "ivf"

    @property
    def code(self) -> int:
        return STRATEGY_CODES[self.value]


def from_code(kind: type[Enum], code: int):
    codes = METRIC_CODES if kind is Metric else STRATEGY_CODES
    for name, own in codes.items():
        if own == code:
            return kind(name)
    raise ValueError(f"unknown {kind.__name__.lower()} code {code}")


@dataclass(frozen=True)
class HnswParams:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    seed: int = 42


@dataclass(frozen=True)
class IvfParams:
    nlist: int = 64
    nprobe: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "nlist", max(1, int(self.nlist)))
        probe = self.nprobe if self.nprobe is not None else -int(-(self.nlist**0.5) // 1)
        object.__setattr__(self, "nprobe", min(max(1, int(probe)), self.nlist))


def u32(value: int) -> int:
    """Ids are unsigned 32-bit: others wrap."""
    return int(value) & 0xFFFFFFFF


def u32_col(col: Column) -> Column:
    return col.cast("long").bitwiseAND(0xFFFFFFFF)


ROWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("meta", T.VariantType()),
    ]
)
HITS = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("meta", T.VariantType())])


class DimMismatch(ValueError):
    def __init__(self, got: int, want: int):
        super().__init__(f"dim mismatch: got {got}, want {want}")
