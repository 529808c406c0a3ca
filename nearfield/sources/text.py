"""Query texts to vectors."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashes import FNV_OFFSET, FNV_PRIME


def parse_vector(text: str, dim: int) -> list[float] | None:
    """Numbers between commas or spaces, if there are ``dim`` of them."""
    parts = [p for p in re.split(r"[,\s]+", text.strip()) if p]
    try:
        numbers = [float(p) for p in parts]
    except ValueError:
        return None
    return numbers if parts and len(numbers) == dim and not any(np.isnan(numbers)) else None


def hash_embed(text: str, dim: int) -> list[float]:
    """The driver's own version of ``functions.hashes.hash_embed``."""
    out = [0.0] * dim
    for token in re.split(r"[^a-z0-9_.-]+", text.lower()):
        if token:
            h = FNV_OFFSET
            for c in token:
                h = ((h ^ ord(c)) * FNV_PRIME) & 0xFFFFFFFF
            out[(h & 0x7FFFFFFF) % dim] += 1.0
    return out


def query_to_vector(text: str, dim: int) -> list[float] | None:
    return parse_vector(text, dim) or (hash_embed(text, dim) if text.strip() else None)


def fitted(vector: Column, dim: int) -> Column:
    """Cut or padded with zeros to ``dim``: for vectors of other models."""
    return F.concat(F.slice(vector, 1, dim), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(dim) - F.size(vector))))
