"""Hashes as Columns: the placement hash and token hashing for text vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of the placement hash and of FNV-1a.
MIX_1, MIX_2, GOLDEN = 0x7FEB352D, 0x846CA68B, 2654435761
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
_MOD = 4294967296
#: Characters of tokens: a-z, 0-9, underscore, full stop, hyphen.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(97, 123), *range(48, 58), ord("_"), ord("."), ord("-")]] = True


def _times(x: Column, factor: int) -> Column:
    """Product in double precision, then modulo 2^32: low bits of products
    beyond 2^53 are rounded, which placements depend on."""
    p = x.cast("double") * F.lit(float(factor))
    return (p - F.floor(p / float(_MOD)).cast("double") * float(_MOD)).cast("long")


def _xor_shift(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, n))


def hash32(x: Column) -> Column:
    """Of an unsigned 32-bit number in a long."""
    x = _xor_shift(x.cast("long").bitwiseAND(_MOD - 1), 16)
    x = _xor_shift(_times(x, MIX_1), 15)
    return _xor_shift(_times(x, MIX_2), 16)


def fnv1a(token: Column) -> Column:
    """FNV-1a over code points, 32 bits."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(_MOD - 1))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9_.-]+"), lambda t: t != "")


def token_slot(token: Column, dim: int) -> Column:
    return F.pmod(fnv1a(token).bitwiseAND(0x7FFFFFFF), F.lit(dim)).cast("int")


def _embedded(texts, dim: int):
    """Counts of hashed tokens of an Arrow array of lower-cased texts. All
    tokens of a batch are hashed at once, a byte of each at a step: tokens are
    ASCII, so bytes are code points."""
    import pyarrow as pa

    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    n = len(texts)
    data = np.frombuffer("\0".join(texts.fill_null("").to_pylist()).encode() + b"\0", np.uint8) if n else np.zeros(0, np.uint8)
    solid = _TOKEN[data]
    first = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    length = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1 - first
    h, live, at = np.full(len(first), FNV_OFFSET, np.uint64), np.arange(len(first)), 0
    while len(live):
        h[live] = ((h[live] ^ data[first[live] + at]) * np.uint64(FNV_PRIME)) & np.uint64(_MOD - 1)
        at += 1
        live = live[length[live] > at]
    doc = np.cumsum(data == 0)[first] if len(first) else first
    counts = np.bincount(doc * dim + ((h & np.uint64(0x7FFFFFFF)) % np.uint64(dim)).astype(np.int64), minlength=n * dim).astype(np.float32)
    rows = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, counts)
    if not texts.null_count:
        return rows
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, counts, mask=texts.is_null())


def hash_embed(text: Column, dim: int) -> Column:
    """Counts of hashed tokens, as floats; null for a null text. Whole Arrow
    batches at a time; the JVM lower-cases, as it knows all letters."""
    embed = F.arrow_udf(lambda texts: _embedded(texts, dim), "array<float>")
    # a NUL ends a token like any other character; inside it ends a text
    return embed(F.translate(F.lower(text), "\0", " "))
