"""URL rules looked up in a cascade of Bloom filters.

A rule names a host and a path; it fits the host and its subdomains where the
url's path starts with the rule's, and the longest fitting rule (host and path
together) decides. Every url therefore asks about a few keys: each ending of
its host at a label, with each beginning of its path that is as long as the
path of some rule.

Membership is exact without a join. Level 1 of the cascade holds the listed
keys; level 2 the keys of the corpus that level 1 wrongly reports; level 3 the
listed keys that level 2 wrongly reports, and so on until a level makes no
mistake. The key universe is taken from all urls first, so over these urls no
mistake is left. Listed keys and asked ones are told apart by a flag that one
aggregation leaves. Filters are built as bitmaps in tasks and merged by OR; their
size follows the number of keys listed (``max_bits`` is checked).

A null url, or one without ``://``, has an empty host and path and asks
nothing. Urls that no rule fits get ``default``. Repeated urls get equal
answers; other columns are left alone; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

#: Bytes of a bitmap that are merged at a time.
CHUNK = 1 << 20
_ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in (rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_ASCII_LOWER), path


def keys_of(host: str, path: str, path_lengths: Iterable[int]) -> list[tuple[str, str]]:
    """The keys a url asks about, longest first, then by longer host."""
    if not host:
        return []
    ends = [host] + [host[k + 1 :] for k, c in enumerate(host) if c == "." and k + 1 < len(host)]
    starts = [path[:n] for n in path_lengths if n <= len(path)]
    return sorted(((h, p) for h in ends for p in starts), key=lambda k: (-len(k[0]) - len(k[1]), -len(k[0])))


def key_hash(host: str, path: str) -> tuple[int, int]:
    d = blake2b(f"{host}\0{path}".encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1


class Bloom:
    def __init__(self, bits: int, hashes: int, data: np.ndarray | None = None):
        self.bits, self.hashes = bits, hashes
        self.data = np.zeros((bits + 7) // 8, np.uint8) if data is None else data

    @classmethod
    def sized(cls, n: int, error: float, max_bits: int) -> Bloom:
        bits = max(64, math.ceil(-n * math.log(error) / math.log(2) ** 2))
        if bits > max_bits:
            raise ValueError(f"a level needs {bits} bits, over max_bits {max_bits}")
        return cls(bits, max(1, round(-math.log2(error))))

    def _at(self, h: np.ndarray, salt: int) -> np.ndarray:
        step = np.arange(self.hashes, dtype=np.uint64)[:, None]
        x = h[:, 0] + step * h[:, 1] + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) % np.uint64(self.bits)

    def add(self, h: np.ndarray, salt: int) -> None:
        at = self._at(h, salt).ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, h: np.ndarray, salt: int) -> np.ndarray:
        at = self._at(h, salt)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


@dataclass(frozen=True)
class Cascade:
    """Levels alternate between listed keys and wrongly reported ones."""

    levels: tuple[Bloom, ...]

    def holds(self, h: np.ndarray) -> np.ndarray:
        listed = np.full(len(h), len(self.levels) % 2 == 1)
        open_ = np.ones(len(h), bool)
        for k, level in enumerate(self.levels):
            out = open_ & ~level.holds(h, k)
            listed[out] = k % 2 == 1
            open_ &= ~out
        return listed

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, error: float = 0.01, max_bits: int = 1 << 31) -> Cascade:
        """``listed``, ``universe``: distinct keys (h1, h2). The first level
        errs for ``error`` of the other keys, further ones for a half."""
        flagged = universe.select("h1", "h2", F.lit(False).alias("listed")).union(listed.select("h1", "h2", F.lit(True)))
        keys = written(flagged.groupBy("h1", "h2").agg(F.max("listed").alias("listed")))
        inside, outside = keys.where("listed").select("h1", "h2"), keys.where("not listed").select("h1", "h2")
        levels: list[Bloom] = []
        n = inside.count()
        while n:
            level = Bloom.sized(n, error if not levels else 0.5, max_bits)
            salt = len(levels)
            fill(level, inside, _pairs, salt)
            levels.append(level)
            inside, outside = written(_hits(outside, level, salt)), inside
            n = inside.count()
        return cls(tuple(levels))


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1)], axis=1)


def fill(level: Bloom, keys: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], salt: int = 0) -> None:
    """Sets the bits of all keys: each task fills a bitmap of its own, bitmaps
    are merged chunk by chunk, and the driver gets each chunk once."""
    bits, hashes = level.bits, level.hashes

    def part(batches):
        own = Bloom(bits, hashes)
        for batch in batches:
            own.add(hashes_of(batch), salt)
        for k, at in enumerate(range(0, len(own.data), CHUNK)):
            piece = own.data[at : at + CHUNK]
            if piece.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "bits": pa.array([piece.tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        every = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")]
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.bitwise_or.reduce(every).tobytes()], pa.binary())})

    merged = keys.mapInArrow(part, "chunk int, bits binary").groupBy("chunk").applyInArrow(merge, "chunk int, bits binary")
    for r in merged.collect():  # the size of the filter, whatever the keys
        level.data[r.chunk * CHUNK : r.chunk * CHUNK + len(r.bits)] |= np.frombuffer(bytes(r.bits), np.uint8)


def _hits(keys: DataFrame, level: Bloom, salt: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(level.holds(_pairs(batch), salt)))

    return keys.select("h1", "h2").mapInArrow(run, "h1 long, h2 long")


def _hashed(keys: list[tuple[str, str]]) -> np.ndarray:
    return np.array([key_hash(*k) for k in keys], np.uint64).reshape(-1, 2)


def universe(urls: DataFrame, url: str, path_lengths: list[int]) -> DataFrame:
    """The distinct keys that the urls ask about, as (h1, h2)."""

    def run(batches):
        for batch in batches:
            keys = {k for x in set(batch.column(0).to_pylist()) for k in keys_of(*split_url(x), path_lengths)}
            h = _hashed(sorted(keys)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], names=["h1", "h2"])

    return urls.select(F.col(url)).mapInArrow(run, "h1 long, h2 long").distinct()


def judge(urls: DataFrame, rules: list[tuple[str, str]], keep: list[str], url: str = "url", default: str = "allow", error: float = 0.01) -> DataFrame:
    """``rules``: (allow or block, host and path). The columns ``keep`` with
    host, path, rule (null if none fits) and verdict."""
    parsed = {(h, p): verdict for verdict, rule in rules for h, slash, rest in [rule.partition("/")] for p in [slash + rest]}
    lengths = sorted({len(p) for _, p in parsed})
    spark = urls.sparkSession
    cascades = []
    with Scratch(spark):
        asked = written(universe(urls, url, lengths))
        for verdict in ("allow", "block"):
            h = _hashed([k for k, v in parsed.items() if v == verdict]).view(np.int64).tolist()
            listed = spark.createDataFrame(h, "h1 long, h2 long")
            cascades.append((verdict, Cascade.build(listed, asked, error)))
    held = urls.select(F.struct(*keep).alias("row"), F.col(url).alias("url"))
    inner = held.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            urls_ = batch.column(1).to_pylist()
            parts = [split_url(x) for x in urls_]
            asks = [keys_of(h, p, lengths) for h, p in parts]
            h = _hashed([k for ks in asks for k in ks])
            found = np.full(len(h), -1)
            for n, (_, cascade) in enumerate(cascades):
                found[cascade.holds(h)] = n
            rule, verdict, at = [], [], 0
            for ks in asks:
                own = found[at : at + len(ks)]
                at += len(ks)
                hit = np.flatnonzero(own >= 0)
                rule.append("".join(ks[hit[0]]) if len(hit) else None)
                verdict.append(cascades[own[hit[0]]][0] if len(hit) else default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in ([p[0] for p in parts], [p[1] for p in parts], rule, verdict))], names=["row", "host", "path", "rule", "verdict"])

    return held.mapInArrow(run, f"row {inner}, host string, path string, rule string, verdict string").select("row.*", "host", "path", "rule", "verdict")
