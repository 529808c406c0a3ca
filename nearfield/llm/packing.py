"""Packing token sequences by minimum bin slack.

Documents become token ids and an end id; only those longer than a sequence
are cut, into full pieces after a first one that may be shorter. Bins are
filled one at a time: the longest piece that is left comes first, then a
bitset subset-sum over the lengths that are left finds the fullest combination
to go with it, and both are removed.

Only lengths matter to that, and there are no more different ones than a
sequence has places; so the bins are planned from the table of lengths and
counts. A combination is taken as often as its lengths are there, in one step.
Pieces then find their places by their number among pieces of their length,
counted in salted groups, so no task holds a whole length.

Null texts are empty: one end id. Repeated rows are packed each; rows without
an id too. Other columns are left alone; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@lru_cache(2)
def _library(path: str):
    """The library's own tokenizer, as it is set by default."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _encoder(path: str):
    """A byte-level BPE file of ``tokenizers`` in the quicker tiktoken: the
    same vocabulary, pattern and merges, the same ids for texts without the
    strings of added tokens, which come as a second result."""
    import tiktoken

    with open(path) as f:
        spec = json.load(f)
    added = {t["content"] for t in spec.get("added_tokens") or []}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    # byte-level files write each byte as a printable character
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
    ranks = {bytes(byte_of[c] for c in piece): rank for piece, rank in spec["model"]["vocab"].items() if piece not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), tuple(added)


def token_ids(path: str, text: str, end: int = 0) -> np.ndarray:
    """The ids of ``tokenizers`` with add_special_tokens=False, then the end.
    Texts that hold the string of an added token, which the library makes one
    id of, go to the library itself; so do runs too long for tiktoken."""
    quick, added = _encoder(path)
    ids = None
    if not any(x in text for x in added):
        try:
            ids = quick.encode_ordinary(text)
        except BaseException as e:  # noqa: BLE001  a Rust panic is no Exception
            if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                raise
    if ids is None:
        ids = _library(path).encode(text, add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = held.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, rows = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = token_ids(tokenizer, text or "", end)
                    for n, (start, length) in enumerate(cuts(len(ids), size)):
                        own = ids[start : start + length].tobytes()
                        doc.append(k)
                        rows.append((n, start, length, zlib.crc32(own), own if with_ids else None))
                cols = list(zip(*rows))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pc.take(part.column(0), pa.array(doc)), *(pa.array(c, t) for c, t in zip(cols[: len(names) - 1], kinds))], names=names)

    return held.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """A combination of the lengths (each at most as often as it is there)
    with the largest sum that ``room`` holds."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        steps.append((length, reach))
        left, much = min(counts[length], room // length), 1
        while left > 0:
            take = min(much, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            much *= 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        times = 0
        while not before >> at & 1:
            at -= length
            times += 1
        if times:
            found[length] = times
    return found


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, bin, of a bin, offset): the pieces of a length
    numbered ``first`` to ``last`` - 1 go to bins from ``bin`` on, so many in
    each, from ``offset`` on."""
    left = {x: n for x, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out, bins = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        take = _fullest(rest, size - longest)
        take[longest] = take.get(longest, 0) + 1
        times = min(left[x] // n for x, n in take.items())
        offset = 0
        for x, n in sorted(take.items(), reverse=True):
            out.append((x, used[x], used[x] + times * n, bins, n, offset))
            used[x] += times * n
            left[x] -= times * n
            offset += n * x
            if not left[x]:
                del left[x]
        bins += times
    return sorted(out)


def packed(parts: DataFrame, size: int = 2048, salts: int | None = None) -> DataFrame:
    """``parts`` (doc_id, piece, length and more) with sequence_id and offset."""
    parts = written(parts)
    salts = salts or max(16, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = written(dealt.groupBy("length", "__salt").agg(F.count("*").alias("n")))
    # at most one row for each length; what the driver gets does not grow
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = np.array(plan(counts, size), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    # both sides lie by (length, salt) already; a merge join broadcasts nothing
    numbered = dealt.withColumn("__own", F.row_number().over(own)).join(base.hint("merge"), ["length", "__salt"])
    numbered = numbered.select(*parts.columns, (F.col("__base") + F.col("__own") - 1).alias("__number"))
    names = parts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    # steps in order of (length, first) as one ascending key
    wide = int(steps[:, 2].max(initial=0)) + 1
    starts = steps[:, 0] * wide + steps[:, 1]

    def run(batches):
        for batch in batches:
            number = batch.column(len(names)).to_numpy()
            length = batch.column(names.index("length")).to_numpy()
            row = steps[np.searchsorted(starts, length * wide + number, side="right") - 1] if batch.num_rows else np.zeros((0, 6), np.int64)
            nth = number - row[:, 1]
            many = np.maximum(row[:, 4], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(row[:, 3] + nth // many), pa.array(row[:, 5] + nth % many * length)], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")
