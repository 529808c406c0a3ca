"""Shard plans, hashed placement, segment layout and rebalancing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import GOLDEN, _MOD, hash32
from ..types import u32_col


@dataclass(frozen=True)
class PlacementMap:
    pgs: int = 64
    replicas: int = 1
    targets: tuple[str, ...] = field(default=("0",))


def shard_by_hash(id_col: Column, shards: int) -> Column:
    return F.pmod(u32_col(id_col), F.lit(shards)).cast("int")


def shard_by_range(rows: DataFrame, shards: int) -> DataFrame:
    """Ids in order, dealt in turn."""
    return numbered(rows, "id").withColumn("shard", F.pmod("__n", F.lit(shards)).cast("int")).drop("__n")


def ranged(rows: DataFrame, by: str, parts: int | None = None) -> DataFrame:
    """Adds __p, the range that a number falls in; about equally many rows in
    each. The bounds are literals: a plan that is run twice deals alike."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    found = rows.agg(F.percentile_approx(F.col(by), shares, 10_000)).first()[0] if shares else None
    bounds = sorted(set(found or []))

    def at(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(by) <= F.lit(bounds[mid]), at(lo, mid)).otherwise(at(mid + 1, hi))

    return rows.withColumn("__p", at(0, len(bounds)))


def numbered(rows: DataFrame, by: str, parts: int | None = None) -> DataFrame:
    """Adds __n, the place (from 0) in the order of ``by``, a number: rows are
    dealt in ranges, ranges are counted, a row's number is its range's start
    and its place in the range. No task sorts all rows."""
    ranges = ranged(rows, by, parts)
    dealt = ranges.withColumn("__own", F.row_number().over(Window.partitionBy("__p").orderBy(by)))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__p").agg(F.count("*").alias("__c")).select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    # one row for each range
    return dealt.join(F.broadcast(starts), "__p").withColumn("__n", F.col("__s") + F.col("__own") - 1).drop("__p", "__own", "__s")


def shard_plan(rows: DataFrame, shards: int, kind: str = "hash") -> DataFrame:
    if kind == "hash":
        return rows.withColumn("shard", shard_by_hash(F.col("id"), shards))
    if kind == "range":
        return shard_by_range(rows, shards)
    raise ValueError(f"unknown shard plan {kind!r}")


def pg_of(id_col: Column, pgs: int) -> Column:
    return F.pmod(hash32(u32_col(id_col)), F.lit(pgs)) if pgs > 0 else F.lit(0).cast("long")


def primaries_of(pg: Column, m: PlacementMap) -> Column:
    """Places of the distinct targets of a placement group, first the primary.
    A target that is taken gives way to the next free one."""
    t = len(m.targets)
    if not t:
        return F.array().cast("array<int>")
    base = (pg * F.lit(GOLDEN)).bitwiseAND(_MOD - 1)
    picks = F.array().cast("array<int>")
    for r in range(min(max(1, m.replicas), t)):
        start = F.pmod(hash32((base + r).bitwiseAND(_MOD - 1)), F.lit(t)).cast("int")
        pick = start if not r else None
        if r:
            tried = [F.pmod(start + k, F.lit(t)).cast("int") for k in range(r + 1)]
            pick = F.coalesce(*(F.when(~F.array_contains(picks, c), c) for c in tried))
        picks = F.concat(picks, F.array(pick))
    return picks


def located(rows: DataFrame, m: PlacementMap) -> DataFrame:
    """Adds pg and primaries (target keys)."""
    names = F.array(*(F.lit(k) for k in m.targets)) if m.targets else F.array().cast("array<string>")
    df = rows.withColumn("pg", pg_of(F.col("id"), m.pgs)).withColumn("__at", primaries_of(F.col("pg"), m))
    return df.withColumn("primaries", F.transform("__at", lambda k: F.get(names, k))).drop("__at")


def row_bytes(meta_json: Column, dim: Column) -> Column:
    """Length of a row in a data segment: three numbers, metadata, floats."""
    return (F.lit(12) + F.octet_length(F.coalesce(meta_json, F.lit("null"))) + 4 * dim).cast("long")


#: Bytes before the first row of a segment.
SEGMENT_HEADER = 8


def segments(rows: DataFrame, segment_bytes: int) -> DataFrame:
    """``rows`` (pg, pos, bytes and more) with part, name suffix and offset.
    Rows of a group follow their order; where they begin beyond a multiple of
    the size, the next part begins. Every part is kept. Bytes are added up in
    ranges of positions inside a group, and ranges by one row each; no task
    sorts a whole group."""
    held = ranged(rows, "pos")
    before = Window.partitionBy("pg").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy("pg", "__p").agg(F.sum("bytes").alias("__b")).select("pg", "__p", F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("pg", "__p").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    df = held.withColumn("__own", F.coalesce(F.sum("bytes").over(own), F.lit(0))).join(bases, ["pg", "__p"])
    df = df.withColumn("__at", F.col("__base") + F.col("__own")).withColumn("part", F.floor(F.col("__at") / segment_bytes).cast("int"))
    first = Window.partitionBy("pg", "part")  # the rows of one segment
    df = df.withColumn("offset", F.lit(SEGMENT_HEADER) + F.col("__at") - F.min("__at").over(first))
    return df.withColumn("segment", F.concat(F.lit("pg"), "pg", F.lit(".part"), "part")).select(*rows.columns, "part", "offset", "segment")


def rebalance_plan(manifest: DataFrame, m: PlacementMap, by: str = "placement") -> DataFrame:
    """``manifest``: (name, target). Moves (name, source, target) that bring
    segments where ``m`` wants them. ``by``: placement (the primary that rows
    are located by) or plain (the older formula, one multiplication)."""
    pg = F.regexp_extract("name", "\\.pg([0-9]+)\\.", 1)
    df = manifest.withColumn("__pg", F.when(pg != "", pg.cast("long")))
    names = F.array(*(F.lit(k) for k in m.targets)) if m.targets else F.array(F.lit("0"))
    if by == "placement" and m.targets:
        at = F.get(primaries_of(F.col("__pg"), m), F.lit(0))
    else:
        at = F.pmod((F.col("__pg") * F.lit(GOLDEN)).bitwiseAND(_MOD - 1), F.lit(max(1, len(m.targets)))).cast("int")
    df = df.withColumn("wanted", F.get(names, at))
    return df.where("__pg is not null and wanted <> target").select("name", F.col("target").alias("source"), F.col("wanted").alias("target"))


def rebalanced(manifest: DataFrame, moves: DataFrame) -> DataFrame:
    """The manifest (name, target) after moves (name, source, target)."""
    to = moves.select("name", F.col("target").alias("__to"))
    return manifest.join(to, "name", "left").withColumn("target", F.coalesce("__to", "target")).drop("__to")


def move_segments(files, folders, moves: DataFrame, verify: bool = True, cleanup: bool = True, workers: int = 8) -> int:
    """Carries out moves of binary segments: each is copied aside and renamed,
    with ``verify`` read back and compared, and with ``cleanup`` its source
    goes last, so a move that breaks off can be run again. ``folders`` tells
    the folder of a target. Moves come to the driver a few at a time."""
    from concurrent.futures import ThreadPoolExecutor
    from itertools import islice

    def move(m) -> None:
        source, target = f"{folders(m.source)}/{m.name}", f"{folders(m.target)}/{m.name}"
        files.copy(source, target)
        if verify and files.read_bytes(source) != files.read_bytes(target):
            raise OSError(f"{target} differs from {source}")

    done, left = 0, moves.toLocalIterator()
    with ThreadPoolExecutor(workers) as pool:
        while some := list(islice(left, 64 * workers)):
            list(pool.map(move, some))
            for m in some if cleanup else ():
                files.delete(f"{folders(m.source)}/{m.name}")
            done += len(some)
    return done


def check_placement(manifest: DataFrame | None, m: PlacementMap, mode: str = "warn", by: str = "placement", apply=None, shown: int = 1000) -> dict:
    """ok, how many segments are misplaced, and the first ``shown`` moves;
    strict raises where one is misplaced, auto hands all moves to ``apply``. A
    manifest that can't be read counts as placed."""
    if mode not in ("warn", "strict", "auto"):
        raise ValueError(f"unknown mode {mode!r}")
    if manifest is None:
        return {"ok": True, "misplaced": 0, "plan": [], "moved": 0}
    moves = rebalance_plan(manifest, m, by)
    n = moves.count()
    if n and mode == "strict":
        raise RuntimeError(f"{n} segments are misplaced")
    plan = [r.asDict() for r in moves.orderBy("name").limit(shown).collect()] if n else []
    moved = apply(moves) if n and mode == "auto" and apply else 0
    return {"ok": not n or moved == n, "misplaced": n, "plan": plan, "moved": moved}
