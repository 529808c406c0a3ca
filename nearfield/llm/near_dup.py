"""Near-duplicate documents by MinHash with odd sketches.

Every text's set of word shingles gives a MinHash signature. The signature is
used twice: in bands, whose equal keys bring candidates together, and folded
into an odd sketch, a bitmap of parities; the bits in which two sketches
differ tell a high similarity within a few hundredths. Candidates that the
sketches don't rule out (six standard errors below the threshold) are
confirmed on the full sets, so what is linked is exact.

No list of all pairs of a group is made:

* texts with equal sets are one class; its smallest id stands for it;
* in each band bucket documents are tied to the bucket's smallest id only.
  Ties that the sketches don't rule out make families;
* a family meets with its full sets, in tiles of ``TILE`` documents if it is
  large, the first and the last of the family in each; a tile gives the edges of
  a spanning forest of its links, never more than it has documents. What is not
  tied to the family's largest part then (mostly nothing) meets all of the
  family, in tiles of ``TILE`` by ``TILE``;
* what shares a bucket without being in one family is compared by sketches,
  and pairs that may be similar are confirmed. Each bucket gives the most
  similar ones of every two families, 64 at first; rounds with ever more
  follow until no bucket holds any back.

With 32 bands of 4 a pair at the threshold 0.8 meets in some band but for
one case in 2 * 10^7.

Null and empty texts have empty sets and link with nothing; a text shorter
than a shingle is one shingle. Repeated rows are copies of each other. Rows
without an id take no part (their component is null, they are kept). Ids are
unique otherwise: of rows with one id but several texts one text counts. Other
columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, text_buffers, written
from .tokens import mix, word_hashes
from .url_filter import Bloom, fill

TILE = 512
#: Most bits of the filter that picks texts before they move.
FILTER_BITS = 1 << 26
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    """``threshold``: intersection over union, in hundredths."""

    shingle: int = 5
    threshold: int = 80
    bands: int = 32
    rows: int = 4
    sketch_bits: int = 512
    seed: int = 7

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def most_differing(self) -> int:
        """Sketch bits in which two sets at the threshold hardly ever differ
        more: those expected six standard errors below it, and a margin."""
        s = self.threshold / 100
        low = max(0.0, s - 6 * math.sqrt(s * (1 - s) / self.samples))
        z = self.sketch_bits
        return math.ceil(z / 2 * (1 - math.exp(-4 * self.samples * (1 - low) / z)) + 3 * math.sqrt(z) / 4)


def shingle_hashes(h: np.ndarray, docs: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted set of shingles of each document."""
    n = len(h)
    rolled = np.full(max(0, n - k + 1), np.uint64(k), np.uint64)
    for i in range(k):
        rolled = mix(rolled * _STEP + h[i : n - k + 1 + i])
    out = []
    for lo, hi in zip(docs[:-1], docs[1:]):
        if hi - lo >= k:
            out.append(np.unique(rolled[lo : hi - k + 1]))
        elif hi > lo:
            one = np.uint64(hi - lo)
            for x in h[lo:hi]:
                one = mix(np.array([one * _STEP + x], np.uint64))[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(column: pa.Array, k: int):
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets, 4 << 20):
        with np.errstate(over="ignore"):
            h, docs = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield lo, hi, shingle_hashes(h, docs, k)


def _signatures(batches, p: Params):
    odd = mix(np.arange(1, p.samples + 1, dtype=np.uint64) * _STEP + np.uint64(p.seed)) | np.uint64(1)
    place = np.arange(p.samples, dtype=np.uint64) * _STEP
    weight = mix(place + np.uint64(11)).reshape(p.bands, p.rows) | np.uint64(1)
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, sets in _sets(batch.column(1), p.shingle):
            low = np.zeros((hi - lo, p.samples), np.uint64)
            d1, d2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    low[i] = np.min([np.multiply.outer(odd, s[j : j + 8192]).min(axis=1) for j in range(0, len(s), 8192)], axis=0)
                    d1[i], d2[i] = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s))
            keys = mix((low.reshape(-1, p.bands, p.rows) * weight).sum(axis=2, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64))
            bit = (mix(low + place) % np.uint64(p.sketch_bits)).astype(np.int64)
            odds = np.bincount((bit + np.arange(hi - lo)[:, None] * p.sketch_bits).ravel(), minlength=(hi - lo) * p.sketch_bits) & 1
            sketch = np.packbits(odds.astype(np.uint8).reshape(hi - lo, -1), axis=1, bitorder="little").view(np.int64)
            rows = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), rows(sketch), rows(keys)],
                names=["doc_id", "n_shingles", "d1", "d2", "sketch", "bands"],
            )


def _confirm(batches, p: Params):
    for batch in batches:
        a, b = ([s for _, _, sets in _sets(batch.column(k), p.shingle) for s in sets] for k in (2, 3))
        both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], np.int64)
        every = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64) - both
        linked = (100 * both >= p.threshold * every) & (every > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["hi", "lo", "linked"])


def _across(table: pa.Table, p: Params, most: int) -> pa.Table:
    """Pairs of one tile that lie in different families and may be similar: of
    every two families the ``most`` with the fewest differing bits."""
    of = lambda name: table.column(name).to_numpy()
    ids, comps, n, side = of("doc_id"), of("comp"), of("n_shingles"), of("side")
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).view(np.uint64)
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    found = []
    step = max(1, (1 << 21) // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        i, j = np.nonzero((comps[rows][:, None] != comps[right]) & (ids[rows][:, None] > ids[right]) if (side == 3).all() else comps[rows][:, None] != comps[right])
        i, j = rows[i], right[j]
        fit = 100 * np.minimum(n[i], n[j]) >= p.threshold * np.maximum(n[i], n[j])
        i, j = i[fit], j[fit]
        differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        fit = differ <= p.most_differing()
        found.append((i[fit], j[fit], differ[fit]))
    i, j, differ = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    hi, lo = np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])
    c1, c2 = np.maximum(comps[i], comps[j]), np.minimum(comps[i], comps[j])
    order = np.lexsort((lo, hi, differ, c2, c1))
    hi, lo, c1, c2 = hi[order], lo[order], c1[order], c2[order]
    new = np.r_[True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])] if len(hi) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(hi)])
    rank = np.arange(len(hi)) - np.repeat(first, size)
    keep = rank < most
    return pa.table({"hi": hi[keep], "lo": lo[keep], "more": np.repeat(size > most, size)[keep]})


def _tile(p: Params, most: int):
    return lambda table: _across(table, p, most)


def _links(table: pa.Table, p: Params) -> pa.Table:
    """A spanning forest of the exact links in one tile of a family. A
    document is compared with those it isn't connected with yet, all at once:
    a mark for each of its shingles, summed over the others' shingle lists.
    ``comp`` tells what is connected already."""
    every, sides = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
    ids, first, row = np.unique(every, return_index=True, return_inverse=True)  # repeated rows are one
    side = np.zeros(len(ids), sides.dtype)
    np.bitwise_or.at(side, row, sides)
    texts = table.column("text").combine_chunks().take(pa.array(first))
    sets = [s for _, _, part in _sets(texts, p.shingle) for s in part]
    n = np.array([len(s) for s in sets], np.int64)
    known, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    at = np.r_[0, np.cumsum(n)]
    up = np.unique(table.column("comp").to_numpy()[first], return_inverse=True)[1]
    mark, out = np.zeros(len(known), np.int32), []
    for i in np.flatnonzero((side & 1) & (n > 0)):
        other = (up != up[i]) & (side & 2 > 0) & (100 * np.minimum(n, n[i]) >= p.threshold * np.maximum(n, n[i]))
        rows = np.flatnonzero(other)
        if not len(rows):
            continue
        mark[flat[at[i] : at[i + 1]]] = 1
        width = n[rows]
        begin = np.r_[0, np.cumsum(width)[:-1]]
        places = np.arange(width.sum()) + np.repeat(at[rows] - begin, width)
        both = np.add.reduceat(mark[flat[places]], begin)
        mark[flat[at[i] : at[i + 1]]] = 0
        for j in rows[100 * both >= p.threshold * (n[rows] + n[i] - both)]:
            if up[j] != up[i]:
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                up[up == up[j]] = up[i]
    return pa.table({"hi": pa.array([int(x) for x, _ in out], pa.int64()), "lo": pa.array([int(x) for _, x in out], pa.int64())})


def _forest(p: Params):
    return lambda table: _links(table, p)


def _tiled(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """Deals groups out in tiles: adds ti, tj and the side a row is on (1, 2,
    or 3 where both are one)."""
    tiles = F.ceil(F.col(size) / TILE).cast("int")
    rest = [c for c in rows.columns if c not in by]
    dealt = rows.withColumn("__own", F.pmod(F.xxhash64("doc_id"), tiles).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    side = F.when(F.col("__own") == F.col("__other"), 3).when(F.col("__own") < F.col("__other"), 1).otherwise(2)
    return dealt.select(*by, F.least("__own", "__other").alias("ti"), F.greatest("__own", "__other").alias("tj"), side.alias("side"), *rest)


def _family_links(docs: DataFrame, family: DataFrame, p: Params) -> DataFrame:
    """(doc_id, comp) by the exact links inside families (doc_id, family). A
    text moves once, and the two that lead a family to each of its tiles; only
    what these leave apart moves again."""
    forest = "hi long, lo long"
    groups = family.groupBy("family").agg(F.count("*").alias("size"), F.max("doc_id").alias("last"))
    sized = written(family.join(groups, "family"))
    texts = written(picked(docs, sized))
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), tiles).cast("int")
    leads = (F.col("doc_id") == F.col("family")) | (F.col("doc_id") == F.col("last"))
    met = texts.select("family", F.explode(F.when(leads, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(own))).alias("tile"), F.lit(3).alias("side"), "doc_id", F.col("doc_id").alias("comp"), "text")
    edges = written(met.groupBy("family", "tile").applyInArrow(_forest(p), forest))
    comp = components(edges)

    # families of several tiles that are still in parts
    tied = sized.where(F.col("size") > TILE).join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    parts = written(tied.groupBy("family", "comp").agg(F.count("*").alias("n")))
    apart = parts.groupBy("family").agg(F.max_by("comp", "n").alias("main"), F.count("*").alias("parts"), (F.sum("n") - F.max("n")).alias("rest")).where("parts > 1")
    apart = written(apart)
    if not apart.head(1):
        return comp
    open_ = written(tied.join(apart, "family"))
    rows = texts.select("doc_id", "text").join(open_, "doc_id")
    others = F.ceil(F.col("rest") / TILE).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = ["doc_id", "comp", "text"]
    left = rows.where("comp <> main").select("family", F.pmod(F.xxhash64("doc_id"), others).cast("int").alias("ti"), every(tiles).alias("tj"), F.lit(1).alias("side"), *held)
    right = rows.select("family", every(others).alias("ti"), own.alias("tj"), F.lit(2).alias("side"), *held)
    more = left.union(right).groupBy("family", "ti", "tj").applyInArrow(_forest(p), forest)
    return components(edges.union(more))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, comp) of every node of ``edges`` (hi, lo with hi > lo): the
    smallest id that it is connected with. Large-star and small-star steps,
    each a few aggregations over the edges that are left."""
    e = written(edges.select("hi", "lo").distinct())
    mark = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first()
    was = mark(e)
    while was[0]:
        both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both.hi == least.u).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        joined = large.join(least, large.hi == least.u)
        small = joined.select("hi", F.col("m").alias("lo")).union(joined.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        e = written(small)
        now = mark(e)
        if now == was:
            break
        was = now
    return e.groupBy(F.col("hi").alias("doc_id")).agg(F.min("lo").alias("comp"))


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after more links: only what the links tie together is looked
    at again, each component as one node."""
    one, two = (comp.select(F.col("doc_id").alias(k), F.col("comp").alias(f"{k}_comp")) for k in ("hi", "lo"))
    ends = links.join(one, "hi", "left").join(two, "lo", "left").select(F.coalesce("hi_comp", "hi").alias("x"), F.coalesce("lo_comp", "lo").alias("y"))
    up = components(ends.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")))
    moved = comp.join(up.select(F.col("doc_id").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("doc_id", F.coalesce("new", "comp").alias("comp"))
    return moved.union(up)


def _keys(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * _STEP
    return np.stack([mix(h), mix(h + np.uint64(1)) | np.uint64(1)], axis=1)


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with an id among ``ids``. A Bloom filter of at
    most ``FILTER_BITS`` goes to the texts first, so few others move."""
    bits = min(max(64, 12 * ids.count()), FILTER_BITS)

    known = Bloom(bits, 4)
    fill(known, ids.select("doc_id"), lambda batch: _keys(batch.column(0).to_numpy()))

    def run(batches):
        for batch in batches:
            id_ = batch.column(0)
            yield batch.filter(pa.array(known.holds(_keys(id_.fill_null(0).to_numpy()), 0) & id_.is_valid().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, "doc_id long, text string").join(ids, "doc_id")


def confirmed(docs: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """(hi, lo, linked) of pairs, from their whole texts."""
    ids = written(pairs.select(F.explode(F.array("hi", "lo")).alias("doc_id")).distinct())
    texts = written(picked(docs, ids).dropDuplicates(["doc_id"]))
    one, two = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"{k}_text")) for k in ("hi", "lo"))
    rows = pairs.join(one, "hi").join(two, "lo").select("hi", "lo", "hi_text", "lo_text")
    return written(rows.mapInArrow(lambda b: _confirm(b, p), "hi long, lo long, linked boolean"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.
    Ids are unique, but for rows that repeat as a whole."""
    with Scratch(docs.sparkSession) as scratch:
        return _near_duplicates(docs, id_col, text_col, params, scratch)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, p: Params, scratch: Scratch) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = scratch.keep(written(docs.mapInArrow(lambda b: _signatures(b, p), "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>, bands array<long>")))
    filled = sig.where("n_shingles > 0 and doc_id is not null")
    classes = written(filled.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("size")).where("size > 1")
    hits = written(keyed.join(shared, "key"))
    lite = written(reps.select("doc_id", "n_shingles", "sketch").join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))

    # families: ties to the leading ids of buckets that sketches don't rule out
    ties = hits.where("doc_id > lead").select(F.col("doc_id").alias("hi"), F.col("lead").alias("lo")).distinct()
    differ = F.aggregate(F.zip_with("hi_s", "lo_s", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    for k in ("hi", "lo"):
        ties = ties.join(lite.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_s")), k)
    fits = 100 * F.least("hi_n", "lo_n") >= p.threshold * F.greatest("hi_n", "lo_n")
    family = components(ties.where(fits & (differ <= p.most_differing())))
    family = family.select("doc_id", F.col("comp").alias("family"))
    family = written(family.union(family.select(F.col("family").alias("doc_id"), "family").distinct()))
    comp = written(_family_links(docs, family, p))

    # pairs in one bucket but not in one family
    own = F.coalesce("family", "doc_id")
    of = hits.join(family, "doc_id", "left").select("key", "size", "doc_id", own.alias("comp"))
    split = of.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    apart = written(of.join(split, "key").join(lite, "doc_id"))
    judged, most = None, 64
    while True:
        dealt = _tiled(apart, ["key"], "size")
        pairs = dealt.groupBy("key", "ti", "tj").applyInArrow(_tile(p, most), "hi long, lo long, more boolean").groupBy("hi", "lo").agg(F.max("more").alias("more"))
        pairs = written(pairs if judged is None else pairs.join(judged, ["hi", "lo"], "left_anti"))
        found = pairs.agg(F.count("*").alias("n"), F.max("more").alias("more")).first()
        if found["n"]:
            fresh = confirmed(docs, pairs.select("hi", "lo"), p)
            judged = fresh.select("hi", "lo") if judged is None else judged.union(fresh.select("hi", "lo"))
            if fresh.where("linked").head(1):
                comp = written(merged(comp, fresh.where("linked")))
        if not found["more"]:
            break
        most *= 16

    scratch.keep(classes)
    scratch.keep(comp)
    member = sig.join(classes, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    out = member.join(comp.withColumnRenamed("doc_id", "rep"), "rep", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with
    the smallest id. Rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, params).where("not kept").select(F.col("doc_id").alias("__nf_id"))
    rest = docs.join(gone, docs[id_col].cast("long") == gone["__nf_id"], "left_anti")
    once = rest.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return once.unionByName(rest.where(F.col(id_col).isNull()))
