"""Interpolated modified Kneser-Ney word model, counted in Spark.

The model lives as sorted hash arrays in a folder all machines mount; workers
memory-map them, so a machine holds one copy in its page cache however many
workers it runs. It is built from the top:

1. words: every partition counts its words, merges per bucket of the word
   hash; a bucket's sorted hashes number the words.
2. n-grams of the highest order: every partition counts them as numbers of
   words, merges per bucket. A bucket gives each shorter n-gram one count for
   every n-gram it ends (in how many contexts it occurs), and what follows it
   as a context; these are merged the same way, down to the words.

N-grams are dealt by the last word of their context; where that word is so
frequent that it would fill a bucket, by the whole context; where all words of
the context are, by the whole n-gram. What a context adds up to is added up
where the context lies as an n-gram of its own, so no key, however frequent, is
one task's alone; and a text's n-gram is the context of its next word, so one
search answers for both.

What moves between machines is arrays of distinct keys with their counts,
never one row an occurrence. The model grows with the corpus; nothing is cut.
Keys are 64-bit hashes of which a bucket keeps 32 bits after those its index of
places tells: 47 bits or more in all. Counts are bytes, larger ones stand aside
in 64 bits.

A text is its words and one end; before its first word are as many starts as a
context has words, which are never predicted. A word not in training gets the
share of the uniform distribution that interpolation leaves. Null and empty
texts are one end. Rows with a null id count as training rows, repeated rows
count repeatedly; other columns are left alone. An empty training table makes
the uniform model.
"""

from __future__ import annotations

import os
import pickle
import shutil
import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mounted_folder, slices, text_buffers
from .tokens import mix, word_hashes

#: Hashes that stand for the end and the start of a text.
END, START = np.uint64(0x51F15EEDC0FFEE01), np.uint64(0x57A2757A2757A275)
#: Tokens that a worker counts before it hands counts on: few enough that
#: three ranks of their words fit 63 bits.
CHUNK_TOKENS = 2_000_000
SLICE_BYTES = 8 << 20
#: Bytes of input, and tokens, that a bucket is meant for.
BUCKET_BYTES, BUCKET_TOKENS = 64 << 20, 4_000_000
MOST_BITS = 14
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "kind string, level int, bucket int, data binary"


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts.astype(np.uint64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts.astype(np.uint64), first)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Written aside and renamed: a task that runs twice does no harm."""
    os.makedirs(folder, exist_ok=True)
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}.npy"
    np.save(aside, array)
    os.replace(aside, f"{folder}/{name}.npy")


def _bits(n: int) -> int:
    return max(0, (n - 1).bit_length())


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


# ---- arrays on their way: by planes of bytes, which pack well


def _packed(a: np.ndarray) -> tuple:
    kind = np.min_scalar_type(int(a.max(initial=0)))
    a = a.astype(kind)
    data = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), kind.itemsize).T).tobytes()
    return kind.str, len(a), bytes(pa.compress(data, codec="zstd", asbytes=True)), len(data)


def _unpacked(x: tuple) -> np.ndarray:
    kind, n, data, size = x
    planes = np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, n).T).reshape(-1).view(kind).astype(np.uint64)


def _row(kind: str, level: int, bucket: int, arrays: list[np.ndarray]) -> tuple:
    return kind, level, bucket, pickle.dumps([_packed(a) for a in arrays])


def _dealt(kind: str, level: int, bucket: np.ndarray, arrays: list[np.ndarray]) -> list[tuple]:
    """One row for each bucket that occurs, with its part of each array."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(bucket) else np.zeros(0, int)
    return [_row(kind, level, int(bucket[order[i]]), [a[order[i:j]] for a in arrays]) for i, j in zip(cut, np.r_[cut[1:], len(bucket)])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["kind", "level", "bucket", "data"])


def _glued(table: pa.Table) -> list[np.ndarray]:
    parts = [[_unpacked(x) for x in pickle.loads(d.as_buffer())] for d in table.column("data")]
    return [np.concatenate(p) for p in zip(*parts)]


# ---- tables of a bucket: 32 bits of a key behind an index of places


def _save_table(folder: str, keys: np.ndarray, columns: dict[str, np.ndarray]) -> None:
    """``keys``: different hashes. Numbers above 254 stand aside."""
    order = np.argsort(keys)
    keys = keys[order]
    bits = max(0, _bits(len(keys)) - 3)
    shift = np.uint64(64 - bits) if bits else None
    place = (keys >> shift).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    _save(folder, "index", np.searchsorted(place, np.arange((1 << bits) + 1)).astype(np.uint32))
    _save(folder, "low", ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32))
    for name, x in columns.items():
        x = x[order].astype(np.uint64)
        aside = np.flatnonzero(x > 254)
        _save(folder, name, np.minimum(x, 255).astype(np.uint8))
        _save(folder, f"{name}_at", aside.astype(np.uint32))
        _save(folder, f"{name}_aside", x[aside])


class _Arrays:
    """The memory-mapped arrays of a model; one copy for each worker process."""

    open_: dict[str, _Arrays] = {}

    def __init__(self, shape: Shape):
        self.shape, self.maps = shape, {}
        self.starts = np.array(shape.bases, np.int64)

    @classmethod
    def of(cls, shape: Shape) -> _Arrays:
        if shape.folder not in cls.open_ or cls.open_[shape.folder].shape != shape:
            cls.open_.clear()
            cls.open_[shape.folder] = cls(shape)
        return cls.open_[shape.folder]

    def get(self, kind: str, bucket: int, name: str) -> np.ndarray | None:
        key = (kind, bucket, name)
        if key not in self.maps:
            path = f"{self.shape.folder}/{kind}{bucket:05d}/{name}.npy"
            self.maps[key] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.maps[key]

    def words(self, hashes: np.ndarray, names: tuple[str, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of sorted hashes: number (-1: unknown), and the columns ``names``."""
        number = np.full(len(hashes), -1, np.int64)
        out = [np.zeros(len(hashes), np.int64) for _ in names]
        bucket = _top(hashes, self.shape.bits)
        cut = np.searchsorted(bucket, np.arange((1 << self.shape.bits) + 1))
        for b in np.flatnonzero(np.diff(cut)):
            known = self.get("words", b, "hash")
            if known is None or not len(known):
                continue
            part = slice(cut[b], cut[b + 1])
            at = np.minimum(np.searchsorted(known, hashes[part]), len(known) - 1)
            hit = known[at] == hashes[part]
            number[part] = np.where(hit, self.starts[b] + at, -1)
            for x, name in zip(out, names):
                if (v := self.get("words", b, name)) is not None:
                    x[part] = np.where(hit, v[at], 0)
        return number, out

    def find(self, kind: str, bucket: np.ndarray, keys: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """The columns of keys in the tables of their buckets; 0 where a key
        isn't there. Keys are looked up in order, which the pages like."""
        out = [np.zeros(len(keys), np.int64) for _ in names]
        order = np.argsort((bucket.astype(np.uint64) << np.uint64(48)) | (keys >> np.uint64(16)))
        cut = np.searchsorted(bucket[order], np.arange((1 << self.shape.bits) + 1))
        for b in np.flatnonzero(np.diff(cut)):
            index = self.get(kind, b, "index")
            if index is None or not index[-1]:
                continue
            low = self.get(kind, b, "low")
            rows = order[cut[b] : cut[b + 1]]
            own, bits = keys[rows], _bits(len(index) - 1)
            place = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
            want = ((own << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            lo, hi = index[place].astype(np.int64), index[place + 1].astype(np.int64)
            end = hi
            for _ in range(_bits(int((hi - lo).max(initial=0)) + 1)):
                mid = (lo + hi) >> 1
                less = (low[np.minimum(mid, len(low) - 1)] < want) & (lo < hi)
                lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
            at = np.minimum(lo, len(low) - 1)
            hit = np.flatnonzero((lo < end) & (low[at] == want))
            at = at[hit]
            for x, name in zip(out, names):
                v = self.get(kind, b, name)[at].astype(np.int64)
                if len(big := np.flatnonzero(v == 255)):
                    aside = np.searchsorted(self.get(kind, b, f"{name}_at"), at[big])
                    v[big] = self.get(kind, b, f"{name}_aside")[aside].astype(np.int64)
                x[rows[hit]] = v
        return out


@dataclass(frozen=True)
class Shape:
    """What workers need besides the arrays. ``discounts``: of each order from
    1 on, for counts 1, 2 and more; ``grams``: different n-grams of order 2."""

    folder: str
    bits: int
    order: int = 3
    hot_from: int = 2**62
    bases: tuple[int, ...] = ()
    tokens: int = 0
    words: int = 0
    discounts: tuple[tuple[float, float, float], ...] = ()
    grams: int = 0
    rest: float = 1.0
    hot: np.ndarray | None = None

    def __eq__(self, other) -> bool:
        return (self.folder, self.discounts, self.hot_from) == (other.folder, other.discounts, other.hot_from)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = mix(h * _STEP + c.astype(np.uint64))
    return h


def _places(columns: list[np.ndarray], shape: Shape) -> np.ndarray:
    """The bucket of each n-gram of two words or more; of a word, its own."""
    if len(columns) == 1:
        return np.searchsorted(np.array(shape.bases), columns[0].astype(np.int64), side="right") - 1
    context = columns[:-1]
    by = _hash(context[-1:])
    if shape.hot is not None and len(shape.hot):
        hot = [np.isin(c, shape.hot) for c in context]
        rows = np.flatnonzero(hot[-1])
        by[rows] = _hash([c[rows] for c in context])
        rows = np.flatnonzero(np.logical_and.reduce(hot))
        by[rows] = _hash([c[rows] for c in columns])
    return _top(mix(by), shape.bits)


def _keyed(ranks: list[np.ndarray], width: int) -> np.ndarray | None:
    """One number for each n-gram, in order of the last context word, which
    packs best; None if 63 bits are too few."""
    n = len(ranks)
    if n * width > 63:
        return None
    key = np.zeros(len(ranks[0]), np.uint64)
    for k in _order(n):
        key <<= np.uint64(width)
        key |= ranks[k].astype(np.uint64)
    return key


def _order(n: int) -> list[int]:
    return [n - 2, *range(n - 2), n - 1] if n > 1 else [0]


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _counted(ranks: list[np.ndarray], known: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different n-grams and how often each occurs."""
    width = _bits(max(2, len(known)))
    key = _keyed(ranks, width)
    if key is None:
        return _summed([known[r] for r in ranks], [np.ones(len(ranks[0]), np.uint64)])
    key.sort()
    first = _starts([key])
    times = np.diff(np.r_[first, len(key)])
    key, mask, out = key[first], np.uint64((1 << width) - 1), [None] * len(ranks)
    for k in reversed(_order(len(ranks))):
        out[k] = known[(key & mask).astype(np.int64)]
        key >>= np.uint64(width)
    return out, times.astype(np.uint64)


def _summed(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple:
    """Different n-grams in the same order, and the sums of their values."""
    n = len(columns)
    known = np.unique(np.concatenate([np.unique(c) for c in columns]))
    ranks = [np.searchsorted(known, c) for c in columns]
    key = _keyed(ranks, _bits(max(2, len(known))))
    order = np.lexsort([ranks[k] for k in reversed(_order(n))]) if key is None else np.argsort(key)
    columns = [c[order] for c in columns]
    first = _starts(columns)
    sums = [np.add.reduceat(v[order].astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64) for v in values]
    return [c[first] for c in columns], *sums


def _texts(batches, size: int = SLICE_BYTES):
    """Word hashes of slices of a partition: rows, their hashes, where each
    text's hashes begin."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in slices(offsets, size):
            h, docs = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield batch, lo, hi, h, docs


def _with_ends(h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, each closed by an end, and where texts begin."""
    return np.insert(h, docs[1:], END), docs + np.arange(len(docs))


def _histories(tokens: np.ndarray, docs: np.ndarray, start, order: int) -> list[np.ndarray]:
    """The tokens and those before them, the farthest first; before a text's
    first there are starts."""
    out = [tokens]
    for _ in range(order - 1):
        prev = np.empty_like(tokens)
        prev[1:] = out[0][:-1]
        prev[docs[:-1]] = start
        out.insert(0, prev)
    return out


def _discounts(n) -> tuple[float, float, float]:
    """Modified Kneser-Ney's three discounts from the counts of counts 1 to 4;
    counts too few to tell fall back to the plain one of a half."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.0), k) for k, d in zip((1.0, 2.0, 3.0), found))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _tally(level: int, counts: np.ndarray) -> tuple:
    return _row("tally", level, -1, [np.array([int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(counts)])])


#: What follows an n-gram as a context: the sum of counts, and how many
#: different words do once, twice and more often.
_CONTEXT = ("total", "once", "twice", "more")


def _merged(table: pa.Table, shape: Shape) -> pa.Table:
    """What a bucket's rows add up to: saved, and handed on to the next lower
    order. ``grams`` rows hold n-grams and counts, ``contexts`` rows n-grams
    and what follows them."""
    level, bucket = table.column("level")[0].as_py(), table.column("bucket")[0].as_py()
    kinds = table.column("kind").to_pylist()
    if bucket < 0:
        tallies = _glued(table)[0]
        return pa.Table.from_batches([_batch([_row("tally", level, -1, [tallies.reshape(-1, 5).sum(axis=0)])])])
    parts = {k: _glued(table.filter(pa.array([x == k for x in kinds]))) for k in set(kinds)}
    grams, follow = parts.get("grams"), parts.get("contexts")
    zeros = lambda p, n: [np.zeros(len(p[0]), np.uint64)] * n
    if follow is None:
        columns, counts = _summed(grams[:level], grams[level:])
        after = []
    else:
        rows = [] if grams is None else [[*grams, *zeros(grams, 4)]]
        rows.append([*follow[:level], *zeros(follow, 1), *follow[level:]])
        both = [np.concatenate(x) for x in zip(*rows)]
        columns, counts, *after = _summed(both[:level], both[level:])
    out = [_tally(level, counts[counts > 0])]
    if level == 1:
        at = f"{shape.folder}/words{bucket:05d}"
        size = len(np.load(f"{at}/hash.npy", mmap_mode="r"))
        for name, x in zip(("cont", *_CONTEXT), (counts, *after)):
            whole = np.zeros(size, np.uint64)
            whole[columns[0].astype(np.int64) - shape.bases[bucket]] = x
            _save(at, name, whole.astype(np.min_scalar_type(int(whole.max(initial=0)))))
    else:
        _save_table(f"{shape.folder}/grams{level}-{bucket:05d}", _hash(columns), dict(zip(("count", *_CONTEXT), (counts, *after))))
        real = np.flatnonzero(counts)
        columns, counts = [c[real] for c in columns], counts[real]
        shorter, times = _summed(columns[1:], [np.ones(len(counts), np.uint64)])
        out += _dealt("grams", level - 1, _places(shorter, shape), [*shorter, times])
        context = columns[:-1]  # n-grams lie in its order
        first = _starts(context)
        sums = [np.add.reduceat(x.astype(np.uint64), first) if len(first) else x for x in (counts, counts == 1, counts == 2, counts > 2)]
        context = [c[first] for c in context]
        out += _dealt("contexts", level - 1, _places(context, shape), [*context, *sums])
    return pa.Table.from_batches([_batch(out)])


class KneserNey:
    """``fit`` on a text column, ``score`` texts, ``close`` when done."""

    def __init__(self, shape: Shape):
        self.shape = shape

    # ---- training

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", model_dir: str | None = None, buckets: int | None = None, order: int = 3) -> KneserNey:
        """``order``: words of the longest n-gram, 2 or more. ``buckets``
        (rounded up to a power of two): unset, by the size of the input."""
        if order < 2:
            raise ValueError("the order has to be 2 or more")
        spark = docs.sparkSession
        folder = f"{model_dir}/{uuid.uuid4().hex}" if model_dir else mounted_folder(spark)
        os.makedirs(folder, exist_ok=True)
        docs = docs.select(F.col(text).alias("text"))
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        bits = min(MOST_BITS, _bits(buckets or max(64, -(-min(size, 1 << 60) // BUCKET_BYTES))))
        cleaned = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = spark.conf.get(cleaned, None)
        spark.conf.set(cleaned, "true")  # a step's shuffle files go when its tables are written
        model = None
        try:
            model = cls(cls._words(docs, folder, bits, order))
            model.shape = cls._grams(docs, model.shape)
            return model
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        finally:
            spark.conf.unset(cleaned) if was is None else spark.conf.set(cleaned, was)

    @staticmethod
    def _words(docs: DataFrame, folder: str, bits: int, order: int) -> Shape:
        def count(batches):
            held, size = [], 0

            def flush():
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                return _batch(_dealt("words", 0, _top(keys, bits), [keys, counts]))

            for _, _, _, h, docs_at in _texts(batches):
                n = len(docs_at) - 1
                held += [h, np.full(n, END, np.uint64), np.full(n, START, np.uint64)]
                size += len(h) + 2 * n
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held, size = [], 0
            if size:
                yield flush()

        def merge(table):
            b = table.column("bucket")[0].as_py()
            keys, counts = _sum_by_key(*_glued(table))
            at = f"{folder}/words{b:05d}"
            _save(at, "hash", keys)
            _save(at, "count", counts)
            real = counts[keys != START]
            return pa.table({"bucket": pa.array([b], pa.int32()), "n": [len(keys)], "words": [len(real)], "tokens": [int(real.sum())]})

        rows = docs.mapInArrow(count, _ROWS).groupBy("bucket").applyInArrow(merge, "bucket int, n long, words long, tokens long").collect()
        sizes = np.zeros(1 << bits, np.int64)
        for r in rows:
            sizes[r.bucket] = r.n
        tokens = sum(r.tokens for r in rows)
        hot_from = max(1, tokens >> (bits + 2))
        bases = tuple(int(x) for x in np.r_[0, np.cumsum(sizes)[:-1]])
        # at most four words for each bucket are that frequent
        hot = []
        for r in rows:
            counts = np.load(f"{folder}/words{r.bucket:05d}/count.npy", mmap_mode="r")
            hot += (np.flatnonzero(counts >= hot_from) + bases[r.bucket]).tolist()
        return Shape(folder, bits, order, hot_from, bases, tokens, sum(r.words for r in rows), hot=np.array(sorted(hot), np.uint64))

    @staticmethod
    def _grams(docs: DataFrame, shape: Shape) -> Shape:
        order = shape.order

        def count(batches):
            held, size, arrays = [], 0, _Arrays.of(shape)
            start = arrays.words(np.array([START]))[0]  # its number

            def flush():
                ids = np.concatenate([now for now, _ in held])
                before = np.cumsum([0, *(len(now) for now, _ in held)])
                docs_at = np.concatenate([*(at[:-1] + n for (_, at), n in zip(held, before)), before[-1:]])
                known, ranks = np.unique(np.r_[ids, start], return_inverse=True)
                columns, counts = _counted(_histories(ranks[:-1], docs_at, ranks[-1], order), known.astype(np.uint64))
                return _batch(_dealt("grams", order, _places(columns, shape), [*columns, counts]))

            for _, _, _, h, docs_at in _texts(batches, SLICE_BYTES // 2):
                tokens, at = _with_ends(h, docs_at)
                seen, inverse = np.unique(tokens, return_inverse=True)
                held.append((arrays.words(seen)[0][inverse], at))
                size += len(tokens)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held, size = [], 0
            if size:
                yield flush()

        rows = docs.mapInArrow(count, _ROWS)
        for _ in range(order):
            rows = rows.groupBy("level", "bucket").applyInArrow(lambda t: _merged(t, shape), _ROWS)
        tallies = rows.where("bucket < 0").groupBy("level", "bucket").applyInArrow(lambda t: _merged(t, shape), _ROWS)
        counts = {r.level: _unpacked(pickle.loads(r.data)[0]) for r in tallies.collect()}
        none = np.zeros(5, np.uint64)
        discounts = tuple(_discounts(counts.get(k, none)[:4]) for k in range(1, order + 1))
        grams, words = int(counts.get(2, none)[4]), counts.get(1, none).astype(np.int64)
        rest = sum(d * n for d, n in zip(discounts[0], (words[0], words[1], words[4] - words[0] - words[1]))) / grams if grams else 1.0
        return replace(shape, discounts=discounts, grams=grams, rest=float(rest))

    # ---- scoring

    def score(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """The columns ``keep``, n_tokens, n_known, base_score (log10
        probability under the word counts smoothed by a half) and score
        (under this model)."""
        shape = self.shape
        held = [f"k{i}" for i in range(len(keep))]
        kinds = [docs.schema[k].dataType.simpleString() for k in keep]
        rows = docs.select(*(F.col(k).alias(h) for k, h in zip(keep, held)), F.col(text).alias("text"))
        schema = ", ".join([*(f"{h} {t}" for h, t in zip(held, kinds)), "n_tokens long, n_known long, base_score double, score double"])
        done = rows.mapInArrow(lambda batches: _scores(batches, shape, held), schema)
        return done.select(*(F.col(h).alias(k) for k, h in zip(keep, held)), "n_tokens", "n_known", "base_score", "score")

    def close(self) -> None:
        shutil.rmtree(self.shape.folder, ignore_errors=True)


def _raised(p: np.ndarray, times: np.ndarray, follow: list[np.ndarray], d: tuple[float, float, float]) -> None:
    """``p``, the probabilities of the next lower order, interpolated with the
    counts of n-grams, where something follows their contexts."""
    rows = np.flatnonzero(follow[0])
    total, *kinds = (x[rows] for x in follow)
    times = times[rows]
    p[rows] = (times - _discount(times, d) + sum(x * n for x, n in zip(d, kinds)) * p[rows]) / total


def _scores(batches, shape: Shape, held: list[str]):
    arrays = _Arrays.of(shape)
    N, V = shape.tokens, shape.words
    uniform = 1.0 / (V + 1)
    # what follows the starts before a text, for each length of context
    start = arrays.words(np.array([START]))[0].astype(np.uint64)
    begin = {k: arrays.find(f"grams{k}-", _places([start] * k, shape), _hash([start] * k), _CONTEXT) for k in range(2, shape.order)} if shape.grams else {}
    for batch, lo, hi, h, docs in _texts(batches):
        tokens, at = _with_ends(h, docs)
        seen, inverse = np.unique(np.r_[tokens, START], return_inverse=True)
        number, (count, cont, *follow) = arrays.words(seen, ("count", "cont", *_CONTEXT))
        word = (cont - _discount(cont, shape.discounts[0])) / shape.grams + shape.rest * uniform if shape.grams else np.full(len(seen), uniform)
        base = np.log10((count + 0.5) / (N + 0.5 * (V + 1)))
        now, ends = inverse[:-1], at[1:]
        p = word[now]
        if shape.grams:
            history = _histories(now, at, inverse[-1], shape.order)
            ids = number.astype(np.uint64)
            known = number[now] >= 0
            after = [x[history[-2]] for x in follow]
            for level in range(2, shape.order + 1):
                # an n-gram whose context was never followed isn't there
                rows = np.flatnonzero(known & (after[0] > 0))
                columns = [ids[c[rows]] for c in history[-level:]]
                names = ("count", *_CONTEXT) if level < shape.order else ("count",)
                got = arrays.find(f"grams{level}-", _places(columns, shape), _hash(columns), names)
                found = [np.zeros(len(now), np.int64) for _ in names]
                for x, v in zip(found, got):
                    x[rows] = v
                _raised(p, found[0], after, shape.discounts[level - 1])
                if level < shape.order:  # the n-gram that ends a word before is the next context
                    after = [np.r_[np.int64(0), x[:-1]] for x in found[1:]]
                    for x, v in zip(after, begin[level]):
                        x[at[:-1]] = v[0]
        known = np.r_[0, np.cumsum(count[now] > 0)]
        logs, bases = np.log10(p), base[now]
        out = {k: batch.column(batch.schema.get_field_index(k)).slice(lo, hi - lo) for k in held}
        out |= {"n_tokens": np.diff(at), "n_known": known[ends] - known[at[:-1]], "base_score": np.add.reduceat(bases, at[:-1]), "score": np.add.reduceat(logs, at[:-1])}
        yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})
