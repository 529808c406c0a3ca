"""Navigable small-world graphs, one for each shard.

A graph is built from one shard's rows in a grouped Arrow function and kept as
one binary row. Searching sends every query to every shard's graph and merges
the shards' best; shards are of bounded size, so a task holds one graph.

Rows count as inserted in order of position; levels come from a hash of seed
and id, so a rebuild gives the same graph. A row links to the nearest M of those
before it, neighbour lists keep the nearest. Those M are found by matrix products
over the shard, which is what a walk as wide as the shard finds; many queries
walk a graph in step. Both are a hundredth of the work of walks one by one.
"""

from __future__ import annotations

import heapq
import io
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import np_pair_scores, query_vector
from ..types import HnswParams, Metric
from ..sources.scratch import materialised
from .search import top_per_query

#: Rows of a graph. Larger graphs would make fewer walks, but miss more: on vectors
#: without clusters a walk of 50 finds 0.93 of the nearest among 4,096 rows, 0.80
#: among 18,700.
SHARD_ROWS = 4096
#: Kinds of rows that meet in a search.
GRAPH, QUERY, DELETED, ALLOWED = range(4)


@dataclass(frozen=True)
class Control:
    """How a search walks. ``mask``: ids that may be hits. hard: others are
    not entered; soft: up to ``bridge_budget`` others are passed through."""

    mode: str = "none"
    mask: tuple[int, ...] | None = None
    bridge_budget: int = 32
    seeds: int | str = "auto"
    adaptive_ef: dict | None = None
    early_stop_margin: float | None = None


def num_seeds(n: int, seeds: int | str = "auto") -> int:
    if n <= 0:
        return 1
    if seeds == "auto":
        return min(8, max(1, math.isqrt(n)))
    return min(32, max(1, int(seeds)))


def effective_ef(ef: int, control: Control) -> int:
    """Adaptive: base times the root of the mask's size, between bounds."""
    a = control.adaptive_ef
    if not a or control.mask is None:
        return ef
    return int(min(max(math.floor(a.get("base", ef) * math.sqrt(len(control.mask))), a.get("min", 1)), a.get("max", 10**9)))


def _unit(seed: int, ids: np.ndarray) -> np.ndarray:
    """A number in (0, 1] for each id."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


#: Nodes that a step of many walks opens in each beam.
WIDE = 4
_LAST = (1 << 30) - 1


def _keys(scores: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Numbers above 0 in the order of the scores; of equal ones, the first
    node is the greatest. Bit 0 is left to the caller."""
    bits = (scores + np.float32(0)).view(np.int32).astype(np.int64)
    high = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) + (1 << 31)
    return high << 31 | (_LAST - nodes) << 1


def _nodes(keys: np.ndarray) -> np.ndarray:
    return _LAST - (keys >> 1 & _LAST)


@dataclass
class Layer:
    """Neighbours of a level's nodes; short lists are filled with the node."""

    nodes: np.ndarray
    near: np.ndarray

    def of(self, n):
        return self.near[np.searchsorted(self.nodes, n)] if len(self.nodes) < self.nodes[-1] + 1 else self.near[n]

    def links(self) -> np.ndarray:
        return self.near != self.nodes[:, None]


@dataclass
class Graph:
    params: HnswParams
    metric: Metric
    ids: np.ndarray
    x: np.ndarray
    levels: np.ndarray
    layers: list[Layer] = field(default_factory=list)
    entry: int = -1

    def __post_init__(self) -> None:
        # walks compare scores only; a scale keeps them in range
        self.scale = 2.0 ** -math.frexp(float(np.abs(self.x).max(initial=0, where=np.isfinite(self.x))) or 1.0)[1]
        self.w = self._walked(self.x)

    def _walked(self, x: np.ndarray) -> np.ndarray:
        w = np.where(np.isfinite(x), x, 0).astype(np.float64) * self.scale
        return np.clip(w, -1e15, 1e15).astype(np.float32)

    def near(self, q: np.ndarray, nodes) -> np.ndarray:
        part = self.w[nodes]
        if self.metric == Metric.L2:
            d = part - q
            return -(d * d).sum(axis=-1)
        return np.einsum("...d,...d->...", part, q)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, params: HnswParams, metric: Metric) -> Graph:
        u = _unit(params.seed, ids)
        levels = np.floor(-np.log(u) / math.log(max(2, params.m))).astype(int)
        g = cls(params, metric, ids, x.astype(np.float32), levels)
        for level in range(int(levels.max(initial=-1)) + 1):
            g.layers.append(g._linked(np.flatnonzero(levels >= level), params.m, params.m if level else 2 * params.m))
        g.entry = int(levels.argmax()) if len(ids) else -1
        return g

    def _linked(self, nodes: np.ndarray, m: int, most: int, step: int = 256) -> Layer:
        """Each node with the nearest m before it, and with later ones that
        chose it; the nearest ``most`` stay, the first of equal ones."""
        w, n = self.w[nodes], len(nodes)
        square = (w * w).sum(axis=1) if self.metric == Metric.L2 else None
        a, b, scores = [], [], []
        for at in range(0, n, step):
            end = min(n, at + step)
            s = w[at:end] @ w[:end].T
            if square is not None:
                s = 2 * s - square[at:end, None] - square[:end]
            key = _keys(s, np.arange(end))
            key[:, at:][np.triu_indices(end - at)] = 0  # itself and later ones
            if end > m:
                key = np.partition(key, end - m, axis=1)[:, end - m :]
            i, j = np.nonzero(key)
            a.append(at + i)
            b.append(_nodes(key[i, j]))
            scores.append(s[i, b[-1]])
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(scores)
        own, other, s = np.r_[a, b], np.r_[b, a], np.r_[s, s]
        order = np.lexsort((other, -s, own))
        own, other = own[order], other[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        near = np.repeat(nodes[:, None], most, axis=1).astype(np.int32)
        kept = place < most
        near[own[kept], place[kept]] = nodes[other[kept]]
        return Layer(nodes, near)

    def _greedy(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self.near(q, [at])[0])
        while True:
            near = self.layers[level].of(at)
            s = self.near(q, near)
            k = int(s.argmax())
            if s[k] <= best:
                return at
            at, best = int(near[k]), float(s[k])

    def walk(self, q: np.ndarray, k: int, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, node) of the k best found for each of many queries: the
        walk of ``search`` without masks, in step; the ``WIDE`` nearest nodes
        of each beam are opened at once."""
        ef, n = max(k, self.params.ef_search), len(self.ids)
        others = np.argsort(_unit(self.params.seed + 1, self.ids), kind="stable")[: num_seeds(n) - 1]
        rows, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin in range(0, len(q) if self.entry >= 0 else 0, step):
            part = self._walked(q[begin : begin + step])
            at = np.full(len(part), self.entry)
            best = self.near(part, at)
            for level in range(int(self.levels[self.entry]), 0, -1):
                moving = np.arange(len(part))
                while len(moving):
                    near = self.layers[level].of(at[moving])
                    s = self.near(part[moving, None], near)
                    top = s.argmax(axis=1)
                    s = s[np.arange(len(top)), top]
                    moving, near, s = (v[s > best[moving]] for v in (moving, near[np.arange(len(top)), top], s))
                    at[moving], best[moving] = near, s
            seen = np.full(len(part) * n, -1, np.int16)
            beam = np.zeros((len(part), ef), np.int64)
            asked, near = np.arange(len(part)), np.c_[at, np.tile(others, (len(part), 1))].astype(np.int32)
            while len(asked):
                # a node that several neighbours lead to counts once
                cell = (asked[:, None] * n + near).ravel()
                fresh = np.flatnonzero(seen.take(cell) < 0)
                cell, place = cell[fresh], fresh % near.shape[1]
                seen[cell] = place
                once = seen.take(cell) == place
                fresh, i, node = fresh[once], fresh[once] // near.shape[1], near.take(fresh[once])
                new = np.zeros(near.shape, np.int64)
                new.ravel()[fresh] = _keys(self.near(part[asked[i]], node), node) | 1
                both = np.sort(np.c_[beam[asked], new], axis=1)[:, -ef:]
                # the lowest bit is of nodes that are still closed
                closed = (both & 1).astype(bool)
                turn = np.cumsum(closed[:, ::-1], axis=1)[:, ::-1]
                opened = closed & (turn <= WIDE)
                both[opened] -= 1
                beam[asked] = both
                going = opened.any(axis=1)
                asked, opened, both = asked[going], opened[going], both[going]
                if len(asked):
                    i, j = np.nonzero(opened)
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    node = _nodes(both[i, j])
                    wide = self.layers[0].near[node[np.searchsorted(i, np.arange(len(asked)))]]
                    near = np.repeat(wide[:, None], WIDE, axis=1)  # fewer than WIDE: the first again
                    near[i, place] = self.layers[0].near[node]
                    near = near.reshape(len(asked), -1)
            i, j = np.nonzero(beam[:, -k:])
            rows.append(begin + i)
            nodes.append(_nodes(beam[:, -k:][i, j]))
        return np.concatenate(rows), np.concatenate(nodes)

    def _beam(self, q: np.ndarray, start: list[int], level: int, ef: int, allowed: np.ndarray | None = None, control: Control | None = None) -> list[tuple[float, int]]:
        """Best first (score, node). Without ``allowed`` every node may be a hit."""
        seen = np.zeros(len(self.ids), bool)
        budget = control.bridge_budget if control and control.mode == "soft" else 0
        hard = bool(control and control.mode == "hard")
        margin = control.early_stop_margin if control else None
        todo, best = [], []
        for n, s in zip(start, self.near(q, start)):
            if not seen[n]:
                seen[n] = True
                heapq.heappush(todo, (-float(s), n))
                if allowed is None or allowed[n]:
                    heapq.heappush(best, (float(s), -n))
        while todo:
            s, n = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0] - (margin or 0.0):
                break
            near = [k for k in self.layers[level].of(n).tolist() if not seen[k]]
            if not near:
                continue
            seen[near] = True
            for k, score in zip(near, self.near(q, near)):
                fits = allowed is None or bool(allowed[k])
                if not fits:
                    if hard:
                        continue
                    if control and control.mode == "soft":
                        if budget <= 0:
                            continue
                        budget -= 1
                if len(best) < ef or score > best[0][0]:
                    heapq.heappush(todo, (-float(score), k))
                    if fits:
                        heapq.heappush(best, (float(score), -k))
                        if len(best) > ef:
                            heapq.heappop(best)
        return [(s, -n) for s, n in sorted(best, key=lambda t: (-t[0], -t[1]))]

    def search(self, q: np.ndarray, k: int, deleted: np.ndarray | None = None, control: Control = Control()) -> list[tuple[int, float]]:
        """(id, score) of the k best found; tombstones are passed through but
        are no hits. The beam is never narrower than k."""
        if self.entry < 0:
            return []
        allowed = None
        if control.mask is not None:
            allowed = np.isin(self.ids, np.array(control.mask, np.int64))
        if deleted is not None and len(deleted):
            alive = ~np.isin(self.ids, deleted)
            allowed = alive if allowed is None else allowed & alive
        raw, q = q, self._walked(q)
        many = num_seeds(len(self.ids), control.seeds)
        at = self.entry
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self._greedy(q, at, level)
        start = [at]
        if many > 1:
            others = np.argsort(_unit(self.params.seed + 1, self.ids), kind="stable")[: many - 1]
            start += [int(n) for n in others if n != at]
        if control.mode == "hard" and allowed is not None:
            inside = np.flatnonzero(allowed)
            if not len(inside):
                return []
            start = [int(n) for n in inside[:: max(1, len(inside) // many)][:many]]
        ef = max(k, effective_ef(self.params.ef_search, control))
        found = [n for _, n in self._beam(q, start, 0, ef, allowed, control)][:k]
        return sorted(zip(self.ids[found].tolist(), self.scores(raw[None], np.zeros(len(found), int), np.array(found, int)).tolist()), key=lambda t: (-t[1], t[0]))

    def scores(self, q: np.ndarray, i: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of hits: those of the exact search."""
        return np_pair_scores(q, self.x, i, nodes, self.metric)

    def dump(self) -> bytes:
        """Levels, vectors, and neighbours of each layer as offsets and targets."""
        arrays = {"ids": self.ids, "x": self.x, "levels": self.levels, "entry": np.array([self.entry]), "p": np.array([self.params.m, self.params.ef_construction, self.params.ef_search, self.params.seed, self.metric.code])}
        for level, layer in enumerate(self.layers):
            links = layer.links()
            many = np.zeros(len(self.ids), np.int64)
            many[layer.nodes] = links.sum(axis=1)
            arrays[f"o{level}"], arrays[f"n{level}"] = np.r_[0, np.cumsum(many)], layer.near[links]
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def restore(cls, data: bytes) -> Graph:
        from ..types import from_code

        a = np.load(io.BytesIO(data))
        m, efc, efs, seed, code = (int(v) for v in a["p"])
        g = cls(HnswParams(m, efc, efs, seed), from_code(Metric, code), a["ids"], a["x"], a["levels"])
        for level in range(int(g.levels.max(initial=-1)) + 1):
            nodes, many = np.flatnonzero(g.levels >= level), np.diff(a[f"o{level}"])
            near = np.repeat(nodes[:, None], max(1, int(many.max(initial=0))), axis=1).astype(np.int32)
            near[np.arange(near.shape[1]) < many[nodes][:, None]] = a[f"n{level}"]
            g.layers.append(Layer(nodes, near))
        g.entry = int(a["entry"][0])
        return g


def build(rows: DataFrame, params: HnswParams, metric: Metric, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, n, links, levels, graph): links counts all links of the shard.
    Graphs are built once and kept as a table in the shared folder."""
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select("id", "pos", "vector").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def make(table: pa.Table) -> pa.Table:
        ids, pos = table.column("id").to_numpy(), table.column("pos").to_numpy()
        order = np.argsort(pos, kind="stable")
        v = table.column("vector").combine_chunks()
        x = v.flatten().to_numpy().reshape(len(ids), -1)
        g = Graph.build(ids[order], x[order], params, metric)
        return pa.table({"shard": table.column("shard")[:1], "n": pa.array([len(ids)], pa.int64()), "links": pa.array([sum(int(x.links().sum()) for x in g.layers)], pa.int64()), "levels": pa.array([int(g.levels.max(initial=0))], pa.int32()), "graph": pa.array([g.dump()], pa.binary())})

    return materialised(dealt.groupBy("shard").applyInArrow(make, "shard int, n long, links long, levels int, graph binary"), "graphs")


def search_batch(graphs: DataFrame, queries: DataFrame, k: int, deleted: DataFrame | None = None, control: Control = Control(), block: int = 8192, ef_search: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, score. A task has one graph and one block of
    queries. ``deleted``: (id) of tombstones, ``allowed``: (id) of rows that
    may be hits; both go to their shard only, whatever their number."""
    blocks = max(1, -(-queries.count() // block))
    n = graphs.count()
    own = F.pmod(F.xxhash64("id"), F.lit(max(1, n))).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    none = F.lit(None)
    left = graphs.select("shard", every, F.lit(GRAPH).alias("kind"), "graph", none.cast("long").alias("id"), none.cast("array<float>").alias("vector"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(QUERY).alias("kind"), none.cast("binary").alias("graph"), "id", "vector")
    rows = left.unionByName(asked)
    for ids, kind in ((deleted, DELETED), (allowed, ALLOWED)):
        if ids is not None:
            rows = rows.unionByName(ids.select(own, every, F.lit(kind).alias("kind"), none.cast("binary").alias("graph"), "id", none.cast("array<float>").alias("vector")))
    masked = allowed is not None

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        ids = lambda what: table.column("id").filter(pa.array(kind == what)).to_numpy()
        data = table.column("graph").filter(pa.array(kind == GRAPH))
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(data):
            graph, gone, own = Graph.restore(data[0].as_py()), ids(DELETED), control
            if masked:
                own = replace(control, mask=tuple(ids(ALLOWED).tolist()))
            if ef_search:
                graph.params = replace(graph.params, ef_search=ef_search)
            asked_, who = table.column("vector").filter(pa.array(kind == QUERY)).combine_chunks(), ids(QUERY)
            x = asked_.flatten().to_numpy().reshape(len(asked_), -1)
            if own == Control() and not len(gone):
                i, nodes = graph.walk(x, k)
                found = [who[i], graph.ids[nodes], graph.scores(x, i, nodes)]
            else:
                hits = [(i, j, s) for i, q in zip(who.tolist(), x) for j, s in graph.search(q, k, gone, own)]
                found = [np.array([h[j] for h in hits], v.dtype) for j, v in enumerate(found)]
        fine = ~np.isnan(found[2])
        return pa.table({n: v[fine] for n, v in zip(("query_id", "id", "score"), found)})

    return top_per_query(rows.groupBy("shard", "block").applyInArrow(run, "query_id long, id long, score double"), k)


def search(graphs: DataFrame, query, dim: int, metric: Metric, k: int = 5, deleted: DataFrame | None = None, control: Control = Control(), allowed: DataFrame | None = None) -> DataFrame:
    q = query_vector(query, dim, metric)
    asked = graphs.sparkSession.createDataFrame([(0, q)], "id long, vector array<float>")
    return search_batch(graphs, asked, k, deleted, control, allowed=allowed).select("id", "score")


def tune(rows: DataFrame, queries: DataFrame, metric: Metric, ms: list[int], efs: list[int], k: int = 10, seed: int = 42) -> DataFrame:
    """(m, ef_search, recall, latency_ms) of a grid, best recall first, then
    quickest. One build for each m; recall against the exact search."""
    import time

    from .search import knn_batch, recall

    spark = rows.sparkSession
    truth = knn_batch(rows, queries, metric, k).persist()
    many = max(1, queries.count())
    out = []
    for m in ms:
        graphs = build(rows, HnswParams(m=m, seed=seed), metric)
        for ef in efs:
            began = time.perf_counter()
            got = recall(search_batch(graphs, queries, k, ef_search=ef), truth, k).agg(F.avg("recall")).first()[0]
            out.append((m, ef, float(got or 0.0), (time.perf_counter() - began) * 1000 / many))
    truth.unpersist()
    return spark.createDataFrame(out, "m int, ef_search int, recall double, latency_ms double").orderBy(F.col("recall").desc(), "latency_ms")
