"""A collection of vectors: rows, attributes and an index as DataFrames.

Collections don't change in place. Every write gives a new one that shares
what it can. ``logged`` starts a log: from then on every write adds its records
to ``log``, and replaying them gives the same rows. ``save`` makes a snapshot of
rows, attributes and index; ``open`` reads them back and builds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import Scope, Typed, compile_filter, pushable
from ..functions.kernels import stored
from ..plans.planner import SearchPlan, plan_search
from ..plans.placement import PlacementMap, numbered
from ..sources.snapshot import Head, Store
from ..types import ROWS, DimMismatch, HnswParams, IvfParams, Metric, Strategy, u32, u32_col
from . import changes, hnsw, ivf, maintenance, search
from .attr_index import AttrIndex


#: Columns that every row of a collection has.
BASE = ("id", "pos", "vector", "meta")
#: Records of a change log; how many of them a write may have.
LOG = "seq long, type string, id long, vector array<float>, meta variant"
WRITE_STEP = 1 << 40


@dataclass(frozen=True)
class Collection:
    spark: SparkSession
    dim: int
    metric: Metric
    strategy: Strategy
    rows: DataFrame
    attrs: DataFrame | None = None
    params: HnswParams | IvfParams | None = None
    index: object = None
    deleted: DataFrame | None = None
    log: DataFrame | None = None
    writes: int = 0
    typed: dict[tuple[str, str], Typed] | None = None

    # ---- making and opening

    @classmethod
    def create(cls, spark: SparkSession, dim: int, metric: str = "cosine", strategy: str = "bruteforce", params=None) -> Collection:
        if int(dim) != dim or dim <= 0:
            raise ValueError("dim must be a positive integer")
        s = Strategy(strategy)
        params = params or {Strategy.HNSW: HnswParams(), Strategy.IVF: IvfParams()}.get(s)
        return cls(spark, int(dim), Metric(metric), s, spark.createDataFrame([], ROWS), None, params)

    @classmethod
    def of(cls, df: DataFrame, dim: int, metric: str = "cosine", strategy: str = "bruteforce", params=None, id_col: str = "id", vector_col: str = "vector", meta: Column | None = None, attrs: Column | None = None, typed: dict[str, str] | None = None) -> Collection:
        """Over a table that is there: vectors in stored form, in order of id
        (an id is its row's position; nothing is counted or sorted for that).
        ``typed``: names of columns of the table that are metadata keys as
        well, and their kinds; filters on them reach the scan."""
        empty = cls.create(df.sparkSession, dim, metric, strategy, params)
        meta = F.lit(None).cast("variant") if meta is None else meta
        id_ = u32_col(F.col(id_col))
        held = {("meta", k): Typed(F.col(f"__meta_{k}"), kind) for k, kind in (typed or {}).items()}
        rows = df.select(id_.alias("id"), id_.alias("pos"), stored(F.col(vector_col), empty.metric).alias("vector"), meta.alias("meta"), *(F.col(k).alias(f"__meta_{k}") for k in typed or {}))
        own = None if attrs is None else df.select(id_.alias("id"), attrs.alias("attrs"))
        return replace(empty, rows=rows, attrs=own, typed=held or None)

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_ts: int | None = None) -> Collection | None:
        found = Store(spark, path).open(read_ts)
        if found is None:
            return None
        rows, catalog = found
        kinds = {Strategy.HNSW: HnswParams, Strategy.IVF: IvfParams}
        kind = kinds.get(catalog["strategy"])
        params = kind(**catalog["params"]) if kind else None
        folder, tables = catalog["folder"], catalog.get("tables", [])
        attrs = spark.read.parquet(f"{folder}/attrs") if "attrs" in tables else None
        index = None
        if "graphs" in tables:
            index = spark.read.parquet(f"{folder}/graphs")
        elif "lists" in tables:
            index = ivf.load(spark, f"{folder}/lists", catalog["metric"], params)
        back = cls(spark, catalog["dim"], catalog["metric"], catalog["strategy"], rows, attrs, params, index)
        return back if index is not None or kind is None else back.with_index()  # a snapshot without its index

    def save(self, path: str, placement: PlacementMap = PlacementMap(), **more) -> Head:
        """A snapshot with the index that searches use (a graph with
        tombstones is built anew first) and the attributes."""
        own = self.with_index() if self.deleted is not None else self
        tables: dict = {}
        if own.attrs is not None:
            tables["attrs"] = lambda at: own.attrs.write.parquet(at)
        if own.index is not None and own.strategy == Strategy.HNSW:
            tables["graphs"] = lambda at: own.index.write.parquet(at)
        elif own.index is not None and len(own.index.centroids):
            tables["lists"] = lambda at: ivf.save(own.index, at)
        rows = own.live().select(*BASE)
        return Store(self.spark, path).save(rows, self.dim, self.metric, self.strategy, self.params.__dict__ if self.params else {}, placement, tables=tables, **more)

    # ---- reading

    def live(self) -> DataFrame:
        return self.rows if self.deleted is None else self.rows.join(self.deleted, "id", "left_anti")

    def size(self) -> int:
        return self.live().count()

    def has(self, id_: int) -> bool:
        return bool(self.live().where(F.col("id") == u32(id_)).select("id").head(1))

    def get(self, id_: int):
        found = self.live().where(F.col("id") == u32(id_)).select("vector", "meta").head(1)
        return found[0] if found else None

    def get_meta(self, id_: int):
        found = self.get(id_)
        return None if found is None else found.meta

    # ---- writing

    def _changed(self, rows: DataFrame) -> Collection:
        """An index follows its rows: vectors that changed are placed anew.
        Columns beside the base ones are let go; filters read the metadata."""
        new = replace(self, rows=rows, index=None, deleted=None, typed=None)
        return new.with_index() if self.index is not None else new

    def logged(self) -> Collection:
        """The same, with an empty log of the writes from now on."""
        return replace(self, log=self.spark.createDataFrame([], LOG), writes=0)

    def _noted(self, new: Collection, kind: str, records: DataFrame) -> Collection:
        """``new`` with the records of a write behind those before. Writes are
        numbered; a record's place inside its write is ``ord``."""
        if self.log is None:
            return new
        none = {"vector": F.lit(None).cast("array<float>"), "meta": F.lit(None).cast("variant"), "ord": F.lit(0).cast("long")}
        have = {c: F.col(c) if c in records.columns else x for c, x in none.items()}
        seq = F.lit(self.writes * WRITE_STEP) + have["ord"]
        added = records.select(seq.alias("seq"), F.lit(kind).alias("type"), u32_col(F.col("id")).alias("id"), have["vector"].alias("vector"), have["meta"].alias("meta"))
        return replace(new, log=self.log.unionByName(added), writes=self.writes + 1)

    def replayed(self, log: DataFrame) -> Collection:
        """The rows after a change log; what it changes is placed anew. Vectors
        in the log are as they were given."""
        from ..streaming.wal import fold_onto

        base = self.live().select(*BASE)
        rows = fold_onto(base.select("id", "vector", "meta"), log.withColumn("vector", stored(F.col("vector"), self.metric)))
        kept = rows.join(base.select("id", "pos"), "id", "left")
        placed = numbered(kept.withColumn("__key", F.coalesce("pos", F.lit(2**40) + F.col("id"))), "__key")
        return self._changed(placed.select("id", F.col("__n").alias("pos"), "vector", "meta"))

    def _fine(self, new: DataFrame) -> DataFrame:
        good, wrong = changes.validated(new, self.dim)
        bad = wrong.head(1)
        if bad:
            raise DimMismatch(int(bad[0].error.split("got ")[1].split(",")[0]), self.dim)
        return good

    def add(self, new: DataFrame) -> Collection:
        """Insert only; a known id is an error."""
        good = self._fine(new)
        return self._noted(self._changed(changes.insert_strict(self._base(), good, self.metric)), "upsert", good)

    def push(self, new: DataFrame) -> tuple[Collection, DataFrame]:
        """Insert only; known ids are skipped and reported."""
        good = self._fine(new)
        rows, report = changes.insert_only(self._base(), good, self.metric)
        came = good.join(report.where("outcome = 'created'").select("id", "ord"), ["id", "ord"], "left_semi")
        return self._noted(self._changed(rows), "upsert", came), report

    def upsert(self, new: DataFrame) -> tuple[Collection, DataFrame]:
        good = self._fine(new)
        rows, report = changes.upsert(self._base(), good, self.metric)
        return self._noted(self._changed(rows), "upsert", good), report

    def upsert_valid(self, new: DataFrame, all_or_nothing: bool = False) -> tuple[Collection, DataFrame, DataFrame]:
        """Rows of the wrong length are reported, the others come in; with
        ``all_or_nothing`` none does if one is wrong."""
        good, wrong = changes.validated(new, self.dim)
        if all_or_nothing and wrong.head(1):
            return self, good.limit(0).select("id", F.lit("").alias("outcome")), wrong
        rows, report = changes.upsert(self._base(), good, self.metric)
        return self._noted(self._changed(rows), "upsert", good), report, wrong

    def remove(self, ids: DataFrame) -> tuple[Collection, DataFrame]:
        """Gone for every reader at once. A graph keeps tombstones until it is
        compacted; other strategies drop the rows."""
        rows, report = changes.remove_many(self.live(), ids)
        return self._noted(self._without(rows, report), "remove", report.where("outcome = 'removed'").select("id")), report

    def _without(self, rows: DataFrame, report: DataFrame) -> Collection:
        if self.strategy == Strategy.HNSW and self.index is not None:
            gone = report.where("outcome = 'removed'").select("id")
            return replace(self, deleted=gone if self.deleted is None else self.deleted.unionByName(gone).distinct())
        if self.strategy == Strategy.IVF and self.index is not None:
            kept = self.index.assigned.join(report.select("id"), "id", "left_anti")
            return replace(self, rows=rows, index=replace(self.index, assigned=kept))
        return replace(self, rows=rows)

    def set_meta(self, new: DataFrame) -> tuple[Collection, DataFrame]:
        """The index holds no metadata: hits take it from the rows."""
        rows, report = changes.set_meta(self._base(), new)
        changed = replace(self, rows=rows, typed=None) if self.deleted is None else self._changed(rows)
        return self._noted(changed, "setMeta", new), report

    def set_vector(self, new: DataFrame) -> Collection:
        good = self._fine(new)
        base = self._base()
        known = good.select("id", "vector", "ord").join(base.select("id", "meta"), "id")
        return self._noted(self._changed(changes.set_vector(base, good, self.metric)), "upsert", known)

    def _base(self) -> DataFrame:
        return self.live().select(*BASE)

    # ---- indexes

    def with_index(self, strategy: str | None = None, params=None, iters: int = 10, seed: int = 42) -> Collection:
        """The same rows under another strategy, or the index built anew."""
        s = Strategy(strategy) if strategy else self.strategy
        if params is None:
            params = self.params if s == self.strategy else {Strategy.HNSW: HnswParams(), Strategy.IVF: IvfParams()}.get(s)
        rows = self.live()
        index = None
        if s == Strategy.HNSW:
            index = hnsw.build(rows, params, self.metric)
        elif s == Strategy.IVF:
            index = ivf.build(rows.select("id", "pos", "vector"), params, self.metric, iters, seed)
        return replace(self, rows=rows, strategy=s, params=params, index=index, deleted=None)

    def rebuilt(self, ids: DataFrame | None = None, params=None) -> Collection:
        """The index built anew. With ``ids``, lists only place those rows anew
        and keep their centroids. A change of probes or of the width of a walk
        alone builds nothing."""
        if self.index is None or self.strategy == Strategy.BRUTEFORCE:
            return self.with_index(params=params)
        if self.strategy == Strategy.IVF:
            if params is not None and params.nlist == self.index.params.nlist and ids is None:
                return replace(self, params=params, index=replace(self.index, params=params))
            if ids is not None and params is None and len(self.index.centroids):
                rest = replace(self.index, assigned=self.index.assigned.join(ids.select("id"), "id", "left_anti"))
                return replace(self, index=ivf.repaired(rest, self.live().select("id", "pos", "vector")))
        return self.with_index(params=params)

    def repaired(self) -> tuple[Collection, int, int]:
        """Rows that the lists lack are placed, assignments without a row go;
        how many of each."""
        if self.strategy != Strategy.IVF or self.index is None:
            return self, 0, 0
        found = {r.problem: r["count"] for r in maintenance.check_consistency(self.live(), self.index.assigned).groupBy("problem").count().collect()}
        fixed = replace(self, index=ivf.repaired(self.index, self.live().select("id", "pos", "vector")))
        return fixed if found else self, found.get("missing_in_index", 0), found.get("missing_in_store", 0)

    def compacted(self, ratio: float | None = None) -> tuple[Collection, int]:
        if self.deleted is None:
            return self, 0
        rows, gone = maintenance.compacted(self.rows, self.deleted, ratio)
        return (replace(self, rows=rows, index=None, deleted=None).with_index(), gone) if gone else (self, 0)

    # ---- searching

    def _scope(self, rows: DataFrame) -> tuple[DataFrame, Scope]:
        if self.attrs is None:
            return rows, Scope(meta=F.col("meta"), typed=self.typed)
        return rows.join(self.attrs, "id", "left"), Scope(attrs=F.col("attrs"), meta=F.col("meta"), typed=self.typed)

    def _with_meta(self, hits: DataFrame) -> DataFrame:
        """k hits with their rows' metadata."""
        return self.rows.select("id", "meta").join(F.broadcast(hits.select("id", "score")), "id").select("id", "score", "meta").orderBy(F.col("score").desc(), "id")

    def find_many(self, query, k: int | None = None, expr: dict | None = None, keep: Column | None = None, attr_index: AttrIndex | None = None, control: hnsw.Control | None = None, nprobe: int | None = None) -> DataFrame:
        """``expr`` filters before scoring; ``keep`` is a caller's test, before
        scoring without ``expr``, after top-k with it."""
        k = search.k_of(k)
        if len(query) != self.dim:
            raise DimMismatch(len(query), self.dim)
        plan = plan_search(self.strategy, self.index is not None, expr is not None or keep is not None, control.mode if control else "none")
        if plan == SearchPlan.GRAPH:
            return self._with_meta(hnsw.search(self.index, query, self.dim, self.metric, k, self.deleted, control or hnsw.Control()))
        if plan == SearchPlan.PROBE:
            return self._with_meta(ivf.search(self.index, query, k, None, nprobe))
        rows, scope = self._scope(self.live())
        where = keep if expr is None else compile_filter(expr, scope)
        if expr is not None and (sure := pushable(expr, scope)) is not None:
            rows = rows.where(sure)  # plain tests on columns of the table: the scan skips by them
        if expr is not None and attr_index is not None and (ids := attr_index.candidates(expr)) is not None:
            rows = rows.join(ids, "id", "left_semi")
        if plan == SearchPlan.MASKED_GRAPH:
            # the rows that pass go to their shards as a table, however many
            hits = hnsw.search(self.index, query, self.dim, self.metric, k, self.deleted, replace(control, mode="soft"), rows.where(where).select("id"))
            hits = self._with_meta(hits)
            return hits if expr is None or keep is None else hits.where(keep)
        hits = search.knn(rows, query, self.dim, self.metric, k, where)
        return hits if expr is None or keep is None else hits.where(keep)

    def find(self, query, **more) -> DataFrame:
        return self.find_many(query, 1, **more)

    # ---- statistics

    def stats(self) -> maintenance.StatsView:
        n = self.size()
        base = maintenance.StatsView(n, self.dim, self.metric.value, self.strategy.value)
        if self.strategy == Strategy.HNSW and self.index is not None:
            dead = 0 if self.deleted is None else self.deleted.count()
            r = maintenance.hnsw_stats(self.index, dead).first()
            return replace(base, levels=r.levels, avg_degree=r.avg_degree, tombstone_ratio=r.tombstone_ratio)
        if self.strategy == Strategy.IVF and self.index is not None:
            sizes = maintenance.list_sizes(self.index.assigned, len(self.index.centroids)).orderBy("list_id").collect()
            return replace(base, list_sizes=tuple(r["size"] for r in sizes))
        return base


def connect(spark: SparkSession, path: str, dim: int | None = None, metric: str = "cosine", strategy: str = "bruteforce", on_missing: str = "create", log: DataFrame | None = None) -> Collection:
    """Opens the collection at ``path`` or makes one; a change log is replayed
    before this returns."""
    found = Collection.open(spark, path)
    if found is None:
        if on_missing != "create" or dim is None:
            raise FileNotFoundError(path)
        found = Collection.create(spark, dim, metric, strategy)
        found.save(path)
    return found if log is None else found.replayed(log)
