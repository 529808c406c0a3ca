"""Mixing sources to target weights by iterative proportional fitting, in
DataFrame functions only.

Documents fall in cells (source, language, topic). A document's probability is
its cell's: the product of one factor for each value, at most 1. The factors
are raked with that bound inside the loop: in turn, each value of a dimension
gets the factor that brings its expected tokens to its target, cells taken
whole counted as whole (a Newton step: exact unless the factor itself takes
more cells whole), until all marginals hold within ``TOLERANCE``. Documents are
drawn by a hash of id and seed, so a draw can be repeated; a larger budget
keeps what a smaller had as long as no cell is taken whole.

A value cannot give more tokens than it has. Where its target asks for more it
is taken whole and the other values of the dimension share the rest as their
targets are to each other; the budget is kept. ``Fit.marginals`` reports target,
attainable and reached share of every value, ``Fit.converged`` whether the
attainable ones were all reached at once; where the dimensions contradict each
other they cannot be, raking ends when it no longer gains, and a warning says
how far off the mix is.

Targets are shares of tokens in each dimension; unless given, each value's
share is its token count to the power ``temper``. Cells are aggregated before
anything moves; the text is never shuffled. Up to ``TASK_CELLS`` cells are
raked by windows in one task of bounded size, more of them by aggregations and
joins; both do the same steps. Only three numbers a dimension go to the driver.

Nulls in a dimension are the value ``(none)``, null texts have no tokens; a
null id draws like an empty one. Repeated rows are drawn alike. Other columns
stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written

DIMENSIONS = ("source", "language", "topic")
#: Cells that one task rakes; above it they are raked by shuffles.
TASK_CELLS = 200_000
#: Raking ends when no marginal is further than this from its target, as a
#: share of the budget; when ``SWEEPS`` rounds gain less than a tenth; or after
#: ``MOST_SWEEPS``.
TOLERANCE, SWEEPS, MOST_SWEEPS = 1e-5, 5, 60
#: Factors run away where targets contradict each other; they stop here.
LEAST, MOST = 1e-100, 1e100
#: Topics in order: the first of whose patterns one is found in the text, else prose.
TOPICS = (("table", " \\| "), ("legal", "(?i)license|copyright|warranty"), ("contact", "@"), ("figures", "[0-9]{4}"))


def n_words(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def _found(text: Column, pattern: str) -> Column:
    """``rlike``; alternatives of plain letters as quicker substring tests."""
    words, folded = pattern.removeprefix("(?i)"), pattern.startswith("(?i)")
    plain = words.replace("\\|", "\0").split("|")
    if all(w.replace("\0", "").replace(" ", "").replace("@", "").isalpha() or not w.strip("\0 @") for w in plain):
        low = F.lower(text) if folded else text
        tests = [low.contains(w.replace("\0", "|")) for w in plain]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out
    return text.rlike(pattern)


def topic_of(text: Column) -> Column:
    out = None
    for name, pattern in TOPICS:
        out = F.when(_found(text, pattern), name) if out is None else out.when(_found(text, pattern), name)
    return out.otherwise("prose")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 for each id: 52 bits of an MD5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


@dataclass
class Fit:
    """``cells``: the dimensions, tokens and probability. ``marginals``: for
    each dimension and value the shares of the drawn tokens that were asked
    for (target), that can be had (attainable), and that are expected."""

    cells: DataFrame
    marginals: DataFrame
    sweeps: int
    off: float

    @property
    def converged(self) -> bool:
        return self.off <= TOLERANCE


def _by_dimension(numbers: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for d, n in numbers.items() for x in (d, float(n))))[F.col("dimension")]


def _wanted(cells: DataFrame, budget: float, targets: dict[str, dict[str, float]], temper: float) -> DataFrame:
    """(dimension, value, have, share, want, full): the tokens that each value
    has and is to give; ``full`` where that is all it has."""
    values = None
    for d in DIMENSIONS:
        fixed = F.lit(None).cast("double")
        for value, share in targets.get(d, {}).items():
            fixed = F.when(F.col(d) == value, F.lit(float(share))).otherwise(fixed)
        side = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("have")).select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "have", fixed.alias("fixed"))
        values = side if values is None else values.union(side)
    free = F.when(F.col("fixed").isNull(), F.pow("have", F.lit(temper)))
    values = written(values.withColumn("free", free))
    sums = values.groupBy("dimension").agg(F.sum("free").alias("free"), F.sum("fixed").alias("fixed")).collect()  # three rows
    rest = {r.dimension: max(0.0, 1 - (r.fixed or 0.0)) / r.free if r.free else 0.0 for r in sums}
    share = F.coalesce("fixed", F.col("free") * _by_dimension(rest))
    total = {r.dimension: (r.fixed or 0.0) + (r.free or 0.0) * rest[r.dimension] for r in sums}
    values = values.select("dimension", "value", "have", (share / _by_dimension(total)).alias("share"))
    # budget * share, but at most all: those that give all only become more, so this ends
    scale, was = dict.fromkeys(DIMENSIONS, budget), None
    while True:
        full = F.col("share") * _by_dimension(scale) >= F.col("have")
        left = values.groupBy("dimension").agg(F.sum(F.when(full, F.col("have"))).alias("have"), F.sum(F.when(~full, F.col("share"))).alias("share"), F.sum(full.cast("int")).alias("n")).collect()
        now = {r.dimension: r.n for r in left}
        if now == was:
            break
        was = now
        scale = {r.dimension: (budget - (r.have or 0.0)) / r.share if r.share else 1e300 for r in left}
    return values.withColumn("full", full).withColumn("want", F.when(full, F.col("have")).otherwise(F.col("share") * _by_dimension(scale)))


#: Of the cells of one value: tokens of those taken whole, expected tokens of
#: the others for their factors, the least factor.
_SUMS = {"whole": "sum(CASE WHEN ratio >= 1 THEN CAST(tokens AS DOUBLE) ELSE 0D END)", "part": "sum(CASE WHEN ratio < 1 THEN tokens * ratio ELSE 0D END)", "lowest": "min(ratio)"}


def _factor(d: str) -> str:
    new = f"CASE WHEN full_{d} THEN ratio / least(1D, lowest) WHEN want_{d} > whole AND part > 0 THEN ratio * ((want_{d} - whole) / part) ELSE ratio * (want_{d} / (whole + part)) END"
    return f"least({MOST!r}D, greatest({LEAST!r}D, {new})) AS ratio"


def _gap(d: str) -> dict[str, str]:
    return {f"drawn_{d}": "sum(tokens * least(1D, ratio))"}


def _swept(state: DataFrame, keep: list[str], one_task: bool) -> DataFrame:
    """``SWEEPS`` rounds over the dimensions; adds gap, the most that any
    marginal of a cell is off. In one task it is one statement of windows."""
    if one_task:
        view = f"nearfield_{uuid.uuid4().hex}"
        state.createOrReplaceTempView(view)
        step, names = view, ", ".join(keep)
        over = lambda sums, d: ", ".join(f"{x} OVER (PARTITION BY {d}) AS {k}" for k, x in sums.items())
        for d in DIMENSIONS * SWEEPS:
            step = f"(SELECT {names}, {_factor(d)} FROM (SELECT {names}, ratio, {over(_SUMS, d)} FROM {step}))"
        gaps = [f"abs({over(_gap(d), d).split(' AS ')[0]} - want_{d})" for d in DIMENSIONS]
        try:
            return state.sparkSession.sql(f"SELECT {names}, ratio, greatest({', '.join(gaps)}) AS gap FROM {step}")
        finally:
            state.sparkSession.catalog.dropTempView(view)
    summed = lambda df, d, sums: df.join(df.groupBy(d).agg(*(F.expr(x).alias(k) for k, x in sums.items())), d)
    for d in DIMENSIONS * SWEEPS:
        state = written(summed(state, d, _SUMS).selectExpr(*keep, _factor(d)))
    for d in DIMENSIONS:
        state = written(summed(state, d, _gap(d)))
    return state.selectExpr(*keep, "ratio", f"greatest({', '.join(f'abs(drawn_{d} - want_{d})' for d in DIMENSIONS)}) AS gap")


def raked(cells: DataFrame, keep: float, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.5, task_cells: int = TASK_CELLS) -> Fit:
    """``cells``: the three dimensions and tokens. Adds probability."""
    with Scratch(cells.sparkSession) as scratch:
        return _raked(cells, keep, targets, temper, task_cells, scratch)


def _raked(cells: DataFrame, keep: float, targets: dict[str, dict[str, float]] | None, temper: float, task_cells: int, scratch: Scratch) -> Fit:
    cells = written(cells.select(*DIMENSIONS, "tokens").where("tokens > 0"))
    size = cells.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).first()
    one_task, budget = size["n"] <= task_cells, keep * float(size["tokens"] or 0)
    if budget <= 0:
        none = cells.select(F.lit("").alias("dimension"), F.lit("").alias("value"), *(F.lit(0.0).alias(k) for k in ("target", "attainable", "expected"))).limit(0)
        return Fit(scratch.keep(cells).withColumn("probability", F.lit(0.0)), none, 0, 0.0)
    gathered = (lambda df: df.coalesce(1)) if one_task else (lambda df: df)  # a bounded table: then no step shuffles
    values = scratch.keep(written(_wanted(cells, budget, targets or {}, temper)))
    state = cells.withColumn("ratio", F.lit(1.0))
    for d in DIMENSIONS:
        side = values.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("want").alias(f"want_{d}"), F.col("full").alias(f"full_{d}"))
        state = state.join(side, d)
    state = gathered(written(gathered(state)))
    keep_columns = [c for c in state.columns if c != "ratio"]
    off, sweeps = float("inf"), 0
    while True:
        table = written(gathered(_swept(state, keep_columns, one_task)))
        state = gathered(table)
        was, off, sweeps = off, state.agg(F.max("gap")).first()[0] / budget, sweeps + SWEEPS
        if off <= TOLERANCE or off > 0.9 * was or sweeps >= MOST_SWEEPS:
            break
    scratch.keep(table)
    done = state.select(*DIMENSIONS, "tokens", F.least(F.lit(1.0), F.col("ratio")).alias("probability"))
    reached = None
    for d in DIMENSIONS:
        side = done.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability")).alias("reached")).select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "reached")
        reached = side if reached is None else reached.union(side)
    shares = [F.col("share").alias("target"), (F.col("want") / budget).alias("attainable"), (F.col("reached") / budget).alias("expected")]
    return Fit(done, values.join(reached, ["dimension", "value"]).select("dimension", "value", *shares), sweeps, off)


def _named(docs: DataFrame, source: Column, language: Column, topic: Column, tokens: Column) -> DataFrame:
    """(row, source, language, topic, tokens): ``row`` has the columns of ``docs``."""
    named = [F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in zip(DIMENSIONS, (source, language, topic))]
    return docs.select(F.struct("*").alias("row"), *named, tokens.alias("tokens"))


def with_probability(docs: DataFrame, source: Column, language: Column, topic: Column, tokens: Column, keep: float = 0.5, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.5) -> DataFrame:
    """(row, source, language, topic, tokens, probability): ``row`` has the
    columns of ``docs``. Documents without tokens have probability 1."""
    rows = _named(docs, source, language, topic, tokens)
    fit = raked(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), keep, targets, temper)
    if not fit.converged:
        logging.getLogger(__name__).warning("the targets contradict each other at a budget of %g: marginals are up to %.2g of it off", keep, fit.off)
    # Spark broadcasts the cells if their written size is small
    put = rows.join(fit.cells.select(*DIMENSIONS, "probability"), list(DIMENSIONS), "left")
    return put.withColumn("probability", F.coalesce("probability", F.lit(1.0)))


def sampled(docs: DataFrame, id_col: str, source: Column, language: Column, topic: Column, tokens: Column, keep: float = 0.5, seed: str = "mix-1", **more) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their own columns."""
    rows = with_probability(docs, source, language, topic, tokens, keep, **more)
    return rows.where(uniform(F.col(f"row.{id_col}"), seed) < F.col("probability")).select("row.*")
