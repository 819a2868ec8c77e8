"""Mixing sources to target weights by iterative proportional fitting.

Token counts by (source, language, topic) are raked: each dimension's margins in turn are scaled to their targets,
and a cell never asks for more tokens than it has. A cell's weight is its fitted share over its own; documents are
sampled with the calibrated probability of their cell, by a hash of their id, so every run draws the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks_of, rows_of, text_batches, thrifty
from .shingles import words_of_each

#: Part of all tokens that the sample is to hold.
BUDGET = 0.5
ROUNDS, CLOSE = 200, 1e-9
#: Cells that are raked on the driver; more are raked as DataFrames.
LOCAL_CELLS = 50_000
#: Topics: groups of hashed word profiles, fitted on all documents in at most so many updates.
TOPICS, UPDATES, PROFILE = 6, 25, 256
#: Profiles and centres are whole multiples of 1/GRID: cosines and sums are exact, in whatever order rows come.
GRID = 1 << 20
GATHER = 4 << 20


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, unit profile of hashed words) of each text; no words, no profile."""
    n, counts = word_profile(texts)
    return n, unit_profiles(counts)


def word_profile(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, how many of them fall to each of PROFILE hashes) of each text."""
    hashes = list(words_of_each(texts))
    n = np.array([len(h) for h in hashes], np.int64)
    owner = np.repeat(np.arange(len(hashes)), n)
    part = (np.concatenate([np.zeros(0, np.uint64), *hashes]) >> np.uint64(56)).astype(np.int64)
    return n, np.bincount(owner * PROFILE + part, minlength=len(hashes) * PROFILE).reshape(len(hashes), PROFILE)


def unit_profiles(counts: np.ndarray) -> np.ndarray:
    """Logarithms of counts, at length 1, on the grid."""
    held = np.log1p(counts)
    norm = np.sqrt((held**2).sum(1, keepdims=True))
    return np.rint(np.divide(held, norm, out=held, where=norm > 0) * GRID) / GRID


def fit_topics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topics: int = TOPICS, updates: int = UPDATES) -> np.ndarray:
    """Centres of spherical k-means, farthest-first start, on all documents with words; repeated rows count each.

    Texts become counts of 256 hashed words once, written for the passes to read; a pass brings the driver one row
    for each task in the start, and one for each centre and hash in an update. The same documents give the same
    centres however they are dealt.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    work = Scratch(spark, "topics")

    def count(batches):
        for batch in batches:
            for held in chunks_of(rows_of(batch, "text"), GATHER, lambda r: len(r[0] or "")):
                n, counts = word_profile([r[0] for r in held])
                counts = counts.astype("<u4")[n > 0]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in counts], pa.binary())], ["counts"])

    made = work.save(docs.select(F.col(text_col).alias("text")).mapInArrow(thrifty(count), "counts binary"), "counts")

    def read(batch):
        return np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(-1, PROFILE)

    def farthest(centres):
        def run(batches):
            best = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                counts = read(batch)
                close = (unit_profiles(counts) @ centres.T).max(1)
                least = close.min()
                # of equals the least counts, as bytes
                here = (float(least), min(counts[k].tobytes() for k in np.flatnonzero(close == least)))
                best = here if best is None or here < best else best
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.binary())], ["close", "counts"])

        found = made.mapInArrow(thrifty(run), "close double, counts binary").orderBy("close", "counts").first()
        return found and (found["close"], unit_profiles(np.frombuffer(found["counts"], "<u4").reshape(1, PROFILE))[0])

    def sums(centres):
        def run(batches):
            total = np.zeros(centres.shape, np.int64)
            for batch in batches:
                x = unit_profiles(read(batch))
                near = (x @ centres.T).argmax(1)
                for k in range(len(centres)):
                    total[k] += (x[near == k] * GRID).astype(np.int64).sum(0)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["at", "n"])

        total = np.zeros(centres.size)
        for at, n in made.mapInArrow(thrifty(run), "at int, n long").groupBy("at").agg(F.sum("n")).collect():
            total[at] = n
        return total.reshape(centres.shape)

    # the start: the document farthest from the mean direction, then from those chosen
    whole = sums(np.zeros((1, PROFILE)))
    if not whole.any():
        return np.zeros((1, PROFILE))
    centres = _unit(whole)
    chosen: list[np.ndarray] = []
    while len(chosen) < topics:
        close, x = farthest(np.array(chosen) if chosen else centres)
        if chosen and close >= 1 - 1e-5:  # no other profile is left
            break
        chosen.append(x)
    centres = np.array(chosen)
    for _ in range(updates):
        before, total = centres, sums(centres)
        centres = np.where(total.any(1, keepdims=True), _unit(total), centres)
        if (centres == before).all():
            break
    work.drop("counts")
    return centres


def _unit(sums: np.ndarray) -> np.ndarray:
    norm = np.sqrt((sums**2).sum(1, keepdims=True))
    return np.rint(np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0) * GRID) / GRID


def describe(docs: DataFrame, centres: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, kept columns, tokens, topic): tokens are words; a text without words is of topic t0."""
    text_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for held in chunks_of(rows_of(batch, text_col), GATHER, lambda r: len(r[0] or "")):
                n, x = profiles([r[0] for r in held])
                near = np.where(n > 0, (x @ centres.T).argmax(1), 0)
                part = batch.slice(at, len(held))
                at += len(held)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1 + len(keep))), pa.array(n), pa.array([f"t{k}" for k in near])], [id_col, *keep, "tokens", "topic"])

    fields = [docs.schema[c] for c in (id_col, *keep)]
    return docs.select(id_col, *keep, text_col).mapInArrow(thrifty(run), T.StructType([*fields, T.StructField("tokens", T.LongType()), T.StructField("topic", T.StringType())]))


def targets_of(shares: Mapping[str, float], wanted: Mapping[str, float] | float) -> dict[str, float]:
    """Target share of each value: given ones, and for the rest what they have; or all shares to a power (0: equal). Values without tokens get none."""
    if isinstance(wanted, Mapping):
        given = {str(v): float(x) for v, x in wanted.items()}
        raw = {v: given.get(v, s) if s > 0 else 0.0 for v, s in shares.items()}
    else:
        raw = {v: s**wanted if s > 0 else 0.0 for v, s in shares.items()}
    total = sum(raw.values())
    return {v: x / total for v, x in raw.items()} if total else raw


def rake(cells: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray], budget: float) -> np.ndarray:
    """Fitted shares of the cells. margins[d][c] is the value of cell c in dimension d, targets[d] its values' shares."""
    natural = cells / cells.sum()
    most = natural / budget  # a cell holds no more
    fitted = natural.copy()
    for _ in range(ROUNDS):
        before = fitted
        for value, target in zip(margins, targets, strict=True):
            now = np.bincount(value, fitted, len(target))
            fitted = np.minimum(fitted * np.divide(target, now, out=np.ones_like(now), where=now > 0)[value], most)
        if np.abs(fitted - before).max() < CLOSE:
            break
    return fitted


def rake_frames(work: Scratch, cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], budget: float) -> DataFrame:
    """As ``rake``, for more cells than the driver should hold: cells (dims, natural) gain ``fitted``."""
    now = cells.withColumn("fitted", F.col("natural"))
    for k in range(ROUNDS):
        now = now.withColumn("before", F.col("fitted"))
        for d in dims:
            margin = now.groupBy(d).agg(F.sum("fitted").alias("m")).join(targets[d], d)
            factor = F.coalesce(F.try_divide(F.col("target"), F.col("m")), F.lit(1.0))
            now = now.join(margin, d).withColumn("fitted", F.least(F.col("fitted") * factor, F.col("natural") / budget)).drop("m", "target")
        now = work.save(now, f"raked-{k}")
        if k:
            work.drop(f"raked-{k - 1}")
        moved = now.agg(F.max(F.abs(F.col("fitted") - F.col("before")))).first()[0]
        now = now.drop("before")
        if moved < CLOSE:
            break
    return now


def uniform(key: Column, seed: int) -> Column:
    """In [0, 1), from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(spark: SparkSession, described: DataFrame, targets: Mapping[str, Mapping[str, float] | float], id_col: str = "doc_id", budget: float = BUDGET, seed: int = 7, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """``described`` (id, tokens, a column for each dimension of ``targets``) with weight, probability and kept.

    Null values of a dimension are one value of their own. The probability is at most 1; a cell that would need
    more is taken whole, and the others make up for it as far as they can; more than ``local_cells`` cells are raked
    as DataFrames, by the same rule to the same result. Documents without tokens follow their cell; a cell without tokens keeps the budget's share. An empty table gives an empty result.
    """
    work = Scratch(spark, "mixing")
    dims = list(targets)
    rows = work.save(described.withColumns({f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit("\0none")) for d in dims}), "described")
    keys = [f"_{d}" for d in dims]
    cells = work.save(rows.groupBy(*keys).agg(F.sum("tokens").cast("double").alias("n")), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    if not total:
        none = F.lit(budget)
        return rows.withColumns({"weight": F.lit(1.0), "probability": none, "kept": uniform(F.col(id_col), seed) < none}).drop(*keys)
    if cells.count() <= local_cells:
        held = cells.orderBy(*keys).collect()
        n = np.array([r["n"] for r in held])
        margins, wanted = [], []
        for d, key in zip(dims, keys, strict=True):
            values = sorted({r[key] for r in held})
            number = {v: i for i, v in enumerate(values)}
            margins.append(np.array([number[r[key]] for r in held]))
            share = np.bincount(margins[-1], n, len(values)) / total
            goal = targets_of(dict(zip(values, share, strict=True)), targets[d])
            wanted.append(np.array([goal[v] if s > 0 else 0.0 for v, s in zip(values, share, strict=True)]))
        fitted = rake(n, margins, wanted, budget)
        weight = np.divide(fitted, n / total, out=np.ones_like(n), where=n > 0)
        scale = _scale(lambda x: (n[x * weight >= 1].sum(), (n * weight)[x * weight < 1].sum()), budget * total)
        told = [(*(r[k] for k in keys), float(w), float(min(1.0, scale * w)) if r["n"] > 0 else budget) for r, w in zip(held, weight, strict=True)]
        fitted_cells = F.broadcast(spark.createDataFrame(told, ", ".join(f"{k} string" for k in keys) + ", weight double, probability double"))  # at most local_cells
    else:
        natural = cells.withColumn("natural", F.col("n") / total)
        goals = {}
        for d, key in zip(dims, keys, strict=True):
            share = natural.groupBy(key).agg(F.sum("natural").alias("s"))
            t = targets[d]
            if isinstance(t, Mapping):
                given = spark.createDataFrame([(str(v), float(x)) for v, x in t.items()], f"{key} string, given double")
                raw = share.join(given, key, "left").withColumn("target", F.when(F.col("s") > 0, F.coalesce("given", "s")).otherwise(0.0))
            else:
                raw = share.withColumn("target", F.when(F.col("s") > 0, F.pow("s", F.lit(float(t)))).otherwise(0.0))
            whole = raw.agg(F.sum("target")).first()[0]
            goals[key] = raw.select(key, (F.col("target") / whole).alias("target"))
        raked = rake_frames(work, natural, keys, goals, budget)
        weighted = work.save(raked.select(*keys, "n", F.coalesce(F.try_divide(F.col("fitted"), F.col("natural")), F.lit(1.0)).alias("weight")), "weighted")

        def sums(x: float) -> tuple[float, float]:
            whole = x * F.col("weight") >= 1
            return tuple(v or 0.0 for v in weighted.agg(F.sum(F.when(whole, F.col("n"))), F.sum(F.when(~whole, F.col("n") * F.col("weight")))).first())

        scale = _scale(sums, budget * total)
        likely = F.when(F.col("n") > 0, F.least(F.lit(scale) * F.col("weight"), F.lit(1.0))).otherwise(budget)
        fitted_cells = weighted.select(*keys, "weight", likely.alias("probability"))
    return rows.join(fitted_cells, keys).withColumn("kept", uniform(F.col(id_col), seed) < F.col("probability")).drop(*keys)


def _scale(sums: Callable[[float], tuple[float, float]], goal: float) -> float:
    """The factor at which the expected tokens meet the goal, or at which no cell can give more.

    sums(x): tokens of the cells with x * weight >= 1, and the others' tokens times their weight. What is expected
    is concave in x, so Newton's steps from 0 rise to the factor, and each but the last fills a cell.
    """
    scale = 0.0
    while True:
        whole, rest = sums(scale)
        then = (goal - whole) / rest if rest > 0 else scale
        if then <= scale * (1 + 1e-12):
            return scale
        scale = then
