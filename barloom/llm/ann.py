"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``length`` nearest pivots in order. Each pivot has an inverted file of the vectors that
name it, with the rank at which they do. A query adds up, over the files of its own pivots, length - max(rank, own
rank): with the sum S the footrule distance of the two orders is a constant less 2 * S. The vectors of least
footrule distance, ties included, are compared with the query by their original components.

The index is cut into slices and the query set into blocks; every block meets every slice once.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Pivots are chosen from a sample of so many vectors, those with the least hashed ids, each farthest from the ones before.
PIVOTS, SAMPLE = 128, 4096
#: Pivots that represent a vector.
LENGTH = 32
#: Part of a slice, and least number of its vectors, that are compared by their components.
PART, LEAST = 0.35, 512
#: Vectors in a slice and queries in a block, about.
SLICE, BLOCK = 16_384, 4_096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one row for each id; without null, zero or non-finite vectors and those of an uncommon dimension."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    return rows.dropDuplicates(["id"])


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Farthest-first from the sampled vectors; fewer when there are fewer different ones."""
    found = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in found], float)
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < pivots and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    d = (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :length].astype(np.int16)


def _represent(pivots: np.ndarray, length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = np.array(part.column(1).flatten()).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(orders(x, pivots, length)), pa.list_(pa.int16()))], ["id", "v", "pivots"])

    return run


def build_index(work: Scratch, rows: DataFrame, pivots: np.ndarray, length: int = LENGTH, slice_size: int = SLICE) -> tuple[DataFrame, int]:
    """(id, v, pivots, slice), written to the shared folder, and the number of slices."""
    n_slices = max(1, ceil(rows.count() / slice_size))
    held = rows.mapInArrow(_represent(pivots, length), "id long, v array<double>, pivots array<short>")
    return work.save(held.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(n_slices)).cast("int")), "index"), n_slices


def _search(k: int, n_pivots: int, part: float, least: int):
    def run(index, queries):
        import pandas as pd

        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, x = index["id"].to_numpy(), np.stack(index["v"].to_numpy())
        names = np.stack(index["pivots"].to_numpy())
        length = names.shape[1]
        # inverted files: the rows that name a pivot, and at which rank
        flat = names.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))
        row, rank = (by_pivot // length).astype(np.int32), (by_pivot % length).astype(np.int16)
        take = min(len(ids), max(least, ceil(part * len(ids))))
        out = []
        for query, q, own in zip(queries["id"], queries["v"], queries["pivots"], strict=True):
            near = np.zeros(len(ids), np.int32)
            for r, p in enumerate(own):
                files = slice(cuts[p], cuts[p + 1])
                near[row[files]] += length - np.maximum(rank[files], r)
            bound = np.partition(near, len(ids) - take)[len(ids) - take]
            chosen = np.flatnonzero(near >= bound)
            chosen = chosen[ids[chosen] != query]
            score = np.sqrt(((x[chosen] - q) ** 2).sum(1))
            if len(score) > k:
                best = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
                chosen, score = chosen[best], score[best]
            best = np.lexsort((ids[chosen], score))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[chosen[best]], "score": score[best]}))
        return pd.concat(out)

    return run


def nearest(spark: SparkSession, vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, sample: int = SAMPLE, length: int = LENGTH, part: float = PART, least: int = LEAST, slice_size: int = SLICE, block_size: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by Euclidean distance, ties to the smaller id.

    ``is_query`` tells from the column id which rows ask; candidates are all rows but the query's own. Vectors that
    are null, zero or hold null or non-finite components take no part; repeated ids count once. With fewer than k
    candidates all are returned; a slice of up to ``least`` vectors is compared whole. Other columns are not read.
    """
    work = Scratch(spark, "ann")
    rows = work.save(usable(vectors, id_col, vector_col), "usable")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == common["d"])
    found = choose_pivots(rows, pivots, sample)
    index, n_slices = build_index(work, rows, found, length, slice_size)
    asking = index.where(is_query(F.col("id")))
    n_blocks = max(1, ceil(asking.count() / block_size))
    block = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(n_blocks)).cast("int")
    asked = asking.withColumn("block", block).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    against = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = against.groupBy("slice", "block").cogroup(asked.groupBy("slice", "block"))
    near = pairs.applyInPandas(_search(k, len(found), part, least), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
