"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Every document belongs to one of 2**k runs, by a hash of its id. Within a task equal digests of a run become one row
before anything moves; a run is then written in the order of its digests, each once, with what verifies it (size in
bytes, a second hash), the number of its rows, and its smallest and largest id. In binomial rounds 2**FAN_BITS runs
merge into one, until one is left: rows are brought into the order of (run, digest, id) by a sort, and of equal
neighbours the winner stays and takes over the others' rows. A round is dealt out by (run, digest), so no task waits for a
whole level, and a digest that a third of all rows share enters the first round as one row of each run. The way back
down joins the last level to the runs of the first, and these to the documents by (digest, run): the hot digest stays
spread over its runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: 2**RUN_BITS runs; each round merges 2**FAN_BITS of them.
RUN_BITS, FAN_BITS = 8, 4
KEY = ["text_sha256", "n_bytes", "check"]


def digests(docs: DataFrame, id_col: str, text_col: str, run_bits: int) -> DataFrame:
    """(id, run, digest, size in bytes, second hash): texts are equal when digest, size and second hash are."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col), text.alias("text")).select(
        F.col(id_col),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << run_bits)).cast("int").alias("run"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("check"),
    )


def first_runs(each: DataFrame, id_col: str) -> DataFrame:
    """The sorted runs: each digest of a run once; sorted by digest where they are written."""
    found = each.groupBy("run", *KEY).agg(F.count(F.lit(1)).alias("size"), F.min(id_col).alias("low"), F.max(id_col).alias("high"))
    return found.sortWithinPartitions("run", *KEY)


def merged(runs: DataFrame, bits: int) -> DataFrame:
    """One round: runs that agree but for their lowest ``bits`` bits become one.

    The multiway merge is a sort by (run, digest, smallest id) and a pass over equal neighbours, 2**bits at most, that
    keeps the row of the smallest id, verified by size and second hash, with the sum of the rows and the largest id.
    """
    same = Window.partitionBy("run", *KEY)
    order = same.orderBy(F.asc_nulls_last("low"), F.asc_nulls_last("high"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = runs.withColumn("run", F.shiftright("run", bits))
    return (
        met.withColumns({"place": F.row_number().over(order), "size": F.sum("size").over(whole), "high": F.max("high").over(whole)})
        .where("place = 1")
        .drop("place")
    )


def dedup_exact(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", run_bits: int = RUN_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays (``keep="smallest"``: the smallest). Rows that repeat an id repeat their result; group_size
    counts rows. Rows of one id with different texts are judged each by its text. A row without an id stays only where
    its text has no row with one. An empty table gives an empty result; other columns are not read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is {keep!r}, not 'largest' or 'smallest'")
    work = Scratch(spark, "exact-dedup")
    each = work.save(digests(docs, id_col, text_col, run_bits), "digests")
    first = work.save(first_runs(each, id_col), "runs")
    level, left = first, run_bits
    while left > 0:
        level = merged(level, min(fan_bits, left))
        left -= fan_bits
    root = level.select(*KEY, F.col("size").alias("group_size"), F.col("high" if keep == "largest" else "low").alias("keep_id"))
    down = first.select("run", *KEY).join(root, KEY)
    return each.join(down, ["run", *KEY]).select(id_col, "keep_id", F.col("group_size").cast("long"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
