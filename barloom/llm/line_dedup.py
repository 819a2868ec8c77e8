"""Line dedup by a suffix array over line-id sequences, built by distributed prefix doubling.

A document is the sequence of its non-blank lines; a line's id is 128 bits of its text. Round j ranks, over all documents,
the suffixes in the order of their first 2**j lines, from the pairs of ranks of round j - 1; only suffixes whose 2**j
lines occur again go on, so the tables shrink fast and no round holds text. The interval of suffixes with a common
prefix of m lines is the set of equal pairs (rank of the first 2**j lines, rank of the last 2**j of the m). A maximal
repeated run of ``words`` words or more is the union of those intervals' runs that are shortest from some line on or up
to some line: any line of it lies in a run of so many words, inside the maximal one, that cannot be cut on one of its
sides. These intervals are looked up, so every maximal run is found, and the threshold holds for intervals. Of an
interval's runs the first, by document id and line, stays; the lines of the others are deleted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, rows_of

#: A repeated run of lines is deleted when it has so many words.
WORDS = 50


def runs_of(counts: np.ndarray, words: int) -> set[tuple[int, int]]:
    """(start, number of lines) of the shortest runs of ``words`` words from each start, and up to each end."""
    total = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    ends = np.searchsorted(total, total[:-1] + words)  # lines before it suffice
    starts = np.searchsorted(total, total[1:] - words, "right") - 1
    forward = {(s, int(e) - s) for s, e in enumerate(ends.tolist()) if e <= n}
    return forward | {(s, e + 1 - s) for e, s in enumerate(starts.tolist()) if s >= 0}


def _lines(words: int):
    """One row for each non-blank line: its document, number, line id in two halves, and the lengths of runs that begin there."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            owner, numbers, high, low, lengths = [], [], [], [], []
            for k, (text,) in enumerate(rows_of(batch, "text")):
                lines = [x for line in (text or "").split("\n") if (x := line.strip())]
                begin: list[list[int]] = [[] for _ in lines]
                for s, m in sorted(runs_of(np.array([len(x.split()) for x in lines], np.int64), words)):
                    begin[s].append(m)
                owner += [k] * len(lines)
                numbers += range(len(lines))
                for x in lines:
                    whole = xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass"))
                    high.append((whole >> 64) - (1 << 63))
                    low.append((whole & (1 << 64) - 1) - (1 << 63))
                lengths += begin
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(numbers, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(lengths, pa.list_(pa.int32()))], ["doc", "i", "high", "low", "runs"])

    return run


def _ranked(work: Scratch, pairs: DataFrame, name: str) -> DataFrame:
    """(doc, i, rank) of the rows (doc, i, a, b) whose pair (a, b) occurs again; ranks follow the pairs' order."""
    again = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a range sort numbers the pairs in order without bringing them together
    ranks = work.save(again.select("a", "b").orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()), f"{name}-ranks")
    return work.save(pairs.join(ranks, ["a", "b"]).select("doc", "i", "rank"), name)


def repeated_runs(spark: SparkSession, work: Scratch, docs: DataFrame, words: int) -> DataFrame:
    """(doc, i, m): runs of m lines from line i on that occur earlier; docs has doc and text."""
    schema = T.StructType([docs.schema["doc"], T.StructField("i", T.IntegerType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("runs", T.ArrayType(T.IntegerType()))])
    lines = docs.mapInArrow(_lines(words), schema)
    if not docs.groupBy("doc").count().where("count > 1").isEmpty():  # repeated rows are one document
        lines = lines.dropDuplicates(["doc", "i"])
    lines = work.save(lines, "lines")
    level = _ranked(work, lines.select("doc", "i", F.col("high").alias("a"), F.col("low").alias("b")), "level-0")
    runs = lines.join(level.select("doc", "i"), ["doc", "i"], "left_semi").select("doc", "i", F.explode("runs").alias("m")).distinct()
    runs = work.save(runs.withColumn("j", F.floor(F.log2("m") + 1e-9).cast("int")), "runs")
    longest = runs.agg(F.max("j")).first()[0]
    found = None
    for j in range(0 if longest is None else longest + 1):
        if j:
            half = 1 << (j - 1)
            then = level.select("doc", (F.col("i") - half).alias("i"), F.col("rank").alias("b"))
            pairs = work.save(level.withColumnRenamed("rank", "a").join(then, ["doc", "i"]), f"pairs-{j}")
            level = _ranked(work, pairs, f"level-{j}")
        # the run's first and last 2**j lines
        first = runs.where(F.col("j") == j).join(level.withColumnRenamed("rank", "a"), ["doc", "i"])
        last = level.select("doc", F.col("i").alias("at"), F.col("rank").alias("b"))
        here = first.withColumn("at", F.col("i") + F.col("m") - (1 << j)).join(last, ["doc", "at"]).select("doc", "i", "m", "a", "b")
        found = here.withColumn("j", F.lit(j)) if found is None else found.unionByName(here.withColumn("j", F.lit(j)))
    if found is None:
        return runs.select("doc", "i", "m").limit(0)
    found = work.save(found, "intervals")
    # written, so that an interval of very many runs can be dealt to several tasks
    start = work.save(found.groupBy("j", "m", "a", "b").agg(F.min(F.struct("doc", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    return found.join(start, ["j", "m", "a", "b"]).where(F.struct("doc", "i") != F.col("first")).select("doc", "i", "m").distinct()


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row for each row of docs: id, text without later copies, n_lines (not blank), removed (their numbers).

    Lines are compared without white space at their ends; blank lines do not interrupt a run and stay. A null text
    stays null, an empty one empty. The first occurrence of a line is never deleted. Repeated rows are one document;
    rows of one id with different texts are different ones, as are different texts without an id; these come first. An
    empty table gives an empty result; other columns are not read; a text is read whole, whatever its length. Runs of
    fewer words than ``words`` stay: with 1, every repeated line goes.
    """
    work = Scratch(spark, "line-dedup")
    slim = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("doc"), F.col(text_col).alias("text"))
    later = repeated_runs(spark, work, slim, words)
    # bounded by the lines of one document
    cuts = work.save(later.groupBy("doc").agg(F.collect_list(F.struct("i", "m")).alias("cuts")), "cuts")
    work.drop("lines", "runs", "intervals", "firsts", *(f"{x}-{j}{y}" for j in range(40) for x, y in (("level", ""), ("level", "-ranks"), ("pairs", ""))))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts, counts, gone = [], [], []
            for text, spans in rows_of(batch, "text", "cuts"):
                drop = {k for c in spans or () for k in range(c["i"], c["i"] + c["m"])}
                kept, k = [], 0
                for line in (text or "").split("\n"):
                    if line.strip():
                        k += 1
                        if k - 1 in drop:
                            continue
                    kept.append(line)
                texts.append(None if text is None else "\n".join(kept))
                counts.append(k)
                gone.append(sorted(drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], schema.names)

    # always dealt out by document, never broadcast: deletions grow with the corpus, and so the plan is one at every size
    return slim.join(cuts.hint("shuffle_hash"), "doc", "left").select("doc.id", "text", "cuts").mapInArrow(cut, schema)
