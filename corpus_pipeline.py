"""A training corpus from raw documents: toxicity, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from barloom.llm.common import Scratch, maybe_broadcast, table
from barloom.llm.queries import MIX_TARGETS, tokenizer_path


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for the ids of ``dropped``; the ids are broadcast only when few."""
    return docs.join(maybe_broadcast(dropped.select("doc_id")), "doc_id", "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scores reject go."""
    labels = table(spark, sf_dir, "labels").where(toxicity.may_learn(F.col("doc_id")))
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, of repeated rows one; an id with several texts loses only those that are
    copies. Rows without an id are not told apart and stay."""
    work = Scratch(spark, "stage-exact")
    each = exact_dedup.dedup_exact(spark, docs).groupBy("doc_id", "text_sha256")
    found = work.save(each.agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "found")
    partly = found.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all")).where("some and not all and doc_id is not null")
    if partly.isEmpty():
        stays = without(docs, found.where("not kept"))
    else:
        text = exact_dedup.digests(docs.withColumn("_row", F.struct(*docs.columns)), "_row", "text", 0)
        gone = found.where("not kept").select(F.col("doc_id").alias("_id"), "text_sha256")
        stays = text.withColumn("_id", F.col("_row.doc_id")).join(gone, ["_id", "text_sha256"], "left_anti").select("_row.*")
    return stays if found.where("n > 1").isEmpty() else stays.dropDuplicates(["doc_id", "text"])


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; all rows of an id share its lot."""
    work = Scratch(spark, "stage-near")
    found = work.save(jaccard_join.link_components(spark, docs).select("doc_id", "component_id"), "found")
    return without(docs, found.where("doc_id <> component_id"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target weights of sources, languages and topics; an id with several rows stays only
    where all are drawn."""
    work = Scratch(spark, "stage-mix")
    mixed = mixing.mix(spark, mixing.describe(docs, mixing.fit_topics(docs)), MIX_TARGETS)
    return without(docs, work.save(mixed.where("not kept").select("doc_id").distinct(), "left-out"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL states the classifier, the raking or the tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again; the last stage's rows.

    Null and empty texts are documents without words: not toxic, equal to each other, linked with nothing, packed as
    the end id alone. Texts are read whole, whatever their length. Rows without an id go only where they are toxic:
    the other stages tell rows apart by their id. Columns beyond those of documents pass through, whatever their
    names. An empty table gives an empty result.
    """
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
