"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, mixing to target weights."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import decontaminate, line_dedup, ordinal, pivotal, simhash
from trialweave.llm.common import shared_folder, table

#: SQL can express neither the fitted model nor XXH64.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, does not reject; nulls and empty texts stay, rows that repeat are judged alike."""
    model = ordinal.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal.with_severity(docs, model).where("not toxic").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; n_chars follows the text."""
    cut = line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.select(*docs.columns)


def _mark(docs: DataFrame) -> Column:
    """What tells rows apart: the id, known ones first, and a hash of all columns. Rows of one mark are the same in every column."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("hash"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the one row with the smallest id (null ids last; rows of one id by a hash).

    Rows that share an id, or have none, are documents of their own; of rows that are the same in every column one stays.
    """
    marked = docs.withColumn("_mark", _mark(docs))
    groups = simhash.simhash_components(marked.select("_mark", "text"), doc="_mark")
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_mark")).distinct()
    return marked.join(first, "_mark", "left_semi").dropDuplicates(["_mark"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; rows that share an id, or have none, are judged each by its own text."""
    marked = docs.withColumn("_mark", _mark(docs))
    found = decontaminate.contaminated(marked.select("_mark", "text"), table(spark, sf_dir, "benchmark"), doc="_mark")
    return marked.join(found.select(F.col("doc_id").alias("_mark")).distinct(), "_mark", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with `taken` words of each (repeats counted) and its source's target.

    Columns of `docs` that have the name of a result give way to it. Rows that are the same in id, text and source take the
    same, in whole words.
    """
    added = ("size", "source_size", "target", "taken")
    mark = F.struct(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text", "source").alias("hash"))
    marked = docs.drop(*added).withColumn("_mark", mark)
    mixed = pivotal.pivotal_mix(marked.select("_mark", "text", "source"), doc="_mark")
    same = [F.first(c).alias(c) for c in added[:3]]
    taken = mixed.groupBy(F.col("doc_id").alias("_mark")).agg(*same, F.floor(F.sum("taken") / F.count("*")).alias("taken"))
    return marked.join(taken.where("taken > 0"), "_mark").drop("_mark")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
