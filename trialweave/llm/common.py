"""Helpers shared by the corpus operators: stored tables, hot keys, components of a link table."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A key that holds more than one part in HOT_PARTS of all rows is split, so at most HOT_PARTS keys are hot.
HOT_PARTS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share; set here only where the session has none, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="trialweave-llm-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def known_key(value: str | Column) -> Column:
    """A key that is never null and keeps null apart from every text."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def span_columns(found: DataFrame, kinds: Sequence[str], *keep: str) -> DataFrame:
    """Digest columns of `base` and `added`, arrays of (start, kind, end): n_<kind> each, base_sha256 and spans.

    `kinds` gives the order of kinds that start at one place; other kinds come after them, by name.
    """
    order = F.array(*[F.lit(k) for k in kinds])

    def joined(spans: Column) -> Column:
        place = lambda s: F.coalesce(F.nullif(F.array_position(order, s["kind"]), F.lit(0)), F.lit(len(kinds) + 1))
        ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), place(s).alias("b"), s["kind"].alias("c"), s["end"].alias("d"))))
        return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["c"], s["a"].cast("string"), s["d"].cast("string"))), ",")

    names = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(names) - F.size(F.array_remove(names, k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(*keep, *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def unit(*parts: str | Column) -> Column:
    """A repeatable number in [0, 1) drawn from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hot_keys(counts: DataFrame, key: str, n: str = "n", parts: int = HOT_PARTS) -> DataFrame:
    """The keys with more than 1/parts of all rows and the number of pieces to deal each to (below 2 * parts in all)."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    share = F.col(n) * F.lit(float(parts)) / F.lit(float(max(total, 1)))
    return counts.where(share > 1).select(key, F.ceil(share).cast("int").alias("_pieces"))


def with_pieces(df: DataFrame, key: str, hot: DataFrame, *spread: str | Column) -> DataFrame:
    """Adds `_piece`: rows of a hot key are dealt by the hash of `spread`; other keys have piece 0."""
    dealt = F.pmod(F.xxhash64(*spread), F.coalesce("_pieces", F.lit(1))).cast("int")
    return df.join(F.broadcast(hot), key, "left").withColumn("_piece", dealt).drop("_pieces")


def in_every_piece(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Repeats the one row of a hot key for each of its pieces."""
    pieces = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
    return df.join(F.broadcast(hot), key, "left").withColumn("_piece", F.explode(pieces)).drop("_pieces")


def split_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, *spread: str | Column) -> DataFrame:
    """Left join of many rows to one row a key, with hot keys dealt over pieces. `key` is never null."""
    left, right = with_pieces(big, key, hot, *spread), in_every_piece(small, key, hot)
    return left.join(right, [key, "_piece"], "left").drop("_piece")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root being the smallest node of its component.

    `links` has columns a and b. Large-star and small-star rounds alternate until the links form stars; each round
    is stored, and only a count and a checksum of it reach the driver.
    """
    now = stored(_downward(links))
    seen = None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first()) != seen:
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("least"))
        large = _downward(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = stored(_downward(moved.unionByName(least.select("a", F.col("least").alias("b")))))
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _downward(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
