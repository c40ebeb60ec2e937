"""Friedman rank test over complete, unreplicated blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.models.tails import chi2_tail


@dataclass(frozen=True)
class FriedmanResult:
    statistic: float
    df: int
    blocks: int
    p_value: float


def complete_blocks(df: DataFrame, y: str, treatment: str, block: str, drop_incomplete: bool = False) -> DataFrame:
    """Rows of the blocks that hold every treatment exactly once.

    A repeated (block, treatment) raises; so does an incomplete block, unless asked to be
    dropped. After this check a block has as many rows as there are treatments.
    """
    rows = df.select(treatment, block, y).dropna()
    cells = rows.groupBy(block, treatment).agg(F.count(F.lit(1)).alias("_n"))
    sizes = cells.groupBy(block).agg(F.max("_n").alias("_most"), F.count(F.lit(1)).alias("_k"))
    most, smallest = sizes.agg(F.max("_most"), F.min("_k")).first()
    if most is not None and most > 1:
        raise ValueError(f"a {block} has more than one row for a {treatment}")
    k = rows.select(treatment).distinct().count()
    if smallest is not None and smallest < k and not drop_incomplete:
        raise ValueError(f"a {block} lacks a {treatment}")
    per_block = F.count(F.lit(1)).over(Window.partitionBy(block))
    return rows.withColumn("_k", per_block).where(F.col("_k") == k)


def average_ranks(df: DataFrame, y: str, block: str, out: str = "rank") -> DataFrame:
    """Rank within the block, ties sharing their mean rank; also the tie size."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(block, y))
    low = F.rank().over(Window.partitionBy(block).orderBy(y))
    return df.withColumns({"_ties": ties, "_rank": low}).withColumn(
        out, F.col("_rank") + (F.col("_ties") - 1) / 2).drop("_rank")


def friedman_stats(df: DataFrame, y: str, treatment: str, block: str, drop_incomplete: bool = False) -> DataFrame:
    """One row: statistic, degrees of freedom, number of blocks."""
    ranked = average_ranks(complete_blocks(df, y, treatment, block, drop_incomplete), y, block)
    per_treatment = ranked.groupBy(treatment).agg(
        F.sum("rank").alias("_r"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("_ties") * F.col("_ties") - 1).alias("_t"))
    totals = per_treatment.agg(F.count(F.lit(1)).alias("k"), F.max("_n").alias("blocks"), F.sum("_t").alias("_t"),
                               F.sum("_r").alias("_r1"), F.sum(F.col("_r") * F.col("_r")).alias("_r2"))
    k, n = F.col("k"), F.col("blocks")
    # rank sums always add up to n k (k + 1) / 2, which is their mean times k
    spread = F.col("_r2") - F.col("_r1") * F.col("_r1") / k
    return totals.select(
        F.try_divide(12 * spread, n * k * (k + 1) - F.try_divide(F.col("_t").cast("double"), k - 1)).alias("statistic"),
        (k - 1).alias("df"), n.alias("blocks"))


def friedman(df: DataFrame, y: str, treatment: str, block: str, drop_incomplete: bool = False) -> FriedmanResult:
    statistic, dof, blocks = friedman_stats(df, y, treatment, block, drop_incomplete).first()
    if statistic is None:
        raise ValueError("no complete block, or all values tied")
    return FriedmanResult(statistic, dof, blocks, chi2_tail(statistic, dof))
