"""Snapshots, rating exports and small fixed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """A questionnaire export, as parquet or as comma-separated text with a header."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"')
    return spark.read.parquet(path)


def write_snapshot(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Store a table as parquet; ``keys`` become folders that later filters can skip.

    Rows are rebalanced by folder first: files of a sensible size, a large folder in many.
    """
    if keys:
        df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, by: Sequence[str], order: Sequence[str] = (), buckets: int = 200) -> DataFrame:
    """Store a table in ``buckets`` files by the hash of ``by``, each sorted by ``by`` and ``order``; returns the stored table.

    Windows, aggregates and joins on exactly these columns then need no exchange, in any later session that has
    the table ``name`` in its catalog. A group is in one file, so use it where groups are of bounded size; a hot
    group is better off in a plain snapshot, where scans cut it along the time.
    """
    writer = df.repartition(buckets, *by).write.mode("overwrite").option("path", path).bucketBy(buckets, *by)
    writer.sortBy(*by, *order).saveAsTable(name)
    return df.sparkSession.table(name)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def unit_grid(spark: SparkSession, n: int = 100) -> DataFrame:
    """Rows 1/n, 2/n, ..., 1 as ``x``."""
    return spark.range(1, n + 1).select((F.col("id") / F.lit(float(n))).alias("x"))
