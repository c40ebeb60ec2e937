"""Roll-ups of the session table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.missing import (na_count_if, na_max, na_mean, na_min, na_sum,
                                          only_value)
from trialweave.operators.quantiles import box_stats, exact_quantiles  # noqa: F401
from trialweave.operators.ratings import PLAYER_KEYS
from trialweave.operators.scans import join_null_safe, ordered_scan, stored
from trialweave.operators.sequence import SESSION_KEYS


def add_metrics(sessions: DataFrame, metrics: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Add metric columns; a session without the metric gets NULL, not 0."""
    return join_null_safe(sessions, metrics, keys)


def condition_summary(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("GameTitle", "Condition").agg(
        na_mean("rate_trial").alias("avg_rate"), na_sum("accInput").alias("sum_acc"))


def participant_summary(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("Participant", "GameTitle").agg(
        only_value("gender").alias("gender"),
        na_mean("rate_trial").alias("mean_rate"), na_min("rate_trial").alias("min_rate"),
        na_max("rate_trial").alias("max_rate"), na_mean("rate_feedback").alias("mean_feedback"),
        only_value("mi_experience").alias("mi_experience"), na_mean("time_total").alias("time_total"),
        na_sum("mi_recog").alias("mi_recog_total"), na_sum("mi_recog_rest").alias("mi_recog_rest"),
        na_sum("mi_recog_window").alias("mi_recog_window"), na_mean("fp_rate_minute").alias("fp_rate_minute"))


def order_summary(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("ConditionOrder").agg(
        na_mean("rate_trial").alias("mean_rate_trial"), na_mean("rate_feedback").alias("mean_rate_feedback"))


def group_counts(df: DataFrame, keys: Sequence[str], out: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def distinct_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The distinct known values of each group, as rows."""
    return df.select(*keys, value).where(F.col(value).isNotNull()).distinct()


def value_counts(df: DataFrame, keys: Sequence[str], value: str, out: str = "n") -> DataFrame:
    """In how many groups each value occurs."""
    return group_counts(distinct_values(df, keys, value), [value], out)


def rate_spread(sessions: DataFrame, keys: Sequence[str] = ("Participant", "GameTitle"),
                value: str = "rate_trial", limit: float = 25.0,
                pieces: bool = True) -> DataFrame:
    """Median, min and max per group, kept if both lie within ``limit`` percent of the median."""
    top, mid, low = F.col("max_value"), F.col("median_value"), F.col("min_value")
    return (exact_quantiles(sessions, keys, value, {"median_value": 0.5}, pieces=pieces)
            .withColumns({"percentage_change_max": F.try_divide(top - mid, top) * 100,
                          "percentage_change_min": F.try_divide(mid - low, mid) * 100})
            .where((F.col("percentage_change_max") < limit) & (F.col("percentage_change_min") < limit)))


def low_performers(sessions: DataFrame, keys: Sequence[str] = ("Participant", "GameTitle"),
                   value: str = "rate_trial", limit: float = 0.5) -> DataFrame:
    """Groups whose largest value stays below the limit."""
    return sessions.groupBy(*keys).agg(na_max(value).alias("max_value")).where(F.col("max_value") < limit)


def balance_table(df: DataFrame, keys: Sequence[str], levels: Mapping[str, tuple[str, str]],
                  na: str = "propagate") -> DataFrame:
    """``{out: (column, level)}``: how often each level occurs, all in one pass."""
    return df.groupBy(*keys).agg(*[na_count_if(F.col(c) == level, na).alias(out)
                                   for out, (c, level) in levels.items()])


def group_means(df: DataFrame, by: Sequence[str], means: Sequence[str],
                bias: Mapping[str, tuple[str, str]] | None = None, na: str = "propagate",
                mean_products: bool = False) -> DataFrame:
    """Means per group; ``bias`` columns are the product of two group means.

    ``mean_products=True`` adds ``<name>_mean_product``, the mean of the row products,
    which is a different number.
    """
    aggs = [na_mean(c, na).alias(c) for c in means]
    for name, (a, b) in (bias or {}).items():
        aggs.append((na_mean(a, na) * na_mean(b, na)).alias(name))
        if mean_products:
            aggs.append(na_mean(F.col(a) * F.col(b), na).alias(f"{name}_mean_product"))
    return df.groupBy(*by).agg(*aggs)


def _joined(order: Sequence[Column], text: Column, sep: str) -> Column:
    """Aggregate: texts of the group in order, missing ones written ``NA``."""
    at = [x for c in order for x in (c.isNull(), c)]
    fields = [c.alias(f"o{i}") for i, c in enumerate(at)]
    item = F.struct(*fields, F.coalesce(text.cast("string"), F.lit("NA")).alias("text"))
    return F.array_join(F.sort_array(F.collect_list(item)).getField("text"), sep)


def ordered_concat(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str,
                   sep: str = "") -> DataFrame:
    """One text per group: its values in order.

    The text is one cell, so use keys with few rows each, as the conditions of a participant.
    """
    return df.groupBy(*keys).agg(_joined([F.col(c) for c in order], F.col(value), sep).alias(out))


def sequence_frequency(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """How many groups share each ordered text."""
    return group_counts(ordered_concat(df, keys, value, order, out), [out], "n")


def distinct_concat(df: DataFrame, keys: Sequence[str], value: str, order: str, out: str,
                    sep: str = ",") -> DataFrame:
    """Distinct values of each group in first-seen order, and their number.

    Rows are reduced to one per (group, value) first, so a cell holds distinct values only.
    """
    first_seen = df.groupBy(*keys, value).agg(F.min(order).alias("_seen"))
    return first_seen.groupBy(*keys).agg(
        _joined([F.col("_seen"), F.col(value)], F.col(value), sep).alias(out),
        F.count(F.lit(1)).alias("n_values"))


def stability(sessions: DataFrame, keys: Sequence[str] = PLAYER_KEYS, label: str = "mi_group",
              order: str = "Condition") -> DataFrame:
    """Whether the sessions of a participant share one label, and the labels in order."""
    labels = distinct_concat(sessions, keys, label, order, "stability_type")
    return labels.withColumn("mi_stability", F.when(F.col("n_values") > 1, "unstable").otherwise("stable")).drop("n_values")


def member_lists(df: DataFrame, keys: Sequence[str], member: str, out: str, size: int = 1000,
                 pieces: bool = True) -> DataFrame:
    """Group count and member list, the list in pieces of at most ``size`` members.

    A group with few members is one row (``chunk`` 0); a larger one has more rows, so no
    member is dropped and no cell grows with the data.
    """
    members = df.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("_n"))
    if pieces:
        members = stored(members)

    def build(rows, scan):
        rows = scan.running_sum(rows, _at=F.lit(1))
        return scan.whole(rows, count=F.sum("_n"))

    numbered = ordered_scan(members, keys, [member], build, pieces)
    chunk = F.floor((F.col("_at") - 1) / size)
    return (numbered.groupBy(*keys, "count", chunk.alias("chunk"))
            .agg(_joined([F.col("_at")], F.col(member), ",").alias(out)))
