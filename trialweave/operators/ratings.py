"""Questionnaire tables: union, clean, order and relate the ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.missing import label_cascade, not_in_na
from trialweave.operators.scans import join_null_safe, ordered_scan
from trialweave.operators.sequence import SESSION_KEYS, fill_down_up

PLAYER_KEYS = ("GameTitle", "Participant")

# Condition labels of sessions that were run wrongly.
DISCARDED_CONDITIONS = ("50A_WRONG", "50A-2")


def combine_games(kiwi: DataFrame, hand: DataFrame) -> DataFrame:
    """Union both tables by column name, with the game as a column."""
    kiwi = kiwi.drop("Participant").withColumnRenamed("KiwiParticipant", "Participant")
    return (kiwi.withColumn("GameTitle", F.lit("Kiwi"))
            .unionByName(hand.withColumn("GameTitle", F.lit("HandStrength")), allowMissingColumns=True))


def keep_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the member table; a missing key is no member."""
    return df.join(members.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def overall_order(df: DataFrame, out: str = "OrderAll") -> DataFrame:
    """Play order over both games: the game played second counts on from four."""
    order = F.col("Order")
    return df.withColumn(out, label_cascade(order, [
        ((F.col("GameTitle") == "Kiwi") & (F.col("GameOrder") == "HandKiwi"), order + 4),
        ((F.col("GameTitle") == "HandStrength") & (F.col("GameOrder") == "KiwiHand"), order + 4)]))


def rel_to_first(df: DataFrame, value: str, out: str, keys: Sequence[str] = PLAYER_KEYS,
                 pieces: bool = True) -> DataFrame:
    """Value minus the first of its group in ascending order of the value itself.

    Missing values sort last, so the first one is the smallest known one.
    """
    def build(rows, scan):
        rows = scan.whole(rows, _first=F.min(value))
        return rows.withColumn(out, F.col(value) - F.col("_first")).drop("_first")

    return ordered_scan(df, keys, [value], build, pieces)


def rating_deltas(df: DataFrame, value: str = "PercNormalized", order: Sequence[str] = ("OrderAll", "Condition"),
                  keys: Sequence[str] = PLAYER_KEYS, pieces: bool = True) -> DataFrame:
    """Differences to the previous rating (0 before the first) and to the first one."""
    def build(rows, scan):
        rows = scan.previous(rows, _prev=F.col(value))
        rows = scan.first(rows, _first=F.col(value))
        return rows.withColumns({
            f"{value}_prev_diff": F.col(value) - F.coalesce(F.col("_prev"), F.lit(0.0)),
            f"{value}_first_diff": F.col(value) - F.col("_first")}).drop("_prev", "_first")

    return ordered_scan(df, keys, order, build, pieces)


def prepare_ratings(kiwi: DataFrame, hand: DataFrame, valid: DataFrame,
                    pieces: bool = True) -> DataFrame:
    """The whole questionnaire chain, one row per (game, participant, condition)."""
    ratings = keep_members(combine_games(kiwi, hand), valid, "Participant")
    ratings = fill_down_up(ratings, ["GameOrder"], ["GameTitle", "Order", "Condition"], ["Participant"], pieces)
    ratings = rating_deltas(overall_order(ratings), pieces=pieces)
    return rel_to_first(ratings, "PercNormalized", "PercNormalized_rel", pieces=pieces)


def attach_ratings(df: DataFrame, ratings: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Left join ratings, missing keys matching missing keys.

    Ratings grow with the sessions, so there is no broadcast hint: Spark broadcasts them
    only if their size is under its threshold.
    """
    return join_null_safe(df, ratings, keys)


def drop_discarded(df: DataFrame, labels: Sequence[str] = DISCARDED_CONDITIONS) -> DataFrame:
    """Remove the discarded conditions; a missing condition stays."""
    return df.where(not_in_na("Condition", labels))
