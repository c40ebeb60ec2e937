"""The study pipeline on the driver tables: raw events to labelled log to session table.

The event table stands in for the game log. Fixed mapping: user = participant, the first
or second half of the month = game, blocks of four days = condition, and the event types
play the log's event names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.scalars import to_number
from trialweave.operators.ratings import attach_ratings, drop_discarded, prepare_ratings
from trialweave.operators.sequence import SESSION_KEYS, gap_seconds, label_periods, label_run
from trialweave.operators.sessions import experience_flags, session_rates, session_summary

ORDER = ("Timestamp", "event_id")
RATING_COLUMNS = {"OrderAll": "ConditionOrder", "PercNormalized": "PercNormalized",
                  "PercNormalized_first_diff": "PercNormalized_first_diff",
                  "PercNormalized_prev_diff": "PercNormalized_prev_diff",
                  "PercNormalized_rel": "PercNormalized_rel", "FrustNormalized": "FrustNormalized",
                  "GameOrder": "GameOrder", "Gender": "gender", "Comment": "comment",
                  "Color": "color", "Preference": "gamePreference"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _session_columns() -> dict:
    day = F.dayofmonth("ts")
    block = F.floor((day - 1) % 15 / 4)
    return {"GameTitle": F.when(day <= 15, "Kiwi").otherwise("HandStrength"),
            "Participant": F.col("user_id"),
            "Condition": F.when(block == 0, "50A").when(block == 1, "50B").when(block == 2, "100A").otherwise("100B")}


def study_log(spark: SparkSession, sf_dir: str, stops: bool = False) -> DataFrame:
    """The event table as a typed game log.

    ``stops`` adds what the plain mapping has none of: every 11th click stops the game, and the
    first condition of every 13th participant carries a label that is discarded.
    """
    kind, value = F.col("event_type"), F.col("value")
    names = {"purchase": "GameRunning", "view": "InputWindowChange", "error": "InputWindowChange",
             "click": "MotorImagery", "signup": "GameDecision"}
    event = F.lit(None)
    for source, name in names.items():
        event = F.when(kind == source, name).otherwise(event)
    change = kind.isin("view", "error")
    keys = _session_columns()
    if stops:
        event = F.when((kind == "click") & (F.col("event_id") % 11 == 0), "GameStopped").otherwise(event)
        wrong = (F.col("user_id") % 13 == 0) & (keys["Condition"] == "50A")
        keys["Condition"] = F.when(wrong, "50A_WRONG").otherwise(keys["Condition"])
    return table(spark, sf_dir, "events").select(
        *[c.alias(n) for n, c in keys.items()],
        F.col("ts").alias("Timestamp"), "event_id", event.alias("Event"),
        F.when(kind == "view", "Open").when(kind == "error", "Closed").alias("InputWindow"),
        F.when(change, to_number(F.regexp_extract("props", r"(\d+)", 1))).alias("InputWindowOrder"),
        F.when(kind == "signup", F.when(value < 20, "RejInput").when(value < 60, "AccInput")
               .otherwise("FabInput")).alias("TrialResult"),
        F.concat(F.lit("mode"), F.col("user_id") % 3).alias("BCIProcessingMode"))


def study_questionnaires(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One questionnaire table per game, in the form they are handed in.

    Ratings are shares of exact integer sums. The first table names its participant column
    differently, and the order of the games is noted on one row per participant only.
    """
    keys = _session_columns()
    cents = F.round(F.col("value") * 100).cast("bigint")
    per_session = (table(spark, sf_dir, "events")
                   .select(*[c.alias(n) for n, c in keys.items()], cents.alias("cents"), "event_type")
                   .groupBy(*keys)
                   .agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"),
                        F.count_if(F.col("event_type") == "error").alias("errors")))
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Participant"),
        F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("Gender"),
        F.when(F.col("c_mktsegment") == "BUILDING", "BCIExperience")
        .when(F.col("c_mktsegment") == "MACHINERY", "MIExperience, some BCIExperience")
        .when(F.col("c_mktsegment") == "FURNITURE", "MIExperience").alias("Comment"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Yellow").when(F.col("c_mktsegment") == "MACHINERY", "Blue")
        .when(F.col("c_mktsegment") == "FURNITURE", "Grey").when(F.col("c_mktsegment") == "HOUSEHOLD", "Red")
        .otherwise("Green").alias("Color"),
        F.when(F.col("c_nationkey") % 3 == 0, "Kiwi").when(F.col("c_nationkey") % 3 == 1, "HandStrength")
        .alias("Preference"))
    place = (F.when(F.col("Condition") == "50A", 0).when(F.col("Condition") == "50B", 1)
             .when(F.col("Condition") == "100A", 2).otherwise(3))
    rated = (per_session.join(people, "Participant", "left")
             .withColumns({
                 "Order": (1 + (place + F.col("Participant")) % 4).cast("int"),
                 "GameOrder": F.when(F.col("Condition") == "50A",
                                     F.when(F.col("Participant") % 2 == 0, "KiwiHand").otherwise("HandKiwi")),
                 "PercNormalized": F.least(F.lit(1.0), F.col("cents") / (F.col("n") * 10000.0)),
                 "FrustNormalized": F.col("errors") / F.col("n").cast("double")})
             .drop("cents", "n", "errors"))
    kiwi = (rated.where(F.col("GameTitle") == "Kiwi").drop("GameTitle")
            .withColumnRenamed("Participant", "KiwiParticipant"))
    hand = rated.where(F.col("GameTitle") == "HandStrength").drop("GameTitle")
    return kiwi, hand


def study_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared questionnaire; valid participants are the known customers."""
    kiwi, hand = study_questionnaires(spark, sf_dir)
    valid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Participant"))
    # built above with two games and four conditions, so a participant has eight rows at most
    return prepare_ratings(kiwi, hand, valid, pieces=False)


def labelled_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log with gaps and periods."""
    return label_periods(gap_seconds(study_log(spark, sf_dir), ORDER), ORDER)


def gated_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: gaps, the first game run of each session, periods, metrics, discarded labels, rates."""
    log = label_run(gap_seconds(study_log(spark, sf_dir, stops=True), ORDER), ORDER)
    return session_rates(drop_discarded(session_summary(log)))


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session: metrics, rates, ratings and flags."""
    return _rated(spark, sf_dir, session_rates(session_summary(labelled_log(spark, sf_dir))))


def gated_session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the first game run of each session, without discarded conditions."""
    return _rated(spark, sf_dir, gated_sessions(spark, sf_dir))


def _rated(spark: SparkSession, sf_dir: str, sessions: DataFrame) -> DataFrame:
    """Ratings hold one row per session, so they are joined to the finished sessions and never to the log."""
    ratings = study_ratings(spark, sf_dir).select(
        *SESSION_KEYS, *[F.col(c).alias(n) for c, n in RATING_COLUMNS.items()])
    return experience_flags(attach_ratings(sessions, ratings))
