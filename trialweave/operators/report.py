"""Report tables and delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.missing import if_else_na, paste_na, plain_text
from trialweave.functions.scalars import fixed_decimals, percent_text
from trialweave.operators.columns import all_text, pivot_wide, unpivot
from trialweave.operators.scans import join_null_safe
from trialweave.operators.sequence import number_rows

# Limits of the feedback rate that each condition was designed for.
DESIGN_LIMITS = (("100A", 0.0, 1.0), ("100B", 0.3, 1.0), ("50A", 0.0, 0.5), ("50B", 0.3, 0.8))

# Row labels of the participant table.
FEATURES = {"mi_experience": "MI Experience", "mean_rate": "Mean Rate", "min_rate": "Min. Rate",
            "max_rate": "Max. Rate", "mean_feedback": "Mean Pos. Feedback", "time_total": "Mean Time (s)",
            "fp_rate_minute": "False Positives (pr min)", "gender": "Gender"}


def participant_features(players: DataFrame) -> DataFrame:
    """Formatted feature texts of each (participant, game), in long form.

    A missing number prints ``NA``. Numbers carry no padding.
    """
    text = {"mi_experience": if_else_na(F.col("mi_experience"), F.lit("Yes"), F.lit("No")),
            **{c: percent_text(c) for c in ("mean_rate", "min_rate", "max_rate", "mean_feedback")},
            "time_total": F.coalesce(fixed_decimals("time_total", 0), F.lit("NA")),
            "fp_rate_minute": F.coalesce(fixed_decimals("fp_rate_minute", 2), F.lit("NA"))}
    table = all_text(players.select("Participant", "GameTitle", *FEATURES).withColumns(text))
    table = table.withColumnsRenamed(FEATURES)
    return unpivot(table, ["Participant", "GameTitle"], list(FEATURES.values()), "Feature", "value")


def participant_table(players: DataFrame, participants: Sequence) -> DataFrame:
    """Features as rows, the listed participants as columns."""
    return pivot_wide(participant_features(players), ["GameTitle", "Feature"], "Participant", "value",
                      [str(p) for p in participants])


def participant_blocks(players: DataFrame, bucket, width: int = 16,
                       pieces: bool = True) -> DataFrame:
    """The participant table for any number of participants, in blocks of ``width`` columns.

    Participants are numbered in order; block b holds numbers b * width + 1 and on in the
    columns ``p1`` to ``p<width>``. A row ``Participant`` names them. ``bucket`` is a column
    that never decreases with the participant, see ``number_rows``.
    """
    people = players.groupBy("Participant").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    numbered = number_rows(people, ["Participant"], "_no", bucket=bucket if isinstance(bucket, (list, tuple)) else [bucket], pieces=pieces)
    place = numbered.select(plain_text(numbered, "Participant"),
                            F.floor((F.col("_no") - 1) / width).alias("block"),
                            F.concat(F.lit("p"), ((F.col("_no") - 1) % width + 1)).alias("column"))
    # the naming row of each game comes from the same rows, so every block has one per game
    features = participant_features(players)
    names = (players.select(plain_text(players, "Participant"), "GameTitle").distinct()
             .select("Participant", "GameTitle", F.lit("Participant").alias("Feature"),
                     F.col("Participant").alias("value")))
    placed = join_null_safe(features.unionByName(names), place, ["Participant"], "inner")
    return pivot_wide(placed, ["block", "GameTitle", "Feature"], "column", "value",
                      [f"p{i + 1}" for i in range(width)])


def delimited_rows(df: DataFrame, cols: Sequence[str], sep: str = " & ", out: str = "line") -> DataFrame:
    """Add each row as one delimited text; a missing cell is written ``NA``."""
    return df.withColumn(out, paste_na(*cols, sep=sep))


def delimited_text(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str],
                   sep: str = " & ", row_sep: str = " \\\\ ", out: str = "text") -> DataFrame:
    """One text per key with a header line first. Meant for report tables of few rows per key."""
    lines = delimited_rows(df, cols, sep, "_line")
    at = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(at)], F.col("_line").alias("line"))
    body = F.sort_array(F.collect_list(item)).getField("line")
    header = F.array(F.lit(sep.join(cols)))
    return lines.groupBy(*keys).agg(F.array_join(F.concat(header, body), row_sep).alias(out))


# Study keys and the labels they are printed with.
BRAIN_STUDY, BRAIN_INPUT, OTHER_INPUT = "realbci", "BCI (EEG, MRP)", "Eye-blinks"
PATIENT_STUDY, PATIENTS, OTHERS = "strokesur", "Stroke patients", "Non-patients"


def study_labels() -> dict[str, Column]:
    study = F.col("study")
    return {"BCI input": if_else_na(study == BRAIN_STUDY, F.lit(BRAIN_INPUT), F.lit(OTHER_INPUT)),
            "Participants": if_else_na(study == PATIENT_STUDY, F.lit(PATIENTS), F.lit(OTHERS))}


def study_table(coefficients: DataFrame) -> DataFrame:
    """Study coefficients with derived labels and print names."""
    return coefficients.select(
        *[c.alias(n) for n, c in study_labels().items()],
        F.col("perc_intercept").alias("Agency (alpha)"), F.col("perc_slope").alias("Agency (beta)"),
        F.col("frust_intercept").alias("Frustration (alpha)"), F.col("frust_slope").alias("Frustration (beta)"))


def design_limits(spark) -> DataFrame:
    return spark.createDataFrame(list(DESIGN_LIMITS), "Condition string, lower double, upper double")


def design_vs_actual(sessions: DataFrame) -> DataFrame:
    """Feedback rate of each session against the limits of its condition.

    The limits are four fixed rows, so they are always broadcast.
    """
    limits = F.broadcast(design_limits(sessions.sparkSession))
    return (sessions.select("GameTitle", "Participant", "Condition", "rate_feedback")
            .join(limits, "Condition", "left")
            .withColumn("within_limits", F.col("rate_feedback").between(F.col("lower"), F.col("upper"))))


def ordered_series(sessions: DataFrame, values: Sequence[str], bucket,
                   pieces: bool = True) -> DataFrame:
    """Sessions of each game in (participant, play order), with position from 0 and label.

    ``bucket`` never decreases with the participant, see ``number_rows``.
    """
    order = ["Participant", "ConditionOrder", "Condition"]
    rows = sessions.select("GameTitle", *order, *[v for v in values if v not in order])
    numbered = number_rows(rows, order, "position", start=0, keys=["GameTitle"], bucket=bucket if isinstance(bucket, (list, tuple)) else [bucket], pieces=pieces)
    return numbered.withColumn("label", paste_na(plain_text(numbered, "Participant"), "Condition"))
