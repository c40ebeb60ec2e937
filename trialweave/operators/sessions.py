"""One row per session: trial counts, times, attempts and rates in a single pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.missing import if_else_na, is_in_na, matches, na_count_if, safe_ratio
from trialweave.operators.sequence import OPEN_PERIOD, REST_PERIOD, SESSION_KEYS

# Event and result names of the log.
DECISION, ATTEMPT = "GameDecision", "MotorImagery"
REJECTED, ACCEPTED, FABRICATED = "RejInput", "AccInput", "FabInput"


def _trial_aggs(here: Column) -> dict[str, Column]:
    """Counts over the rows where ``here`` is true; NULL once a result is missing."""
    result = F.when(here, F.coalesce(F.col("TrialResult"), F.lit("")))
    unknown = F.count_if(here & F.col("TrialResult").isNull())

    def known(test):
        return F.when(unknown == 0, F.count_if(test))

    return {
        "rejInput": known(result == REJECTED),
        "accInput": known(result == ACCEPTED),
        "fabInput": known(result == FABRICATED),
        "posTrial": known(result.isin(FABRICATED, ACCEPTED)),
        "negTrial": known(result == REJECTED),
        "otherInput": F.count_if(here & ~result.isin(REJECTED, ACCEPTED, FABRICATED)),
    }


def trial_counts(df: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Outcome counts of the decisions of each session."""
    aggs = _trial_aggs(F.lit(True))
    return (df.where(F.col("Event") == DECISION).groupBy(*keys)
            .agg(*[a.alias(n) for n, a in aggs.items()])
            .withColumn("totalTrials", F.col("rejInput") + F.col("accInput") + F.col("fabInput")))


def session_time(df: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Time spent in rest and open periods."""
    return (df.where(is_in_na("Period", [REST_PERIOD, OPEN_PERIOD])).groupBy(*keys)
            .agg(F.sum("time_delta").alias("time_total"))
            .withColumn("time_total_min", F.col("time_total") / 60))


def mi_total(df: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Attempts in rest and open periods."""
    return (df.where(is_in_na("Period", [REST_PERIOD, OPEN_PERIOD])).groupBy(*keys)
            .agg(na_count_if(F.col("Event") == ATTEMPT).alias("mi_recog")))


def window_hits(df: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Open windows with at least one attempt, and the time in open windows."""
    per_window = (df.where((F.col("Period") == OPEN_PERIOD) & (F.col("InputWindowOrderFilled") > -1))
                  .groupBy(*keys, "InputWindowOrderFilled")
                  .agg(na_count_if(F.col("Event") == ATTEMPT).alias("mi_recog_window_count"),
                       F.sum("time_delta").alias("time_window")))
    hit = if_else_na(F.col("mi_recog_window_count") > 0, F.lit(1), F.lit(0))
    return (per_window.withColumn("_hit", hit).groupBy(*keys)
            .agg(na_count_if(F.col("_hit") > 0).alias("mi_recog_trial"),
                 na_count_if(F.col("_hit") == 1).alias("mi_recog_window"),
                 F.sum("time_window").alias("time_window"))
            .withColumn("time_window_min", F.col("time_window") / 60))


def filter_below_global_max(df: DataFrame, col: str) -> DataFrame:
    """Rows whose value is below the largest value of the whole table (one-row subquery)."""
    return df.where(F.col(col) < df.agg(F.max(col)).scalar())


def rest_metrics(df: DataFrame, keys: Sequence[str] = SESSION_KEYS, below_global_max: bool = False) -> DataFrame:
    """Attempts and time in the rest periods before the last closed window.

    On the output of ``label_periods`` the last closed window of a session is never a rest
    period, so the "below the largest id of the log" test cannot remove a row and is left
    out; ``below_global_max=True`` applies it, at the price of a second pass.
    """
    if below_global_max:
        df = filter_below_global_max(df, "InputWindowClosedFill")
    return (df.where((F.col("Period") == REST_PERIOD) & (F.col("InputWindowClosedFill") > -1))
            .groupBy(*keys)
            .agg(na_count_if(F.col("Event") == ATTEMPT).alias("mi_recog_rest"),
                 F.sum("time_delta").alias("time_rest"))
            .withColumn("time_rest_min", F.col("time_rest") / 60))


def session_summary(df: DataFrame, keys: Sequence[str] = SESSION_KEYS,
                    constants: Sequence[str] = ("BCIProcessingMode",),
                    on_conflict: str = "error") -> DataFrame:
    """All session metrics from one scan of the labelled log, sessions with a decision only.

    First level: one row per (session, trial order) with plain sums, combined before the
    shuffle, so a session of any size is reduced in many tasks. Second level: one row per
    session. A session without rest or open rows has NULL, not 0, in those metrics.
    ``constants`` are columns that hold one value on the decisions of a session.
    """
    event, period = F.col("Event"), F.col("Period")
    decision = F.coalesce(event == DECISION, F.lit(False))
    playing = is_in_na("Period", [REST_PERIOD, OPEN_PERIOD])
    in_open = F.coalesce((period == OPEN_PERIOD) & (F.col("InputWindowOrderFilled") > -1), F.lit(False))
    in_rest = F.coalesce((period == REST_PERIOD) & (F.col("InputWindowClosedFill") > -1), F.lit(False))
    attempt = F.coalesce(event == ATTEMPT, F.lit(False))
    results = {REJECTED: "rejInput", ACCEPTED: "accInput", FABRICATED: "fabInput"}
    result = F.col("TrialResult")

    parts = {"_decisions": F.count_if(decision),
             "_other": F.count_if(decision & ~F.coalesce(result.isin(*results), F.lit(False))),
             "_no_result": F.count_if(decision & result.isNull())}
    parts |= {name: F.count_if(decision & (result == value)) for value, name in results.items()}
    for name, here in (("total", playing), ("window", in_open), ("rest", in_rest)):
        parts |= {f"_rows_{name}": F.count_if(here),
                  f"_mi_{name}": F.count_if(here & attempt),
                  f"_mi_unknown_{name}": F.count_if(here & event.isNull()),
                  f"_time_{name}": F.sum(F.when(here, F.col("time_delta")))}
    for c in constants:
        value = F.when(decision, F.col(c))
        parts |= {f"_min_{c}": F.min(value), f"_max_{c}": F.max(value), f"_n_{c}": F.count(value)}
    per_order = df.groupBy(*keys, "InputWindowOrderFilled").agg(*[a.alias(n) for n, a in parts.items()])

    def total(name):
        return F.sum(name)

    def known_trials(name):
        return F.when(total("_no_result") == 0, total(name))

    def attempts(name):
        return F.when((total(f"_rows_{name}") > 0) & (total(f"_mi_unknown_{name}") == 0), total(f"_mi_{name}"))

    # a window is hit if it has an attempt, whatever the number
    hits = F.when((total("_rows_window") > 0) & (total("_mi_unknown_window") == 0),
                  F.count_if((F.col("_rows_window") > 0) & (F.col("_mi_window") > 0)))
    out = {"rejInput": known_trials("rejInput"), "accInput": known_trials("accInput"),
           "fabInput": known_trials("fabInput"),
           "posTrial": known_trials("fabInput") + known_trials("accInput"),
           "negTrial": known_trials("rejInput"), "otherInput": total("_other"),
           "totalTrials": known_trials("rejInput") + known_trials("accInput") + known_trials("fabInput"),
           "time_total": total("_time_total"), "mi_recog": attempts("total"),
           "mi_recog_trial": hits, "mi_recog_window": hits, "time_window": total("_time_window"),
           "mi_recog_rest": attempts("rest"), "time_rest": total("_time_rest")}
    for c in constants:
        known, low, high = total(f"_n_{c}"), F.min(f"_min_{c}"), F.max(f"_max_{c}")
        fine = (known == 0) | ((known == total("_decisions")) & (low == high))
        clash = (F.lit(None) if on_conflict == "null"
                 else F.raise_error(F.lit(f"{c} is not constant in its session")))
        out[c] = F.when(fine | (total("_decisions") == 0), low).otherwise(clash)
    summary = (per_order.groupBy(*keys)
               .agg(total("_decisions").alias("_decisions"), *[a.alias(n) for n, a in out.items()])
               .where(F.col("_decisions") > 0).drop("_decisions"))
    return summary.withColumns({f"time_{x}_min": F.col(f"time_{x}") / 60 for x in ("total", "window", "rest")})


def session_rates(df: DataFrame) -> DataFrame:
    """Ratios per session; a zero divisor gives NULL."""
    return df.withColumns({
        "rate_trial": safe_ratio("mi_recog_trial", "totalTrials"),
        "rate_feedback": safe_ratio("posTrial", "totalTrials"),
        "rate_fabInput": safe_ratio("fabInput", "totalTrials"),
        "rest_window_mi_ratio": safe_ratio("mi_recog_window", "mi_recog_rest"),
        "fp_rate_minute": safe_ratio("mi_recog_rest", "time_rest_min"),
        "mi_window_frequency": safe_ratio("mi_recog_window", "time_window_min"),
        "excess_rate": F.col("mi_recog_window") - safe_ratio("mi_recog_rest", "time_rest"),
    })


def experience_flags(df: DataFrame, comment: str = "comment") -> DataFrame:
    """Flags from the free-text comment; a missing comment counts as no."""
    return df.withColumns({"bci_experience": matches(comment, "BCIExperience"),
                           "mi_experience": matches(comment, "MIExperience")})
