"""Registered queries: one per operator or report, each with its check query where SQL can say it.

Every query reads whole driver tables. Doubles are rounded for the comparison only: to nine
digits where values are exact quotients (six would cut many of them at a tie), to six where
they come out of longer sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions import missing as na
from trialweave.functions import scalars as sc
from trialweave.models import linear, mixed, ranks, smooth
from trialweave.operators import cohorts, columns, ratings, report, sequence, sessions, summaries
from trialweave.operators.scans import stored
from trialweave.plans import study
from trialweave.plans.oracle import K, chi1_tail_sql, chi3_tail_sql, mixed_fit_sql, rnd, t_tail_sql, with_gate, with_parts
from trialweave.plans.study import ORDER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEYS = list(sequence.SESSION_KEYS)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(sql: str | None = None, digits: int = 9):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLE[fn.__name__] = sql.replace("@D", str(digits))
        return fn
    return register


# --- sequence operators -------------------------------------------------------------------

@query(with_parts("gaps") + f"SELECT event_id, {rnd('time_delta')} FROM gaps")
def event_gaps(spark, d):
    log = study.study_log(spark, d)
    return sequence.gap_seconds(log, ORDER).select("event_id", "time_delta")


@query(with_parts("log") + f"""SELECT event_id, {rnd('''coalesce((epoch_us(Timestamp) - epoch_us(lag(Timestamp) OVER
(PARTITION BY GameTitle, Participant, Condition ORDER BY Timestamp, event_id))) / 1e6, 0.0)''', 'time_delta')} FROM log""")
def session_gaps(spark, d):
    log = study.study_log(spark, d)
    return sequence.gap_seconds(log, ORDER, partition_by=KEYS).select("event_id", "time_delta")


@query(with_parts("log") + f"""SELECT {K}, event_id, Event FROM (SELECT *, count(CASE WHEN Event = 'GameRunning' THEN 1 END)
OVER (PARTITION BY {K} ORDER BY Timestamp, event_id ROWS UNBOUNDED PRECEDING) AS runs FROM log) WHERE runs = 1""")
def gate_run(spark, d):
    log = study.study_log(spark, d)
    return sequence.gate_run(log, ORDER).select(*KEYS, "event_id", "Event")


@query(with_parts("numbered") + f"SELECT {K}, event_id, InputWindowClosedID FROM numbered")
def occurrence_id(spark, d):
    log = study.study_log(spark, d)
    return sequence.occurrence_id(log, ORDER).select(*KEYS, "event_id", "InputWindowClosedID")


@query(with_parts("log") + f"""SELECT event_id, last_value(InputWindow IGNORE NULLS) OVER (PARTITION BY {K}
ORDER BY Timestamp, event_id ROWS UNBOUNDED PRECEDING) AS window_state FROM log""")
def window_state(spark, d):
    log = study.study_log(spark, d)
    return sequence.fill_down(log, {"window_state": "InputWindow"}, ORDER, KEYS).select(
        "event_id", "window_state")


@query(with_parts("labelled") + f"""SELECT {K}, event_id, InputWindowClosedID, InputWindowClosedFill,
InputWindowOrderFilled, Period FROM labelled""")
def period_labels(spark, d):
    log = study.study_log(spark, d)
    return sequence.label_periods(log, ORDER).select(
        *KEYS, "event_id", "InputWindowClosedID", "InputWindowClosedFill", "InputWindowOrderFilled", "Period")


# --- sessions -----------------------------------------------------------------------------

COUNTS = ["rejInput", "accInput", "fabInput", "posTrial", "negTrial", "otherInput", "totalTrials", "mi_recog",
          "mi_recog_trial", "mi_recog_window", "mi_recog_rest"]
TIMES = ["time_total", "time_window", "time_rest", "time_total_min", "time_window_min", "time_rest_min"]
RATES = ["rate_trial", "rate_feedback", "rate_fabInput", "rest_window_mi_ratio", "fp_rate_minute",
         "mi_window_frequency", "excess_rate"]
RATED = ["PercNormalized", "PercNormalized_first_diff", "PercNormalized_prev_diff", "PercNormalized_rel",
         "FrustNormalized"]
PEOPLE = ["BCIProcessingMode", "ConditionOrder", "GameOrder", "gender", "comment", "color", "gamePreference",
          "bci_experience", "mi_experience"]


def _sql_cols(*groups):
    doubles = set(TIMES + RATES + RATED)
    return ", ".join(rnd(c) if c in doubles else c for g in groups for c in g)


@query(with_parts("st") + f"SELECT {K}, {_sql_cols(COUNTS, TIMES, RATES, RATED, PEOPLE)} FROM st")
def session_summary(spark, d):
    return study.session_table(spark, d).select(*KEYS, *COUNTS, *TIMES, *RATES, *RATED, *PEOPLE)


KEPT = "coalesce(Condition NOT IN ('50A_WRONG', '50A-2'), true)"


@query(with_gate("labelled") + f"""SELECT {K}, event_id, {rnd('time_delta')}, InputWindowClosedID, InputWindowClosedFill,
InputWindowOrderFilled, Period FROM labelled""")
def gated_labels(spark, d):
    """Gap, gate and label in one chain; the gaps are those of the whole log."""
    log = sequence.gap_seconds(study.study_log(spark, d, stops=True), ORDER)
    return sequence.label_run(log, ORDER).select(
        *KEYS, "event_id", "time_delta", "InputWindowClosedID", "InputWindowClosedFill", "InputWindowOrderFilled", "Period")


@query(with_gate("metrics") + f"""SELECT {K}, {_sql_cols(COUNTS, TIMES)}, {rnd('mi_recog_trial / NULLIF(totalTrials, 0)', 'rate_trial')},
{rnd('posTrial / NULLIF(totalTrials, 0)', 'rate_feedback')}, {rnd('mi_recog_rest / NULLIF(time_rest_min, 0)', 'fp_rate_minute')}
FROM metrics WHERE {KEPT}""")
def gated_sessions(spark, d):
    return study.gated_sessions(spark, d).select(*KEYS, *COUNTS, *TIMES, "rate_trial", "rate_feedback", "fp_rate_minute")


@query(with_gate("metrics") + f"""SELECT Participant, GameTitle, count(*) AS sessions, sum(totalTrials)::BIGINT AS trials,
{rnd('CASE WHEN count(r) = count(*) THEN avg(r) END', 'mean_rate')}, {rnd('CASE WHEN count(r) = count(*) THEN min(r) END', 'min_rate')}
FROM (SELECT *, mi_recog_trial / NULLIF(totalTrials, 0) AS r FROM metrics WHERE {KEPT}) GROUP BY 1, 2""")
def gated_participants(spark, d):
    return study.gated_sessions(spark, d).groupBy("Participant", "GameTitle").agg(
        F.count(F.lit(1)).alias("sessions"), na.na_sum("totalTrials").alias("trials"),
        na.na_mean("rate_trial").alias("mean_rate"), na.na_min("rate_trial").alias("min_rate"))


@query(with_parts("metrics") + f"SELECT {K}, BCIProcessingMode, {_sql_cols(COUNTS, TIMES)} FROM metrics")
def session_metrics(spark, d):
    return sessions.session_summary(study.labelled_log(spark, d)).select(*KEYS, "BCIProcessingMode", *COUNTS, *TIMES)


@query(with_parts("metrics") + f"SELECT {K}, {_sql_cols(COUNTS, TIMES)} FROM metrics")
def session_metrics_joined(spark, d):
    """The five aggregates one by one, each joined onto the first."""
    log = stored(study.labelled_log(spark, d).drop("BCIProcessingMode", "Timestamp"))
    out = sessions.trial_counts(log)
    for part in (sessions.session_time, sessions.mi_total, sessions.window_hits, sessions.rest_metrics):
        out = summaries.add_metrics(out, part(log))
    return out.select(*KEYS, *COUNTS, *TIMES)


@query(with_parts("labelled") + """SELECT event_id, InputWindowClosedFill FROM labelled
WHERE InputWindowClosedFill < (SELECT max(InputWindowClosedFill) FROM labelled)""")
def below_global_max(spark, d):
    log = study.study_log(spark, d)
    log = sequence.label_periods(log, ORDER).select("event_id", "InputWindowClosedFill")
    return sessions.filter_below_global_max(stored(log), "InputWindowClosedFill")


@query(with_parts("metrics") + f"""SELECT {K}, row_number() OVER (ORDER BY {K}) AS session, totalTrials FROM metrics""")
def numbered_sessions(spark, d):
    counts = stored(sessions.trial_counts(study.study_log(spark, d)))
    return sequence.number_rows(counts, KEYS, "session", bucket=[F.col("GameTitle"), *_people_bucket()],
                                pieces=False).select(*KEYS, "session", "totalTrials")


# --- roll-ups -----------------------------------------------------------------------------

def _strict_sql(agg, c, alias, cast=""):
    return f"CASE WHEN count({c}) = count(*) THEN {agg}({c}){cast} END AS {alias}"


@query(with_parts("st") + f"""SELECT GameTitle, Condition, {rnd('CASE WHEN count(rate_trial) = count(*) THEN avg(rate_trial) END', 'avg_rate')},
sum(accInput)::BIGINT AS sum_acc FROM st GROUP BY 1, 2""")
def condition_summary(spark, d):
    return summaries.condition_summary(study.session_table(spark, d))


@query(with_parts("st") + f"""SELECT GameTitle, Condition, {rnd('avg(rate_trial)', 'avg_rate')}, {rnd('min(rate_trial)', 'min_rate')},
{rnd('max(rate_trial)', 'max_rate')}, sum(mi_recog_rest)::BIGINT AS sum_rest FROM st GROUP BY 1, 2""")
def condition_summary_known(spark, d):
    """The same kind of roll-up over the known values only."""
    return study.session_table(spark, d).groupBy("GameTitle", "Condition").agg(
        na.na_mean("rate_trial", "skip").alias("avg_rate"), na.na_min("rate_trial", "skip").alias("min_rate"),
        na.na_max("rate_trial", "skip").alias("max_rate"), na.na_sum("mi_recog_rest", "skip").alias("sum_rest"))


@query(with_parts("players") + f"""SELECT Participant, GameTitle, gender, {rnd('mean_rate')}, {rnd('min_rate')}, {rnd('max_rate')},
{rnd('mean_feedback')}, mi_experience, {rnd('time_total')}, mi_recog_total, mi_recog_rest, mi_recog_window,
{rnd('fp_rate_minute')} FROM players""")
def participant_summary(spark, d):
    return summaries.participant_summary(study.session_table(spark, d))


@query(with_parts("st") + f"""SELECT ConditionOrder, {rnd('CASE WHEN count(rate_trial) = count(*) THEN avg(rate_trial) END', 'mean_rate_trial')},
{rnd('CASE WHEN count(rate_feedback) = count(*) THEN avg(rate_feedback) END', 'mean_rate_feedback')} FROM st GROUP BY 1""")
def order_summary(spark, d):
    return summaries.order_summary(study.session_table(spark, d))


@query(with_parts("st") + """SELECT gamePreference, count(*) AS n FROM (SELECT DISTINCT Participant, gamePreference FROM st
WHERE gamePreference IS NOT NULL) GROUP BY 1""")
def preference_counts(spark, d):
    return summaries.value_counts(study.session_table(spark, d), ["Participant"], "gamePreference")


@query(with_parts("st") + f"""SELECT Participant, GameTitle, {rnd('median_value')}, {rnd('min_value')}, {rnd('max_value')},
{rnd('(max_value - median_value) / max_value * 100', 'percentage_change_max')},
{rnd('(median_value - min_value) / median_value * 100', 'percentage_change_min')}
FROM (SELECT Participant, GameTitle, quantile_cont(rate_trial, 0.5) AS median_value, min(rate_trial) AS min_value,
  max(rate_trial) AS max_value FROM st GROUP BY 1, 2 HAVING count(rate_trial) = count(*) AND max(rate_trial) > 0)
WHERE median_value > 0 AND (max_value - median_value) / max_value * 100 < 25
  AND (median_value - min_value) / median_value * 100 < 25""")
def rate_spread(spark, d):
    return summaries.rate_spread(study.session_table(spark, d), pieces=False)  # four sessions each at most


@query(with_parts("st") + f"""SELECT Participant, GameTitle, {rnd('max(rate_trial)', 'max_value')} FROM st GROUP BY 1, 2
HAVING count(rate_trial) = count(*) AND max(rate_trial) < 0.5""")
def low_performers(spark, d):
    return summaries.low_performers(study.session_table(spark, d))


# Columns of the balance check.
BALANCE = {"Con_50A": ("Condition", "50A"), "Con_50B": ("Condition", "50B"), "Con_100A": ("Condition", "100A"),
           "Con_100B": ("Condition", "100B"), "Gender_M": ("gender", "M"), "Gender_F": ("gender", "F"),
           "KiwiHand": ("GameOrder", "KiwiHand"), "HandKiwi": ("GameOrder", "HandKiwi"),
           "Hand": ("GameTitle", "HandStrength"), "Kiwi": ("GameTitle", "Kiwi"),
           "Color_yellow": ("color", "Yellow"), "Color_blue": ("color", "Blue"), "Color_grey": ("color", "Grey"),
           "Color_red": ("color", "Red"), "Color_green": ("color", "Green")}
_BALANCE_SQL = ", ".join(f"CASE WHEN count({c}) = count(*) THEN count(*) FILTER ({c} = '{v}') END AS {n}"
                         for n, (c, v) in BALANCE.items())


@query(with_parts("st") + f"SELECT GameTitle, {_BALANCE_SQL} FROM st GROUP BY 1")
def balance_by_game(spark, d):
    return summaries.balance_table(study.session_table(spark, d), ["GameTitle"], BALANCE)


@query(with_parts("st") + f"SELECT GameTitle, Participant, {_BALANCE_SQL} FROM st GROUP BY 1, 2")
def balance_by_participant(spark, d):
    return summaries.balance_table(study.session_table(spark, d), ["GameTitle", "Participant"], BALANCE)


@query(with_parts("st") + """SELECT condition_order, count(*) AS n FROM (SELECT string_agg(Condition, '' ORDER BY
ConditionOrder NULLS LAST, Condition) AS condition_order FROM st GROUP BY GameTitle, Participant) GROUP BY 1""")
def condition_order_frequency(spark, d):
    return summaries.sequence_frequency(study.session_table(spark, d), ["GameTitle", "Participant"], "Condition",
                                        ["ConditionOrder", "Condition"], "condition_order")


@query(with_parts("st") + """SELECT color_order, count(*) AS n FROM (SELECT string_agg(coalesce(color, 'NA'), '' ORDER BY
ConditionOrder NULLS LAST, Condition) AS color_order FROM st GROUP BY GameTitle, Participant) GROUP BY 1""")
def color_order_frequency(spark, d):
    return summaries.sequence_frequency(study.session_table(spark, d), ["GameTitle", "Participant"], "color",
                                        ["ConditionOrder", "Condition"], "color_order")


@query(with_parts("st") + f"""SELECT bci_experience, {rnd('avg(rate_trial)', 'rate_trial')}, {rnd('avg(rate_feedback)', 'rate_feedback')},
{rnd('avg(PercNormalized)', 'PercNormalized')}, {rnd('avg(FrustNormalized)', 'FrustNormalized')},
{rnd('avg(PercNormalized) * avg(rate_trial)', 'perc_bias')}, {rnd('avg(PercNormalized * rate_trial)', 'perc_bias_mean_product')},
{rnd('avg(FrustNormalized) * avg(rate_trial)', 'frust_bias')}, {rnd('avg(FrustNormalized * rate_trial)', 'frust_bias_mean_product')}
FROM st GROUP BY 1""", digits=6)
def bias_by_flag(spark, d):
    return summaries.group_means(
        study.session_table(spark, d), ["bci_experience"],
        ["rate_trial", "rate_feedback", "PercNormalized", "FrustNormalized"],
        {"perc_bias": ("PercNormalized", "rate_trial"), "frust_bias": ("FrustNormalized", "rate_trial")},
        na="skip", mean_products=True)


def _strict_means(expr):
    a, b = expr
    return f"CASE WHEN count({a}) = count(*) THEN avg({a}) END * CASE WHEN count({b}) = count(*) THEN avg({b}) END"


@query(with_parts("st") + f"""SELECT bci_experience, GameTitle, {rnd(_strict_means(("PercNormalized", "rate_trial")), 'perc_bias')},
{rnd(_strict_means(("FrustNormalized", "rate_feedback")), 'frust_bias')} FROM st GROUP BY 1, 2""", digits=6)
def bias_by_flag_strict(spark, d):
    """Unknown once an input is unknown."""
    return summaries.group_means(
        study.session_table(spark, d), ["bci_experience", "GameTitle"], [],
        {"perc_bias": ("PercNormalized", "rate_trial"), "frust_bias": ("FrustNormalized", "rate_feedback")})


@query(with_parts("st") + f"""SELECT GameTitle, {', '.join(rnd(f'CASE WHEN count({c}) = count(*) THEN avg({c}) END', c) for c in
("rate_feedback", "rate_trial", "PercNormalized", "FrustNormalized"))} FROM st GROUP BY 1""")
def means_by_game(spark, d):
    return summaries.group_means(study.session_table(spark, d), ["GameTitle"],
                                 ["rate_feedback", "rate_trial", "PercNormalized", "FrustNormalized"])


def _game_means_sql(by):
    cols = ["rate_feedback", "rate_trial", "PercNormalized", "FrustNormalized"]
    body = ", ".join(rnd(f"CASE WHEN count({c}) = count(*) THEN avg({c}) END", c) for c in cols)
    return with_parts("st") + f"SELECT {by}, {body} FROM st GROUP BY ALL"


@query(_game_means_sql("GameOrder, GameTitle"))
def means_by_game_order(spark, d):
    return summaries.group_means(study.session_table(spark, d), ["GameOrder", "GameTitle"],
                                 ["rate_feedback", "rate_trial", "PercNormalized", "FrustNormalized"])


@query(_game_means_sql("mi_experience"))
def means_by_mi_experience(spark, d):
    return summaries.group_means(study.session_table(spark, d), ["mi_experience"],
                                 ["rate_feedback", "rate_trial", "PercNormalized", "FrustNormalized"])


def _box_sql(src, value, by):
    return f""", q AS (SELECT {by}, count(*) AS n, min({value}) AS min_value, quantile_cont({value}, 0.25) AS q1,
quantile_cont({value}, 0.5) AS median_value, quantile_cont({value}, 0.75) AS q3, max({value}) AS max_value
FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL)
SELECT {by}, n, {rnd('min_value')}, {rnd('q1')}, {rnd('median_value')}, {rnd('q3')}, {rnd('max_value')},
{rnd('min(v) FILTER (inside)', 'whisker_low')}, {rnd('max(v) FILTER (inside)', 'whisker_high')},
count(*) FILTER (NOT inside) AS outliers
FROM (SELECT q.*, s.{value} AS v, s.{value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM {src} s JOIN q ON s.{by} IS NOT DISTINCT FROM q.{by} WHERE s.{value} IS NOT NULL)
GROUP BY {by}, n, min_value, q1, median_value, q3, max_value"""


@query(with_parts("st") + _box_sql("st", "rate_trial", "ConditionOrder"), digits=6)
def box_stats(spark, d):
    return summaries.box_stats(study.session_table(spark, d), "rate_trial", ["ConditionOrder"])


@query("WITH li AS (SELECT * FROM lineitem)" + _box_sql("li", "l_extendedprice", "l_returnflag"), digits=6)
def box_stats_prices(spark, d):
    return summaries.box_stats(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])


# --- cohorts ------------------------------------------------------------------------------

LABELS = ["mi_group", "group_feedback", "group_feedback_range", "group_trial"]


def _cohorts(spark, d):
    # the session table has one row per (game, participant, condition), four conditions at most
    return cohorts.cohort_labels(study.session_table(spark, d), pieces=False)


@query(with_parts("cohorts") + f"SELECT {K}, {', '.join(LABELS)} FROM cohorts")
def cohort_labels(spark, d):
    return _cohorts(spark, d).select(*KEYS, *LABELS)


@query(with_parts("cohorts") + "SELECT GameTitle, mi_group, count(*) AS count FROM cohorts GROUP BY 1, 2")
def cohort_counts(spark, d):
    return summaries.group_counts(cohorts.mi_group(study.session_table(spark, d)), ["GameTitle", "mi_group"])


@query(with_parts("st") + f"""SELECT {K}, lowest FROM st LEFT JOIN (SELECT GameTitle, Participant,
min(totalTrials) AS lowest FROM st GROUP BY 1, 2) USING (GameTitle, Participant)""")
def labels_joined(spark, d):
    """A participant value joined back to all of the participant's sessions."""
    counts = stored(sessions.trial_counts(study.study_log(spark, d)))
    lowest = counts.groupBy("GameTitle", "Participant").agg(na.na_min("totalTrials").alias("lowest"))
    return cohorts.add_labels(counts, lowest).select(*KEYS, "lowest")


def _extract_sql(label, level):
    return with_parts("cohorts") + f"""SELECT {K}, {rnd('rate_feedback')}, {rnd('rate_fabInput')}, {rnd('PercNormalized')},
{rnd('FrustNormalized')}, row_number() OVER (PARTITION BY GameTitle, Participant ORDER BY rate_feedback NULLS LAST, Condition) AS position
FROM cohorts WHERE {label} = '{level}'"""


def _extract(spark, d, label, level):
    return cohorts.cohort_extract(_cohorts(spark, d), label, level, pieces=False).select(
        *KEYS, "rate_feedback", "rate_fabInput", "PercNormalized", "FrustNormalized", "position")


@query(_extract_sql("group_trial", "LOW"))
def cohort_low_trial(spark, d):
    return _extract(spark, d, "group_trial", "LOW")


@query(_extract_sql("group_trial", "HIGH"))
def cohort_high_trial(spark, d):
    return _extract(spark, d, "group_trial", "HIGH")


@query(_extract_sql("group_feedback", "HIGH"))
def cohort_high_feedback(spark, d):
    return _extract(spark, d, "group_feedback", "HIGH")


@query(_extract_sql("group_feedback_range", "HIGH"))
def cohort_high_range(spark, d):
    return _extract(spark, d, "group_feedback_range", "HIGH")


@query(with_parts("st") + f"""SELECT Participant, Condition, {rnd('FrustNormalized', 'Frustration')}, {rnd('rate_feedback', 'control')}
FROM st WHERE GameTitle = 'Kiwi'""")
def narrow_extract(spark, d):
    return cohorts.narrow_extract(study.session_table(spark, d), "Kiwi")


_STABILITY_SQL = with_parts("cohorts") + """, first_seen AS (SELECT GameTitle, Participant, coalesce(mi_group, 'NA') AS g,
min(Condition) AS seen FROM cohorts GROUP BY 1, 2, 3),
stab AS (SELECT GameTitle, Participant, string_agg(g, ',' ORDER BY seen) AS stability_type,
  CASE WHEN count(*) > 1 THEN 'unstable' ELSE 'stable' END AS mi_stability FROM first_seen GROUP BY 1, 2)
"""


@query(_STABILITY_SQL + "SELECT GameTitle, Participant, stability_type, mi_stability FROM stab")
def stability(spark, d):
    return summaries.stability(cohorts.mi_group(study.session_table(spark, d)))


@query(_STABILITY_SQL + """SELECT GameTitle, stability_type, max(count) AS count, chunk, string_agg(Participant, ',' ORDER BY Participant) AS participant
FROM (SELECT *, count(*) OVER (PARTITION BY GameTitle, stability_type) AS count,
  (row_number() OVER (PARTITION BY GameTitle, stability_type ORDER BY Participant) - 1) // 50 AS chunk FROM stab)
GROUP BY GameTitle, stability_type, chunk""")
def stability_types(spark, d):
    kinds = summaries.stability(cohorts.mi_group(study.session_table(spark, d)))
    return summaries.member_lists(kinds, ["GameTitle", "stability_type"], "Participant", "participant", size=50)


# --- questionnaires -----------------------------------------------------------------------

RATING_OUT = ["Order", "OrderAll", "GameOrder", "Gender", "Comment", "Color", "Preference"]
RATING_DOUBLES = ["PercNormalized", "FrustNormalized", "PercNormalized_prev_diff", "PercNormalized_first_diff",
                  "PercNormalized_rel"]


@query(with_parts("ratings") + f"""SELECT {K}, "Order", OrderAll, GameOrder, Gender, Comment, Color, Preference,
{', '.join(rnd(c) for c in RATING_DOUBLES)} FROM ratings""")
def ratings_prepared(spark, d):
    return study.study_ratings(spark, d).select(*KEYS, *RATING_OUT, *RATING_DOUBLES)


@query(with_parts("log", "ratings") + f"""SELECT l.GameTitle, l.Participant, l.Condition, event_id, Event, GameOrder, OrderAll,
{rnd('PercNormalized')} FROM (SELECT * REPLACE (CASE WHEN Participant % 13 = 0 AND Condition = '50A' THEN '50A_WRONG'
WHEN Participant % 17 <> 0 THEN Condition END AS Condition) FROM log) l LEFT JOIN ratings r ON l.GameTitle IS NOT DISTINCT FROM r.GameTitle
AND l.Participant IS NOT DISTINCT FROM r.Participant AND l.Condition IS NOT DISTINCT FROM r.Condition
WHERE coalesce(l.Condition NOT IN ('50A_WRONG', '50A-2'), true)""")
def log_with_ratings(spark, d):
    notes = study.study_ratings(spark, d).select(*KEYS, "GameOrder", "OrderAll", "PercNormalized")
    log = study.study_log(spark, d, stops=True)  # some labels are discarded, some unknown
    log = log.withColumn("Condition", F.when((F.col("Participant") % 17 != 0) | (F.col("Condition") == "50A_WRONG"), F.col("Condition")))
    log = log.withColumn("Event", F.when(F.col("Event") == "GameStopped", "MotorImagery").otherwise(F.col("Event")))
    return ratings.drop_discarded(ratings.attach_ratings(log, notes)).select(
        *KEYS, "event_id", "Event", "GameOrder", "OrderAll", "PercNormalized")


# --- models -------------------------------------------------------------------------------

def _ols_sql(y, x):
    return (f"{rnd(f'regr_slope({y}, {x})', 'slope')}, {rnd(f'regr_intercept({y}, {x})', 'intercept')}, "
            f"{rnd(f'regr_r2({y}, {x})', 'r2')}, regr_count({y}, {x})::BIGINT AS n")


@query(with_parts("st") + f"SELECT Condition, {_ols_sql('PercNormalized', 'rate_feedback')} FROM st GROUP BY 1", digits=6)
def ols_by_condition(spark, d):
    return linear.ols_by(study.session_table(spark, d), "PercNormalized", "rate_feedback", ["Condition"])


@query(f"SELECT l_returnflag, {_ols_sql('l_extendedprice', 'l_quantity')} FROM lineitem GROUP BY 1", digits=6)
def ols_prices(spark, d):
    return linear.ols_by(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])


@query(with_parts("st") + f""", s AS (SELECT regr_count(mi_recog, rate_feedback) AS n, regr_sxx(mi_recog, rate_feedback) AS sxx,
regr_syy(mi_recog, rate_feedback) AS syy, regr_sxy(mi_recog, rate_feedback) AS sxy, regr_avgx(mi_recog, rate_feedback) AS mx,
regr_avgy(mi_recog, rate_feedback) AS my FROM st),
f AS (SELECT *, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM s),
e AS (SELECT *, sigma / sqrt(sxx) AS se_slope, sigma * sqrt(1 / n + mx * mx / sxx) AS se_intercept FROM f)
SELECT n::BIGINT AS n, {rnd('slope')}, {rnd('intercept')}, (n - 2)::BIGINT AS df_residual, {rnd('sxy * sxy / (sxx * syy)', 'r2')},
{rnd('sigma')}, {rnd('se_slope')}, {rnd('se_intercept')}, {rnd('slope / se_slope', 't_slope')},
{rnd('intercept / se_intercept', 't_intercept')}, {rnd(t_tail_sql('slope / se_slope', 'n - 2'), 'p_slope')},
{rnd(t_tail_sql('intercept / se_intercept', 'n - 2'), 'p_intercept')} FROM e""", digits=6)
def ols_summary(spark, d):
    return linear.ols_summary(study.session_table(spark, d), "mi_recog", "rate_feedback")


@query(with_parts("st") + """, z AS (SELECT rate_trial AS y, ConditionOrder AS x1, CASE WHEN GameTitle = 'Kiwi' THEN 1.0 ELSE 0.0 END AS x2
FROM st WHERE rate_trial IS NOT NULL AND ConditionOrder IS NOT NULL AND GameTitle IS NOT NULL),
s AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, regr_sxx(y, x1) AS s11, regr_sxx(y, x2) AS s22,
  regr_syy(y, x1) AS syy, regr_sxy(x1, x2) AS s12, regr_sxy(y, x1) AS s1y, regr_sxy(y, x2) AS s2y FROM z),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
  (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
e AS (SELECT *, syy - b1 * s1y - b2 * s2y AS sse, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS v FROM b),
t AS (SELECT unnest(['ConditionOrder', 'is_kiwi', '(Intercept)']) AS term, unnest([b1, b2, my - b1 * m1 - b2 * m2]) AS estimate,
  unnest([sqrt(v * s22 / det), sqrt(v * s11 / det), sqrt(v * (1 / n + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / det))]) AS std_error,
  1 - sse / syy AS r2, n - 3 AS df FROM e)
""" + f"""SELECT term, {rnd('estimate')}, {rnd('std_error')}, {rnd('estimate / std_error', 't_value')},
{rnd(t_tail_sql('estimate / std_error', 'df'), 'p_value')}, {rnd('r2')}, df::INTEGER AS df_residual FROM t""", digits=6)
def linear_model(spark, d):
    """Two predictors with p-values."""
    rows = study.session_table(spark, d).withColumn("is_kiwi", sc.dummy("GameTitle", "Kiwi"))
    return linear.linear_model(stored(rows.select("rate_trial", "ConditionOrder", "is_kiwi")), "rate_trial",
                               ["ConditionOrder", "is_kiwi"])


def _line_sql(y, points):
    return f""", fit AS (SELECT Condition, regr_slope({y}, rate_trial) AS b, regr_intercept({y}, rate_trial) AS a,
min(rate_trial) * 100 AS lo, max(rate_trial) * 100 AS hi FROM st GROUP BY 1),
pts AS (SELECT *, {points} AS x FROM fit)
SELECT Condition, {rnd('x')}, {rnd('a + b * x', 'y')}"""


_OBSERVED = "unnest(list_transform(generate_series(0, CAST(floor(hi - lo + 1e-10) AS BIGINT)), lambda k: (lo + k) / 100))"
_UNIT = "unnest(list_transform(generate_series(1, 100), lambda k: k / 100))"


@query(with_parts("st") + _line_sql("PercNormalized", _OBSERVED) + " FROM pts", digits=6)
def fit_line(spark, d):
    return linear.fit_line(study.session_table(spark, d), "PercNormalized", "rate_trial", ["Condition"])


@query(with_parts("st") + _line_sql("PercNormalized", _UNIT) + " FROM pts", digits=6)
def fit_line_unit(spark, d):
    return linear.fit_line(study.session_table(spark, d), "PercNormalized", "rate_trial", ["Condition"], grid="unit")


@query(with_parts("st") + "".join(
    f""", {n}f AS (SELECT regr_slope({y}, rate_feedback) AS b, regr_intercept({y}, rate_feedback) AS a FROM st {w}),
{n}p AS (SELECT *, {_UNIT} AS x FROM {n}f)""" for n, y, w in (
        ("k", "PercNormalized", "WHERE GameTitle = 'Kiwi'"), ("h", "PercNormalized", "WHERE GameTitle = 'HandStrength'"),
        ("b", "PercNormalized", ""))) + f"""
SELECT 'kiwi' AS study, {rnd('x')}, {rnd('a + b * x', 'y')} FROM kp UNION ALL
SELECT 'hand', {rnd('x')}, {rnd('a + b * x', 'y')} FROM hp UNION ALL SELECT 'all', {rnd('x')}, {rnd('a + b * x', 'y')} FROM bp""", digits=6)
def stack_curves(spark, d):
    rows = stored(study.session_table(spark, d).select("GameTitle", "PercNormalized", "rate_feedback"))
    parts = {"kiwi": rows.where("GameTitle = 'Kiwi'"), "hand": rows.where("GameTitle = 'HandStrength'"), "all": rows}
    return linear.stack_curves({name: linear.fit_line(part, "PercNormalized", "rate_feedback", [], grid="unit")
                                for name, part in parts.items()})


def _coefficients(spark, d):
    """Slopes and intercepts of both ratings for each game and condition."""
    rows = study.session_table(spark, d).withColumn("study", F.concat_ws(" ", "GameTitle", "Condition"))
    return rows.groupBy("study").agg(
        F.regr_slope("PercNormalized", "rate_feedback").alias("perc_slope"),
        F.regr_intercept("PercNormalized", "rate_feedback").alias("perc_intercept"),
        F.regr_slope("FrustNormalized", "rate_feedback").alias("frust_slope"),
        F.regr_intercept("FrustNormalized", "rate_feedback").alias("frust_intercept"))


METRICS = ["perc_slope", "perc_intercept", "frust_slope", "frust_intercept"]
_COEF_SQL = with_parts("st") + """, coef AS (SELECT concat(GameTitle, ' ', Condition) AS study,
regr_slope(PercNormalized, rate_feedback) AS perc_slope, regr_intercept(PercNormalized, rate_feedback) AS perc_intercept,
regr_slope(FrustNormalized, rate_feedback) AS frust_slope, regr_intercept(FrustNormalized, rate_feedback) AS frust_intercept
FROM st GROUP BY 1)
"""


@query(_COEF_SQL.rstrip() + f""", long AS (UNPIVOT coef ON perc_slope, perc_intercept, frust_slope, frust_intercept INTO NAME metric VALUE value)
SELECT l.study AS a, r.study AS b, l.metric, {rnd('l.value', 'value_a')}, {rnd('r.value', 'value_b')},
{rnd('l.value - r.value', 'difference')},
{rnd('(greatest(l.value, r.value) - least(l.value, r.value)) / NULLIF(greatest(l.value, r.value), 0) * 100', 'perc_change', 3)}
FROM long l JOIN long r ON l.metric = r.metric AND split_part(l.study, ' ', 1) = 'Kiwi'
AND split_part(r.study, ' ', 1) = 'HandStrength' AND split_part(l.study, ' ', 2) = split_part(r.study, ' ', 2)""", digits=6)
def pairwise_study(spark, d):
    """Each condition compared between the two games."""
    coef = stored(_coefficients(spark, d))
    pairs = (coef.where(F.col("study").startswith("Kiwi ")).select(F.col("study").alias("a"))
             .withColumn("b", F.concat_ws(" ", F.lit("HandStrength"), F.substring_index("a", " ", -1))))
    out = linear.pairwise_diff(coef, "study", METRICS, pairs)
    return out.withColumn("perc_change", F.round("perc_change", 3))


_STUDY_NAMES = {"Kiwi 100A": "realbci", "Kiwi 50A": "strokesur", "HandStrength 100A": "handsur"}


@query(_COEF_SQL + f"""SELECT CASE WHEN study = 'Kiwi 100A' THEN 'BCI (EEG, MRP)' ELSE 'Eye-blinks' END AS "BCI input",
CASE WHEN study = 'Kiwi 50A' THEN 'Stroke patients' ELSE 'Non-patients' END AS "Participants",
{rnd('perc_intercept', '"Agency (alpha)"')}, {rnd('perc_slope', '"Agency (beta)"')},
{rnd('frust_intercept', '"Frustration (alpha)"')}, {rnd('frust_slope', '"Frustration (beta)"')} FROM coef""", digits=6)
def study_table(spark, d):
    name = F.col("study")
    for old, new in _STUDY_NAMES.items():
        name = F.when(F.col("study") == old, new).otherwise(name)
    return report.study_table(_coefficients(spark, d).withColumn("study", name))


_BLOCKS_SQL = with_parts("st") + """, cell AS (SELECT Participant, Condition, avg(FrustNormalized) AS y FROM st
WHERE FrustNormalized IS NOT NULL GROUP BY 1, 2),
blocks AS (SELECT * FROM cell WHERE Participant IN (SELECT Participant FROM cell GROUP BY 1 HAVING count(*) = 4)),
r AS (SELECT *, rank() OVER (PARTITION BY Participant ORDER BY y) + (count(*) OVER (PARTITION BY Participant, y) - 1) / 2 AS rk,
  count(*) OVER (PARTITION BY Participant, y) AS t FROM blocks),
tot AS (SELECT count(DISTINCT Participant) AS n, sum(t * t - 1) AS ties FROM r),
rs AS (SELECT Condition, sum(rk) AS rj FROM r GROUP BY 1)
"""


def _rating_cells(spark, d):
    # ratings are round shares, so both engines add them up to the same double
    return (study.session_table(spark, d).where(F.col("FrustNormalized").isNotNull())
            .groupBy("Participant", "Condition").agg(F.avg("FrustNormalized").alias("y")))


@query(_BLOCKS_SQL + f"""SELECT {rnd('12 * sum(power(rj - n * 5 / 2, 2)) / (any_value(n) * 20 - any_value(ties) / 3)', 'statistic')},
3::BIGINT AS df, any_value(n)::BIGINT AS blocks FROM rs, tot""", digits=6)
def friedman(spark, d):
    return ranks.friedman_stats(stored(_rating_cells(spark, d)), "y", "Condition", "Participant", drop_incomplete=True)


@query(_BLOCKS_SQL + f""", f AS (SELECT 12 * sum(power(rj - n * 5 / 2, 2)) / (any_value(n) * 20 - any_value(ties) / 3) AS statistic,
any_value(n)::BIGINT AS blocks FROM rs, tot)
SELECT {rnd('statistic')}, 3::INTEGER AS df, blocks, {rnd(chi3_tail_sql('statistic'), 'p_value')} FROM f""", digits=6)
def friedman_test(spark, d):
    """With the p-value."""
    result = ranks.friedman(stored(_rating_cells(spark, d)), "y", "Condition", "Participant", drop_incomplete=True)
    return spark.createDataFrame([(result.statistic, result.df, result.blocks, result.p_value)],
                                 "statistic double, df int, blocks bigint, p_value double")


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice / 1000) AS s1 FROM orders GROUP BY 1)
SELECT n, count(*) AS groups, """ + rnd("sum(s1)", "sum_y", 5) + ", " + rnd("sum(s1 * s1)", "sum_y2", 1) + " FROM g GROUP BY 1")
def mixed_suffstats(spark, d):
    rows = mixed.complete_rows(table(spark, d, "orders").withColumn("price", F.col("o_totalprice") / 1000),
                               ["price"], "o_custkey")
    stats = mixed.size_statistics(rows, ["price"], "o_custkey")
    return stats.select("n", "groups", F.round(F.col("b_0_1") / F.col("n"), 5).alias("sum_y"),
                        F.round("b_1_1", 1).alias("sum_y2"))


THETAS = [0.0, 0.25, 0.5, 1.0, 2.0]


@query("""WITH z AS (SELECT o_custkey AS g, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x,
  o_totalprice / 100000 AS y FROM orders),
g AS (SELECT g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM z GROUP BY 1),
t AS (SELECT unnest([0.0, 0.25, 0.5, 1.0, 2.0])::DOUBLE AS theta),
w AS (SELECT theta, g.*, theta * theta / (1 + n * theta * theta) AS w FROM g, t),
s AS (SELECT theta, sum(n) AS n, sum(ln(1 + n * theta * theta)) AS ld, sum(n - w * n * n) AS s00, sum(sx - w * n * sx) AS s01,
  sum(sy - w * n * sy) AS s02, sum(xx - w * sx * sx) AS s11, sum(xy - w * sx * sy) AS s12, sum(yy - w * sy * sy) AS s22
  FROM w GROUP BY 1),
b AS (SELECT *, (s11 * s02 - s01 * s12) / (s00 * s11 - s01 * s01) AS b0, (s00 * s12 - s01 * s02) / (s00 * s11 - s01 * s01) AS b1 FROM s)
SELECT theta, """ + rnd("b0", None, 5) + ", " + rnd("b1", None, 5) + ", "
       + rnd("ld + n * (1 + ln(2 * pi() * (s22 - b0 * s02 - b1 * s12) / n))", "deviance", 3) + " FROM b")
def mixed_profile_grid(spark, d):
    rows = table(spark, d, "orders").select(
        "o_custkey", sc.dummy("o_orderstatus", "F").alias("x"), (F.col("o_totalprice") / 100000).alias("y"))
    stats = mixed.size_statistics(mixed.complete_rows(rows, ["x", "y"], "o_custkey"), ["x", "y"], "o_custkey")
    grid = mixed.profile_grid(stats, THETAS)
    return grid.select("theta", F.round("b0", 5).alias("b0"), F.round("b1", 5).alias("b1"),
                       F.round("deviance", 3).alias("deviance"))


# The fitted models, name: (response, predictors), and the tested pairs.
MODELS = {
    "perc_null": ("PercNormalized", []), "perc_feedback": ("PercNormalized", ["rate_feedback"]),
    "perc_trial": ("PercNormalized", ["rate_trial"]), "perc_fab": ("PercNormalized", ["rate_fabInput"]),
    "perc_feedbackfab": ("PercNormalized", ["rate_feedback", "rate_fabInput"]),
    "frust_null": ("FrustNormalized", []), "frust_feedback": ("FrustNormalized", ["rate_feedback"]),
    "frust_trial": ("FrustNormalized", ["rate_trial"]),
    "frust_feedbackfab": ("FrustNormalized", ["rate_feedback", "rate_fabInput"]),
    "frust_feedbackgame": ("FrustNormalized", ["rate_feedback", "is_kiwi"]),
    "feedback_null": ("rate_feedback", []), "feedback_game": ("rate_feedback", ["is_kiwi"])}
TESTS = [("perc_null", "perc_feedback"), ("perc_null", "perc_trial"), ("perc_null", "perc_fab"),
         ("perc_feedback", "perc_feedbackfab"), ("frust_null", "frust_feedback"), ("frust_null", "frust_trial"),
         ("frust_feedback", "frust_feedbackfab"), ("frust_feedback", "frust_feedbackgame"),
         ("feedback_null", "feedback_game")]
PREDICTORS = ["rate_feedback", "rate_trial", "rate_fabInput", "is_kiwi"]


def _fits(spark, d, names):
    """Fit models that share a response from one reduction of the same complete rows."""
    rows = study.session_table(spark, d).withColumn("is_kiwi", sc.dummy("GameTitle", "Kiwi"))
    rows = stored(rows.select("Participant", "PercNormalized", "FrustNormalized", *PREDICTORS))
    fits = {}
    for y in sorted({MODELS[n][0] for n in names}):
        stats = mixed.mixed_statistics(rows, [*[p for p in PREDICTORS if p != y], y], "Participant")
        fits |= mixed.fit_models(stats, {n: MODELS[n] for n in names if MODELS[n][0] == y})
    return {n: fits[n] for n in names}


def _fits_sql(names):
    """``<name>_fit`` of each model, from the same rows as the queries."""
    parts = []
    for n in names:
        y, xs = MODELS[n]
        complete = " AND ".join(f"{c} IS NOT NULL" for c in [*[p for p in PREDICTORS if p != y], y])
        source = f"""SELECT Participant AS g, {", ".join(f"{c}::DOUBLE AS v{i + 1}" for i, c in enumerate([*xs, y]))}
FROM (SELECT *, CASE WHEN GameTitle = 'Kiwi' THEN 1 ELSE 0 END AS is_kiwi FROM st) WHERE {complete}"""
        parts.append(mixed_fit_sql(n, source, len(xs)))
    return with_parts("st") + ", " + ",\n".join(parts) + "\n"


MODEL_NAMES = ["perc_null", "perc_feedback", "frust_feedbackgame"]


@query(_fits_sql(MODEL_NAMES) + " UNION ALL ".join(
    f"""SELECT '{n}' AS model, rows::BIGINT AS n, groups::BIGINT AS groups, {rnd("-deviance / 2", "log_likelihood")}, {rnd("deviance")},
{rnd(f"deviance + {2 * len(MODELS[n][1]) + 6}", "aic")}, {rnd(f"deviance + {len(MODELS[n][1]) + 3} * ln(rows)", "bic")},
{rnd("theta * theta * rss / rows", "var_group")}, {rnd("rss / rows", "var_residual")} FROM {n}_fit""" for n in MODEL_NAMES), digits=5)
def mixed_model(spark, d):
    fits = _fits(spark, d, MODEL_NAMES)
    return spark.createDataFrame([m.fit_row(name) for name, m in fits.items()], mixed.FIT_SCHEMA)


COEFFICIENT_MODELS = ["perc_feedbackfab", "frust_feedbackgame"]


@query(_fits_sql(COEFFICIENT_MODELS) + " UNION ALL ".join(
    f"""SELECT '{n}' AS model, '{term}' AS term, {rnd(f"beta{i}", "estimate")}, {rnd(f"sqrt(rss / rows * inverse{i})", "std_error")},
{rnd(f"beta{i} / sqrt(rss / rows * inverse{i})", "t_value", 4)} FROM {n}_fit"""
    for n in COEFFICIENT_MODELS for i, term in enumerate(["(Intercept)", *MODELS[n][1]])), digits=5)
def mixed_coefficients(spark, d):
    fits = _fits(spark, d, COEFFICIENT_MODELS)
    out = linear.stack_curves({name: m.coefficients(spark) for name, m in fits.items()}, label="model")
    return out.withColumn("t_value", F.round("t_value", 4))


@query(_fits_sql(list(MODELS)) + " UNION ALL ".join(
    f"""SELECT '{small}' AS small, '{large}' AS large, {rnd("greatest(s.deviance - l.deviance, 0)", "statistic")}, 1::INTEGER AS df,
{rnd(chi1_tail_sql("greatest(s.deviance - l.deviance, 0)"), "p_value")} FROM {small}_fit s, {large}_fit l""" for small, large in TESTS), digits=5)
def lr_test(spark, d):
    fits = mixed.fits_table(spark, _fits(spark, d, list(MODELS)))
    return mixed.lr_tests(fits, spark.createDataFrame(TESTS, "small string, large string"))


R2_MODELS = ["perc_fab", "perc_feedbackfab", "perc_trial", "frust_feedbackgame", "frust_feedback"]


@query(_fits_sql(R2_MODELS) + " UNION ALL ".join(
    f"""SELECT '{n}' AS model, {rnd("fixed / (fixed + theta * theta * rss / rows + rss / rows)", "r2_marginal")},
{rnd("(fixed + theta * theta * rss / rows) / (fixed + theta * theta * rss / rows + rss / rows)", "r2_conditional")} FROM {n}_fit""" for n in R2_MODELS), digits=5)
def mixed_r2(spark, d):
    return mixed.mixed_r2s(mixed.fits_table(spark, _fits(spark, d, R2_MODELS)))


def _smooth_pass(src, value, out, span):
    return f"""{out}w AS (SELECT *, greatest(2, CAST(floor(0.5 * {span} * n + 0.5) AS BIGINT)) AS k FROM {src}),
{out}c AS (SELECT *, CASE WHEN 2 * k + 1 > n THEN 1 ELSE greatest(k + 1, least(n - k, rn)) - k END AS lo,
  CASE WHEN 2 * k + 1 > n THEN n ELSE greatest(k + 1, least(n - k, rn)) + k END AS hi FROM {out}w),
{out}f AS (SELECT a.Condition, a.rn, any_value(a.x) AS x, any_value(a.n) AS n, any_value(a.flat) AS flat,
  CASE WHEN regr_sxx(b.{value}, b.x) > any_value(a.flat) THEN regr_intercept(b.{value}, b.x) + regr_slope(b.{value}, b.x) * any_value(a.x)
  ELSE avg(b.{value}) END AS fit
  FROM {out}c a JOIN {src} b ON a.Condition = b.Condition AND b.rn BETWEEN a.lo AND a.hi GROUP BY a.Condition, a.rn),
{out} AS (SELECT *, avg(fit) OVER (PARTITION BY Condition, x) AS y2 FROM {out}f)"""


@query(with_parts("st") + """, base AS (SELECT Condition, rate_feedback AS x, PercNormalized AS y,
  row_number() OVER (PARTITION BY Condition ORDER BY rate_feedback, concat(GameTitle, ' ', lpad(Participant::VARCHAR, 12, '0'))) AS rn,
  count(*) OVER (PARTITION BY Condition) AS n FROM st WHERE rate_feedback IS NOT NULL AND PercNormalized IS NOT NULL),
sc AS (SELECT Condition, power(1e-3 * (max(x) FILTER (rn = least(3 * (n // 4), n)) - max(x) FILTER (rn = n // 4)), 2) AS flat
  FROM base GROUP BY 1),
b0 AS (SELECT * FROM base JOIN sc USING (Condition)),
""" + _smooth_pass("b0", "y", "wide", 0.5) + ",\n" + _smooth_pass("wide", "y2", "narrow", 0.05)
       + f" SELECT Condition, {rnd('x')}, {rnd('max(y2)', 'y', 5)} FROM narrow GROUP BY Condition, x", digits=6)
def running_line_smooth(spark, d):
    rows = study.session_table(spark, d).withColumn(
        "tie", F.concat_ws(" ", "GameTitle", F.lpad(F.col("Participant").cast("string"), 12, "0")))
    out = smooth.running_line_smooth(rows, "PercNormalized", "rate_feedback", ["Condition"], "tie")
    return out.withColumn("y", F.round("y", 5))


def _line_pass(src, value, out, span):
    """``out``: the running line of ``value`` with its residual that leaves the row out, and ``m``, averaged over tied x."""
    return f"""{out}_w AS (SELECT *, greatest(2, CAST(floor(0.5 * {span} * n + 0.5) AS BIGINT)) AS k FROM {src}),
{out}_c AS (SELECT *, CASE WHEN 2 * k + 1 > n THEN 1 ELSE greatest(k + 1, least(n - k, rn)) - k END AS lo,
  CASE WHEN 2 * k + 1 > n THEN n ELSE greatest(k + 1, least(n - k, rn)) + k END AS hi FROM {out}_w),
{out}_s AS (SELECT a.Condition, a.rn, any_value(a.x) AS x, any_value(a.{value}) AS v, any_value(a.flat) AS flat, count(*) AS m, avg(b.x) AS mx,
  avg(b.{value}) AS my, regr_sxx(b.{value}, b.x) AS sxx, regr_sxy(b.{value}, b.x) AS sxy
  FROM {out}_c a JOIN {src} b ON a.Condition = b.Condition AND b.rn BETWEEN a.lo AND a.hi GROUP BY a.Condition, a.rn),
{out}_f AS (SELECT *, my + CASE WHEN sxx > flat THEN sxy / sxx ELSE 0 END * (x - mx) AS fit,
  1 - 1 / m - CASE WHEN sxx > flat THEN (x - mx) * (x - mx) / sxx ELSE 0 END AS left_out FROM {out}_s),
{out} AS (SELECT Condition, rn, CASE WHEN left_out > 1e-12 THEN abs(v - fit) / left_out ELSE 0 END AS r,
  avg(fit) OVER (PARTITION BY Condition, x) AS y2 FROM {out}_f)"""


def _super_smooth_sql(bass):
    pull = f"""CASE WHEN least(e0.y2, e1.y2, e2.y2) < e2.y2 AND least(e0.y2, e1.y2, e2.y2) > 0 THEN
(0.5 - s) * power(greatest(1e-7, least(e0.y2, e1.y2, e2.y2) / e2.y2), {10 - bass}) ELSE 0 END""" if bass else "0"
    return with_parts("st") + """, base AS (SELECT Condition, rate_feedback AS x, PercNormalized AS y,
  row_number() OVER (PARTITION BY Condition ORDER BY rate_feedback, concat(GameTitle, ' ', lpad(Participant::VARCHAR, 12, '0'))) AS rn,
  count(*) OVER (PARTITION BY Condition) AS n FROM st WHERE rate_feedback IS NOT NULL AND PercNormalized IS NOT NULL),
sc AS (SELECT Condition, power(1e-3 * (max(x) FILTER (rn = least(3 * (n // 4), n)) - max(x) FILTER (rn = n // 4)), 2) AS flat
  FROM base GROUP BY 1),
b0 AS (SELECT * FROM base JOIN sc USING (Condition)),
""" + ",\n".join(_line_pass("b0", "y", f"f{i}", span) for i, span in enumerate((0.05, 0.2, 0.5))) + """,
b1 AS (SELECT b0.*, f0.r AS r0, f1.r AS r1, f2.r AS r2, f0.y2 AS m0, f1.y2 AS m1, f2.y2 AS m2 FROM b0
  JOIN f0 USING (Condition, rn) JOIN f1 USING (Condition, rn) JOIN f2 USING (Condition, rn)),
""" + ",\n".join(_line_pass("b1", f"r{i}", f"e{i}", 0.2) for i in range(3)) + f""",
b2 AS (SELECT b.*, s + {pull} AS best FROM (SELECT b1.*, CASE WHEN e0.y2 <= least(e1.y2, e2.y2) THEN 0.05
  WHEN e1.y2 <= e2.y2 THEN 0.2 ELSE 0.5 END::DOUBLE AS s FROM b1 JOIN e0 USING (Condition, rn) JOIN e1 USING (Condition, rn)
  JOIN e2 USING (Condition, rn)) b JOIN e0 USING (Condition, rn) JOIN e1 USING (Condition, rn) JOIN e2 USING (Condition, rn)),
{_line_pass("b2", "best", "q", 0.2)},
b3 AS (SELECT b2.*, greatest(0.05, least(0.5, q.y2)) - 0.2 AS off FROM b2 JOIN q USING (Condition, rn)),
b4 AS (SELECT *, CASE WHEN off < 0 THEN (1 + off / 0.15) * m1 - off / 0.15 * m0 ELSE (1 - off / 0.3) * m1 + off / 0.3 * m2 END AS v FROM b3),
{_line_pass("b4", "v", "z", 0.05)}
SELECT Condition, {rnd('x')}, {rnd('max(z.y2)', 'y', 5)} FROM b4 JOIN z USING (Condition, rn) GROUP BY Condition, x"""


def _super_smooth(spark, d, bass):
    rows = study.session_table(spark, d).withColumn(
        "tie", F.concat_ws(" ", "GameTitle", F.lpad(F.col("Participant").cast("string"), 12, "0")))
    out = smooth.running_line_smooth(rows, "PercNormalized", "rate_feedback", ["Condition"], "tie", bass=bass)
    return out.withColumn("y", F.round("y", 5))


@query(_super_smooth_sql(0), digits=6)
def super_smooth_plain(spark, d):
    return _super_smooth(spark, d, 0)


@query(_super_smooth_sql(5), digits=6)
def super_smooth_bass(spark, d):
    return _super_smooth(spark, d, 5)


# --- reshape and reports ------------------------------------------------------------------

def _people_bucket():
    return [F.floor(F.col("Participant") / (1 << 20)), F.floor(F.col("Participant") / 1024)]


_FEATURES_SQL = with_parts("players") + """, feat AS (
SELECT Participant, GameTitle, unnest(['MI Experience', 'Mean Rate', 'Min. Rate', 'Max. Rate', 'Mean Pos. Feedback',
  'Mean Time (s)', 'False Positives (pr min)', 'Gender']) AS Feature,
  unnest([CASE WHEN mi_experience THEN 'Yes' ELSE 'No' END, concat(pm, ' \\%'), concat(pn, ' \\%'), concat(px, ' \\%'),
  concat(pf, ' \\%'), coalesce(CAST(CAST(round_even(round(time_total, 8), 0) AS BIGINT) AS VARCHAR), 'NA'),
  coalesce(printf('%.2f', round_even(round(fp_rate_minute, 10), 2)), 'NA'), gender]) AS value
FROM (SELECT *, coalesce(CAST(CAST(round_even(round(mean_rate * 100, 8), 0) AS BIGINT) AS VARCHAR), 'NA') AS pm,
  coalesce(CAST(CAST(round_even(round(min_rate * 100, 8), 0) AS BIGINT) AS VARCHAR), 'NA') AS pn,
  coalesce(CAST(CAST(round_even(round(max_rate * 100, 8), 0) AS BIGINT) AS VARCHAR), 'NA') AS px,
  coalesce(CAST(CAST(round_even(round(mean_feedback * 100, 8), 0) AS BIGINT) AS VARCHAR), 'NA') AS pf FROM players))
"""


@query(_FEATURES_SQL + "SELECT CAST(Participant AS VARCHAR) AS Participant, GameTitle, Feature, value FROM feat")
def participant_features(spark, d):
    return report.participant_features(summaries.participant_summary(study.session_table(spark, d)))


_P16 = ", ".join(f"max(value) FILTER (place = {i}) AS p{i + 1}" for i in range(16))
_TABLE_SQL = _FEATURES_SQL + """, people AS (SELECT Participant, row_number() OVER (ORDER BY Participant) - 1 AS no
FROM (SELECT DISTINCT Participant FROM st)),
cells AS (SELECT no // 16 AS block, no % 16 AS place, GameTitle, Feature, value
FROM (SELECT * FROM feat UNION ALL SELECT DISTINCT Participant, GameTitle, 'Participant', CAST(Participant AS VARCHAR) FROM players)
JOIN people USING (Participant)),
tab AS (SELECT block, GameTitle, Feature, """ + _P16 + " FROM cells GROUP BY 1, 2, 3)\n"


def _blocks(spark, d):
    players = stored(summaries.participant_summary(study.session_table(spark, d)))
    return report.participant_blocks(players, _people_bucket())


@query(_TABLE_SQL + "SELECT * FROM tab")
def participant_table(spark, d):
    return _blocks(spark, d)


P_COLS = ["GameTitle", "Feature", *[f"p{i + 1}" for i in range(16)]]
_ROW_SQL = "concat_ws(' & ', " + ", ".join(f"coalesce({c}, 'NA')" for c in P_COLS) + ")"


@query(_TABLE_SQL + f"""SELECT block, concat('{" & ".join(P_COLS)}', ' \\\\ ', string_agg({_ROW_SQL}, ' \\\\ ' ORDER BY GameTitle, Feature)) AS text
FROM tab GROUP BY block""")
def delimited_text(spark, d):
    """One text per block of sixteen participants: a table of eighteen rows at most."""
    return report.delimited_text(_blocks(spark, d), ["block"], P_COLS, ["GameTitle", "Feature"])


@query(with_parts("st") + """SELECT Participant, GameTitle, concat_ws(' & ', GameTitle, Participant, Condition, totalTrials,
coalesce(CAST(mi_recog_rest AS VARCHAR), 'NA')) AS line FROM st""")
def delimited_rows(spark, d):
    rows = report.delimited_rows(study.session_table(spark, d),
                                 ["GameTitle", "Participant", "Condition", "totalTrials", "mi_recog_rest"])
    return columns.select_with_keys(rows, ["Participant", "GameTitle"], ["line"])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_custkey, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in _PRIORITIES).replace(
    "count(*) FILTER", "nullif(count(*) FILTER").replace("') AS", "'), 0) AS") + " FROM orders GROUP BY 1")
def pivot_priorities(spark, d):
    counts = summaries.group_counts(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "n")
    return columns.pivot_wide(counts, ["o_custkey"], "o_orderpriority", "n", _PRIORITIES)


@query("SELECT l_orderkey, l_linenumber, name, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax "
       "FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME name VALUE value)")
def unpivot_lines(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return columns.unpivot(rows, ["l_orderkey", "l_linenumber"])


@query(with_parts("st") + f"""SELECT {K}, {rnd('rate_feedback')}, lower, upper, rate_feedback BETWEEN lower AND upper AS within_limits
FROM st LEFT JOIN (VALUES ('100A', 0.0::DOUBLE, 1.0::DOUBLE), ('100B', 0.3, 1.0), ('50A', 0.0, 0.5), ('50B', 0.3, 0.8))
v(Condition, lower, upper) USING (Condition)""")
def design_vs_actual(spark, d):
    return report.design_vs_actual(study.session_table(spark, d))


@query(with_parts("st") + f"""SELECT GameTitle, Participant, ConditionOrder, Condition, {rnd('PercNormalized')}, {rnd('FrustNormalized')},
mi_recog, row_number() OVER (PARTITION BY GameTitle ORDER BY Participant, ConditionOrder NULLS LAST, Condition) - 1 AS position,
concat(Participant, ' ', Condition) AS label FROM st""")
def ordered_series(spark, d):
    return report.ordered_series(stored(study.session_table(spark, d)), ["PercNormalized", "FrustNormalized", "mi_recog"],
                                 _people_bucket())


# --- scalar functions ---------------------------------------------------------------------

@query(f"""SELECT o_orderkey, {rnd('least(greatest((o_totalprice - 100000) / 300000, 0), 1)', 'clipped')},
{rnd('(greatest(o_totalprice, 250000) - least(o_totalprice, 250000)) / greatest(o_totalprice, 250000) * 100', 'change')},
list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) AS code,
round_even(o_orderkey / 4, 0) AS half_even, epoch_us(o_orderdate - TIMESTAMP '1995-01-01') / 1e6 AS seconds,
CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS is_f FROM orders""")
def scalar_numbers(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", sc.n_clip((price - 100000) / 300000).alias("clipped"),
        sc.perc_change(price, F.lit(250000.0)).alias("change"),
        sc.level_code("o_orderpriority", _PRIORITIES[:3]).cast("int").alias("code"),
        sc.round_half_even(F.col("o_orderkey") / 4).alias("half_even"),
        sc.seconds_between(F.lit("1995-01-01").cast("timestamp_ntz"), "o_orderdate").alias("seconds"),
        sc.dummy("o_orderstatus", "F").alias("is_f"))


@query("""SELECT event_id, epoch_us(CASE WHEN event_id % 8 < 7 THEN
TRY_CAST(rtrim(substr(t, 1, 20 + (event_id % 7)::INTEGER), '.') AS TIMESTAMP) END) AS parsed,
TRY_CAST(CASE WHEN event_id % 3 = 0 THEN props ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number,
concat(coalesce(CASE WHEN event_id % 5 > 0 THEN event_type END, 'NA'), '/', user_id) AS pasted,
printf('%.2f', round_even(value, 2)) AS fixed, coalesce(CASE WHEN event_id % 5 > 0 THEN event_type END, 'none') AS filled
FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t FROM events)""")
def scalar_text(spark, d):
    some_type = F.when(F.col("event_id") % 5 > 0, F.col("event_type"))
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    part = F.rtrim(F.substring(text, F.lit(1), (20 + F.col("event_id") % 7).cast("int")), F.lit("."))  # 0 to 6 digits of the second
    given = F.when(F.col("event_id") % 8 < 7, part).otherwise("no time")
    return table(spark, d, "events").select(
        "event_id",
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), sc.parse_timestamp(given)).alias("parsed"),
        sc.to_number(F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.col("event_id").cast("string"))).alias("number"),
        na.paste_na(some_type, "user_id", sep="/").alias("pasted"),
        sc.fixed_decimals("value", 2).alias("fixed"), sc.default_value(some_type, "none").alias("filled"))


@query("""SELECT doc_id, coalesce(regexp_matches(text, '[0-9]{3}'), false) AS has_number, lang IN ('en', 'de') AS kept,
CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars < 200 THEN 'short' ELSE 'medium' END AS length_label,
concat(lang, '-', source) AS tag FROM documents""")
def text_flags(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", na.matches("text", "[0-9]{3}").alias("has_number"), na.is_in_na("lang", ["en", "de"]).alias("kept"),
        na.label_cascade("medium", [(F.col("n_chars") < 200, "short"), (F.col("n_chars") > 2000, "long")]).alias("length_label"),
        na.paste_na("lang", "source", sep="-").alias("tag"))


@query("""SELECT page_id, nullif(list_extract(p, 1), NULL) AS i0, list_extract(p, 2) AS i1, list_extract(p, 3) AS i2,
list_extract(p, 4) AS i3, list_extract(p, 5) AS i4 FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)""")
def path_split(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return columns.path_parts(pages, "url", "/", [f"i{k}" for k in range(5)]).drop("url")


@query("SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")) + " FROM customer")
def all_text(spark, d):
    return columns.all_text(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query(with_parts("st") + f"""SELECT {K}, rate_feedback IS NOT NULL AS known_x, coalesce(rate_feedback >= 0, true) AS near_x,
coalesce(FrustNormalized >= 0, true) AS near_y FROM st""")
def jitter_points(spark, d):
    """Clipped, jittered points; the noise is random, so its bounds are compared."""
    x, y = F.col("rate_feedback"), F.col("FrustNormalized")
    points = study.session_table(spark, d).select(
        *KEYS, x, y, sc.n_clip(sc.jitter("rate_feedback", 0.02, seed=7)).alias("x"),
        sc.n_clip(sc.jitter("FrustNormalized", 0.02, seed=8)).alias("y"))
    return points.select(
        *KEYS, F.col("x").isNotNull().alias("known_x"),
        F.coalesce(F.abs(F.col("x") - sc.n_clip(x)) <= 0.02, F.lit(True)).alias("near_x"),
        F.coalesce(F.abs(F.col("y") - sc.n_clip(y)) <= 0.02, F.lit(True)).alias("near_y"))
