"""Registered queries of the loaders, snapshots, and the gated study with its ratings.

The loaders read files that these queries write from the driver tables first, into the folder the session keeps
its checkpoints in, so that they grow with the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions import scalars as sc
from trialweave.models import linear, ranks
from trialweave.operators import cohorts, columns, report, sequence, summaries
from trialweave.operators.scans import shared_folder, stored
from trialweave.plans import study
from trialweave.plans.catalog import _BLOCKS_SQL, _COEF_SQL, COUNTS, KEPT, KEYS, PEOPLE, RATED, TIMES, _coefficients, _ols_sql, _sql_cols, query
from trialweave.plans.oracle import K, rnd, t_tail_sql, with_gate, with_parts
from trialweave.plans.study import ORDER, table
from trialweave.sources import logs, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("Timestamp", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _write_log(df: DataFrame, path: str) -> str:
    _as_text(df).write.csv(path, sep=";", header=True, nullValue="NULL", emptyValue="", quote='"', escape='"')
    return path


# --- loaders ------------------------------------------------------------------------------

LOG_COLUMNS = ["SessionID", "Timestamp", "event_id", "Event", "InputWindow", "InputWindowOrder", "TrialResult"]


def _events(spark, d) -> DataFrame:
    return study.study_log(spark, d).withColumn("SessionID", F.concat_ws("-", *KEYS))


_LOADED_SQL = with_parts("log") + """SELECT event_id::VARCHAR AS event_id, concat(GameTitle, '-', Participant, '-', Condition) AS SessionID,
epoch_us(Timestamp) AS at, Event, InputWindow, InputWindowOrder, TrialResult, CASE WHEN event_id % 3 = 0 THEN BCIProcessingMode END AS BCIProcessingMode,
true AS has_place FROM log"""


@query(_LOADED_SQL)
def loaded_log(spark, d):
    """Files of two headers below one folder, combined by name; the second kind has one more column."""
    log, folder = _events(spark, d), _folder(spark, "logs")
    _write_log(log.where("event_id % 3 > 0").select(*LOG_COLUMNS), f"{folder}/a")
    _write_log(log.where("event_id % 3 = 0").select("BCIProcessingMode", *reversed(LOG_COLUMNS)), f"{folder}/b")
    raw = logs.read_logs(spark, folder, "").withColumns({"Timestamp": sc.parse_timestamp("Timestamp").cast("timestamp_ntz"), "InputWindowOrder": sc.to_number("InputWindowOrder")})
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("Timestamp"))
    place = F.col("source_path").contains(folder.rsplit("/", 1)[-1]) & F.col("source_row").isNotNull()
    return raw.select("event_id", "SessionID", at.alias("at"), "Event", "InputWindow", "InputWindowOrder", "TrialResult", "BCIProcessingMode", place.alias("has_place"))


_META_SQL = """, meta AS (SELECT SessionID, max(Timestamp) AS MetaTimestamp, count(*) AS rows FROM named GROUP BY 1)"""


@query(with_parts("log") + """, named AS (SELECT *, CASE WHEN Participant % 17 > 0 THEN concat(GameTitle, '-', Participant, '-', Condition) END AS SessionID FROM log)"""
       + _META_SQL + """ SELECT event_id, n.SessionID, epoch_us(Timestamp) AS at, epoch_us(MetaTimestamp) AS meta_at, rows AS MetaFramecount
FROM named n LEFT JOIN meta m ON n.SessionID IS NOT DISTINCT FROM m.SessionID""")
def meta_joined(spark, d):
    """Metadata of each session: clashing names get a prefix, absent ones are passed over, a missing session matches a missing one."""
    log = _events(spark, d).withColumn("SessionID", F.when(F.col("Participant") % 17 > 0, F.col("SessionID"))).select("event_id", "SessionID", "Timestamp")
    meta = stored(log.groupBy("SessionID").agg(F.max("Timestamp").alias("Timestamp"), F.count("*").alias("Framecount"), F.lit("x").alias("Email")))
    both = logs.attach_meta(log, logs.preprocess_meta(meta))
    micros = {n: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c)) for n, c in (("at", "Timestamp"), ("meta_at", "MetaTimestamp"))}
    return both.select("event_id", "SessionID", *[c.alias(n) for n, c in micros.items()], "MetaFramecount")


@query(with_parts("log") + """SELECT event_id::INTEGER AS event_id, concat(GameTitle, '-', Participant, '-', Condition) AS SessionID, Event, 'kept' AS MetaEmail FROM log""")
def session_from_paths(spark, d):
    """Three explicit paths with inferred types: events, samples and metadata."""
    log, folder = _events(spark, d), _folder(spark, "session")
    sample = F.col("Event") == "MotorImagery"
    event = _write_log(log.where(~sample).select("SessionID", "Timestamp", "event_id", "Event"), f"{folder}/event")
    samples = _plain_csv(log.where(sample).select("event_id", "Event", "SessionID"), f"{folder}/sample")
    meta = _plain_csv(log.select("SessionID").distinct().withColumns({"Email": F.lit("kept"), "Timestamp": F.lit("t"), "Framecount": F.lit(1)}), f"{folder}/meta")
    return logs.read_session(spark, meta, event, samples).select("event_id", "SessionID", "Event", "MetaEmail")


def _plain_csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, sep=";", header=True, nullValue="NULL", quote='"', escape='"')
    return path


@query("""SELECT c_custkey::INTEGER AS Participant, c_mktsegment AS Comment, round(c_acctbal, 2) AS score FROM customer""")
def rating_export(spark, d):
    """A questionnaire as a comma-separated export, types inferred."""
    path = f"{_folder(spark, 'ratings')}/answers.csv"
    table(spark, d, "customer").selectExpr("c_custkey as Participant", "c_mktsegment as Comment", "round(c_acctbal, 2) as score").write.csv(path, header=True)
    return tables.read_ratings(spark, path)


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, """ + rnd("sum(o_totalprice)", "total", 2) + """ FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2""")
def snapshot_round_trip(spark, d):
    """Written with one folder a priority; the filter reads two of them."""
    path = _folder(spark, "snapshot")
    tables.write_snapshot(table(spark, d, "orders"), path, ["o_orderpriority"])
    back = tables.read_snapshot(spark, path).where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    out = back.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return out.withColumn("total", F.round("total", 2))


LEVELS = [("1-URGENT", 1, "now"), ("2-HIGH", 2, "now"), ("3-MEDIUM", 3, "later"), ("4-NOT SPECIFIED", 4, "later")]


@query("""SELECT level, due, count(*) AS n FROM orders LEFT JOIN (VALUES ('1-URGENT', 1, 'now'), ('2-HIGH', 2, 'now'), ('3-MEDIUM', 3, 'later'),
('4-NOT SPECIFIED', 4, 'later')) v(o_orderpriority, level, due) USING (o_orderpriority) GROUP BY 1, 2""")
def literal_lookup(spark, d):
    levels = tables.literal_table(spark, LEVELS, "o_orderpriority string, level int, due string")
    joined = table(spark, d, "orders").join(F.broadcast(levels), "o_orderpriority", "left")  # four fixed rows
    return joined.groupBy("level", "due").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice AS MetaPrice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def preview_of_renamed(spark, d):
    """The first ten rows of a sorted table whose columns were renamed where they exist."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    named = columns.rename_if_present(rows, {"o_totalprice": "MetaPrice"})
    named = columns.rename_if_present(named, {"day": "MetaDay", "o_absent": "MetaAbsent"})  # not all are there: none is renamed
    return columns.preview(named.orderBy(F.desc("MetaPrice"), "o_orderkey"))


# --- sequence -----------------------------------------------------------------------------

@query(with_parts("log") + f"""SELECT event_id, coalesce(last_value(InputWindowOrder IGNORE NULLS) OVER
(PARTITION BY {K} ORDER BY Timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(InputWindowOrder IGNORE NULLS) OVER
(PARTITION BY {K} ORDER BY Timestamp, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS InputWindowOrder FROM log""")
def filled_both_ways(spark, d):
    """Notes that differ within a group: down first, then up."""
    return sequence.fill_down_up(study.study_log(spark, d), ["InputWindowOrder"], ORDER, KEYS).select("event_id", "InputWindowOrder")


# --- the gated study ----------------------------------------------------------------------

@query(with_gate("st") + f"SELECT {K}, {_sql_cols(COUNTS, TIMES, RATED, PEOPLE)}, {rnd('rate_trial')}, {rnd('rate_feedback')} FROM st WHERE {KEPT}")
def gated_session_table(spark, d):
    """The whole chain: gaps, first game run, periods, metrics, discarded labels, rates, ratings, flags."""
    return study.gated_session_table(spark, d).select(*KEYS, *COUNTS, *TIMES, *RATED, *PEOPLE, "rate_trial", "rate_feedback")


def _gated_sql(body: str) -> str:
    return with_gate("st", kept=True) + body


@query(_gated_sql(f"""SELECT GameTitle, Condition, {rnd('CASE WHEN count(rate_trial) = count(*) THEN avg(rate_trial) END', 'avg_rate')},
sum(accInput)::BIGINT AS sum_acc FROM st GROUP BY 1, 2"""))
def gated_conditions(spark, d):
    return summaries.condition_summary(study.gated_session_table(spark, d))


@query(with_gate("cohorts", kept=True) + f"SELECT {K}, mi_group, group_feedback, group_feedback_range, group_trial FROM cohorts")
def gated_cohorts(spark, d):
    labelled = cohorts.cohort_labels(study.gated_session_table(spark, d), pieces=False)  # four sessions each at most
    return labelled.select(*KEYS, "mi_group", "group_feedback", "group_feedback_range", "group_trial")


@query(with_gate("cohorts", kept=True) + f"""SELECT {K}, {rnd('rate_feedback')}, row_number() OVER (PARTITION BY GameTitle, Participant
ORDER BY rate_feedback NULLS LAST, Condition) AS position FROM cohorts WHERE group_trial = 'HIGH'""")
def gated_cohort_high_trial(spark, d):
    labelled = cohorts.cohort_labels(study.gated_session_table(spark, d), pieces=False)
    return cohorts.cohort_extract(labelled, "group_trial", "HIGH", pieces=False).select(*KEYS, "rate_feedback", "position")


@query(_gated_sql(f"SELECT Condition, {_ols_sql('PercNormalized', 'rate_feedback')} FROM st GROUP BY 1"), digits=6)
def gated_ols(spark, d):
    return linear.ols_by(study.gated_session_table(spark, d), "PercNormalized", "rate_feedback", ["Condition"])


# --- further call sites -------------------------------------------------------------------

@query(_BLOCKS_SQL.replace("FrustNormalized", "PercNormalized") + f"""SELECT {rnd('12 * sum(power(rj - n * 5 / 2, 2)) / (any_value(n) * 20 - any_value(ties) / 3)', 'statistic')},
3::BIGINT AS df, any_value(n)::BIGINT AS blocks FROM rs, tot""", digits=6)
def friedman_control(spark, d):
    cells = (study.session_table(spark, d).where(F.col("PercNormalized").isNotNull())
             .groupBy("Participant", "Condition").agg(F.avg("PercNormalized").alias("y")))
    return ranks.friedman_stats(stored(cells), "y", "Condition", "Participant", drop_incomplete=True)


@query(with_parts("st") + f""", s AS (SELECT regr_count(rate_trial, ConditionOrder) AS n, regr_sxx(rate_trial, ConditionOrder) AS sxx,
regr_syy(rate_trial, ConditionOrder) AS syy, regr_sxy(rate_trial, ConditionOrder) AS sxy, regr_avgx(rate_trial, ConditionOrder) AS mx,
regr_avgy(rate_trial, ConditionOrder) AS my FROM st),
f AS (SELECT *, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM s),
e AS (SELECT *, sigma / sqrt(sxx) AS se_slope, sigma * sqrt(1 / n + mx * mx / sxx) AS se_intercept FROM f)
SELECT n::BIGINT AS n, {rnd('slope')}, {rnd('intercept')}, (n - 2)::BIGINT AS df_residual, {rnd('sxy * sxy / (sxx * syy)', 'r2')},
{rnd('sigma')}, {rnd('se_slope')}, {rnd('se_intercept')}, {rnd('slope / se_slope', 't_slope')},
{rnd('intercept / se_intercept', 't_intercept')}, {rnd(t_tail_sql('slope / se_slope', 'n - 2'), 'p_slope')},
{rnd(t_tail_sql('intercept / se_intercept', 'n - 2'), 'p_intercept')} FROM e""", digits=6)
def ols_order_summary(spark, d):
    return linear.ols_summary(study.session_table(spark, d), "rate_trial", "ConditionOrder")


STUDY_COLUMNS = ["BCI input", "Participants", "Agency (alpha)", "Agency (beta)"]


@query(_COEF_SQL + f"""SELECT game, concat('{" & ".join(STUDY_COLUMNS)}', ' \\\\ ', string_agg(concat_ws(' & ', CASE WHEN study = 'Kiwi 100A' THEN 'BCI (EEG, MRP)' ELSE 'Eye-blinks' END,
CASE WHEN study = 'Kiwi 50A' THEN 'Stroke patients' ELSE 'Non-patients' END, printf('%.3f', round(perc_intercept, 3) + 0.0), printf('%.3f', round(perc_slope, 3) + 0.0)),
' \\\\ ' ORDER BY study)) AS text FROM (SELECT *, split_part(study, ' ', 1) AS game FROM coef) GROUP BY 1""")
def study_text(spark, d):
    """The study table as delimited text, one for each game."""
    coefficients = _coefficients(spark, d)
    labels = F.when(F.col("study") == "Kiwi 100A", "realbci").when(F.col("study") == "Kiwi 50A", "strokesur").otherwise(F.col("study"))
    named = coefficients.withColumns({"order": F.col("study"), "game": F.substring_index("study", " ", 1), "study": labels})
    shown = named.select("game", "order", *[c.alias(n) for n, c in report.study_labels().items()],
                         *[F.format_string("%.3f", F.round(c, 3) + 0.0).alias(n) for c, n in (("perc_intercept", "Agency (alpha)"), ("perc_slope", "Agency (beta)"))])
    return report.delimited_text(shown, ["game"], STUDY_COLUMNS, ["order"])
