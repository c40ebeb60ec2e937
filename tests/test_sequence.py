import datetime as dt
import re

import pytest
from conftest import plan_of, same_rows
from pyspark.sql import functions as F

from trialweave.operators import scans, sequence, sessions, summaries
from trialweave.operators.sequence import SESSION_KEYS
from trialweave.plans import study
from trialweave.plans.study import ORDER

KEYS = list(SESSION_KEYS)
BASE = dt.datetime(2021, 1, 1, 12, 0, 0)
LOG = ("GameTitle string, Participant int, Condition string, Timestamp timestamp_ntz, event_id int, Event string, "
       "InputWindow string, InputWindowOrder double, TrialResult string, BCIProcessingMode string")
WORKED = [  # second, event, window, order, gap, kept, closed id, closed fill, period, order filled
    (0, "MotorImagery", None, None, 0, False, None, None, None, None),
    (2, "GameRunning", None, None, 2, True, -1, -1, "PreGame", None),
    (5, "InputWindowChange", "Closed", 0.0, 3, True, 1, 1, "RestPeriod", -1.0),
    (6, "MotorImagery", None, None, 1, True, 0, 1, "RestPeriod", -1.0),
    (9, "InputWindowChange", "Open", 1.0, 3, True, -1, -1, "OpenPeriod", 1.0),
    (10, "MotorImagery", None, None, 1, True, 0, -1, "OpenPeriod", 1.0),
    (11, "GameDecision", None, None, 1, True, 0, -1, "OpenPeriod", 1.0),
    (14, "InputWindowChange", "Closed", 1.0, 3, True, 2, 2, "PostGame", -1.0),
    (15, "GameStopped", None, None, 1, True, -1, -1, "PostGame", -1.0),
    (20, "GameRunning", None, None, 5, False, None, None, None, None)]


def worked_log(spark):
    rows = [("Kiwi", 1, "50A", BASE + dt.timedelta(seconds=s), i, e, w, o,
             "AccInput" if e == "GameDecision" else None, "online") for i, (s, e, w, o, *_) in enumerate(WORKED)]
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def skewed(spark, small_dir):
    """The driver's log with a third of all rows in one session, some of them with unknown cells."""
    log = study.study_log(spark, small_dir)
    hot = F.col("event_id") % 3 == 0
    for k, v in (("GameTitle", "Kiwi"), ("Participant", 7), ("Condition", "50A")):
        log = log.withColumn(k, F.when(hot, F.lit(v)).otherwise(F.col(k)))
    log = log.withColumn("InputWindow", F.when(F.col("event_id") == 600, F.lit(None)).otherwise(F.col("InputWindow")))
    return log.withColumn("Participant", F.when(F.col("event_id") % 7 != 1, F.col("Participant")))


def odd(log):
    """Unknown events, window states that are none of the log's, and sessions of few kinds of rows."""
    draw = F.pmod(F.xxhash64("event_id"), F.lit(40))
    log = log.withColumn("Event", F.when(draw == 0, F.lit(None)).when(draw == 1, "GameStopped").otherwise(F.col("Event")))
    log = log.withColumn("InputWindow", F.when(draw == 2, "Ajar").when(draw == 3, "Open").when(draw == 4, F.lit(None)).otherwise(F.col("InputWindow")))
    return log.where("Participant is null or Participant % 5 > 0 or Event is null or InputWindow is null or InputWindow <> 'Closed'")


@pytest.mark.parametrize("pieces", [False, True])
def test_worked_session(spark, pieces):
    log = sequence.gap_seconds(worked_log(spark), ORDER)
    assert [r.time_delta for r in log.orderBy("event_id").collect()] == [float(r[4]) for r in WORKED]
    gated = sequence.gate_run(log, ORDER, pieces=pieces)
    labelled = sequence.label_periods(gated, ORDER, pieces=pieces)
    got = [(r.InputWindowClosedID, r.InputWindowClosedFill, r.Period, r.InputWindowOrderFilled)
           for r in labelled.orderBy("event_id").collect()]
    assert got == [r[6:] for r in WORKED if r[5]]
    row = sessions.session_rates(sessions.session_summary(labelled)).first()
    expected = dict(totalTrials=1, accInput=1, time_total=9.0, mi_recog=2, mi_recog_trial=1, mi_recog_window=1,
                    time_window=5.0, mi_recog_rest=1, time_rest=4.0, rate_trial=1.0, rate_feedback=1.0,
                    rate_fabInput=0.0, BCIProcessingMode="online", excess_rate=0.75, fp_rate_minute=15.0)
    assert {k: row[k] for k in expected} == expected


@pytest.mark.parametrize("name", ["session_gap", "gate", "label", "label_run", "label_second_run", "label_odd", "occurrence", "fill", "fill_both", "number", "number_keys"])
def test_scan_of_pieces_equals_window(skewed, name):
    run = {
        "session_gap": lambda m: sequence.gap_seconds(skewed, ORDER, partition_by=KEYS, pieces=m),
        "gate": lambda m: sequence.gate_run(skewed, ORDER, pieces=m),
        "label_run": lambda m: (sequence.label_run(skewed, ORDER) if m else
                                sequence.label_periods(sequence.gate_run(skewed, ORDER, pieces=False), ORDER, pieces=False)),
        "label_second_run": lambda m: (sequence.label_run(skewed, ORDER, run=2) if m else sequence.label_periods(
            sequence.between_markers(skewed, F.col("Event") == "GameRunning", ORDER, run=2, pieces=False), ORDER, pieces=False)),
        "label": lambda m: sequence.label_periods(skewed, ORDER, pieces=m),
        "label_odd": lambda m: sequence.label_periods(odd(skewed), ORDER, pieces=m),
        "occurrence": lambda m: sequence.occurrence_id(skewed, ORDER, pieces=m),
        "fill": lambda m: sequence.fill_down(skewed, {"w": "InputWindow"}, ORDER, KEYS, pieces=m),
        "fill_both": lambda m: sequence.fill_down_up(skewed, ["InputWindow"], ORDER, KEYS, pieces=m),
        "number": lambda m: sequence.number_rows(skewed, ["GameTitle", *ORDER], bucket=[F.col("GameTitle")], pieces=m),
        "number_keys": lambda m: sequence.number_rows(skewed, list(ORDER), keys=["GameTitle"],
                                                      bucket=[F.date_trunc("DAY", "Timestamp")], pieces=m),
    }[name]
    same_rows(run(False), run(True))


def test_pieces_of_numbers_and_texts_follow_the_order(spark):
    values = [float("-inf"), -1e300, -2.5, -2.0, -1e-300, 0.0, 1e-300, 0.5, 0.51, 3.0, 1e300, float("inf"), float("nan"), None]
    rows = [(i, v, None if v is None else f"{i:02d}x", i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v double, s string, k int")
    for order in (["v", "i"], ["s", "i"], ["k"]):
        at = [r[0] for r in df.orderBy("i").select(scans.grid_of(df, order)).collect()]
        shown = [(g["missing"], g["at"] is not None, g["at"] or 0 if order[0] != "s" else g["at"] or "", g["next"] or 0) for g in at]
        assert shown == sorted(shown)


def test_any_kind_of_key_is_cut_into_pieces(spark):
    df = spark.range(1000).select(
        "id", F.date_add(F.lit("2021-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.format_string("user_%04d", "id").alias("name"),
        (1000 + F.col("id") / 100).alias("price"), (0.5 + F.col("id") / 2000).alias("rate"), (F.col("id") + 70_000).cast("int").alias("number"))
    for column, least in {"day": 1000, "name": 1000, "price": 500, "rate": 1000, "number": 60}.items():
        cells = [r[0] for r in df.orderBy("id").select(scans.grid_of(df, [column, "id"])["at"]).collect()]
        assert len(set(cells)) >= least and cells == sorted(cells), column
        run = sequence.number_rows(df.withColumn("k", F.lit(1)), [column, "id"], "no", keys=["k"])
        assert run.where("no <> id + 1").count() == 0


def test_rows_are_shuffled_by_piece_once(skewed):
    jobs = skewed.sparkSession.sparkContext.statusTracker().getJobIdsForGroup(None)
    for out in (sequence.label_periods(skewed, ORDER), sequence.label_run(skewed, ORDER), sequence.fill_down(skewed, {"w": "InputWindow"}, ORDER, KEYS)):
        plan = plan_of(out)
        by_piece = [line for line in plan.splitlines() if "Exchange hashpartitioning(_piece#" in line]
        assert len(by_piece) <= 3 and "SinglePartition" not in plan  # the rows twice, and their pieces
    assert len(skewed.sparkSession.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(jobs)  # no job while a plan is built


def test_gap_equals_one_window(skewed):
    gaps = sequence.gap_seconds(skewed, ORDER).select("event_id", "time_delta")
    plain = skewed.selectExpr("event_id", "coalesce(timestampdiff(MICROSECOND, lag(Timestamp) over (order by Timestamp, "
                              "event_id), Timestamp) / 1e6, 0D) as time_delta")
    same_rows(gaps, plain)


def test_untimed_rows_get_no_gap(spark):
    log = worked_log(spark).withColumn("Timestamp", F.when(F.col("event_id") != 3, F.col("Timestamp")))
    gaps = {r.event_id: r.time_delta for r in sequence.gap_seconds(log, ORDER).collect()}
    assert gaps[3] == 0.0 and gaps[4] == 4.0 and len(gaps) == 10


def test_unknown_marker_ends_the_run(spark):
    rows = [(1, 1, "go"), (1, 2, "x"), (1, 3, None), (1, 4, "x"), (1, 5, "go")]
    df = spark.createDataFrame(rows, "k int, t int, e string")
    kept = sequence.between_markers(df, F.col("e") == "go", ["t"], keys=["k"])
    assert sorted(r.t for r in kept.collect()) == [1, 2]


def test_fill_is_idempotent(skewed):
    once = sequence.fill_down(skewed, {"InputWindow": "InputWindow"}, ORDER, KEYS, pieces=False)
    same_rows(once, sequence.fill_down(once, {"InputWindow": "InputWindow"}, ORDER, KEYS, pieces=False))


def test_running_frames_are_row_by_row(spark):
    df = spark.createDataFrame([("k", 1, i, 1) for i in range(4)], "k string, t int, i int, v int")
    out = scans.GroupScan(["k"], ["t", "i"]).running_sum(df, s=F.col("v"))
    assert sorted(r.s for r in out.collect()) == [1, 2, 3, 4]


def test_numbering_is_consecutive(skewed):
    out = sequence.number_rows(skewed, ["GameTitle", *ORDER], "no", bucket=[F.col("GameTitle")])
    assert sorted(r.no for r in out.select("no").collect()) == list(range(1, skewed.count() + 1))


def test_numbering_by_a_tree_of_counts(skewed):
    day, hour = F.date_trunc("DAY", "Timestamp"), F.date_trunc("HOUR", "Timestamp")
    rows = skewed.withColumn("Timestamp", F.when(F.col("event_id") % 50 > 0, F.col("Timestamp")))  # unknown times come last
    out = sequence.number_rows(rows, list(ORDER), "no", bucket=[day, hour])
    plain = rows.withColumn("no", F.expr("row_number() over (order by Timestamp asc nulls last, event_id)").cast("bigint"))
    same_rows(out, plain)
    single = [line for line in plan_of(out).splitlines() if "SinglePartition" in line]
    assert len(single) == 1  # the table of days


def test_plans(spark, small_dir):
    log = study.study_log(spark, small_dir)
    gaps = plan_of(sequence.gap_seconds(log, ORDER))
    single = [line for line in gaps.splitlines() if "SinglePartition" in line]
    assert len(single) == 1  # the table of days only
    after = gaps[gaps.index("SinglePartition"):]
    assert "HashAggregate" in after and "_day" in after  # what goes through it is already one row per day
    for labels in (sequence.label_periods(log, ORDER), sequence.gate_run(log, ORDER)):
        plan = plan_of(labels)
        keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert keyed and "SinglePartition" not in plan  # rows by piece, and one row per piece by its keys
        assert all(re.search(r"hashpartitioning\((_piece|_group|_w\d)#", line) for line in keyed), keyed
        assert sum("(_group#" in line for line in keyed) <= 1


def test_fused_summary_equals_joined_aggregates(spark, small_dir):
    log = scans.stored(study.labelled_log(spark, small_dir))
    joined = sessions.trial_counts(log)
    for part in (sessions.session_time, sessions.mi_total, sessions.window_hits, sessions.rest_metrics):
        joined = summaries.add_metrics(joined, part(log))
    fused = sessions.session_summary(log).select(*joined.columns)
    times = [c for c in joined.columns if c.startswith("time_")]
    same_rows(*[df.withColumns({c: F.round(c, 6) for c in times}) for df in (fused, joined)])
    with_bound = sessions.rest_metrics(log, below_global_max=True)
    same_rows(*[df.withColumns({c: F.round(c, 6) for c in ("time_rest", "time_rest_min")})
                for df in (with_bound, sessions.rest_metrics(log))])


def test_missing_result_makes_counts_unknown(spark):
    log = worked_log(spark).withColumn("TrialResult", F.lit(None).cast("string"))
    labelled = sequence.label_periods(sequence.gap_seconds(log, ORDER), ORDER)
    row = sessions.session_rates(sessions.session_summary(labelled)).first()
    assert row.totalTrials is None and row.otherInput == 1 and row.rate_trial is None
    assert sessions.trial_counts(labelled).first().totalTrials is None


def test_session_without_periods_has_unknown_metrics(spark):
    log = worked_log(spark).where("Event = 'GameDecision'")
    labelled = sequence.label_periods(sequence.gap_seconds(log, ORDER), ORDER)
    row = sessions.session_summary(labelled).first()
    assert (row.mi_recog, row.mi_recog_window, row.mi_recog_rest, row.time_total) == (None,) * 4
    assert sessions.session_summary(labelled.where("Event = 'MotorImagery'")).count() == 0


def test_changing_constant_raises(spark):
    log = worked_log(spark).withColumn("Event", F.lit("GameDecision")).withColumn(
        "BCIProcessingMode", F.col("event_id").cast("string"))
    labelled = sequence.label_periods(sequence.gap_seconds(log, ORDER), ORDER)
    with pytest.raises(Exception, match="not constant"):
        sessions.session_summary(labelled).collect()
    assert sessions.session_summary(labelled, on_conflict="null").first().BCIProcessingMode is None
