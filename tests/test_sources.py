import pytest
from conftest import plan_of, same_rows
from pyspark.sql import functions as F

from trialweave.operators import sequence, sessions
from trialweave.plans import study
from trialweave.sources import logs, tables


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture()
def root(tmp_path):
    data = tmp_path / "data"
    a, b, odd = data / "Kiwi" / "1" / "50A", data / "Kiwi" / "x" / "50B", data / "Kiwi" / "2"
    put(a / "r_Game.csv", "SessionID;Timestamp;Event;InputWindow;InputWindowOrder;TrialResult;BCIProcessingMode\n"
                          "s1;2021-01-01 10:00:00.0001;GameRunning;;NULL;NULL;online\n"
                          "s1;2021-01-01 10:00:02.5;InputWindowChange;Open;0;NULL;online\n"
                          's1;2021-01-01 10:00:03;GameDecision;"";NULL;AccInput;online\n')
    put(b / "r_Game.csv", "Event;Timestamp;SessionID;Extra\n"
                          'GameRunning;bad;s2;"say ""hi"""\n'
                          "GameStopped;2021-01-01 11:00:00;NULL;NULL\n")
    put(a / "r_Sample.csv", "SessionID;Timestamp;Value\ns1;2021-01-01 10:00:01;7\n")
    put(a / "run one_1_2_Meta.csv", "SessionID;Timestamp;Email;Framecount\ns1;2021;a@example.org;3\n")
    put(b / "r_Meta.csv", "SessionID;Timestamp;Email;Framecount\ns2;2022;b@example.org;4\n")
    put(odd / "r_Meta.csv", "SessionID;Timestamp;Email;Framecount\nNULL;2023;c@example.org;5\n")
    return str(data)


def test_columns_are_matched_by_name(spark, root):
    rows = {(r.SessionID, r.Event): r for r in logs.read_logs(spark, root, "Game").collect()}
    assert len(rows) == 5
    assert rows["s2", "GameRunning"].Timestamp == "bad" and rows["s2", "GameRunning"].Extra == 'say "hi"'
    assert rows["s1", "GameRunning"].Extra is None and rows["s1", "GameRunning"].BCIProcessingMode == "online"
    assert rows[None, "GameStopped"].Extra is None
    assert rows["s1", "GameRunning"].source_path.endswith("/Kiwi/1/50A/r_Game.csv")


def test_empty_cells(spark, root):
    def cells(empty):
        df = logs.read_logs(spark, root, "Game", empty=empty).where("SessionID = 's1'")
        return {r.Event: (r.InputWindow, r.InputWindowOrder) for r in df.collect()}

    text = cells("string")
    assert text["GameRunning"] == ("", None) and text["GameDecision"] == ("", None)
    assert cells("null")["GameRunning"] == (None, None)
    with pytest.raises(ValueError):
        logs.read_logs(spark, root, "Game", empty="zero")


def test_same_header_promise_is_checked(spark, root):
    assert logs.read_logs(spark, root, "Meta", same_header=True).count() == 3
    with pytest.raises(Exception, match="(?i)header"):
        logs.read_logs(spark, root, "Game", same_header=True).collect()
    with pytest.raises(FileNotFoundError):
        logs.read_logs(spark, root, "None")


def test_path_columns(spark, root):
    meta = logs.with_path_columns(logs.read_logs(spark, root, "Meta"), root)
    rows = {r.Email: r for r in meta.collect()}
    a, odd = rows["a@example.org"], rows["c@example.org"]
    assert (a.i0, a.i1, a.i2, a.i3, a.i4) == ("data", "Kiwi", "1", "50A", "run one_1_2_Meta.csv")
    assert (a.i5, a.i6, a.i7, a.i8, a.i9) == ("data/Kiwi/1/50A/run one", "1", "2", "Meta.csv", None)
    assert (odd.i3, odd.i4) == ("r_Meta.csv", None)
    assert "source_path" not in meta.columns


def test_directory_to_sessions(spark, root, tmp_path):
    raw = logs.load_directory(spark, root, event="Game")
    assert raw.count() == 6
    log = logs.typed_log(raw)
    tables.write_snapshot(log, str(tmp_path / "snap"))
    log = tables.read_snapshot(spark, str(tmp_path / "snap"))
    stopped = log.where("Event = 'GameStopped'").first()
    assert stopped.SessionID is None and stopped.MetaEmail == "c@example.org"  # missing key matches missing key
    s2 = log.where("SessionID = 's2'").first()
    assert s2.Timestamp is None and s2.Participant is None and s2.Condition == "50B"
    gaps = sequence.gap_seconds(log, ["Timestamp", *logs.ROW_ORDER])
    assert [r.time_delta for r in gaps.where("SessionID = 's1'").orderBy("Timestamp").collect()] == [
        0.0, pytest.approx(0.9999), 1.5, 0.5]
    labelled = sequence.label_periods(gaps, ["Timestamp", *logs.ROW_ORDER])
    row = sessions.session_summary(labelled).first()
    assert (row.GameTitle, row.Participant, row.accInput, row.time_window) == ("Kiwi", 1.0, 1, 2.0)


def test_meta_rules(spark, tmp_path):
    log = spark.createDataFrame([("s", 1), (None, 2)], "SessionID string, v int")
    meta = spark.createDataFrame([("s", "t", "e", "f"), (None, "t", "e", "f")],
                                 "SessionID string, Timestamp string, Email string, Framecount string")
    named = logs.preprocess_meta(meta)
    assert named.columns == ["SessionID", "MetaTimestamp", "MetaEmail", "MetaFramecount"]
    assert logs.preprocess_meta(meta.drop("Email")).columns == ["SessionID", "Timestamp", "Framecount"]
    assert logs.attach_meta(log, named).where("MetaEmail is null").count() == 0
    with pytest.raises(ValueError, match="repeated"):
        logs.attach_meta(log, named.union(named))
    tables.write_snapshot(named, str(tmp_path / "meta"))  # small on disk, so Spark itself chooses to broadcast it
    small = tables.read_snapshot(spark, str(tmp_path / "meta"))
    assert "BroadcastHashJoin" in logs.attach_meta(log, small)._jdf.queryExecution().executedPlan().toString()


def test_one_session_from_paths(spark, root):
    a = f"{root}/Kiwi/1/50A"
    df = logs.read_session(spark, f"{a}/run one_1_2_Meta.csv", f"{a}/r_Game.csv", f"{a}/r_Sample.csv")
    assert df.count() == 4 and dict(df.dtypes)["MetaFramecount"] == "int" and dict(df.dtypes)["InputWindowOrder"] == "int"


def test_snapshots_and_small_tables(spark, tmp_path):
    df = spark.createDataFrame([("Kiwi", "50A", 1), ("Kiwi", "50B", 2)], "GameTitle string, Condition string, n int")
    path = str(tmp_path / "t")
    tables.write_snapshot(df, path, ["GameTitle", "Condition"])
    back = tables.read_snapshot(spark, path)
    same_rows(df, back)
    plan = back.where("Condition = '50A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Condition" in plan
    put(tmp_path / "r.csv", "Participant,PercNormalized\n1,0.5\n")
    assert tables.read_ratings(spark, str(tmp_path / "r.csv")).first() == (1, 0.5)
    assert tables.read_ratings(spark, path).count() == 2
    assert tables.literal_table(spark, [("a", 1.0)], "k string, v double").count() == 1
    grid = [r.x for r in tables.unit_grid(spark).orderBy("x").collect()]
    assert len(grid) == 100 and grid[0] == 0.01 and grid[-1] == 1.0


def test_source_path(spark, root):
    df = logs.with_source_path(spark.read.csv(f"{root}/Kiwi/1/50A/r_Game.csv", sep=";", header=True))
    assert df.select(F.col("source_path")).distinct().count() == 1


def test_bucketed_table_needs_no_exchange(spark, small_dir, tmp_path):
    """Labels and summary of sessions, and their join, stay in the buckets."""
    log = study.study_log(spark, small_dir)
    keys = list(sequence.SESSION_KEYS)
    kept = tables.write_bucketed(sequence.gap_seconds(log, study.ORDER), "bucketed_log", str(tmp_path / "b"), keys, ["Timestamp", "event_id"], 8)
    try:
        labelled = sequence.label_periods(kept, study.ORDER, pieces=False)
        counts = kept.groupBy(*keys).agg(F.count("*").alias("rows"))
        both = labelled.join(counts, keys)
        for plan in (plan_of(labelled), plan_of(counts), plan_of(both.hint("merge"))):
            assert "Exchange hashpartitioning" not in plan and "bucketed_log" in plan
        same_rows(labelled, sequence.label_periods(sequence.gap_seconds(log, study.ORDER), study.ORDER))
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_log")
