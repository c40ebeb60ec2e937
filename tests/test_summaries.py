import random
import struct

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from trialweave.operators import cohorts, quantiles, ratings, report, sequence, sessions, summaries
from trialweave.plans import study

ST = ("GameTitle string, Participant int, Condition string, ConditionOrder int, totalTrials int, mi_recog int, "
      "mi_recog_window int, rate_feedback double, rate_trial double, gender string")


def st(spark, rows):
    return spark.createDataFrame(rows, ST)


def test_roll_ups_and_missing(spark):
    df = st(spark, [("Kiwi", 1, "50A", 1, 4, 4, 2, 0.5, 0.5, "M"), ("Kiwi", 1, "50B", 2, 4, 4, 2, 0.5, None, "M")])
    df = df.withColumns({c: F.lit(2) for c in ("accInput", "mi_recog_rest", "time_total", "fp_rate_minute")})
    df = df.withColumn("mi_experience", F.lit(True))
    c = {r.Condition: r for r in summaries.condition_summary(df).collect()}
    assert c["50A"].avg_rate == 0.5 and c["50B"].avg_rate is None and c["50B"].sum_acc == 2
    p = summaries.participant_summary(df).first()
    assert p.mean_rate is None and p.min_rate is None and p.mean_feedback == 0.5 and p.mi_recog_total == 8
    assert summaries.order_summary(df).count() == 2


@pytest.mark.parametrize("pieces", [False, True])
def test_exact_quantiles(spark, pieces):
    rng = random.Random(5)
    data = {k: [round(rng.random(), 2) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 50), ("d", 101))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    probs = {"q1": 0.25, "med": 0.5, "q9": 0.9}
    got = {r.k: r for r in summaries.exact_quantiles(df, ["k"], "v", probs, pieces=pieces).collect()}
    for k, vs in data.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p))
        assert (got[k].min_value, got[k].max_value) == (min(vs), max(vs))


def test_order_bits_equal_the_layout_of_a_double(spark):
    rng = random.Random(3)
    drawn = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    near = [s * np.nextafter(2.0**e, way) for e in (-1074, -1022, -300, -1, 0, 1, 52, 300, 1023) for way in (0.0, np.inf) for s in (1, -1)]
    values = [float(v) for v in [*drawn, *near, *[2.0**e for e in range(-1074, 1024, 3)], 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), 0.0, -0.0, 0.1, -0.1]]
    values = [v for v in values if v == v]
    got = {r.i: r.b for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", quantiles.order_bits(F.col("v")).alias("b")).collect()}
    for i, v in enumerate(values):
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert got[i] == (-bits if v < 0 else bits), v
    last = spark.createDataFrame([(float("nan"),)], "v double").select(quantiles.order_bits(F.col("v"))).first()[0]
    assert last > max(got.values())


def test_quantiles_of_a_hot_group_of_odd_values(spark):
    """A third of the rows in one group: negative, tiny, repeated, infinite; no window over a group, no job while planned."""
    rng = random.Random(9)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-200), -rng.random() * 1e300, 7.25, float("-inf"), 0.0, -0.0]) for _ in range(4000)]
    rows = [("hot", v) for v in values] + [(None, v) for v in values[:50]] + [(f"k{i % 900}", float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.k: r for r in summaries.exact_quantiles(df, ["k"], "v", probs).collect()}
    for key in ("hot", None, "k17"):
        own = np.sort([v for k, v in rows if k == key])
        for name, p in probs.items():
            at = p * (len(own) - 1)
            lo, hi = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert got[key][name] == pytest.approx(lo + (hi - lo) * (at - np.floor(at)) if lo != hi else lo), (key, name)


def test_quantiles_with_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "k string, v double")
    strict = {r.k: r.m for r in summaries.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    known = {r.k: r.m for r in summaries.exact_quantiles(df, ["k"], "v", {"m": 0.5}, na="skip").collect()}
    assert strict == {"a": None, "b": 2.0, "c": None} and known == {"a": 1.0, "b": 2.0, "c": None}


def test_spread_and_low(spark):
    rows = [("Kiwi", p, str(i), i, 1, 1, 1, None, v, "M") for p, vs in
            ((1, [0.8, 0.85, 0.9]), (2, [0.2, 0.4]), (3, [0.0, 0.0]), (4, [0.5])) for i, v in enumerate(vs)]
    df = st(spark, rows)
    assert sorted(r.Participant for r in summaries.rate_spread(df).collect()) == [1, 4]
    assert sorted(r.Participant for r in summaries.low_performers(df).collect()) == [2, 3]


def test_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, None]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    r = summaries.box_stats(df, "v", ["g"]).first()
    assert (r.n, r.q1, r.median_value, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (6, 2.25, 3.5, 4.75, 1.0, 5.0, 1)


def test_balance_and_orders(spark):
    df = st(spark, [("Kiwi", 1, "50A", 2, 1, 1, 1, 0.0, 0.0, "M"), ("Kiwi", 1, "50B", 1, 1, 1, 1, 0.0, 0.0, "M"),
                    ("Kiwi", 2, "50A", 2, 1, 1, 1, 0.0, 0.0, None), ("Kiwi", 2, "50B", None, 1, 1, 1, 0.0, 0.0, None)])
    levels = {"a": ("Condition", "50A"), "m": ("gender", "M")}
    assert tuple(summaries.balance_table(df, ["GameTitle"], levels).first()) == ("Kiwi", 2, None)
    assert summaries.balance_table(df, ["GameTitle"], levels, na="skip").first().m == 2
    orders = {r.o: r.n for r in summaries.sequence_frequency(
        df, ["GameTitle", "Participant"], "Condition", ["ConditionOrder"], "o").collect()}
    assert orders == {"50B50A": 1, "50A50B": 1}
    text = summaries.ordered_concat(df, ["Participant"], "gender", ["Condition"], "t", sep=",")
    assert {r.Participant: r.t for r in text.collect()} == {1: "M,M", 2: "NA,NA"}
    assert [tuple(r) for r in summaries.value_counts(df, ["Participant"], "gender").collect()] == [("M", 1)]


def test_stability_keeps_first_seen_order(spark):
    rows = [("K", 1, "1", "A"), ("K", 1, "2", "B"), ("K", 2, "1", "B"), ("K", 2, "2", "A"), ("K", 3, "1", "A"),
            ("K", 3, "2", "A"), ("K", 4, "1", None), ("K", 4, "2", "A")]
    df = spark.createDataFrame(rows, "GameTitle string, Participant int, Condition string, mi_group string")
    kinds = summaries.stability(df)
    got = {r.Participant: (r.stability_type, r.mi_stability) for r in kinds.collect()}
    assert got == {1: ("A,B", "unstable"), 2: ("B,A", "unstable"), 3: ("A", "stable"), 4: ("NA,A", "unstable")}
    lists = summaries.member_lists(kinds, ["GameTitle", "stability_type"], "Participant", "who")
    assert {(r.stability_type, r["count"], r.chunk, r.who) for r in lists.collect()} == {
        ("A,B", 1, 0, "1"), ("B,A", 1, 0, "2"), ("A", 1, 0, "3"), ("NA,A", 1, 0, "4")}


@pytest.mark.parametrize("pieces", [False, True])
def test_member_lists_in_pieces_lose_nobody(spark, pieces):
    df = spark.createDataFrame([("g", i % 11) for i in range(33)], "g string, m int")
    rows = summaries.member_lists(df, ["g"], "m", "who", size=4, pieces=pieces).orderBy("chunk").collect()
    assert [r.who for r in rows] == ["0,1,2,3", "4,5,6,7", "8,9,10"] and {r["count"] for r in rows} == {33}


def test_group_means_bias(spark):
    df = spark.createDataFrame([(True, 0.2, 1.0), (True, 0.6, 0.0)], "f boolean, a double, b double")
    r = summaries.group_means(df, ["f"], ["a", "b"], {"bias": ("a", "b")}, mean_products=True).first()
    assert (r.a, r.b, r.bias, r.bias_mean_product) == (0.4, 0.5, 0.2, 0.1)


def test_cohort_thresholds(spark):
    def labels(rows):
        df = cohorts.cohort_labels(st(spark, rows))
        return {(r.Participant, r.Condition): (r.mi_group, r.group_feedback, r.group_feedback_range, r.group_trial)
                for r in df.collect()}

    def row(p, c, trials, mi, window, feedback, trial):
        return ("Kiwi", p, c, 1, trials, mi, window, feedback, trial, "M")

    got = labels([
        row(1, "a", 4, 8, 2, 0.4, 0.4), row(1, "b", 4, 9, 1, 0.4, 0.9),      # bounds are not crossed; last rule wins
        row(2, "a", 4, 4, 1, 0.8, 0.75), row(2, "b", 4, 4, None, 0.8, 0.75),
        row(3, "a", 4, None, 3, 0.85, 0.76), row(3, "b", 4, 4, 3, 0.9, 0.8),
        row(4, "a", 4, 4, 3, 0.0, 0.1), row(4, "b", 4, 4, 3, 0.25, 0.9),
        row(5, "a", 4, 4, 3, 0.0, 0.1), row(5, "b", 4, 4, 3, 0.75, None),
        row(6, "a", 4, 4, 3, None, 0.5)])
    assert got[1, "a"] == ("ExactGroup", "MID", "LOW", "MID") and got[1, "b"][0] == "FPGroup"
    assert got[2, "a"] == ("LowGroup", "MID", "LOW", "MID") and got[2, "b"][0] is None
    assert got[3, "a"] == (None, "HIGH", "LOW", "HIGH")
    assert got[4, "a"][1:] == ("LOW", "LOW", "LOW")
    assert got[5, "a"][1:] == ("LOW", "HIGH", None)
    assert got[6, "a"][1:3] == (None, None)


def test_labels_joined_and_extract(spark):
    df = st(spark, [("K", None, "a", 1, 1, 1, 1, 0.9, 0.0, "M"), ("K", None, "b", 1, 1, 1, 1, 0.1, 0.0, "M")])
    labels = spark.createDataFrame([("K", None, "x")], "GameTitle string, Participant int, tag string")
    assert {r.tag for r in cohorts.add_labels(df, labels).collect()} == {"x"}
    out = cohorts.cohort_extract(df, "gender", "M").orderBy("position").collect()
    assert [(r.Condition, r.position) for r in out] == [("b", 1), ("a", 2)]
    with pytest.raises(ValueError, match="both sides"):
        summaries.add_metrics(df, df.select("GameTitle", "gender"), ["GameTitle"])


QUESTIONS = ("Participant int, Condition string, `Order` int, GameOrder string, PercNormalized double")


@pytest.mark.parametrize("pieces", [False, True])
def test_ratings_chain(spark, pieces):
    kiwi = spark.createDataFrame(
        [(99, 1, "50A", 1, "HandKiwi", 0.5), (99, 1, "50B", 2, None, 0.2), (99, 17, "50A", 1, "HandKiwi", 0.1),
         (99, None, "50A", 1, None, 0.1), (99, 2, None, 1, None, None)],
        "Participant int, KiwiParticipant int, Condition string, `Order` int, GameOrder string, PercNormalized double")
    hand = spark.createDataFrame([(1, "50A", 1, None, 0.4), (1, "50B", 2, None, None)], QUESTIONS)
    valid = spark.range(1, 17).select(F.col("id").cast("int").alias("Participant"))
    out = {(r.GameTitle, r.Participant, r.Condition): r
           for r in ratings.prepare_ratings(kiwi, hand, valid, pieces=pieces).collect()}
    assert set(out) == {("Kiwi", 1, "50A"), ("Kiwi", 1, "50B"), ("Kiwi", 2, None), ("HandStrength", 1, "50A"),
                        ("HandStrength", 1, "50B")}
    assert {k: r.OrderAll for k, r in out.items()} == {
        ("Kiwi", 1, "50A"): 5, ("Kiwi", 1, "50B"): 6, ("Kiwi", 2, None): None, ("HandStrength", 1, "50A"): 1,
        ("HandStrength", 1, "50B"): 2}
    first, second = out["Kiwi", 1, "50A"], out["Kiwi", 1, "50B"]
    assert (first.PercNormalized_prev_diff, first.PercNormalized_first_diff) == (0.5, 0.0)
    assert second.PercNormalized_prev_diff == pytest.approx(-0.3) and second.PercNormalized_rel == 0.0
    assert first.PercNormalized_rel == pytest.approx(0.3)
    assert out["Kiwi", 2, None].PercNormalized_rel is None


def test_discarded_conditions(spark):
    df = spark.createDataFrame([("50A",), ("50A_WRONG",), ("50A-2",), (None,)], "Condition string")
    assert [r[0] for r in ratings.drop_discarded(df).collect()] == ["50A", None]


def test_reports(spark, small_dir):
    table = study.session_table(spark, small_dir)
    shown = report.design_vs_actual(table).collect()
    assert all(r.within_limits is None or r.within_limits == (r.lower <= r.rate_feedback <= r.upper) for r in shown)
    assert "BroadcastHashJoin" in report.design_vs_actual(table)._jdf.queryExecution().executedPlan().toString()
    series = report.ordered_series(table, ["mi_recog"], F.floor(F.col("Participant") / 4), pieces=True).collect()
    for game in ("Kiwi", "HandStrength"):
        rows = sorted((r for r in series if r.GameTitle == game), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        keys = [(r.Participant, r.ConditionOrder) for r in rows]
        assert keys == sorted(keys, key=lambda k: (k[0], k[1] is None, k[1]))
        assert rows[0].label == f"{rows[0].Participant} {rows[0].Condition}"


def test_participant_tables(spark):
    rows = [(p, g, "M" if p % 2 else None, 0.125, 0.0, 1.0, None, True, 61.5, 0.333) for p in (1, 2, 30) for g in ("K", "H")]
    players = spark.createDataFrame(rows, "Participant int, GameTitle string, gender string, mean_rate double, min_rate double, "
                                          "max_rate double, mean_feedback double, mi_experience boolean, time_total double, "
                                          "fp_rate_minute double")
    wide = report.participant_table(players, [1, 2, 30])
    assert wide.columns == ["GameTitle", "Feature", "1", "2", "30"] and wide.count() == 16
    cells = {(r.GameTitle, r.Feature): r["1"] for r in wide.collect()}
    assert cells["K", "Mean Rate"] == "12 \\%" and cells["K", "Mean Pos. Feedback"] == "NA \\%"
    assert cells["K", "Mean Time (s)"] == "62" and cells["K", "False Positives (pr min)"] == "0.33"
    blocks = report.participant_blocks(players, F.floor(F.col("Participant") / 8), width=2)
    named = {(r.block, r.p1, r.p2) for r in blocks.where("Feature = 'Participant'").collect()}
    assert named == {(0, "1", "2"), (1, "30", None)}
    text = report.delimited_text(wide, ["GameTitle"], ["Feature", "1", "2"], ["Feature"])
    body = {r.GameTitle: r.text for r in text.collect()}["K"]
    assert body.startswith("Feature & 1 & 2 \\\\ False Positives (pr min) & 0.33 & 0.33 \\\\ Gender & M & NA \\\\ ")


def test_study_table(spark):
    df = spark.createDataFrame([("realbci", 0.97, -0.11, -0.88, 1.06), ("strokesur", 0.49, 0.31, -0.5, 0.68)],
                               "study string, perc_slope double, perc_intercept double, frust_slope double, frust_intercept double")
    assert tuple(report.study_table(df).first()) == ("BCI (EEG, MRP)", "Non-patients", -0.11, 0.97, 1.06, -0.88)


def test_export(spark, small_dir):
    out = cohorts.narrow_extract(study.session_table(spark, small_dir), "Kiwi")
    assert out.columns == ["Participant", "Condition", "Frustration", "control"]
    people = [r.Participant for r in out.collect()]
    assert people == sorted(people)


def test_experience_flags(spark):
    df = spark.createDataFrame([("some BCIExperience",), ("MIExperience",), (None,)], "comment string")
    assert [(r.bci_experience, r.mi_experience) for r in sessions.experience_flags(df).collect()] == [
        (True, False), (False, True), (False, False)]


def test_numbered_sessions_match_sorted_keys(spark, small_dir):
    table = sessions.trial_counts(study.study_log(spark, small_dir))
    bucket = [F.col("GameTitle"), F.floor(F.col("Participant") / 4)]
    a = sequence.number_rows(table, list(sequence.SESSION_KEYS), bucket=bucket, pieces=False)
    same_rows(a, sequence.number_rows(table, list(sequence.SESSION_KEYS), bucket=bucket, pieces=True))
    rows = sorted(a.collect(), key=lambda r: r.session)
    assert [(r.GameTitle, r.Participant, r.Condition) for r in rows] == sorted(
        (r.GameTitle, r.Participant, r.Condition) for r in rows)
