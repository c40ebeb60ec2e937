import datetime as dt

import pytest
from pyspark.sql import functions as F

from trialweave.functions import missing as na
from trialweave.functions import scalars as sc
from trialweave.operators import columns


def one(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_conditional_keeps_missing(spark):
    out = one(spark, [(True,), (False,), (None,)], "t boolean", v=na.if_else_na(F.col("t"), F.lit(1), F.lit(0)))
    assert out == [(1,), (0,), (None,)]


def test_cascade_later_rule_wins_and_missing_spreads(spark):
    rules = [(F.col("a"), "A"), (F.col("b"), "B")]
    rows = [(True, True), (True, False), (False, False), (None, False), (None, True), (True, None)]
    out = one(spark, rows, "a boolean, b boolean", v=na.label_cascade("none", rules))
    assert [r[0] for r in out] == ["B", "A", "none", None, "B", None]
    assert one(spark, [(True,)], "a boolean", v=na.label_cascade("x", []))[0] == ("x",)


def test_membership(spark):
    rows = [("x",), ("y",), (None,)]
    out = one(spark, rows, "s string", i=na.is_in_na("s", ["x"]), n=na.not_in_na("s", ["x"]))
    assert out == [(True, False), (False, True), (False, True)]


def test_regex_false_on_missing(spark):
    assert one(spark, [("abc",), (None,)], "s string", m=na.matches("s", "b")) == [(True,), (False,)]


def test_strict_and_skipping_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "k string, x double")
    row = {r["k"]: r for r in df.groupBy("k").agg(
        na.na_sum("x").alias("s"), na.na_mean("x").alias("m"), na.na_min("x").alias("lo"), na.na_max("x").alias("hi"),
        na.na_sum("x", "skip").alias("ss"), na.na_count_if(F.col("x") > 2).alias("c")).collect()}
    assert tuple(row["a"])[1:] == (4.0, 2.0, 1.0, 3.0, 4.0, 1)
    assert tuple(row["b"])[1:] == (None, None, None, None, 1.0, None)
    with pytest.raises(ValueError):
        na.na_sum("x", "drop")


def test_only_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", None), ("c", None), ("d", 1), ("d", 2)], "k string, x int")
    quiet = {r[0]: r[1] for r in df.groupBy("k").agg(na.only_value("x", "null")).collect()}
    assert quiet == {"a": 1, "b": None, "c": None, "d": None}
    assert df.where("k in ('a', 'c')").groupBy("k").agg(na.only_value("x")).count() == 2
    with pytest.raises(Exception, match="not constant"):
        df.groupBy("k").agg(na.only_value("x")).collect()


def test_ratio_and_paste(spark):
    out = one(spark, [(1, 0, None), (1, 2, "z")], "a int, b int, s string",
              r=na.safe_ratio("a", "b"), p=na.paste_na("a", "s", sep="-"))
    assert out == [(None, "1-NA"), (0.5, "1-z")]


def test_sort_keeps_missing_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    assert [r[0] for r in df.orderBy(*na.asc_last("x")).collect()] == [1, 2, None]


def test_time(spark):
    rows = [("2021-01-02 03:04:05.1234",), ("2021-01-02 03:04:05.123456",), ("2021-01-02 03:04:05",), ("soon",), (None,)]
    out = [r[0] for r in one(spark, rows, "s string", t=sc.parse_timestamp("s"))]
    assert out[0] == dt.datetime(2021, 1, 2, 3, 4, 5, 123400)
    assert out[1].microsecond == 123456 and out[2].microsecond == 0 and out[3:] == [None, None]
    gap = one(spark, [("2021-01-01 00:00:00", "2021-01-01 00:00:01.5")], "a string, b string",
              g=sc.seconds_between(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz")))
    assert gap == [(1.5,)]


def test_numbers(spark):
    rows = [(-1.0,), (0.25,), (2.0,), (None,)]
    assert one(spark, rows, "x double", c=sc.n_clip("x")) == [(0.0,), (0.25,), (1.0,), (None,)]
    assert one(spark, [(0.97, 0.72), (-0.1, -0.2), (0.0, 0.0), (None, 1.0)], "a double, b double",
               p=F.round(sc.perc_change("a", "b"), 4)) == [(25.7732,), (-100.0,), (None,), (None,)]
    assert one(spark, [(2.5,), (3.5,)], "x double", r=sc.round_half_even("x")) == [(2.0,), (4.0,)]
    assert one(spark, [(1234.5,), (None,)], "x double", f=sc.fixed_decimals("x", 2)) == [("1234.50",), (None,)]
    assert one(spark, [(0.775,), (0.7749999999999999,), (None,)], "x double",
               p=sc.percent_text("x")) == [("78 \\%",), ("78 \\%",), ("NA \\%",)]
    assert one(spark, [("1.5",), ("x",), ("",), (None,)], "s string", n=sc.to_number("s")) == [(1.5,), (None,), (None,), (None,)]
    assert one(spark, [(None,), (3,)], "x int", d=sc.default_value("x", 0)) == [(0,), (3,)]


def test_levels_and_jitter(spark):
    assert one(spark, [("b",), ("z",), (None,)], "s string", c=sc.level_code("s", ["a", "b"])) == [(2,), (None,), (None,)]
    assert one(spark, [("b",), ("z",), (None,)], "s string", c=sc.dummy("s", "b")) == [(1.0,), (0.0,), (None,)]
    noise = spark.range(1000).select((sc.jitter(F.lit(0.5), 0.02, 3)).alias("x")).agg(F.min("x"), F.max("x")).first()
    assert 0.48 <= noise[0] < 0.485 and 0.515 < noise[1] <= 0.52


def test_column_shaping(spark, caplog):
    df = spark.createDataFrame([("a/b/c", 1)], "p string, n int")
    parts = columns.path_parts(df, "p", "/", ["x", "y"]).first()
    assert (parts.x, parts.y) == ("a", "b")
    longer = columns.path_parts(df, "p", "/", ["x", "y", "z", "none"]).first()
    assert longer["none"] is None
    assert columns.rename_if_present(df, {"p": "q"}).columns == ["q", "n"]
    assert columns.rename_if_present(df, {"p": "q", "gone": "r"}).columns == ["p", "n"]
    assert "gone" in caplog.text
    assert columns.select_with_keys(df, ["n"], ["p", "n"]).columns == ["n", "p"]
    assert columns.replace_column(df, "p", "n").columns == ["p"]
    assert columns.all_text(df).first() == ("a/b/c", "1")
    assert columns.preview(spark.range(30)).count() == 10
    other = spark.createDataFrame([(2, "new")], "n int, extra string")
    assert [tuple(r) for r in columns.union_by_name(df, other).collect()] == [("a/b/c", 1, None), (None, 2, "new")]


def test_long_and_wide_again(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, "z", None)], "id int, `a. b` string, c string")
    long = columns.unpivot(df, ["id"])
    assert long.count() == 4
    wide = columns.pivot_wide(long, ["id"], "name", "value", ["a. b", "c"]).orderBy("id")
    assert [tuple(r) for r in wide.collect()] == [tuple(r) for r in df.collect()]


def test_seconds_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [("2024-03-10 01:59:59.5", "2024-03-10 03:00:00.25"), ("2024-03-11 00:00:00", "2024-03-09 23:59:59.999999")]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        out = one(spark, rows, "a string, b string",
                  g=sc.seconds_between(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert out == [(3600.75,), (-86400.000001,)]


def test_whole_numbers_print_plainly(spark):
    df = spark.createDataFrame([(1.0, 1.5, "2.0")], "a double, b double, c string")
    assert tuple(columns.all_text(df).first()) == ("1", "1.5", "2.0")
