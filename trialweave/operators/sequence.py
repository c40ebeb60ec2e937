"""Sequence operators over the time-ordered event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.missing import as_col, asc_last
from trialweave.functions.scalars import seconds_between
from trialweave.operators.labels import GAME_START, OPEN_PERIOD, REST_PERIOD, closed_flag, closed_id, label_scan, period, trial_order  # noqa: F401
from trialweave.operators.scans import join_null_safe, ordered_scan

SESSION_KEYS = ("GameTitle", "Participant", "Condition")

MINUTE, DAY = 60, 86_400


def gap_seconds(df: DataFrame, order: Sequence[str], out: str = "time_delta", partition_by: Sequence[str] = (),
                pieces: bool = True) -> DataFrame:
    """Seconds since the previous event; the first event gets 0. ``order`` starts with the time.

    By default the previous event is the one before in the **whole** log, of whatever session;
    ``partition_by`` restricts it. The whole-log order never goes through one task: events are lagged
    inside a minute, the first event of a minute takes the last time of the minute before it in
    its day, and the first minute of a day the last time of the day before. Only the table of
    days (one row each) has a window without a partition. Rows without a time get 0 and take no
    part in the order.
    """
    ts = order[0]
    gap = F.coalesce(seconds_between(F.col("_prev"), F.col(ts)), F.lit(0.0))
    if partition_by:
        lagged = ordered_scan(df, partition_by, order,
                              lambda rows, scan: scan.previous(rows, _prev=F.col(ts)), pieces)
        return lagged.withColumn(out, gap).drop("_prev")

    epoch = F.lit("1970-01-01 00:00:00").cast(df.schema[ts].dataType)
    timed = df.where(F.col(ts).isNotNull()).withColumn("_minute", F.floor(seconds_between(epoch, F.col(ts)) / MINUTE))
    lagged = timed.withColumn("_prev", F.lag(ts).over(Window.partitionBy("_minute").orderBy(*asc_last(*order))))
    # minutes are known, so plain equality will do and the lagged rows are already placed for it
    gaps = (lagged.join(_minute_carry(timed, ts), "_minute", "left")
            .withColumn("_prev", F.coalesce("_prev", "_carry"))
            .withColumn(out, gap)
            .drop("_minute", "_prev", "_carry"))
    untimed = df.where(F.col(ts).isNull()).withColumn(out, F.lit(0.0))
    return gaps.unionByName(untimed)


def _minute_carry(timed: DataFrame, ts: str) -> DataFrame:
    """The last time before each minute, by way of its day."""
    day = F.floor(F.col("_minute") * MINUTE / DAY)
    minutes = timed.groupBy("_minute").agg(F.max(ts).alias("_last")).withColumn("_day", day)
    days = minutes.groupBy("_day").agg(F.max("_last").alias("_last"))
    before = days.select("_day", F.lag("_last").over(Window.orderBy("_day")).alias("_day_carry"))
    inside = F.lag("_last").over(Window.partitionBy("_day").orderBy("_minute"))
    return (minutes.withColumn("_carry", inside).join(before, "_day")
            .select("_minute", F.coalesce("_carry", "_day_carry").alias("_carry")))


def between_markers(df: DataFrame, marker: Column, order: Sequence[str],
                    keys: Sequence[str] = SESSION_KEYS, run: int = 1, pieces: bool = True) -> DataFrame:
    """Rows from the ``run``-th marker up to, not including, the next one.

    From the first row whose marker test is NULL on, the count is unknown and rows drop.
    """
    def build(rows, scan):
        rows = scan.running_sum(rows, _runs=marker.cast("int"), _unknown=marker.isNull().cast("int"))
        return rows.where((F.col("_runs") == run) & (F.col("_unknown") == 0)).drop("_runs", "_unknown")

    return ordered_scan(df, keys, order, build, pieces)


def gate_run(df: DataFrame, order: Sequence[str], keys: Sequence[str] = SESSION_KEYS, pieces: bool = True) -> DataFrame:
    """The first game run of each session."""
    return between_markers(df, F.col("Event") == GAME_START, order, keys, 1, pieces)


def _with_closed_id(rows, scan):
    """Number closed windows 1, 2, ...; other rows 0; -1 on open, start and stop rows."""
    closed = closed_flag()
    rows = scan.running_sum(rows, _n_closed=closed.cast("int"), _unknown=closed.isNull().cast("int"))
    number = F.when(F.col("_unknown") == 0, F.col("_n_closed"))
    return rows.withColumn("InputWindowClosedID", closed_id(number)).drop("_n_closed", "_unknown")


def occurrence_id(df: DataFrame, order: Sequence[str], keys: Sequence[str] = SESSION_KEYS, pieces: bool = True) -> DataFrame:
    """Add ``InputWindowClosedID``: the running number of each closed window of a session."""
    return ordered_scan(df, keys, order, _with_closed_id, pieces)


def fill_down(df: DataFrame, cols: dict[str, str | Column], order: Sequence[str], keys: Sequence[str], pieces: bool = True) -> DataFrame:
    """``{out: column}``: carry the last known value forward within the group."""
    filled = {out: as_col(c) for out, c in cols.items()}
    return ordered_scan(df, keys, order, lambda rows, scan: scan.last_known(rows, **filled), pieces)


def fill_down_up(df: DataFrame, cols: Sequence[str], order: Sequence[str], keys: Sequence[str], pieces: bool = True) -> DataFrame:
    """Carry the last known value forward, then the first known one backward."""
    def build(rows, scan):
        rows = scan.last_known(rows, **{f"_down_{c}": F.col(c) for c in cols})
        rows = scan.next_known(rows, **{f"_up_{c}": F.col(c) for c in cols})
        rows = rows.withColumns({c: F.coalesce(f"_down_{c}", f"_up_{c}") for c in cols})
        return rows.drop(*[f"_{way}_{c}" for way in ("down", "up") for c in cols])

    return ordered_scan(df, keys, order, build, pieces)


def label_periods(df: DataFrame, order: Sequence[str], keys: Sequence[str] = SESSION_KEYS, pieces: bool = True) -> DataFrame:
    """Add the window numbers, the filled trial order and the period of every event.

    New columns: ``InputWindowClosedID``, ``InputWindowClosedFill``, ``InputWindowOrderFilled``
    and ``Period``. The last closed window of a session starts ``PostGame``. A gap belongs
    to the period of the event that ends it: a change row carries the time since its
    predecessor into the new period.
    """
    if pieces:
        return label_scan(df, order, keys)
    number = F.col("InputWindowClosedID")

    def build(rows, scan):
        rows = _with_closed_id(rows, scan)
        rows = scan.whole(rows, _last_id=F.max("InputWindowClosedID"))
        rows = rows.withColumns({"InputWindowOrder": trial_order(), "Period": period(number, F.col("_last_id"))})
        rows = scan.last_known(rows, InputWindowClosedFill=F.when(number != 0, number),
                               InputWindowOrderFilled=F.col("InputWindowOrder"),
                               Period=F.col("Period"))
        return rows.drop("_last_id")

    return ordered_scan(df, keys, order, build, pieces)


def label_run(df: DataFrame, order: Sequence[str], keys: Sequence[str] = SESSION_KEYS, run: int = 1) -> DataFrame:
    """``label_periods`` of the ``run``-th game run of each session: gate and labels in one scan."""
    return label_scan(df, order, keys, F.col("Event") == GAME_START, run)


def number_rows(df: DataFrame, order: Sequence[str], out: str = "session", start: int = 1,
                keys: Sequence[str] = (), bucket: Sequence[Column] = (), pieces: bool = True) -> DataFrame:
    """Consecutive numbers along a total order, without sorting everything in one task.

    ``bucket`` are columns, coarse to fine, that never decrease along ``order`` inside ``keys``
    and the buckets before (a leading order column, or a coarser form of it). Rows are numbered
    inside the finest bucket, and a tree of counts adds what comes before it: each level sums
    the buckets before it inside their parent only, so only the coarsest level is ever in one task.
    The input is read up to three times, so give it a file scan or a stored table.
    """
    names = [f"_bucket{i}" for i in range(len(bucket))]
    rows = df.withColumns(dict(zip(names, bucket))) if names else df
    inner = [*keys, *names]
    if not inner:
        raise ValueError("number_rows needs keys or a bucket")
    numbered = ordered_scan(rows, inner, order,
                            lambda part, scan: scan.running_sum(part, **{out: F.lit(1)}), pieces)
    if names:
        offsets = _tree_offsets(rows.groupBy(*inner).agg(F.count(F.lit(1)).alias("_n")), list(keys), names)
        numbered = join_null_safe(numbered, offsets, inner).withColumn(out, F.col(out) + F.col("_offset"))
    return (numbered.withColumn(out, (F.col(out) + F.lit(start - 1)).cast("bigint"))
            .drop("_offset", *names))


def _tree_offsets(sizes: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows before each bucket, from the sizes ``_n`` of the finest ones: counted up the levels, summed down again."""
    levels = {len(names): sizes}
    for depth in range(len(names) - 1, 0, -1):
        levels[depth] = levels[depth + 1].groupBy(*keys, *names[:depth]).agg(F.sum("_n").alias("_n"))
    above = None
    for depth in range(1, len(names) + 1):
        parent = [*keys, *names[:depth - 1]]
        before = Window.partitionBy(*parent).orderBy(*asc_last(names[depth - 1])).rowsBetween(Window.unboundedPreceding, -1)
        here = levels[depth].withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        if above is not None:
            here = join_null_safe(here, above, parent).withColumn("_offset", F.col("_offset") + F.col("_above")).drop("_above")
        above = here.withColumnRenamed("_offset", "_above")
    return above.withColumnRenamed("_above", "_offset")
