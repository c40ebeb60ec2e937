"""Start gate, window numbers, fills and periods of a log in one scan.

A session is cut into pieces along the time (``scans.PieceScan``). The rules of the log are a small state machine,
and what a piece does to it is summed up in one row: markers and closed windows counted, whether a count became
unknown, and the last row that sets each filled value, where the value may still depend on the number of windows
before the piece. These rows are composed in the order of the pieces, and each piece learns the state it starts in.
So the log is read twice: for the summaries and for the rows. Nothing runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.missing import asc_last, if_else_na, label_cascade
from trialweave.operators.scans import PIECE, PieceScan

# Event names, window states, period names of the log.
GAME_START, GAME_STOP = "GameRunning", "GameStopped"
WINDOW_CHANGE, OPEN, CLOSED = "InputWindowChange", "Open", "Closed"
PRE_GAME, OPEN_PERIOD, REST_PERIOD, POST_GAME = "PreGame", "OpenPeriod", "RestPeriod", "PostGame"

def _event() -> Column:
    return F.col("Event")


def _window() -> Column:
    return F.col("InputWindow")


def closed_flag() -> Column:
    return (_event() == WINDOW_CHANGE) & (_window() == CLOSED)


def closed_id(number: Column) -> Column:
    """The number on closed windows, 0 on other rows, -1 on open, start and stop rows."""
    return label_cascade(
        if_else_na(closed_flag(), number, F.lit(0)),
        [(_event() == GAME_STOP, -1), (_event() == GAME_START, -1), ((_event() == WINDOW_CHANGE) & (_window() == OPEN), -1)]).cast("bigint")


def trial_order() -> Column:
    return label_cascade(F.col("InputWindowOrder"), [
        (_event() == GAME_STOP, -1.0), (_event() == GAME_START, -1.0), (_window() == CLOSED, -1.0)])


def period(number: Column, last: Column) -> Column:
    """Label of a row that has ``number`` as its closed id; ``last`` is the largest of the session."""
    return label_cascade(F.lit(None).cast("string"), [
        (closed_flag(), REST_PERIOD),
        ((_event() == WINDOW_CHANGE) & (number == last), POST_GAME),
        ((_event() == WINDOW_CHANGE) & (_window() == OPEN), OPEN_PERIOD),
        (_event() == GAME_START, PRE_GAME)])


class _State:
    """What the rows of a piece up to some row say about the fills, given the state the piece starts in."""

    def __init__(self, known: Column, before: Column, last_id: Column):
        self.closed_at = F.when(known, F.col("_closed_at"))
        self.number = before + F.col("_closed")
        self.last_id = last_id

    def fill(self) -> Column:
        at = F.greatest(F.col("_minus_at"), self.closed_at)
        return F.when(at == F.col("_minus_at"), F.lit(-1).cast("bigint")).when(at == self.closed_at, self.number)

    def label(self) -> Column:
        zero_at = F.when(self.last_id == 0, F.col("_zero_change_at"))
        at = F.greatest(F.col("_label.at"), self.closed_at, zero_at)
        of_closed = F.when(self.number == self.last_id, POST_GAME).otherwise(REST_PERIOD)
        return F.when(at == F.col("_label.at"), F.col("_label.label")).when(at == self.closed_at, of_closed).when(at == zero_at, POST_GAME)


def label_scan(df: DataFrame, order: Sequence[str], keys: Sequence[str], marker: Column | None = None, run: int = 1) -> DataFrame:
    """``sequence.label_periods`` of the rows; with ``marker`` of those that ``sequence.between_markers`` keeps."""
    scan = PieceScan(keys, order)
    rows = scan.placed(df)
    lost, beyond = run + 2, run + 1
    if marker is None:
        rows = rows.withColumn("_part", F.lit(run))
    else:
        upto = Window.partitionBy(PIECE).orderBy(*asc_last(*order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({"_runs": F.coalesce(F.sum(marker.cast("int")).over(upto), F.lit(0)), "_lost": F.count(F.when(marker.isNull(), 1)).over(upto)})
        rows = rows.withColumn("_part", F.when(F.col("_lost") > 0, lost).otherwise(F.least(F.col("_runs"), F.lit(beyond))).cast("int"))

    # a piece is split where a marker starts a run; the window number of a row is known in its part but for what came before
    upto = Window.partitionBy(PIECE, "_part").orderBy(*asc_last(*order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closed, own_id = closed_flag(), closed_id(F.lit(1))
    rows = rows.withColumns({"_at": F.row_number().over(upto), "_unknown": F.count(F.when(closed.isNull(), 1)).over(upto)})
    counted = closed & (F.col("_unknown") == 0) & (own_id == 1)
    fixed = F.when(_event() == GAME_START, PRE_GAME).when((_event() == WINDOW_CHANGE) & (_window() == OPEN), OPEN_PERIOD)
    other_change = (_event() == WINDOW_CHANGE) & (own_id == 0)

    def last_at(test: Column) -> Column:
        return F.max(F.when(test, F.col("_at"))).over(upto)

    rows = rows.withColumns({
        "_closed": F.count(F.when(counted, 1)).over(upto), "_closed_at": last_at(counted), "_minus_at": last_at(own_id == -1),
        "_zero_change_at": last_at(other_change), "_label": F.last(F.when(fixed.isNotNull(), F.struct(F.col("_at").alias("at"), fixed.alias("label"))), ignorenulls=True).over(upto),
        "_order": F.last(trial_order(), ignorenulls=True).over(upto), "_own_id": own_id})

    ends = ["_closed", "_closed_at", "_minus_at", "_zero_change_at", "_label", "_order", "_unknown"]
    runs = [F.max("_runs").alias("_runs")] if marker is not None else []
    parts = rows.groupBy(PIECE, "_part").agg(
        *[F.max_by(c, "_at").alias(c) for c in ends], F.max(F.col("_own_id") == 0).alias("_zero"), F.max(F.col("_own_id") == -1).alias("_minus"), *runs)
    state = _piece_states(parts, marker is not None, run, lost)
    rows = rows.join(state, PIECE).where(F.col("_part") == F.col("_kept"))
    here = _State(~F.col("_lost_before"), F.col("_before"), F.col("_last_id"))
    number = F.when((F.col("_unknown") == 0) & ~F.col("_lost_before"), here.number)
    out = rows.withColumns({
        "InputWindowClosedID": closed_id(number),
        "InputWindowClosedFill": F.coalesce(here.fill(), F.col("_fill_before")),
        "InputWindowOrder": trial_order(),
        "InputWindowOrderFilled": F.coalesce(F.col("_order"), F.col("_order_before")),
        "Period": F.coalesce(here.label(), F.col("_label_before"))})
    return out.select(*df.columns, *[c for c in ("InputWindowClosedID", "InputWindowClosedFill", "InputWindowOrderFilled", "Period") if c not in df.columns])


def _piece_states(parts: DataFrame, gated: bool, run: int, lost: int) -> DataFrame:
    """One row per piece with rows to keep: the part kept and the state of the log before it."""
    parts = parts.withColumns({"_group": F.col(f"{PIECE}.keys"), "_place": F.col(f"{PIECE}.grid")})
    group = Window.partitionBy("_group")
    along = group.orderBy("_place", "_part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    if gated:
        in_piece = Window.partitionBy("_group", "_place")
        final = F.col("_part") == F.max("_part").over(in_piece)
        parts = parts.withColumn("_adds", F.when(final, F.max("_runs").over(in_piece)).otherwise(0))
        parts = parts.withColumns({"_ran": F.coalesce(F.sum("_adds").over(before), F.lit(0)), "_ended": F.max(F.col("_part") == lost).over(before)})
        parts = parts.where((F.col("_ran") + F.col("_part") == run) & (F.col("_part") != lost) & ~F.coalesce("_ended", F.lit(False)))
    parts = parts.withColumns({
        "_lost_before": F.coalesce(F.max(F.col("_unknown") > 0).over(before), F.lit(False)),
        "_before": F.coalesce(F.sum("_closed").over(before), F.lit(0))})
    total = F.sum(F.when(~F.col("_lost_before"), F.col("_closed"))).over(group)
    largest = F.when(total > 0, total).when(F.max("_zero").over(group), 0).when(F.max("_minus").over(group), -1)
    parts = parts.withColumn("_last_id", largest)
    here = _State(~F.col("_lost_before"), F.col("_before"), F.col("_last_id"))
    parts = parts.withColumns({"_fill_end": here.fill(), "_label_end": here.label()})
    carried = {f"_{name}_before": F.last(end, ignorenulls=True).over(before) for name, end in (("fill", "_fill_end"), ("label", "_label_end"), ("order", "_order"))}
    return parts.select(PIECE, F.col("_part").alias("_kept"), "_lost_before", "_before", "_last_id", *[c.alias(n) for n, c in carried.items()])
