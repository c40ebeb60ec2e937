"""Ordered scans over groups of rows, safe for a group of any size.

A running sum, a fill or a lag needs its group in order, and a window runs one group in one
task. ``ordered_scan`` therefore cuts every group into pieces by a fixed grid on the leading
order column: a minute of a time, a day, a range of a number, the first letters of a text. The grid
never looks at the data, so the plan is the same for any size. It is fine, as a piece costs one row of a
small table: rows share a task only if their group and leading values are nearly the same.

``PieceScan`` runs the window inside a piece and adds what the earlier pieces of the group
carry in, a table of one row per piece. The rows are shuffled by piece, once, and the carry is
joined to them on the piece they are placed by. Each method reads its input twice and runs
nothing while the plan is built; rules that depend on each other belong into one scan
(``labels.py``) or get a stored table between them.

``pieces=False`` states that groups are small by construction (the sessions of one
participant): one plain window per group, ``GroupScan``, with the same methods.

The order must be total (end it with a unique column). Missing order values sort last.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions.missing import asc_last
from trialweave.functions.scalars import seconds_between

PIECE = "_piece"
PIECE_SECONDS, PIECE_NUMBERS, PIECE_LETTERS = 60, 16, 16
#: Parts of the fixed grid for fractions: each doubling of the size has so many pieces.
PIECES_PER_OCTAVE = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; one is made only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="trialweave-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read it and never recompute what made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join where a missing key matches a missing key; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    clash = set(left.columns) & (set(right.columns) - set(keys))
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"_right_{k}" for k in keys])


class GroupScan:
    """Scans as plain windows: one task per group."""

    def __init__(self, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        self._group = Window.partitionBy(*self.keys)
        self._ordered = self._group.orderBy(*asc_last(*self.order))
        self._so_far = self._ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def running_sum(self, df: DataFrame, **cols: Column) -> DataFrame:
        return df.withColumns({out: F.coalesce(F.sum(c).over(self._so_far), F.lit(0))
                               for out, c in cols.items()})

    def last_known(self, df: DataFrame, **cols: Column) -> DataFrame:
        return df.withColumns({out: F.last(c, ignorenulls=True).over(self._so_far)
                               for out, c in cols.items()})

    def next_known(self, df: DataFrame, **cols: Column) -> DataFrame:
        ahead = self._ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return df.withColumns({out: F.first(c, ignorenulls=True).over(ahead)
                               for out, c in cols.items()})

    def previous(self, df: DataFrame, **cols: Column) -> DataFrame:
        return df.withColumns({out: F.lag(c).over(self._ordered) for out, c in cols.items()})

    def whole(self, df: DataFrame, **aggs: Column) -> DataFrame:
        return df.withColumns({out: a.over(self._group) for out, a in aggs.items()})

    def first(self, df: DataFrame, **cols: Column) -> DataFrame:
        return df.withColumns({out: F.first(c).over(self._so_far) for out, c in cols.items()})


def grid_of(df: DataFrame, order: Sequence[str]) -> Column:
    """The place of a row on the fixed grid of its leading order column; never decreases along the order.

    Rows without that value come last and are cut by the grid of the next order column.
    """
    def at(name: str) -> Column:
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            epoch = F.lit("1970-01-01 00:00:00").cast(kind)
            return F.floor(seconds_between(epoch, c) / PIECE_SECONDS).cast("bigint")
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            x = c.cast("double")
            size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1024.0)) * PIECES_PER_OCTAVE) + (1 << 28)
            sign = F.when(x > 0, 1).when(x < 0, -1).otherwise(0)  # not-a-number is above every number
            return F.when(F.isnan(x), 1 << 40).when(x == 0, 0).otherwise(sign * size).cast("bigint")
        if isinstance(kind, T.DateType):
            return F.unix_date(c).cast("bigint")
        if isinstance(kind, T.IntegralType):
            return F.floor(c / PIECE_NUMBERS).cast("bigint")
        return F.substring(c.cast("string"), 1, PIECE_LETTERS)

    first = F.col(order[0])
    rest = F.when(first.isNull(), at(order[1])) if len(order) > 1 else F.lit(None).cast("bigint")
    return F.struct(first.isNull().alias("missing"), at(order[0]).alias("at"), rest.alias("next"))


class PieceScan:
    """The same scans over rows cut into pieces along the order."""

    def __init__(self, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        self._local = GroupScan([PIECE], self.order)
        self._pieces_of_group = Window.partitionBy(f"{PIECE}.keys").orderBy(f"{PIECE}.grid")
        # rank of a row inside its group, comparable, missing order values last
        self._at = F.struct(*[x for c in self.order for x in (F.col(c).isNull(), F.col(c))])

    def placed(self, df: DataFrame) -> DataFrame:
        """Adds the piece: one column, never missing as a whole, so that a plain equi-join matches missing keys."""
        keys = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)])
        return df.withColumn(PIECE, F.struct(keys.alias("keys"), grid_of(df, self.order).alias("grid")))

    def _carry(self, df: DataFrame, aggs: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
        pieces = df.groupBy(PIECE).agg(*[a.alias(out) for out, a in aggs.items()])
        side = pieces.select(PIECE, *[c.alias(f"_c_{out}") for out, c in carried.items()])
        return df.join(side, PIECE)

    @staticmethod
    def _finish(df: DataFrame, cols) -> DataFrame:
        return df.drop(*[f"_c_{out}" for out in cols])

    def running_sum(self, df: DataFrame, **cols: Column) -> DataFrame:
        before = self._pieces_of_group.rowsBetween(Window.unboundedPreceding, -1)
        df = self._carry(df, {out: F.sum(c) for out, c in cols.items()},
                         {out: F.coalesce(F.sum(out).over(before), F.lit(0)) for out in cols})
        df = self._local.running_sum(df, **cols)
        df = df.withColumns({out: F.col(out) + F.col(f"_c_{out}") for out in cols})
        return self._finish(df, cols)

    def last_known(self, df: DataFrame, **cols: Column) -> DataFrame:
        before = self._pieces_of_group.rowsBetween(Window.unboundedPreceding, -1)
        df = self._carry(df, {out: F.max_by(c, F.when(c.isNotNull(), self._at)) for out, c in cols.items()},
                         {out: F.last(out, ignorenulls=True).over(before) for out in cols})
        df = self._local.last_known(df, **cols)
        df = df.withColumns({out: F.coalesce(F.col(out), F.col(f"_c_{out}")) for out in cols})
        return self._finish(df, cols)

    def next_known(self, df: DataFrame, **cols: Column) -> DataFrame:
        after = self._pieces_of_group.rowsBetween(1, Window.unboundedFollowing)
        df = self._carry(df, {out: F.min_by(c, F.when(c.isNotNull(), self._at)) for out, c in cols.items()},
                         {out: F.first(out, ignorenulls=True).over(after) for out in cols})
        df = self._local.next_known(df, **cols)
        df = df.withColumns({out: F.coalesce(F.col(out), F.col(f"_c_{out}")) for out in cols})
        return self._finish(df, cols)

    def previous(self, df: DataFrame, **cols: Column) -> DataFrame:
        df = self._carry(df, {out: F.max_by(c, self._at) for out, c in cols.items()},
                         {out: F.lag(out).over(self._pieces_of_group) for out in cols})
        df = self._local.running_sum(df, _in_piece=F.lit(1))
        df = self._local.previous(df, **cols)
        df = df.withColumns({out: F.when(F.col("_in_piece") == 1, F.col(f"_c_{out}")).otherwise(F.col(out))
                             for out in cols})
        return self._finish(df.drop("_in_piece"), cols)

    def whole(self, df: DataFrame, **aggs: Column) -> DataFrame:
        """Group totals, one row per group, come down to the rows by way of the pieces."""
        totals = df.groupBy(F.col(f"{PIECE}.keys").alias("_keys")).agg(*[a.alias(out) for out, a in aggs.items()])
        pieces = df.select(PIECE).distinct().withColumn("_keys", F.col(f"{PIECE}.keys"))
        return df.join(pieces.join(totals, "_keys").drop("_keys"), PIECE)

    def first(self, df: DataFrame, **cols: Column) -> DataFrame:
        return self.whole(df, **{out: F.min_by(c, self._at) for out, c in cols.items()})


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 build: Callable[[DataFrame, GroupScan | PieceScan], DataFrame], pieces: bool = True) -> DataFrame:
    """Run ``build(rows, scan)``; see the top of this file for ``pieces``."""
    if not pieces:
        return build(df, GroupScan(keys, order))
    scan = PieceScan(keys, order)
    return build(scan.placed(df), scan).drop(PIECE)
