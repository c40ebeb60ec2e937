"""Scalar column functions: time, numbers, text, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialweave.functions.missing import as_col

# Fixed value: the log's time text, with an optional fraction of up to six digits.
TIME_PATTERN = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"


def parse_timestamp(c: Column | str, pattern: str = TIME_PATTERN) -> Column:
    """Text to timestamp; bad text gives NULL."""
    return F.try_to_timestamp(as_col(c), F.lit(pattern))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds as a double, exact to the microsecond.

    Both columns must have the same timestamp type. For the type without time zone this is
    wall-clock time, whatever the zone of the session.
    """
    gap = as_col(end) - as_col(start)
    parts = {"DAY": 86_400, "HOUR": 3_600, "MINUTE": 60}
    whole = sum((F.date_part(F.lit(unit), gap).cast("bigint") * size for unit, size in parts.items()), F.lit(0))
    return (whole + F.date_part(F.lit("SECOND"), gap)).cast("double")


def to_number(c: Column | str) -> Column:
    """Text to double; bad text gives NULL."""
    return as_col(c).try_cast("double")


def default_value(c: Column | str, value) -> Column:
    return F.coalesce(as_col(c), F.lit(value))


def n_clip(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Limit to ``[low, high]``, keeping a missing value missing."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def perc_change(a: Column | str, b: Column | str) -> Column:
    """Difference in percent of the larger value; NULL if that is zero."""
    a, b = as_col(a), as_col(b)
    top, bottom = F.greatest(a, b), F.least(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), F.try_divide(top - bottom, top) * 100)


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(as_col(c), digits)


def fixed_decimals(c: Column | str, digits: int = 0) -> Column:
    """Round half to even and print with exactly ``digits`` decimals; NULL stays NULL.

    The value is first rounded to eight more decimals, so that a tie does not depend on the
    order in which a distributed mean was summed.
    """
    c = as_col(c)
    exact = F.bround(F.round(c.cast("double"), digits + 8), digits)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", exact))


def percent_text(c: Column | str, suffix: str = "\\%") -> Column:
    """A share as whole percent followed by the suffix; a missing share prints ``NA``."""
    return F.concat_ws(" ", F.coalesce(fixed_decimals(as_col(c) * 100), F.lit("NA")), F.lit(suffix))


def jitter(c: Column | str, amount: float, seed: int) -> Column:
    """Add symmetric uniform noise of at most ``amount``."""
    return as_col(c) + (F.rand(seed) * 2 - 1) * F.lit(float(amount))


def level_code(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in an explicit level list; NULL for anything else."""
    code = F.array_position(F.array(*[F.lit(x) for x in levels]), as_col(c))
    return F.when(code > 0, code.cast("int"))


def dummy(c: Column | str, level: str) -> Column:
    """1.0 for the level, 0.0 for any other known value."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.when(c == level, 1.0).otherwise(0.0))
