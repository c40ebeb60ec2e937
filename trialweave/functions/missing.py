"""Column helpers with explicit missing-value rules.

The default rule is that an unknown input gives an unknown output. Where a
helper treats a missing value as "no" instead, its name or docstring says so.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else_na(test: Column, yes, no) -> Column:
    """``yes`` / ``no`` by ``test``; NULL where ``test`` is NULL."""
    return F.when(test.isNull(), F.lit(None)).when(test, yes).otherwise(no)


def label_cascade(default, rules: Sequence[tuple[Column, object]]) -> Column:
    """Apply ``(condition, label)`` rules in turn, a later rule overriding an earlier one.

    A NULL condition makes the label NULL, unless a still later rule overrides it.
    One flat CASE: the last rule is tested first.
    """
    expr = None
    for cond, label in reversed(list(rules)):
        value = label if isinstance(label, Column) else F.lit(label)
        expr = (F.when(cond.isNull(), F.lit(None)) if expr is None
                else expr.when(cond.isNull(), F.lit(None)))
        expr = expr.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if expr is None else expr.otherwise(default)


def is_in_na(c: Column | str, values: Iterable) -> Column:
    """Membership test that is FALSE, never NULL, for a missing value."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def not_in_na(c: Column | str, values: Iterable) -> Column:
    """Anti-membership that keeps rows with a missing value."""
    return ~is_in_na(c, values)


def matches(c: Column | str, pattern: str) -> Column:
    """Regex test, FALSE for a missing text."""
    return F.coalesce(as_col(c).rlike(pattern), F.lit(False))


def strict(agg: Column, *inputs: Column | str) -> Column:
    """Make an aggregate NULL as soon as one of its inputs is NULL in the group."""
    complete = F.lit(True)
    for c in inputs:
        complete = complete & (F.count(as_col(c)) == F.count(F.lit(1)))
    return F.when(complete, agg)


def _na(fn, c, na: str) -> Column:
    if na not in ("propagate", "skip"):
        raise ValueError(f"na must be 'propagate' or 'skip', not {na!r}")
    agg = fn(as_col(c))
    return strict(agg, c) if na == "propagate" else agg


def na_sum(c: Column | str, na: str = "propagate") -> Column:
    return _na(F.sum, c, na)


def na_mean(c: Column | str, na: str = "propagate") -> Column:
    return _na(F.avg, c, na)


def na_min(c: Column | str, na: str = "propagate") -> Column:
    return _na(F.min, c, na)


def na_max(c: Column | str, na: str = "propagate") -> Column:
    return _na(F.max, c, na)


def na_count_if(test: Column, na: str = "propagate") -> Column:
    """Number of TRUE rows; by default NULL if the test is NULL on any row."""
    return _na(F.count_if, test, na)


def only_value(c: Column | str, on_conflict: str = "error") -> Column:
    """The single value of a column that should be constant in its group.

    Two different values, or a mix of NULL and a value, is a conflict: it raises
    at run time, or gives NULL with ``on_conflict="null"``. Keeps no set of values.
    """
    if on_conflict not in ("error", "null"):
        raise ValueError(f"on_conflict must be 'error' or 'null', not {on_conflict!r}")
    c = as_col(c)
    known, rows = F.count(c), F.count(F.lit(1))
    fine = (known == 0) | ((known == rows) & (F.min(c) == F.max(c)))
    clash = (F.lit(None) if on_conflict == "null"
             else F.raise_error(F.lit("column is not constant in its group")))
    return F.when(fine, F.min(c)).otherwise(clash)


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """Double ratio; a zero divisor gives NULL."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def paste_na(*cols: Column | str, sep: str = " ") -> Column:
    """Join as text; a missing part is written ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit("NA")) for c in cols])


def plain_text(df: DataFrame, name: str) -> Column:
    """A column as text; a whole number held as double prints without decimals."""
    text = F.col(f"`{name}`").cast("string")
    if dict(df.dtypes)[name] in ("double", "float"):
        text = F.regexp_replace(text, r"\.0$", "")
    return text.alias(name)


def asc_last(*cols: Column | str) -> list[Column]:
    """Ascending sort keys with missing values at the end."""
    return [as_col(c).asc_nulls_last() for c in cols]
