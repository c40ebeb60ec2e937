"""Column and table shaping: rename, split, select, union, reshape."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.missing import as_col, plain_text

log = logging.getLogger(__name__)


def split_parts(c: Column | str, sep: str, n: int) -> list[Column]:
    """The first ``n`` parts of a text; missing parts are NULL, further parts are dropped."""
    parts = F.split(as_col(c), "\\Q" + sep + "\\E")
    return [F.try_element_at(parts, F.lit(i + 1)) for i in range(n)]


def path_parts(df: DataFrame, col: str, sep: str, names: Sequence[str]) -> DataFrame:
    """Split a column into named parts."""
    return df.withColumns(dict(zip(names, split_parts(col, sep, len(names)))))


def rename_if_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename all listed columns, or none of them if one is absent (logged)."""
    absent = [c for c in names if c not in df.columns]
    if absent:
        log.warning("columns %s not found in %s, nothing renamed", absent, df.columns)
        return df
    return df.withColumnsRenamed(dict(names))


def select_with_keys(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Select columns; the keys always stay, first."""
    return df.select(*keys, *[c for c in cols if c not in keys])


def replace_column(df: DataFrame, target: str, source: str) -> DataFrame:
    """Put ``source`` in the place of ``target`` under its name."""
    return df.drop(target).withColumnRenamed(source, target)


def all_text(df: DataFrame) -> DataFrame:
    return df.select(*[plain_text(df, c) for c in df.columns])


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Union by column name; a column absent from a table is NULL there."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
            name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long. By default all columns but the ids."""
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], name, value)


def pivot_wide(df: DataFrame, keys: Sequence[str], names_from: str, values_from: str,
               values: Sequence) -> DataFrame:
    """Long to wide, one column per listed value. The list fixes the schema and saves a job."""
    return df.groupBy(*keys).pivot(names_from, list(values)).agg(F.first(values_from, ignorenulls=True))
