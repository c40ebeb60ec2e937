"""Delimited log files: directory scans, header drift, paths, merge with metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions.missing import as_col
from trialweave.functions.scalars import parse_timestamp, to_number
from trialweave.operators.columns import path_parts, rename_if_present, union_by_name
from trialweave.operators.scans import join_null_safe

# The token for a missing cell, and the metadata columns that clash with the log.
MISSING = "NULL"
META_NAMES = {"Timestamp": "MetaTimestamp", "Email": "MetaEmail", "Framecount": "MetaFramecount"}
PATH = "source_path"
ROW_ORDER = ("source_rank", PATH, "source_block", "source_row")


def with_source_path(df: DataFrame, out: str = PATH) -> DataFrame:
    return df.withColumn(out, F.col("_metadata.file_path"))


def _plain_path(path: Column) -> Column:
    """Undo the percent coding of a scan's file path; a plus sign is itself there."""
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def _header_groups(spark: SparkSession, root: str, suffix: str) -> dict[str, list[str]]:
    """Header line to the files that start with it.

    One text scan, reduced to the first line of each file before the shuffle. The driver
    receives file names, which it holds anyway to plan a scan.
    """
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}.csv").text(root)
             .select("value", _plain_path(F.col("_metadata.file_path")).alias("path"),
                     F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")))
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("path").toLocalIterator():
        groups.setdefault(row["header"].lstrip("﻿").rstrip("\r"), []).append(row["path"])
    return groups


def _header_names(spark: SparkSession, path: str, sep: str) -> list[str]:
    return spark.read.csv(path, sep=sep, header=True, quote='"', escape='"').columns


def read_logs(spark: SparkSession, root: str, suffix: str, sep: str = ";", empty: str = "string",
              same_header: bool = False, multi_line: bool = False) -> DataFrame:
    """All ``*<suffix>.csv`` files below a folder, every column text.

    ``source_path``, ``source_block`` and ``source_row`` give the place of a row in its file.
    They order rows of one time; the row number is taken on the scan, so store the loaded
    log (``write_snapshot``) and work from the snapshot.

    Files are combined by column **name**: files with the same header line are scanned
    together, and the scans are united. ``same_header=True`` skips the header pass; the scan
    then raises on a file with another header. ``NULL`` is missing. An empty cell is an empty
    text, or missing with ``empty="null"``.
    """
    if empty not in ("string", "null"):
        raise ValueError(f"empty must be 'string' or 'null', not {empty!r}")
    glob = {"recursiveFileLookup": True, "pathGlobFilter": f"*{suffix}.csv"}
    options = {"sep": sep, "header": True, "quote": '"', "escape": '"', "multiLine": multi_line,
               "enforceSchema": False, "nullValue": MISSING if empty == "null" else ""}

    def scan(names: Sequence[str], paths, extra) -> DataFrame:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = with_source_path(spark.read.options(**options, **extra).schema(schema).csv(paths))
        df = df.withColumns({"source_block": F.col("_metadata.file_block_start"),
                             "source_row": F.monotonically_increasing_id()})
        if empty == "null":
            return df
        return df.select(*ROW_ORDER[1:], *[F.when(F.col(f"`{n}`").isNull(), "").when(F.col(f"`{n}`") != MISSING, F.col(f"`{n}`"))
                                 .alias(n) for n in names])

    if same_header:
        names = spark.read.options(sep=sep, header=True, quote='"', escape='"', **glob).csv(root).columns
        return scan(names, root, glob)
    groups = _header_groups(spark, root, suffix)
    if not groups:
        raise FileNotFoundError(f"no *{suffix}.csv below {root}")
    return union_by_name(*[scan(_header_names(spark, paths[0], sep), paths, {})
                           for _, paths in sorted(groups.items())])


def relative_path(df: DataFrame, root: str, col: str = PATH) -> DataFrame:
    """Cut the path to what follows the parent of ``root``, so that it starts with the root's name."""
    root = root.rstrip("/")
    anchor = (root if root.startswith("/") or ":/" in root else f"/{root}") + "/"
    plain = _plain_path(as_col(col))
    tail = F.substr(plain, F.instr(plain, anchor) + F.lit(len(anchor)))
    return df.withColumn(col, F.concat(F.lit(root.rsplit("/", 1)[-1] + "/"), tail))


def with_path_columns(df: DataFrame, root: str) -> DataFrame:
    """Path parts ``i0`` to ``i4`` (by ``/``) and ``i5`` to ``i9`` (by ``_``); the path is dropped."""
    df = relative_path(df, root)
    df = path_parts(df, PATH, "_", [f"i{k}" for k in range(5, 10)])
    df = path_parts(df, PATH, "/", [f"i{k}" for k in range(5)])
    return df.drop(PATH)


def preprocess_meta(meta: DataFrame) -> DataFrame:
    return rename_if_present(meta, META_NAMES)


def attach_meta(log: DataFrame, meta: DataFrame, key: str = "SessionID", checked: bool = False) -> DataFrame:
    """Left join of the metadata; a missing key matches a missing key.

    Repeated keys in the metadata would multiply log rows, so they raise (one aggregate
    over the key column; ``checked=True`` skips it).
    """
    if not checked:
        repeated = meta.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if repeated:
            raise ValueError(f"metadata has a repeated {key}")
    return join_null_safe(log, meta, [key])


def load_directory(spark: SparkSession, root: str, event: str = "Event", sample: str = "Sample",
                   meta: str = "Meta", sep: str = ";", **options) -> DataFrame:
    """Events and samples of all sessions below a folder, with the metadata of their session."""
    logs = union_by_name(*[read_logs(spark, root, suffix, sep, **options).withColumn("source_rank", F.lit(rank))
                           for rank, suffix in enumerate((event, sample))])
    metadata = with_path_columns(read_logs(spark, root, meta, sep, **options), root).drop(*ROW_ORDER)
    return attach_meta(logs, preprocess_meta(metadata))


def read_session(spark: SparkSession, meta: str, event: str, sample: str, sep: str = ";") -> DataFrame:
    """One session from three explicit files, types inferred."""
    def read(path):
        return spark.read.csv(path, sep=sep, header=True, inferSchema=True, nullValue=MISSING, quote='"', escape='"')

    return attach_meta(union_by_name(read(event), read(sample)), preprocess_meta(read(meta)))


def typed_log(raw: DataFrame) -> DataFrame:
    """Typed boundary of the loaded log: time, keys and numbers; bad text becomes NULL."""
    names = {"i1": "GameTitle", "i2": "Participant", "i3": "Condition"}
    return raw.withColumnsRenamed(names).withColumns({
        "Timestamp": parse_timestamp("Timestamp"), "Participant": to_number("Participant"),
        "InputWindowOrder": to_number("InputWindowOrder")})
