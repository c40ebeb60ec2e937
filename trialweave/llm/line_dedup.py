"""Line deduplication by site-relative frequency.

A line is boilerplate on its site when the share of the site's pages that contain it exceeds `ratio` and at least
`min_pages` pages contain it. Lines are compared after trimming white space; blank lines are neither counted nor dropped.

Defined results: null text stays null. A null site is a site of its own. A line repeated on one page counts once; copies
of a page and rows that repeat a doc_id are pages of their own. A page whose every line goes keeps an empty text. Other
columns, whatever their names, are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import hot_keys, known_key, split_join

RATIO, MIN_PAGES = 0.02, 5
BLANKS = " \t\r\x0b\x0c"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(BLANKS)).cast("binary")))


def boilerplate_lines(docs: DataFrame, pages: DataFrame, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`_site` and `_boiler`, the digests of its boilerplate lines: at most (mean lines of a page) / ratio of them.

    `docs` has `_site`; `pages` has `_site` and its number of rows `n`.
    """
    filled = F.filter(_lines(text), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    each = docs.select("_site", F.explode(F.array_distinct(F.transform(filled, _digest))).alias("line"))
    found = each.groupBy("_site", "line").agg(F.count("*").alias("found")).where(F.col("found") >= min_pages)
    often = found.join(pages, "_site").where(F.col("found") > F.lit(ratio) * F.col("n"))
    return often.groupBy("_site").agg(F.collect_list("line").alias("_boiler"))


def drop_boilerplate(
    docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """All rows and columns of `docs`, with boilerplate lines cut from `text`, plus `n_lines` and `n_dropped`."""
    columns = docs.columns
    keyed = docs.withColumn("_site", known_key(F.col(site)))
    pages = keyed.groupBy("_site").agg(F.count("*").alias("n"))
    boiler = boilerplate_lines(keyed.select("_site", text), pages, text, ratio, min_pages)
    joined = split_join(keyed, boiler, "_site", hot_keys(pages, "_site"), text)
    stays = F.filter(_lines(text), lambda line: ~F.array_contains(F.col("_boiler"), _digest(line)))
    kept = F.when(F.col("_boiler").isNull(), _lines(text)).otherwise(stays)
    counted = joined.withColumn("_kept", kept).withColumn("n_lines", F.size(_lines(text)))
    cut = counted.withColumn("n_dropped", F.col("n_lines") - F.size("_kept"))
    clean = F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n"))
    return cut.withColumn(text, clean).select(*[c for c in columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
