"""Exact deduplication with a heavy-hitter split.

Defined results: null text counts as empty, and empty texts are equal to each other. A null doc_id ranks behind every
other one. Rows that repeat a doc_id count as rows of their group; of rows that tie in length and id one stays. Other columns are
not read.
An empty table gives an empty result. Texts of any length are hashed in one piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import stored

#: Counters of a Misra-Gries summary; at most this many digests are broadcast (about 100 bytes each).
COUNTERS = 1024


def digests(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest of the text without white space, code points of the whole text, a number of the row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    return docs.select(F.col(doc).alias("doc_id"), F.unhex(F.sha2(bare, 256)).alias("digest"), F.char_length(whole).alias("n_chars"), F.monotonically_increasing_id().alias("row"))


def misra_gries(counters: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A summary of the digests of one partition, merged batch by batch: no count is low by more than rows / (counters + 1)."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for found in pc.value_counts(batch.column(0)).to_pylist():
                held[found["values"]] = held.get(found["values"], 0) + found["counts"]
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: n - cut for k, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "low"])

    return summarise


def heavy_digests(table: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them each that more than 2 / (counters + 1) of the rows have.

    Summed over partitions a summary is low by at most rows / (counters + 1), and all counters sum to at most the rows.
    """
    rows = table.count()
    summed = table.select("digest").mapInArrow(misra_gries(counters), "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    return summed.where(F.col("low") * (counters + 1) > rows).select("digest")


def exact_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The longest original stays, then the smallest id."""
    table = stored(digests(docs, doc, text))
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "row"))
    frequent = F.broadcast(heavy_digests(table, counters))
    heavy = stored(table.join(frequent, "digest").groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")))
    marked = table.join(F.broadcast(heavy), "digest", "left")
    rest = marked.where("group_size is null").select(*table.columns)
    light = rest.join(rest.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")), "digest")
    both = marked.where("group_size is not null").unionByName(light)
    keep = F.col("best.id")
    return both.select(
        "doc_id", keep.alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
