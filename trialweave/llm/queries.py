"""The registered queries of this subpackage and their check queries (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialweave.llm import (
    alignment,
    conversations,
    decontaminate,
    exact_dedup,
    kneser_ney,
    line_dedup,
    ordinal,
    pii,
    pivotal,
    secret_scan,
    simhash,
    superminhash,
    wrapper,
)
from trialweave.llm.common import span_columns, table


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pivotal.pivotal_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal.with_severity(docs, model).drop("text")


def personal_data_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_columns(pii.find_personal_data(table(spark, sf_dir, "documents")), pii.KINDS, "doc_id")


def extraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_columns(secret_scan.find_secrets(table(spark, sf_dir, "documents")), secret_scan.KINDS, "doc_id")


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_components(table(spark, sf_dir, "documents"))


def conversation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup_query,
    "op2_decontaminate": decontaminate_query,
    "op3_extract": extraction_query,
    "op4_secrets": secrets_query,
    "op5_quality": quality_query,
    "op6_exact_dedup": exact_dedup_query,
    "op7_simhash": simhash_query,
    "op8_mix": mix_query,
    "op9_toxicity": toxicity_query,
    "op10_personal_data": personal_data_query,
    "op11_superminhash": near_dedup_query,
    "op12_conversations": conversation_query,
    "op13_alignment": alignment_query,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": """
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT page, source, n, ls[n] AS line, trim(ls[n], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare
          FROM (SELECT page, source, ls, unnest(range(1, len(ls) + 1)) AS n FROM pages)),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
found AS (SELECT source, bare, count(DISTINCT page) AS n FROM lines WHERE bare <> '' GROUP BY source, bare),
boiler AS (SELECT found.source, bare FROM found JOIN totals ON found.source IS NOT DISTINCT FROM totals.source
           WHERE found.n >= 5 AND found.n > 0.02 * totals.n),
kept AS (SELECT page, string_agg(line, chr(10) ORDER BY n) AS text, count(*) AS n FROM lines
         WHERE NOT EXISTS (SELECT 1 FROM boiler WHERE boiler.source IS NOT DISTINCT FROM lines.source AND boiler.bare = lines.bare)
         GROUP BY page)
SELECT doc_id, source, CASE WHEN pages.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(len(ls) AS INTEGER) AS n_lines, CAST(len(ls) - coalesce(kept.n, 0) AS INTEGER) AS n_dropped
FROM pages LEFT JOIN kept ON kept.page = pages.page""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g""",
}
