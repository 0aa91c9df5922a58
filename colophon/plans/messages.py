"""Queries on messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators import messages
from colophon.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered row that is not the kept copy of its message."""
    jobs = table(spark, sf_dir, "pipeline_jobs").select("id", "semantic_key", "queued_at")
    return messages.redundant_copies(jobs).select("id")


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message, with its run and status."""
    jobs = table(spark, sf_dir, "pipeline_jobs").select("id", "run_id", "semantic_key", "queued_at", "status")
    return messages.keep_one(jobs).select("id", "run_id", "semantic_key", "status")


def p1_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message of stored and new rows together; the jobs of one kind have just arrived, without their status."""
    jobs = table(spark, sf_dir, "pipeline_jobs").select("id", "run_id", "kind", "semantic_key", "queued_at", "status")
    late = F.coalesce(F.col("kind") == "embed-corpus-topics", F.lit(False))
    kept = messages.keep_one(jobs.where(~late), jobs.where(late).drop("status"))
    return kept.select("id", "semantic_key", "status")


QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept, "p1_arrivals": p1_arrivals}

_SQL = r"""
WITH j AS (SELECT id, run_id, kind, semantic_key, status, lower(regexp_replace(semantic_key, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) AS k,
    CASE WHEN regexp_matches(queued_at, '^[0-9]+$') THEN make_timestamp(CAST(queued_at AS BIGINT) * 1000)
         WHEN regexp_matches(queued_at, '([+-][0-9]{2}:[0-9]{2}|Z)$') THEN CAST(queued_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
         ELSE TRY_CAST(queued_at AS TIMESTAMP) END AS moment FROM pipeline_jobs),
p AS (SELECT *, CASE WHEN k IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY k ORDER BY moment NULLS LAST, id) END AS place FROM j)
"""
ORACLES = {
    "p1_found": _SQL + "SELECT id FROM p WHERE place > 1",
    "p1_kept": _SQL + "SELECT id, run_id, semantic_key, status FROM p WHERE place = 1",
    "p1_arrivals": _SQL + "SELECT id, semantic_key, CASE WHEN coalesce(kind = 'embed-corpus-topics', false) THEN NULL ELSE status END AS status FROM p WHERE place = 1",
}
