"""Queries on the job table and the event stream; streams run over what is there and stop."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.plans.base import Queries
from colophon.session import ensure_checkpoint_dir
from colophon.sources.tables import table
from colophon.streaming import jobs

Q = Queries()


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


_WINDOWS_SQL = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@Q.add(_WINDOWS_SQL)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and kind, in one batch."""
    return jobs.window_counts(table(spark, sf_dir, "events")).select(F.col("w.start").alias("start"), "event_type", "n")


@Q.add(_WINDOWS_SQL)
def event_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: every update of a window is written under its batch, the last one counts."""
    out = _folder(spark, "windows")
    stream = jobs.window_counts(jobs.events(spark, sf_dir))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    jobs.run_available(stream, write, f"{out}/state", "update")
    rows = spark.read.schema("start timestamp_ntz, event_type string, n long, batch int").parquet(f"{out}/rows")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


@Q.add("SELECT DISTINCT user_id, event_type FROM events")
def first_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of events, once each: the stream drops what repeats within a day and forgets older keys, what returns
    later is dropped where the rows are read."""
    out = _folder(spark, "first")
    rows = jobs.events(spark, sf_dir).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    stream = jobs.deduplicated(rows, "key", "ts", "1 day")
    jobs.run_available(stream, lambda batch, n: batch.select("user_id", "event_type").write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/state")
    return spark.read.schema("user_id long, event_type string, batch int").parquet(f"{out}/rows").select("user_id", "event_type").distinct()


@Q.add("SELECT user_id AS user, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def busy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users over a rate limit, and when."""
    return jobs.over_limit(table(spark, sf_dir, "events"), "user_id", "ts", 2, "6 hours")


_INSTANT_SQL = r"""CASE WHEN regexp_matches(queued_at, '^[0-9]+$') THEN make_timestamp(CAST(queued_at AS BIGINT) * 1000)
    WHEN regexp_matches(queued_at, '([+-][0-9]{2}:[0-9]{2}|Z)$') THEN CAST(queued_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE TRY_CAST(queued_at AS TIMESTAMP) END"""
_KEY_SQL = r"lower(regexp_replace(semantic_key, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'))"


@Q.add(
    f"""SELECT key, status, attempts FROM (SELECT {_KEY_SQL} AS key, status, attempts, {_INSTANT_SQL} AS changed FROM pipeline_jobs WHERE semantic_key IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END DESC, changed DESC NULLS LAST, attempts DESC NULLS LAST, status DESC) = 1"""
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every message: its last one, success being final."""
    return jobs.folded(jobs.job_changes(table(spark, sf_dir, "pipeline_jobs"))).select("key", "status", "attempts")


@Q.add()
def job_claims_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted transitions of every message, folded batch by batch."""
    out = _folder(spark, "claims")
    stream = jobs.job_changes(jobs.events(spark, sf_dir, "pipeline_jobs"))
    jobs.run_available(stream, lambda batch, n: jobs.write_accepted(batch, n, f"{out}/rows"), f"{out}/state")
    return spark.read.schema("key string, status string, attempts int, batch int").parquet(f"{out}/rows").select("key", "status", "attempts")


@Q.add(
    f"""SELECT id, CASE WHEN error IS NULL THEN NULL WHEN regexp_matches(error, '{jobs.TRANSIENT}') AND coalesce(attempts, 0) < 3 THEN 'retry' WHEN regexp_matches(error, '{jobs.TRANSIENT}') THEN 'defer' ELSE 'dead' END AS verdict FROM pipeline_jobs WHERE status = 'failed'"""
)
def retry_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pipeline_jobs").where("status = 'failed'")
    return rows.select("id", jobs.retry_class(F.col("error"), F.col("attempts")).alias("verdict"))


@Q.add(f"SELECT id FROM pipeline_jobs WHERE status = 'failed' AND NOT coalesce(regexp_matches(error, '{jobs.TRANSIENT}'), false)")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that failed for good, for inspection and replay."""
    return jobs.dead_letters(table(spark, sf_dir, "pipeline_jobs"))[1].select("id")


@Q.add(
    f"""WITH s AS (SELECT kind, run_id, min({_INSTANT_SQL}) AS start FROM pipeline_jobs WHERE kind IS NOT NULL AND run_id IS NOT NULL GROUP BY 1, 2), n AS (SELECT kind, run_id FROM s QUALIFY row_number() OVER (PARTITION BY kind ORDER BY start DESC NULLS LAST, run_id DESC) = 1)
SELECT id FROM pipeline_jobs SEMI JOIN n USING (kind, run_id)"""
)
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the run of each kind that began last."""
    return jobs.newest_generation(table(spark, sf_dir, "pipeline_jobs").select("id", "kind", "run_id", "queued_at")).select("id")


@Q.add(
    """SELECT kind, count(*) AS jobs, round(avg(epoch_ms(CAST(completed_at AS TIMESTAMPTZ)) - epoch_ms(CAST(started_at AS TIMESTAMPTZ))) / 1000.0, 3) AS mean_seconds FROM pipeline_jobs WHERE started_at LIKE '____-__-__T%Z' AND completed_at LIKE '____-__-__T%Z' GROUP BY 1"""
)
def phase_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the jobs of each kind ran."""
    whole = lambda c: F.col(c).rlike(r"^\d{4}-\d\d-\d\dT.*Z$")
    rows = table(spark, sf_dir, "pipeline_jobs").where(whole("started_at") & whole("completed_at"))
    ran = F.unix_millis(jobs.instant(F.col("completed_at"))) - F.unix_millis(jobs.instant(F.col("started_at")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("jobs"), F.round(F.avg(ran) / 1000.0, 3).alias("mean_seconds"))


@Q.add(
    """SELECT DISTINCT correlation_id FROM pipeline_jobs j WHERE correlation_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM pipeline_jobs o WHERE o.correlation_id = j.correlation_id AND o.kind <> 'topic-finalize-rebuild' AND o.status IN ('queued', 'processing', 'deferred'))
AND NOT EXISTS (SELECT 1 FROM pipeline_jobs f WHERE f.correlation_id = j.correlation_id AND f.kind = 'topic-finalize-rebuild')"""
)
def runs_to_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of jobs (by correlation) without open ones that nothing finishes yet."""
    return jobs.ready_to_finish(table(spark, sf_dir, "pipeline_jobs").select("correlation_id", "kind", "status"), "correlation_id")


@Q.add("SELECT id, CASE WHEN status = 'queued' AND coalesce(attempts, 0) <= 1 THEN 'processing' ELSE status END AS status, CASE WHEN status = 'queued' AND coalesce(attempts, 0) <= 1 THEN coalesce(attempts, 0) + 1 ELSE attempts END AS attempts FROM pipeline_jobs")
def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table after a worker claimed what it saw as queued; rows seen with a stale number of attempts are not its own."""
    rows = table(spark, sf_dir, "pipeline_jobs").select("id", "status", "attempts")
    queued = rows.where("status = 'queued'").select("id", F.lit("queued").alias("expected"), F.when(F.coalesce("attempts", F.lit(0)) <= 1, F.col("attempts")).otherwise(F.col("attempts") - 1).alias("attempts"))
    return jobs.claimed(rows, queued)


@Q.add(f"WITH j AS (SELECT *, {_INSTANT_SQL} AS moment FROM pipeline_jobs) SELECT id FROM j WHERE status = 'queued' AND started_at IS NULL AND moment < (SELECT max(moment) FROM j) - INTERVAL 1 HOUR")
def unsent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued jobs that nobody took, to be handed over again."""
    return jobs.never_sent(table(spark, sf_dir, "pipeline_jobs").select("id", "status", "queued_at", "started_at")).select("id")


@Q.add(f"SELECT id || ':replay' AS id, 'queued' AS status, 0 AS attempts, CAST(NULL AS VARCHAR) AS error, semantic_key FROM pipeline_jobs WHERE status = 'failed' AND NOT coalesce(regexp_matches(error, '{jobs.TRANSIENT}'), false)")
def replayed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters queued anew."""
    rows = table(spark, sf_dir, "pipeline_jobs").select("id", "status", "attempts", "error", "semantic_key")
    return jobs.replayed(jobs.dead_letters(rows)[1])


@Q.add(
    """WITH c AS (SELECT id, list_transform(list_filter(string_split(semantic_key, ''), lambda c: c <> ''), lambda c: CAST(ascii(c) AS BIGINT)) AS codes FROM pipeline_jobs WHERE semantic_key IS NOT NULL)
SELECT id, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, codes), lambda h, c: (xor(h, c) * 16777619) & 4294967295))), 8, '0') AS fnv FROM c"""
)
def key_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of every message identifier, as the job table's keys are named."""
    rows = table(spark, sf_dir, "pipeline_jobs").where("semantic_key IS NOT NULL")
    return rows.select("id", jobs.fnv1a(F.col("semantic_key")).alias("fnv"))


@Q.add("SELECT run_id, count(*) AS batches, CAST(sum(CAST(json_extract(payload_json, '$.size') AS BIGINT)) AS BIGINT) AS size FROM pipeline_jobs WHERE status = 'succeeded' AND run_id IS NOT NULL AND json_extract(payload_json, '$.size') IS NOT NULL GROUP BY 1")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a run's jobs put together from their JSON."""
    rows = table(spark, sf_dir, "pipeline_jobs").where("status = 'succeeded' AND run_id IS NOT NULL")
    parsed = rows.select("run_id", F.from_json("payload_json", "size long")["size"].alias("size")).where("size IS NOT NULL")
    return parsed.groupBy("run_id").agg(F.count(F.lit(1)).alias("batches"), F.sum("size").alias("size"))


QUERIES, ORACLES = Q.functions, Q.sql
