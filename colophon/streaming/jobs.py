"""The durable job pipeline as streams: deduplication, state, windows, fences, dead letters."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from colophon.operators.messages import instant, message_key
from colophon.operators.skew import numbered_within

# Words of errors that pass by themselves.
TRANSIENT = r"(?i)sqlite_busy|database is locked|\b429\b|\b503\b|rate limit|too many requests|temporarily unavailable|network|storage caused object to be reset|reset because its code was updated"
#: How long a message's state is remembered.
REMEMBER_MS = 7 * 24 * 3600 * 1000
#: What a message can be, in the order in which changes of one time and attempt count.
STATUSES = ("queued", "processing", "deferred", "failed", "succeeded")
ATTEMPTS, BASE_MS, JITTER_MS, DEFER_SECONDS = 5, 25, 25, 60


def events(spark: SparkSession, sf_dir: str, name: str = "events", files_per_batch: int = 20) -> DataFrame:
    """The table ``name`` as a stream of its files; times without zone become instants, as watermarks need them."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        rows = reader.parquet(path)
    else:  # a stream reads folders: the one above, and of it only this file
        rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def window_counts(rows: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts per window and kind; what comes later than ``late`` is dropped."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(rows: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """One row per key among those that arrive within ``late`` of each other; state is bounded by the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there, batch by batch, then stop.  ``each`` gets the batch and its number; written under this number,
    a batch repeated after a failure replaces itself."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def folded(changes: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(key, status, attempts, changed_at) after all changes: the last by time counts, but success is final.

    Both inputs are (key, status, attempts, changed_at); folding the result with later changes gives the same as folding all
    at once, so a micro-batch only meets the keys' last states.
    """
    rows = changes if previous is None else changes.unionByName(previous)
    done = F.when(F.col("status") == "succeeded", 1).otherwise(0)
    last = F.max(F.struct(done.alias("done"), F.col("changed_at").alias("changed_at"), F.col("attempts").alias("attempts"), F.col("status").alias("status"))).alias("s")
    return rows.where("key IS NOT NULL").groupBy("key").agg(last).select("key", "s.status", "s.attempts", "s.changed_at")


def job_changes(jobs: DataFrame) -> DataFrame:
    """(key, status, attempts, changed_at) of rows of the job table."""
    return jobs.select(message_key(F.col("semantic_key")).alias("key"), "status", F.col("attempts").cast("int").alias("attempts"), instant(F.col("queued_at")).alias("changed_at"))


def accepted(changes: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(key, status, attempts, last) of the ``changes`` that ``stateful_claims`` would accept, by windows instead of a Python
    call per key.  ``states`` (key, status) is what keys were before; ``last`` marks what a key is afterwards.

    Along a key's rows nothing follows the first success.  Before it, failed and deferred are accepted after a row that is
    neither (a row of theirs leaves the state with them); queued is accepted first or after failed or deferred; processing
    is accepted unless it came already since the last failed or deferred.  A state before is like a row in front.
    """
    known = F.col("status").isin(*STATUSES)
    rows = changes.where(F.col("key").isNotNull() & known).select("key", "status", "attempts", "changed_at", F.lit(True).alias("_new"))
    if states is not None:
        blank = [F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in ("attempts", "changed_at")]
        rows = rows.unionByName(states.select("key", "status", *blank, F.lit(False).alias("_new")))
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    order = W.partitionBy("key").orderBy("_new", F.asc_nulls_last("changed_at"), F.asc_nulls_last("attempts"), place)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    status, stopped = F.col("status"), ["failed", "deferred"]
    previous = F.lag("status").over(order)
    settled = F.last(F.when(status != "queued", status), ignorenulls=True).over(before)
    done = F.coalesce(F.max(status == "succeeded").over(before), F.lit(False))
    seen = rows.withColumns({"_previous": previous, "_settled": settled, "_done": done})
    after_stop = lambda c: F.col(c).isNull() | F.col(c).isin(*stopped)
    fits = F.when(status == "queued", after_stop("_previous")).when(status == "processing", after_stop("_settled"))
    fits = fits.when(status.isin(*stopped), F.col("_previous").isNull() | ~F.col("_previous").isin(*stopped)).otherwise(True)
    taken = seen.where(~F.col("_done") & fits).withColumn("last", F.lead("status").over(order).isNull())
    return taken.where("_new").select("key", "status", F.coalesce("attempts", F.lit(0)).alias("attempts"), "last")


def write_accepted(changes: DataFrame, number: int, path: str) -> None:
    """Write the accepted rows of micro-batch ``number`` under ``path``, for ``run_available``.

    What a key was before is its last row of the latest batch before this one that wrote any; so nothing else is kept, and a
    batch repeated after a failure reads and writes the same.
    """
    states = None
    if number:
        written = changes.sparkSession.read.schema("key string, status string, last boolean, batch int").parquet(path)
        states = written.where(F.col("last") & (F.col("batch") < number)).groupBy("key").agg(F.max_by("status", "batch").alias("status"))
    accepted(changes, states).write.mode("overwrite").parquet(f"{path}/batch={number}")


def stateful_claims(changes: DataFrame, remember_ms: int | None = None) -> DataFrame:
    """Stream of accepted transitions (key, status, attempts): a custom stateful operator.

    queued may become processing, processing may become succeeded, failed or deferred, failed and deferred may be queued again;
    nothing follows success.  Any other change is refused and not emitted.  State is one status per key, forgotten once no
    change came for ``remember_ms`` (``REMEMBER_MS`` suits a stream that never ends).  A run that takes what is there and stops must pass
    None and forget nothing, as a query that waits for timeouts never has nothing left to do.  Arrow hands a key's
    rows over in slices, so the key's whole micro-batch is kept, at some 17 bytes a row, and sorted by time before it is folded.
    Each key of a batch costs a Python call; where nothing is to be forgotten, ``write_accepted`` gives the same without.
    """
    allowed = {None: {"queued", "processing", "succeeded", "failed", "deferred"}, "queued": {"processing", "succeeded", "failed", "deferred"}, "processing": {"succeeded", "failed", "deferred"}, "failed": {"queued", "processing", "succeeded"}, "deferred": {"queued", "processing", "succeeded"}, "succeeded": set()}

    codes = {name: i for i, name in enumerate(STATUSES)}

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status = state.get[0] if state.exists else None
        slices = []
        for batch in batches:
            kinds = np.array([codes.get(s, -1) for s in batch["status"].tolist()], dtype="int8")
            times = batch["changed_at"].to_numpy().astype("datetime64[ns]")
            times = np.where(np.isnat(times), np.iinfo("int64").max, times.astype("int64"))  # those without come last
            attempts = batch["attempts"].to_numpy(dtype="float64", na_value=np.nan)
            slices.append((kinds, times, attempts))
        kinds, times, attempts = (np.concatenate(x) for x in zip(*slices))
        out = []
        for i in np.lexsort((kinds, attempts, times)).tolist():
            name = STATUSES[kinds[i]] if kinds[i] >= 0 else None
            if name in allowed.get(status, set()):
                status = name
                out.append((key[0], status, 0 if np.isnan(attempts[i]) else int(attempts[i])))
        if status is not None:
            state.update((status,))
            if remember_ms is not None:
                state.setTimeoutDuration(remember_ms)
        yield pd.DataFrame(out, columns=["key", "status", "attempts"])

    timeout = GroupStateTimeout.NoTimeout if remember_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return changes.where("key IS NOT NULL").groupBy("key").applyInPandasWithState(run, "key string, status string, attempts int", "status string", "append", timeout)


def retry_class(error: Column, attempts: Column, most: int = 3) -> Column:
    """retry for passing errors with attempts left, defer for passing errors without, dead for all others; null without error."""
    passing = error.rlike(TRANSIENT)
    return F.when(error.isNull(), None).when(passing & (F.coalesce(attempts, F.lit(0)) < most), "retry").when(passing, "defer").otherwise("dead")


def with_retries(operation: Callable, attempts: int = ATTEMPTS, base_ms: int = BASE_MS, jitter_ms: int = JITTER_MS, sleep: Callable[[float], None] = time.sleep):
    """Call ``operation``; after a passing error again, each pause twice the one before plus a random part."""
    import re

    for attempt in range(1, attempts + 1):
        try:
            return operation()
        except Exception as error:
            if attempt == attempts or not re.search(TRANSIENT, str(error)):
                raise
            sleep((base_ms * 2 ** (attempt - 1) + random.uniform(0, jitter_ms)) / 1000)


def newest_generation(rows: DataFrame, generation: str = "run_id", started: str = "queued_at", by: str = "kind") -> DataFrame:
    """Rows of the run of each kind that began last; a slower, older run can't overwrite a newer one's results."""
    starts = rows.groupBy(by, generation).agg(F.min(instant(F.col(started))).alias("_start"))
    newest = starts.groupBy(by).agg(F.max_by(generation, F.struct("_start", generation)).alias(generation))
    return rows.join(newest, [by, generation], "left_semi")


def dead_letters(rows: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, rows for the dead letter store)."""
    verdict = retry_class(F.col("error"), F.col("attempts"), most)
    judged = rows.withColumn("verdict", F.when(F.col("status") == "failed", F.coalesce(verdict, F.lit("dead"))))
    return judged.where("verdict IS NULL OR verdict <> 'dead'"), judged.where("verdict = 'dead'")


def over_limit(rows: DataFrame, user: str, at: str, most: int, width: str = "60 seconds") -> DataFrame:
    """(user, start, n): windows in which a user exceeds ``most`` events."""
    counts = rows.groupBy(F.col(user).alias("user"), F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).select("user", F.col("w.start").alias("start"), "n")


def paced(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """``rows`` with ``batch``: numbers of ``size`` rows within ``group``, which may hold any part of all rows."""
    numbered = numbered_within(rows, [group], [order], "_place")
    return numbered.withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters' codes, as eight hexadecimal digits; null of null."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    step = lambda h, c: ((h.bitwiseXOR(c.cast("long"))) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    value = F.aggregate(codes, F.lit(2166136261).cast("long"), step)
    return F.when(text.isNotNull(), F.lower(F.lpad(F.hex(value), 8, "0")))


def ready_to_finish(rows: DataFrame, run: str = "run_id", final_kind: str = "topic-finalize-rebuild") -> DataFrame:
    """(run): runs that have jobs, none of them open, and no finishing job of their own yet: two anti joins."""
    open_jobs = rows.where(F.col("status").isin("queued", "processing", "deferred") & (F.col("kind") != final_kind)).select(run).distinct()
    finishing = rows.where(F.col("kind") == final_kind).select(run).distinct()
    runs = rows.where(F.col(run).isNotNull()).select(run).distinct()
    return runs.join(open_jobs, run, "left_anti").join(finishing, run, "left_anti")


def claimed(table: DataFrame, claims: DataFrame) -> DataFrame:
    """``table`` (id, status, attempts, ...) after compare-and-set: a row becomes processing, with one attempt more, if a claim
    (id, expected, attempts) saw the status and attempts that it still has; of several claims one counts.  For use within
    ``foreachBatch``, where table and claims are read at one point."""
    seen = claims.select(F.col("id").alias("_id"), F.col("expected").alias("_expected"), F.col("attempts").alias("_attempts")).distinct()
    hit = (F.col("id") == F.col("_id")) & (F.col("status") == F.col("_expected")) & F.col("attempts").eqNullSafe(F.col("_attempts"))
    won = F.col("_id").isNotNull()
    joined = table.join(seen, hit, "left")
    new = {"status": F.when(won, F.lit("processing")).otherwise(F.col("status")), "attempts": F.when(won, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts"))}
    return joined.withColumns(new).select(table.columns)


def never_sent(rows: DataFrame, least_age: str = "1 hour") -> DataFrame:
    """Rows of the outbox that were written but not handed over: queued, never started, and older than the newest row by
    ``least_age``."""
    at = rows.withColumn("_at", instant(F.col("queued_at")))
    newest = at.agg(F.max("_at").alias("_newest"))
    waiting = at.where("status = 'queued' AND started_at IS NULL AND _at IS NOT NULL").join(F.broadcast(newest))
    return waiting.where(F.col("_at") < F.col("_newest") - F.expr(f"INTERVAL {least_age}")).drop("_at", "_newest")


def replayed(letters: DataFrame) -> DataFrame:
    """Dead letters as jobs queued anew: no attempts, error or times of the earlier life, and the identifier of a replay."""
    blank = {c: F.lit(None).cast(letters.schema[c].dataType) for c in ("error", "started_at", "completed_at") if c in letters.columns}
    return letters.withColumns({"id": F.concat("id", F.lit(":replay")), "status": F.lit("queued"), "attempts": F.lit(0), **blank}).drop("verdict")
