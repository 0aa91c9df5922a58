"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import gc
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings a cluster run wants; a session that exists already keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "colophon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``; ``conf`` overrides them (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; where it is unset, a folder of this machine, in local mode only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="colophon-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Stored:
    """A table in the checkpoint folder, and what was observed while it was written."""

    frame: DataFrame
    path: str
    observed: dict = field(default_factory=dict)

    def discard(self) -> None:
        """Delete the table, which no later plan may read."""
        context = self.frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, *kept: str, **metrics: str) -> Stored:
    """Write ``df`` as a table into the checkpoint folder and read it from there, in one job that also gives ``metrics``.

    Of use in iterations: a checkpoint computes its last stage twice and leaves its removal to the driver's garbage
    collector, while a stored step is deleted as soon as the next one stands.  ``kept`` names the columns to write, all by
    default; ``metrics`` are aggregates over ``df`` in SQL.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    watch = Observation() if metrics else None
    watched = df.observe(watch, *[F.expr(m).alias(name) for name, m in metrics.items()]) if metrics else df
    written = watched.select(*kept) if kept else watched
    written.write.parquet(path)
    return Stored(spark.read.schema(written.schema).parquet(path), path, watch.get if metrics else {})


def release(spark: SparkSession) -> None:
    """Have the driver collect garbage: only then does Spark remove the checkpoints and broadcasts of earlier rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
