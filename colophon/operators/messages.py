"""Messages delivered more than once: keep one copy of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.operators.skew import HOT_ROWS, SALTS, salted

_KEY, _AT = "_message_key", "_message_at"


def message_key(raw: Column) -> Column:
    """The identifier that copies share: without spaces, tabs and line ends at both ends, in lower case."""
    return F.lower(F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def instant(raw: Column) -> Column:
    """A point in time from ISO text with or without offset and milliseconds, a space or ``T`` between date and time, or
    epoch milliseconds; text without a zone is UTC whatever the session's zone.  Null if it can't be read."""
    text = F.trim(raw)
    zoned = F.when(text.rlike(r"(?i)(z|utc|gmt|[+-]\d{2}:?\d{2})$") & text.contains(":"), text).otherwise(F.concat(text, F.lit("Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(zoned, r"[zZ]$", "+00:00").try_cast("timestamp"))
    epoch = F.when(text.rlike(r"^[+-]?\d{1,17}$"), F.timestamp_millis(text.try_cast("long")))
    return F.coalesce(epoch, iso)


def _numbered(
    stored: DataFrame, new: DataFrame | None, key: str, queued_at: str, row_id: str, hot_rows: int, salts: int
) -> tuple[DataFrame, DataFrame]:
    """(singletons, ranked): rows alone under their identifier, and all others with ``_place`` (1: the copy to keep)."""
    rows = stored if new is None else stored.unionByName(new, allowMissingColumns=True)
    rows = rows.withColumns({_KEY: message_key(F.col(key)), _AT: instant(F.col(queued_at))})
    counts = rows.where(F.col(_KEY).isNotNull()).groupBy(_KEY).agg(F.count(F.lit(1)).alias("_copies"))
    repeated = counts.where(F.col("_copies") > 1)
    hot = hot_keys_from(counts, hot_rows)
    spread = [F.col(row_id), F.col(_AT)]
    by_salt = salted(rows, [_KEY], hot, spread, salts)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    marks = repeated.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), _KEY, "left").select(_KEY, F.explode(every).alias("_salt"))
    singletons = by_salt.join(marks, [_KEY, "_salt"], "left_anti").drop("_salt", "_hot")
    groups = by_salt.join(marks, [_KEY, "_salt"], "left_semi")
    order = [F.col(_AT).asc_nulls_last(), F.col(row_id).asc_nulls_last()]
    groups = groups.withColumn("_place", F.row_number().over(W.partitionBy(_KEY, "_salt").orderBy(*order)))
    # Of a hot identifier each salt sends its first row only: salts rows at most meet in one task.
    ordinary = groups.where(F.col("_hot").isNull())
    beaten = groups.where(F.col("_hot") & (F.col("_place") > 1))
    firsts = groups.where(F.col("_hot") & (F.col("_place") == 1))
    firsts = firsts.withColumn("_place", F.row_number().over(W.partitionBy(_KEY).orderBy(*order)))
    ranked = ordinary.unionByName(beaten).unionByName(firsts)
    return singletons, ranked.drop("_salt", "_hot")


def hot_keys_from(counts: DataFrame, hot_rows: int, max_hot: int = 1024) -> DataFrame:
    """The identifiers with at least ``hot_rows`` copies, ``max_hot`` at most."""
    return counts.where(F.col("_copies") >= hot_rows).orderBy(F.desc("_copies"), _KEY).limit(max_hot).select(_KEY)


def keep_one(
    stored: DataFrame,
    new: DataFrame | None = None,
    key: str = "semantic_key",
    queued_at: str = "queued_at",
    row_id: str = "id",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Exactly one row per message of ``stored`` and ``new`` together, with all its columns.

    Identifiers are counted first.  A row alone under its identifier passes as it is; only the rows of repeated
    identifiers are ranked, by instant (unreadable or null last), then ``row_id``; both results are united.  A null
    identifier belongs to no message: such rows all stay.  Columns that one input lacks are null.  Rows alike in
    everything leave one copy.  Empty tables give an empty result.
    """
    singletons, ranked = _numbered(stored, new, key, queued_at, row_id, hot_rows, salts)
    return singletons.drop(_KEY, _AT).unionByName(ranked.where(F.col("_place") == 1).drop("_place", _KEY, _AT))


def redundant_copies(
    stored: DataFrame,
    new: DataFrame | None = None,
    key: str = "semantic_key",
    queued_at: str = "queued_at",
    row_id: str = "id",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """The rows that :func:`keep_one` leaves out, with all their columns."""
    _, ranked = _numbered(stored, new, key, queued_at, row_id, hot_rows, salts)
    return ranked.where(F.col("_place") > 1).drop("_place", _KEY, _AT)
