"""Sinks as queries: the rows a table holds after an upsert, a partial update, a replacement or a deletion.

Each takes the table and the change and gives the new table, to be written beside the old one and swapped in; partitioned
tables are written by :func:`overwrite_partitions`, which touches only the partitions that occur in the change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.operators.skew import skew_join


def upserted(table: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """``table`` with ``changes`` (one row per key): new keys inserted, of known keys the ``update`` columns replaced."""
    new = changes.select([F.col(c).alias(f"_new_{c}") for c in table.columns])
    match = [F.col(k) == F.col(f"_new_{k}") for k in keys]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    joined = table.withColumn("_old", F.lit(True)).join(new.withColumn("_changed", F.lit(True)), condition, "full")
    old, changed = F.col("_old").isNotNull(), F.col("_changed").isNotNull()
    value = lambda c: F.when(old & changed, F.col(f"_new_{c}" if c in update else c)).when(changed, F.col(f"_new_{c}")).otherwise(F.col(c))
    return joined.select([value(c).alias(c) for c in table.columns])


def partially_updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` that are not null replace those of ``table``; unknown keys change nothing."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, key, "left")
    return joined.select([F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that occur in ``rows`` replaced by these."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def fenced_edges(edges: DataFrame, snapshot: DataFrame, vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges (keyword_a, keyword_b, ...) after an incremental rebuild.

    ``snapshot`` and ``vectors`` are (keyword, version) as read before and as they stand now.  Edges whose both ends are
    unchanged since the snapshot are replaced by ``fresh`` ones; fresh edges with an end that changed meanwhile are dropped.
    A keyword may be in any number of edges: the joins salt hot ones.
    """
    stable = snapshot.join(vectors, ["keyword", "version"], "left_semi").select("keyword").distinct()

    def marked(rows: DataFrame) -> DataFrame:
        for end, other in (("keyword_a", "keyword_b"), ("keyword_b", "keyword_a")):
            known = stable.select(F.col("keyword").alias(end), F.lit(True).alias(f"_stable_{end}"))
            rows = skew_join(rows, known, [end], "left", [other])
        return rows.withColumn("_stable", F.coalesce(F.col("_stable_keyword_a") & F.col("_stable_keyword_b"), F.lit(False)))

    kept = marked(edges).where(~F.col("_stable")).select(edges.columns)
    return kept.unionByName(marked(fresh).where("_stable").select(edges.columns))


def overwrite_partitions(rows: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write ``rows`` over the partitions they touch; all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
