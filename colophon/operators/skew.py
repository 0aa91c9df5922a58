"""Joins, ranks and prefix sums that stay distributed when one key holds a large part of all rows.

Hot keys are found by an aggregate that combines before its shuffle.  At most ``max_hot`` of them are ever broadcast, so
the broadcast is bounded whatever the input; a key that is not among them holds fewer than a ``1/max_hot`` part of the
rows and is handled by the ordinary shuffle.  Results never depend on which keys are hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from colophon.session import stored

HOT_ROWS = 200_000
MAX_HOT = 1024
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """The keys with at least ``hot_rows`` rows, largest first, ``max_hot`` at most; keys with a null never count."""
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") >= hot_rows).orderBy(F.desc("_rows"), *keys).limit(max_hot).select(*keys)


def salted(df: DataFrame, keys: Sequence[str], hot: DataFrame, spread: Sequence[Column], salts: int = SALTS) -> DataFrame:
    """``df`` with ``_salt``: a hash of ``spread`` for rows of hot keys, 0 for all others."""
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), list(keys), "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    return marked.withColumn("_salt", salt)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose left side may hold any number of rows of one key.

    ``right`` should hold few rows per key: those of hot keys are repeated ``salts`` times.  ``spread`` names the left
    columns whose hash spreads a hot key (all columns by default); ``hot`` may give the hot keys if the caller knows them.
    ``how`` is inner, left, left_semi or left_anti.  Null keys match nothing and stay where the join type keeps them.
    """
    keys = list(keys)
    hot = hot_keys(left, keys, hot_rows) if hot is None else hot
    spread_columns = [F.col(c) for c in (spread or left.columns)]
    left = salted(left, keys, hot, spread_columns, salts).drop("_hot")
    right = right.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def numbered_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... within ``group`` along ``order`` (columns that tell the rows of a group apart).

    No task holds a group: rows are split into ranges of group and order, written down with the number of their range, and
    numbered within it, after the rows that the group has in earlier ranges.  Nulls in ``group`` form a group.
    """
    group = list(group)
    ranges = stored(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())).frame
    counts = ranges.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_range")) - F.col("_n")
    starts = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_range").alias("_g_range"), before.alias("_before"))
    inside = F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_g_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = ranges.withColumn("_inside", inside).join(starts, same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(out))


def rank_within(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    out: str,
    ascending: bool = True,
    hot_rows: int = HOT_ROWS,
    max_hot: int = MAX_HOT,
    splits: int = 64,
) -> DataFrame:
    """``rank()`` of ``score`` within ``group`` (ties share the best rank); null scores get a null rank.

    Groups of fewer than ``hot_rows`` scores are ranked by one window.  For a larger group the counts of its distinct
    scores are cut into ``splits`` ranges by approximate quantiles, of which the driver holds ``max_hot * splits`` numbers
    at most; each range is ranked by itself, starting after the rows of the ranges before it.  The ranks are exact in
    both cases.
    """
    group = list(group)
    order = F.col(score).asc() if ascending else F.col(score).desc()
    plain = W.partitionBy(*group).orderBy(order)
    scored, blank = df.where(F.col(score).isNotNull()), df.where(F.col(score).isNull()).withColumn(out, F.lit(None).cast("long"))
    sizes = scored.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= hot_rows)
    hot = sizes.orderBy(F.desc("_rows"), *group).limit(max_hot).select(*group).dropna().collect()
    if not hot:
        return scored.withColumn(out, F.rank().over(plain).cast("long")).unionByName(blank)
    spark = df.sparkSession
    quantiles = F.percentile_approx(score, F.array(*[F.lit(i / splits) for i in range(1, splits)]), F.lit(10_000))
    wanted = F.broadcast(spark.createDataFrame(hot, scored.select(*group).schema))
    found = scored.join(wanted, group, "left_semi").groupBy(*group).agg(quantiles.alias("_cuts")).collect()
    schema = scored.select(*group).schema.add("_cuts", ArrayType(scored.schema[score].dataType))
    cuts = F.broadcast(spark.createDataFrame([[*[r[g] for g in group], sorted(set(r["_cuts"]))] for r in found], schema))
    counts = scored.join(cuts, group).groupBy(*group, score, "_cuts").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col(score)))).drop("_cuts")
    ranges = counts.groupBy(*group, "_range").agg(F.sum("_n").alias("_rows"))
    by_range = W.partitionBy(*group).orderBy(F.col("_range").asc() if ascending else F.col("_range").desc())
    ranges = ranges.withColumn("_before", F.sum("_rows").over(by_range) - F.col("_rows")).drop("_rows")
    inside = W.partitionBy(*group, "_range").orderBy(order)
    values = counts.withColumn("_upto", F.sum("_n").over(inside)).join(F.broadcast(ranges), [*group, "_range"])
    values = values.select(*group, score, (F.col("_before") + F.col("_upto") - F.col("_n") + 1).alias(out))
    large = skew_join(scored.join(cuts.drop("_cuts"), group, "left_semi"), values, [*group, score], "inner", hot_rows=hot_rows)
    small = scored.join(cuts.drop("_cuts"), group, "left_anti").withColumn(out, F.rank().over(plain).cast("long"))
    columns = [*df.columns, out]
    return large.select(columns).unionByName(small.select(columns)).unionByName(blank.select(columns))
