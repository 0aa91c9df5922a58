"""One ranking from several scores of different scale: robust rank aggregation."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.operators.skew import HOT_ROWS, MAX_HOT, rank_within, skew_join


def at_least(k: int, n: int, x: Column) -> Column:
    """P(the k-th smallest of n uniform ranks is at most x): the distribution function of Beta(k, n - k + 1)."""
    terms = [F.lit(float(comb(n, i))) * F.pow(x, F.lit(i)) * F.pow(F.lit(1.0) - x, F.lit(n - i)) for i in range(k, n + 1)]
    return reduce(lambda a, b: a + b, terms)


def aggregate_ranks(
    hits: DataFrame, query: str, item: str, scores: Mapping[str, bool], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(query, item, rho, mean_rank) for each distinct item of a query.

    ``scores`` names the score columns; True where larger is better.  Per score an item's rank is divided by the number of
    the query's items; an item without the score (null or NaN) gets 1, the worst.  The sorted ranks are held against the
    order statistics of independent uniform ranks; ``rho`` is the smallest probability times the number of scores, 1 at
    most.  Small means that the scores agree on the item more than chance allows; scales and outliers have no effect,
    as only ranks enter.  Equal scores share the best rank.  Of repeated rows the best value of each score counts once.
    Rows without query or item are left out.  An empty input gives an empty result.
    """
    known = hits.where(F.col(query).isNotNull() & F.col(item).isNotNull())
    usable = {s: F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")) for s in scores}
    best = [(F.max if up else F.min)(usable[s]).alias(f"_s{i}") for i, (s, up) in enumerate(scores.items())]
    ranked = known.groupBy(query, item).agg(*best)
    sizes = ranked.groupBy(query).agg(F.count(F.lit(1)).alias("_items"))
    for i, up in enumerate(scores.values()):
        ranked = rank_within(ranked, [query], f"_s{i}", f"_r{i}", ascending=not up, hot_rows=hot_rows)
    hot = sizes.where(F.col("_items") >= hot_rows).orderBy(F.desc("_items"), query).limit(MAX_HOT).select(query)
    ranked = skew_join(ranked, sizes, [query], "inner", [item], hot)
    n = len(scores)
    shares = [F.coalesce(F.col(f"_r{i}") / F.col("_items"), F.lit(1.0)) for i in range(n)]
    ranked = ranked.withColumn("_sorted", F.array_sort(F.array(*shares)))
    chances = [at_least(k, n, F.col("_sorted")[k - 1]) for k in range(1, n + 1)]
    smallest = F.least(*chances) if n > 1 else chances[0]
    rho = F.least(F.lit(1.0), smallest * F.lit(float(n)))
    mean = reduce(lambda a, b: a + b, shares) / F.lit(float(n))
    return ranked.select(query, item, rho.alias("rho"), mean.alias("mean_rank"))


def leading_items(
    hits: DataFrame, query: str, item: str, scores: Mapping[str, bool], top: int = 3, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The ``top`` items of each query with their ``place``, by ``rho``, then mean rank, then item."""
    order = [F.round("rho", 12).asc(), F.round("mean_rank", 12).asc(), F.col(item).asc()]
    placed = aggregate_ranks(hits, query, item, scores, hot_rows)
    return placed.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(*order))).where(F.col("place") <= top)
