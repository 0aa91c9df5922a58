"""How characteristic a term is of its record: positive pointwise mutual information with smoothed context counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.operators.skew import HOT_ROWS, MAX_HOT, skew_join
from colophon.session import cut


def spelled(raw: Column) -> Column:
    """Lower case, each run of spaces, hyphens and underscores as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(raw), r"[ _-]+", " "))


def term_weights(topics: DataFrame, record: str, term: str, score: str) -> DataFrame:
    """(record, term, weight, share): one row per record and term as :func:`spelled`, its best score counting once.

    ``weight`` is the joint count, 1 / score: a term that is twice as prominent counts as mentioned twice as often.
    ``share`` is the weight over that of the record's most prominent term.  Rows without record, term or a positive score
    are left out, blank terms too.
    """
    rows = topics.select(F.col(record).alias("record"), spelled(F.col(term)).alias("term"), F.col(score).cast("double").alias("score"))
    rows = rows.where(F.col("record").isNotNull() & (F.col("term") != "") & (F.col("score") > 0) & ~F.isnan("score"))
    rows = cut(rows.groupBy("record", "term").agg((F.lit(1.0) / F.min("score")).alias("weight")))
    tops = rows.groupBy("record").agg(F.sum("weight").alias("record_weight"), F.max("weight").alias("_top"), F.count(F.lit(1)).alias("_terms"))
    hot = tops.where(F.col("_terms") >= HOT_ROWS).orderBy(F.desc("_terms"), "record").limit(MAX_HOT).select("record")
    rows = skew_join(rows, tops, ["record"], "inner", ["term"], hot)
    return rows.select("record", "term", "weight", "record_weight", (F.col("weight") / F.col("_top")).alias("share"))


def pointwise_information(weights: DataFrame, wanted: DataFrame | None = None, exponent: float = 0.75, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(record, term, weight, share, records, ppmi) of :func:`term_weights`, of the ``wanted`` records only if given.

    ppmi = max(0, ln(p(term, record) / (p(record) * p'(term)))), p'(term) being the term's weight over all records raised
    to ``exponent``, over the sum of these powers; the exponent keeps terms of a single record from winning by rarity
    alone.  Marginal counts are always those of all records.  ``records`` is the number of records with the term.
    """
    terms = weights.groupBy("term").agg(F.sum("weight").alias("_term_weight"), F.count(F.lit(1)).alias("records"))
    terms = cut(terms.select("term", "records", F.pow("_term_weight", F.lit(exponent)).alias("_smoothed")))
    total = terms.agg(F.sum("_smoothed")).first()[0] or 1.0
    hot = terms.where(F.col("records") >= hot_rows).orderBy(F.desc("records"), "term").limit(MAX_HOT).select("term")
    rows = weights if wanted is None else skew_join(weights, wanted.select("record").distinct(), ["record"], "left_semi", spread=["term"], hot_rows=hot_rows)
    rows = skew_join(rows, terms, ["term"], "inner", ["record"], hot)
    information = F.ln(F.col("weight") * F.lit(float(total)) / (F.col("record_weight") * F.col("_smoothed")))
    return rows.select("record", "term", "weight", "share", "records", F.greatest(F.lit(0.0), information).alias("ppmi"))


def most_characteristic(scored: DataFrame, least_share: float = 0.1) -> DataFrame:
    """The one term of each record with the largest ppmi among the terms of at least ``least_share`` of the weight of the
    record's most prominent term; ties go to the term of fewer records, then the heavier, then the first in byte order."""
    fit = scored.where(F.col("share") >= least_share)
    order = [F.round("ppmi", 9).desc(), F.col("records").asc(), F.col("weight").desc(), F.col("term").asc()]
    return fit.withColumn("_place", F.row_number().over(W.partitionBy("record").orderBy(*order))).where(F.col("_place") == 1).drop("_place")
