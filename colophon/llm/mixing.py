"""Mixing sources to target weights: systematic sampling of whole documents."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.llm import tokens
from colophon.session import cut

#: Hash buckets per source and size class at least; a task sorts one of them at a time.
BUCKETS = 16
#: Documents of a source that call for one more bucket.
PER_BUCKET = 2_000_000


@dataclass(frozen=True)
class SourcePlan:
    """What one source contributes: expected copies of each of its documents, and the offset of its sample."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    copies: float
    offset: float


def plan_mixture(targets: list[tuple[str, float, int]], available: dict[str, int], total_tokens: float | None = None, seed: int = 0) -> list[SourcePlan]:
    """Expected copies per source.

    Shares of sources without any token can't be met; the others keep their proportions.  Without ``total_tokens`` the
    mixture is as large as the scarcest source allows, so that all shares are met; with it, a source too small for its
    part gives its documents ``max_repeats`` times and falls short, which the report shows.
    """
    present = [(s, w, r) for s, w, r in targets if available.get(s, 0) > 0 and w > 0 and r > 0]
    weight = sum(w for _, w, _ in present)
    largest = min((available[s] * r * weight / w for s, w, r in present), default=0.0)
    total = largest if total_tokens is None else float(total_tokens)
    plans = []
    for s, w, r in targets:
        have = available.get(s, 0)
        copies = min(float(r), total * w / weight / have) if have > 0 and w > 0 and r > 0 else 0.0
        plans.append(SourcePlan(s, w, r, have, copies, random.Random(f"{seed}:{s}").random()))
    return plans


def sized_documents(documents: DataFrame, doc_id: str, source: str, text: str, sources: list[str], ranks: str = tokens.RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of ``sources``, written down once."""
    rows = documents.where(F.col(source).isin(sources)).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    return cut(tokens.with_token_counts(rows, "text", ranks))


def mixture(sized: DataFrame, targets: list[tuple[str, float, int]], total_tokens: float | None = None, seed: int = 0, buckets: int = BUCKETS) -> tuple[DataFrame, list[SourcePlan]]:
    """((doc_id, source, copy_no from 1, n_tokens), plans): the documents that make up the mixture, a row per use.

    Within its source every document has the same expected number of copies; these are summed along an order by size class,
    hash bucket and size, one random offset is added, and a copy is emitted for each whole number crossed.  Prefix sums run
    in small groups, each starting after the groups before it, so that a source may hold any part of all rows.  As
    documents of like size follow each other, a source's tokens come close to its part.  No document is used more than its
    source's ``max_repeats`` times; repeated rows are documents of their own.
    """
    if len({s for s, _, _ in targets}) != len(targets):
        raise ValueError("a source has several targets")
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).where(F.col("source").isin([s for s, _, _ in targets]))
    counted = totals.collect()  # one row per target at most
    available = {r["source"]: int(r["n"]) for r in counted}
    buckets = max([buckets, *(-(-r["rows"] // PER_BUCKET) for r in counted)])
    plans = plan_mixture(targets, available, total_tokens, seed)
    spark = sized.sparkSession
    schema = "source string, copies double, offset double, max_repeats int"
    factors = spark.createDataFrame([(p.source, p.copies, p.offset, p.max_repeats) for p in plans if p.copies > 0], schema)
    size_class = F.floor(F.log2(F.col("n_tokens") + 1) * 8).cast("int")
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)).cast("int")
    keys = ["source", "size_class", "bucket"]
    rows = sized.where("n_tokens > 0").withColumns({"size_class": size_class, "bucket": bucket})
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("size_class", "bucket")) - F.col("n")
    starts = counts.select(*keys, before.alias("before"))  # targets x size classes x buckets rows at most
    inside = F.row_number().over(W.partitionBy(*keys).orderBy("n_tokens", "doc_id"))
    placed = rows.withColumn("inside", inside).join(starts, keys).join(F.broadcast(factors), "source")
    upto = F.floor(F.col("offset") + F.col("copies") * (F.col("before") + F.col("inside")))
    until = F.floor(F.col("offset") + F.col("copies") * (F.col("before") + F.col("inside") - 1))
    placed = placed.withColumn("times", F.least(upto - until, F.col("max_repeats")).cast("int")).where("times > 0")
    chosen = placed.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"), "n_tokens")
    return chosen, plans


def share_report(chosen: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """(source, target_share, actual_share, documents, uses, tokens, most_copies), one row per target."""
    spark = chosen.sparkSession
    schema = "source string, target_share double, max_repeats int, available_tokens long"
    targets = spark.createDataFrame([(p.source, p.target_share, p.max_repeats, p.available) for p in plans], schema)
    used = chosen.groupBy("source").agg(
        F.sum(F.when(F.col("copy_no") == 1, 1).otherwise(0)).alias("documents"), F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("tokens"), F.max("copy_no").alias("most_copies")
    )
    joined = targets.join(used, "source", "left").fillna(0, ["documents", "uses", "tokens", "most_copies"])
    whole = joined.agg(F.sum("tokens").alias("all_tokens"))
    total = whole.first()[0] or 0
    return joined.withColumn("actual_share", F.round(F.col("tokens") / F.lit(float(max(total, 1))), 6))


def violations(chosen: DataFrame, plans: list[SourcePlan], documents: DataFrame, doc_id: str, source: str) -> DataFrame:
    """(source, problem): what a mixture must not hold, so none for a sound one.

    ``foreign``: documents that the source doesn't hold, or of no target; ``repeated``: a document used more than
    ``max_repeats`` times, or a copy's number twice.
    """
    spark = chosen.sparkSession
    schema = "source string, copies double, max_repeats int"
    targets = F.broadcast(spark.createDataFrame([(p.source, p.copies, p.max_repeats) for p in plans], schema))
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source")).distinct()
    uses = chosen.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("uses"), F.max("copy_no").alias("last"))
    foreign = uses.join(own, ["doc_id", "source"], "left_anti").select("source", F.lit("foreign").alias("problem"))
    limits = uses.join(targets, "source", "left")
    repeated = limits.where("max_repeats IS NULL OR uses > max_repeats OR uses <> last").select("source", F.lit("repeated").alias("problem"))
    return foreign.unionByName(repeated).distinct()
