"""Semantic search over given vectors: filtered top-k by cosine, chunks collapsed to documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import dictionaries as D
from colophon.functions import vectors as V


def top_chunks(chunks: DataFrame, key: str, embedding: str, query: Sequence[float], keep: Column | None = None, top: int = D.SEMANTIC_TOP) -> DataFrame:
    """The ``top`` rows by cosine with ``query``, with ``score``; ``keep`` is applied before, as a filter after a limit would
    lose results.  Ties go by ``key``.  Every executor sends ``top`` rows at most."""
    rows = chunks if keep is None else chunks.where(keep)
    scored = rows.withColumn("score", V.cosine(F.col(embedding), V.vector(query)))
    return scored.orderBy(F.col("score").desc(), F.col(key).asc()).limit(top)


def query_scores(queries: DataFrame, chunks: DataFrame, key: str, embedding: str, blocks: int = 16) -> DataFrame:
    """``chunks`` with ``score``, the cosine rounded to 6 digits, once for each row of ``queries``, whose columns all come along
    (but its vector ``query_vector``).

    The chunks lie in ``blocks`` hash blocks by ``key``, and the queries visit each block."""
    visits = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = chunks.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return visits.join(placed, "_block").withColumn("score", F.round(V.cosine(F.col(embedding), F.col("query_vector")), 6)).drop("_block", "query_vector")


def top_chunks_each(
    queries: DataFrame, chunks: DataFrame, query: str, key: str, embedding: str, keep: Column | None = None, top: int = D.SEMANTIC_TOP, blocks: int = 16
) -> DataFrame:
    """:func:`top_chunks` for each row of ``queries`` (``query``, ``query_vector`` and what ``keep`` may refer to)."""
    scored = query_scores(queries, chunks, key, embedding, blocks)
    rows = scored if keep is None else scored.where(keep)
    place = F.row_number().over(W.partitionBy(query).orderBy(F.col("score").desc(), F.col(key).asc()))
    return rows.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")


def collapsed(chunks: DataFrame, document: str, key: str, floor: float = D.CHUNK_FLOOR, extra: Sequence[str] = (), top: int = 500, query: str | None = None) -> DataFrame:
    """(document, top_score, top_chunk, chunk_count, semantic_rank) of the ``top`` documents by their best chunk of at least
    ``floor``; ``extra`` columns come from that chunk.  With the column ``query``, for each of its values."""
    good = chunks.where(F.col("score") >= floor)
    order = F.struct(F.col("score"), F.col(key))
    best = [F.max_by(F.col(c), order).alias(f"top_{c}") for c in extra]
    by = [query] if query else []
    grouped = good.groupBy(*by, document).agg(F.max("score").alias("top_score"), F.max_by(F.col(key), order).alias("top_chunk"), F.count(F.lit(1)).alias("chunk_count"), *best)
    ranking = [F.col("top_score").desc(), F.col(document).asc()]
    if query is None:
        grouped = grouped.orderBy(*ranking).limit(top)
    return grouped.withColumn("semantic_rank", F.row_number().over(W.partitionBy(*by).orderBy(*ranking))).where(F.col("semantic_rank") <= top)


def date_filter(published: Column, before: str | None = None, after: str | None = None, nulls_pass: bool = True) -> Column:
    """Strict bounds on date texts; on the semantic side rows without a date pass, on the lexical side they don't."""
    bounds = [published < before] if before else []
    bounds += [published > after] if after else []
    result = F.lit(True)
    for b in bounds:
        result = result & ((published.isNull() | b) if nulls_pass else b)
    return result
