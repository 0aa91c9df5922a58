"""From a query's text to a page of results: parsed, looked up in the index and among vectors, fused, boosted, paged."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import dictionaries as D
from colophon.functions import text as T
from colophon.operators import fusion, lexical, query_language, search_index, semantic
from colophon.operators.query_language import Filters

RESULT = ("issue_id", "lexical_rank", "semantic_rank", "top_score", "final_score", "confidence", "rank")


def _carriers(topics: DataFrame, topic: str) -> DataFrame:
    return topics.where(T.topic_value(F.col("keyword")) == topic).select("issue_id").distinct()


def _passing(issues: DataFrame, given: Filters, nulls_pass: bool) -> DataFrame:
    """Issues within the dates and the year; ``nulls_pass`` lets those without a date through the bounds."""
    rows = issues.where(semantic.date_filter(F.col("published_at"), given.before, given.after, nulls_pass=nulls_pass))
    return rows if given.year is None else rows.where(F.col("year") == given.year)


def search(
    raw: str,
    index: search_index.SearchIndex,
    issues: DataFrame,
    topics: DataFrame,
    chunks: DataFrame | None = None,
    embed: Callable[[str], Sequence[float] | None] | None = None,
    chunk_floor: float = D.CHUNK_FLOOR,
    semantic_floor: float = D.SEMANTIC_FLOOR,
    page: str | int | None = 1,
    limit: str | int | None = 20,
    most: int = 500,
) -> DataFrame:
    """The columns ``RESULT`` of one page of results for the query text ``raw``, best first.

    ``issues`` (id, title, subtitle, headings, full_text_plain, issue_number, published_at, year), ``topics`` (issue_id, keyword) and
    ``chunks`` (chunk_id, issue_id, section_label, embedding) are the archive; ``embed`` turns text into a vector or gives
    None.  Three paths: filters without text give the newest issues with score 0; text without a vector, or without
    chunks, gives the lexical ranking; else both rankings are fused.  Dates, year, section and topic are applied to
    chunks before their best are taken.  What only vectors found needs ``semantic_floor``.  Nothing but the page is ranked
    for the caller: either side hands over ``most`` documents at most.
    """
    parsed = query_language.parse_query(raw)
    given = parsed.filters
    offset, size = query_language.page_of(page, limit)
    carriers = _carriers(topics, given.topic) if given.topic else None
    about = issues.withColumnRenamed("id", "issue_id")
    strict = _passing(about, given, nulls_pass=False)
    if carriers is not None:
        strict = strict.join(carriers, "issue_id", "left_semi")
    if parsed.filter_only:
        if given.issue_number is not None:
            strict = strict.where(F.col("issue_number") == given.issue_number)
        place = F.row_number().over(W.orderBy(F.desc("published_at"), "issue_id"))
        newest = strict.orderBy(F.col("published_at").desc(), "issue_id").offset(offset).limit(size)
        blank = {"lexical_rank": F.lit(None).cast("int"), "semantic_rank": F.lit(None).cast("int"), "top_score": F.lit(None).cast("double"), "final_score": F.lit(0.0), "confidence": F.lit("medium")}
        return newest.withColumns(blank).withColumn("rank", place + offset).select(*RESULT)
    scores = search_index.bm25(index, query_language.match_groups(parsed))
    found = scores.join(strict.select(F.col("issue_id").alias("doc_id")), "doc_id", "left_semi")
    left = lexical.ranked(found, most).select(F.col("doc_id").alias("issue_id"), F.col("rank").alias("lexical_rank"))
    vector = embed(" ".join([*parsed.phrases, parsed.free_text]).strip()) if embed is not None and chunks is not None else None
    if vector is None:
        empty = {"semantic_rank": F.lit(None).cast("int"), "top_score": F.lit(None).cast("double"), "chunk_count": F.lit(None).cast("long")}
        both = left.withColumns(empty)
    else:
        near = chunks.join(_passing(about, given, nulls_pass=True).select("issue_id"), "issue_id", "left_semi")
        if given.section:
            near = near.where(T.display_section(F.col("section_label"), D.SECTIONS) == given.section)
        if carriers is not None:
            near = near.join(carriers, "issue_id", "left_semi")
        best = semantic.top_chunks(near, "chunk_id", "embedding", vector)
        right = semantic.collapsed(best.withColumn("score", F.round("score", 6)), "issue_id", "chunk_id", chunk_floor)
        both = fusion.fused(left, right.select("issue_id", "semantic_rank", "top_score", "chunk_count"), ["issue_id"])
        both = both.where(F.col("lexical_rank").isNotNull() | (F.col("top_score") >= semantic_floor))
    counts = left.agg(F.count(F.lit(1)).alias("lexical_hits"))
    rows = both.join(about, "issue_id").join(F.broadcast(counts))
    names = [x for x in {parsed.free_text.lower(), given.topic, (parsed.phrases or [""])[0].lower()} if x]
    matching = topics.where(T.keyword(F.col("keyword")).isin(names)).select("issue_id").distinct().withColumn("topic_hit", F.lit(True))
    rows = rows.join(matching, "issue_id", "left")
    phrases = F.array(*[F.lit(p) for p in parsed.phrases]).cast("array<string>")
    points = fusion.boosts(phrases, F.lit(parsed.free_text), F.lit(given.issue_number).cast("int"), F.col("topic_hit"), F.col("lexical_hits"))
    rows = rows.withColumns({f"p_{k}": v for k, v in points.items()})
    named: dict[str, Column] = {k: F.col(f"p_{k}") for k in points}
    total = fusion.reciprocal_ranks()
    for c in named.values():
        total = total + c
    rows = rows.withColumns({"final_score": total, "confidence": fusion.confidence(named)})
    ranked = rows.withColumn("rank", fusion.final_rank([]))  # twice `most` rows at most
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + size)).select(*RESULT)
