"""Hybrid ranking: reciprocal rank fusion of a lexical and a semantic result, boosts, confidence, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import dictionaries as D
from colophon.functions import text as T


def fused(lexical: DataFrame, semantic: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join by ``keys`` of (keys, lexical_rank) and (keys, semantic_rank, top_score, chunk_count)."""
    return lexical.join(semantic, keys, "full")


def reciprocal_ranks(lexical_weight: float = D.LEXICAL_WEIGHT, semantic_weight: float = D.SEMANTIC_WEIGHT, k: float = D.RRF_K) -> Column:
    """Weighted reciprocal rank fusion of ``lexical_rank`` and ``semantic_rank``; a missing rank adds nothing."""
    lexical = F.coalesce(F.lit(lexical_weight) / (F.lit(k) + F.col("lexical_rank")), F.lit(0.0))
    semantic = F.coalesce(F.lit(semantic_weight) / (F.lit(k) + F.col("semantic_rank")), F.lit(0.0))
    return lexical + semantic


def _holds(column: str, phrase: Column) -> Column:
    return F.coalesce(F.contains(F.lower(F.col(column)), F.lower(phrase)), F.lit(False))


def boosts(phrases: Column, free_text: Column, issue_number: Column, topic_match: Column, lexical_hits: Column) -> dict[str, Column]:
    """Name -> points of each boost and penalty of a fused row that also has its document's columns.

    ``phrases`` is an array, each phrase of which counts by itself.  Titles overlap with two words of the free text, or with
    its only one.  A row without lexical rank is penalised where the query has enough lexical hits.
    """
    per_phrase = lambda *columns: F.size(F.filter(phrases, lambda p: T.any_of(_holds(c, p) for c in columns)))
    query_words = F.filter(F.split(F.lower(free_text), r"\s+"), lambda w: w != "")
    title_words = F.split(F.lower(F.coalesce(F.col("title"), F.lit(""))), r"\s+")
    overlap = F.size(F.filter(query_words, lambda w: F.array_contains(title_words, w)))
    both = F.col("lexical_rank").isNotNull() & F.col("semantic_rank").isNotNull()
    only_semantic = F.col("lexical_rank").isNull() & F.col("semantic_rank").isNotNull()
    points = lambda condition, value: F.when(condition, F.lit(value)).otherwise(F.lit(0.0))
    return {
        "exact_issue": points(F.coalesce(F.col("issue_number") == issue_number, F.lit(False)), D.EXACT_ISSUE),
        "phrase_title": per_phrase("title") * F.lit(D.PHRASE_TITLE),
        "phrase_heading": per_phrase("subtitle", "headings") * F.lit(D.PHRASE_HEADING),
        "phrase_body": per_phrase("full_text_plain") * F.lit(D.PHRASE_BODY),
        "title_overlap": points((overlap >= 2) | ((overlap == 1) & (F.size(query_words) == 1)), D.TITLE_OVERLAP),
        "lexical_semantic_agreement": points(both, D.AGREEMENT),
        "topic_match": points(F.coalesce(topic_match, F.lit(False)), D.TOPIC_MATCH),
        "multi_chunk_support": points(F.coalesce(F.col("chunk_count") > 1, F.lit(False)) & F.col("semantic_rank").isNotNull(), D.MULTI_CHUNK),
        "semantic_only_penalty": points(only_semantic & (lexical_hits >= D.STRONG_LEXICAL), D.SEMANTIC_ONLY_PENALTY),
    }


def confidence(points: dict[str, Column]) -> Column:
    """high for an exact issue or a phrase in title or body, low for a penalised row, else medium."""
    high = (points["exact_issue"] > 0) | (points["phrase_title"] > 0) | (points["phrase_body"] > 0)
    return F.when(high, F.lit("high")).when(points["semantic_only_penalty"] < 0, F.lit("low")).otherwise(F.lit("medium"))


def final_rank(group: list[str], score: str = "final_score", key: str = "issue_id") -> Column:
    """Position by score; ties keep lexical results first, then semantic ones, then the identifier."""
    order = [F.round(score, 9).desc(), F.col("lexical_rank").asc_nulls_last(), F.col("semantic_rank").asc_nulls_last(), F.col(key).asc()]
    return F.row_number().over(W.partitionBy(*group).orderBy(*order))


def snippet(rank: Column, highlight: Column, chunk: Column, summary: Column, body: Column) -> Column:
    """The highlight if there is one, else the start of chunk, summary or body, longer for the first results."""
    source = F.coalesce(F.nullif(chunk, F.lit("")), F.nullif(summary, F.lit("")), F.nullif(body, F.lit("")), F.lit(""))
    cut = F.when(rank <= D.SNIPPET_TOP, T.shortened(source, D.SNIPPET_LONG)).otherwise(T.shortened(source, D.SNIPPET_SHORT))
    return F.coalesce(F.nullif(highlight, F.lit("")), cut)


def facets(results: DataFrame, section: str = "section") -> DataFrame:
    return results.groupBy(F.coalesce(F.nullif(F.col(section), F.lit("")), F.lit("other")).alias("section")).agg(F.count(F.lit(1)).alias("hits"))


def quarter_sections(results: DataFrame, published: str = "published_at", section: str = "section") -> DataFrame:
    """(quarter, sections): per quarter a map from section to hits; rows without a date don't count."""
    rows = results.select(T.quarter_key(F.col(published)).alias("quarter"), F.coalesce(F.nullif(F.col(section), F.lit("")), F.lit("other")).alias("section"))
    counts = rows.where(F.col("quarter").isNotNull()).groupBy("quarter", "section").agg(F.count(F.lit(1)).alias("hits"))
    return counts.groupBy("quarter").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "hits")))).alias("sections"))


def snippet_section(text: str | None, sections: list[tuple[str, str, str]]) -> str | None:
    """The section (type, title, body) that a snippet comes from: its first six words in a body, else a title within it, else
    any four words in a row; None if nothing fits."""
    plain = (text or "").replace("<mark>", "").replace("</mark>", "")
    fragments = [f.split() for f in plain.split("...") if f.strip()]
    bodies = [(kind, " ".join(title.lower().split()), " ".join(body.lower().split())) for kind, title, body in sections]
    within = lambda words: next((k for k, _, b in bodies if " ".join(words).lower() in b), None)
    for words in fragments:
        if len(words) >= 3 and (kind := within(words[:6])):
            return kind
    for words in fragments:
        for kind, title, _ in bodies:
            if len(title) >= 4 and title in " ".join(words).lower():
                return kind
    for words in fragments:
        for i in range(len(words) - 3):
            if kind := within(words[i : i + 4]):
                return kind
    return None
