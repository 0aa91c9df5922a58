"""Ingest queries: pages to documents, sections, chunks, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import ingest
from colophon.plans.base import Queries
from colophon.sources import html
from colophon.sources.tables import table

Q = Queries()


@Q.add()
def normalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crawled page as a document."""
    return ingest.documents(table(spark, sf_dir, "crawl_pages"))


@Q.add(
    """SELECT url, CASE WHEN contains(url, '/p/') AND length(coalesce(markdown, '')) > 200 THEN 'issue' WHEN url LIKE '%/archive' OR url LIKE '%/about' THEN 'non_issue_post' ELSE 'junk' END AS page_kind,
sha256(coalesce(markdown, '')) AS content_hash, TRY_CAST(nullif(regexp_extract(url, '/p/(\\d+)(?:$|[^0-9])', 1), '') AS INTEGER) AS number_in_url FROM crawl_pages"""
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawl_pages")
    rows = ingest.documents(pages).select(F.col("source_url").alias("url"), "page_kind", "content_hash")
    number = F.regexp_extract("url", r"/p/(\d+)(?:$|[^0-9])", 1).try_cast("int")
    return rows.withColumn("number_in_url", number)


@Q.add("SELECT id, sha256(full_text_plain) AS hash, len(list_filter(regexp_split_to_array(coalesce(full_text_plain, ''), '\\s+'), lambda w: w <> '')) AS words FROM issues")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "issues").select("id", F.sha2("full_text_plain", 256).alias("hash"), T.word_count(F.col("full_text_plain")).cast("long").alias("words"))


_HTML = """'<html><head><title>' || coalesce(title, '') || '</title><meta name="author" content="' || coalesce(authors, '') || '"><script>var x = 1 < 2;</script></head><body><h1>' || coalesce(title, '') || '</h1><p>A &lt; B &amp; C</p><p>' || coalesce(summary, '') || '</p></body></html>'"""


def _pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    page = F.concat(
        F.lit("<html><head><title>"), value("title"), F.lit('</title><meta name="author" content="'), value("authors"), F.lit('"><script>var x = 1 < 2;</script></head><body><h1>'),
        value("title"), F.lit("</h1><p>A &lt; B &amp; C</p><p>"), value("summary"), F.lit("</p></body></html>"),
    )
    return table(spark, sf_dir, "issues").select(F.col("source_url").alias("url"), page.alias("html"))


@Q.add(
    rf"""WITH h AS (SELECT source_url AS url, {_HTML} AS html FROM issues)
SELECT url, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM h"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of HTML pages: scripts and tags out, entities decoded, comparisons kept."""
    return _pages_html(spark, sf_dir).select("url", T.html_to_text(F.col("html")).alias("text"))


@Q.add("SELECT source_url AS url, nullif(trim(coalesce(title, '')), '') AS title, nullif(coalesce(authors, ''), '') AS author FROM issues")
def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = T.page_metadata(F.col("html"))
    rows = _pages_html(spark, sf_dir).select("url", meta.alias("m"))
    return rows.select("url", F.col("m")["title"].alias("title"), F.col("m")["author"].alias("author"))


@Q.add()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.crawled(_pages_html(spark, sf_dir)).select("url", "markdown")


@Q.add()
def issue_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sections(table(spark, sf_dir, "issues"))


@Q.add()
def rechunked_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunks(table(spark, sf_dir, "issues"))


_DECISION_SQL = """
WITH n AS (SELECT 'new-' || id AS id, CASE WHEN issue_number % 3 = 0 THEN source_url ELSE source_url || '?new' END AS source_url, CASE WHEN issue_number % 3 = 1 THEN content_hash ELSE content_hash || 'x' END AS content_hash, issue_number, published_at FROM issues WHERE issue_number IS NOT NULL),
u AS (SELECT source_url, min(id) AS u FROM issues WHERE source_url IS NOT NULL GROUP BY 1), h AS (SELECT content_hash, min(id) AS h FROM issues WHERE content_hash IS NOT NULL GROUP BY 1),
d AS (SELECT issue_number, published_at, min(id) AS d FROM issues WHERE status = 'active' AND issue_number IS NOT NULL AND published_at IS NOT NULL GROUP BY 1, 2)
SELECT n.id, coalesce(u, h, d) AS duplicate_of, CASE WHEN u IS NOT NULL THEN 'source_url' WHEN h IS NOT NULL THEN 'content_hash' WHEN d IS NOT NULL THEN 'issue_number_date' END AS reason, coalesce(n.content_hash = e.content_hash, false) AS unchanged
FROM n LEFT JOIN u USING (source_url) LEFT JOIN h USING (content_hash) LEFT JOIN d USING (issue_number, published_at) LEFT JOIN issues e ON e.id = coalesce(u, h, d)"""


@Q.add(_DECISION_SQL)
def duplicate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which known issue each page read again repeats, and by what."""
    issues = table(spark, sf_dir, "issues").select("id", "source_url", "content_hash", "issue_number", "published_at", "status")
    n = F.col("issue_number") % 3
    incoming = issues.where("issue_number IS NOT NULL").select(
        F.concat(F.lit("new-"), "id").alias("id"), F.when(n == 0, F.col("source_url")).otherwise(F.concat("source_url", F.lit("?new"))).alias("source_url"),
        F.when(n == 1, F.col("content_hash")).otherwise(F.concat("content_hash", F.lit("x"))).alias("content_hash"), "issue_number", "published_at",
    )
    return ingest.duplicate_decisions(incoming, issues)


@Q.add(
    """SELECT c.id, issue_id, issue_number, title, published_at, year, section_label AS section, chunk_index, CASE WHEN length(chunk_text) > 500 THEN left(chunk_text, 500) || '...' ELSE chunk_text END AS text FROM issue_chunks c JOIN issues i ON i.id = c.issue_id"""
)
def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.vector_records(table(spark, sf_dir, "issue_chunks"), table(spark, sf_dir, "issues"))


QUERIES, ORACLES = Q.functions, Q.sql
