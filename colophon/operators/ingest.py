"""Pages to documents: fields, sections, chunks, duplicates, records for a vector index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions import dictionaries as D
from colophon.functions import text as T
from colophon.operators.fusion import snippet_section
from colophon.operators.skew import skew_join

# Lines of a page that say something about it.
_METADATA_LINE = r"(?i)^((Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d|\d+\s*Share$|Share\s*this|Subscribe|(Share|Like|Comment|Reply)$)"
_MONTH_DATE = r"(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def issue_number(url: Column, markdown: Column) -> Column:
    """From the address, else from the text: the first of five notations that occurs."""
    found = [
        F.regexp_extract(url, r"/p/(\d+)(?:$|[^0-9])", 1),
        F.regexp_extract(url, r"(?i)(?:review-|ep-|ep_)(\d+)", 1),
        F.regexp_extract(markdown, r"(?i)\bEp\.?\s*(\d+)", 1),
        F.regexp_extract(markdown, r"(?i)Review,?\s*#(\d+)", 1),
        F.regexp_extract(markdown, r"(?i)(?:Episode|Issue)\s+(\d+)", 1),
    ]
    return F.coalesce(*[f.try_cast("int") for f in found])


def published_at(markdown: Column, metadata: Column) -> Column:
    """``yyyy-MM-dd`` from the metadata, a date in words, or a date that stands alone; null if there is none."""
    given = F.substring_index(F.try_element_at(metadata, F.lit("article:published_time")), "T", 1)
    spoken = F.regexp_replace(F.regexp_replace(F.regexp_extract(markdown, _MONTH_DATE, 1), r"(?i)(\d+)(st|nd|rd|th)", "$1"), ",", "")
    short = F.regexp_replace(F.regexp_replace(spoken, r"^([A-Za-z]{3})[a-z]*", "$1"), r"\s+", " ")
    alone = F.regexp_extract(markdown, r"(?:^|\s)(\d{4}-\d{2}-\d{2})(?:\s|$)", 1)
    day = F.coalesce(F.try_to_date(F.initcap(short), "MMM d yyyy"), F.try_to_date(alone, "yyyy-MM-dd"))
    return F.coalesce(_blank_to_null(given), F.date_format(day, "yyyy-MM-dd"))


def documents(pages: DataFrame) -> DataFrame:
    """Documents of (url, markdown, metadata): one row per page, with ``page_kind`` issue, non_issue_post or junk.

    Title from the metadata, else the first heading of level one; subtitle, date, number, summary, headings, opening quote
    and lead title likewise from metadata or text.  The identifier and the content hash are SHA-256 of address and text, so
    that a page read again gets the same.  Null texts are junk.
    """
    md, url, meta = F.coalesce(F.col("markdown"), F.lit("")), F.col("url"), F.col("metadata")
    lines = F.transform(F.split(md, "\n"), lambda x: F.trim(x))
    of = lambda key: _blank_to_null(F.try_element_at(meta, F.lit(key)))
    kind = F.when(url.contains("/p/") & (F.length(md) > 200), "issue").when(url.endswith("/archive") | url.endswith("/about"), "non_issue_post").otherwise("junk")
    heading = F.transform(F.filter(lines, lambda x: x.rlike(r"^#{1,3}\s+\S")), lambda x: F.regexp_replace(x, r"^#{1,3}\s+", ""))
    quotes = F.transform(F.filter(lines, lambda x: x.rlike(r"^>\s+[“\"]")), lambda x: F.regexp_replace(x, r"^[\s>\"“”]+|[\s\"“”]+$", ""))
    level_two = F.transform(F.filter(lines, lambda x: x.startswith("## ")), lambda x: T.without_leading_emoji(F.substring(x, 4, 500)))
    after = F.filter(lines, lambda x, i: (i > F.array_position(F.transform(lines, lambda y: y.startswith("#")), True) - 1) & (F.array_position(F.transform(lines, lambda y: y.startswith("#")), True) > 0))
    prose = F.filter(after, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("![") & ~x.rlike(_METADATA_LINE))
    first = F.get(prose, F.lit(0))
    date = published_at(md, meta)
    plain = T.html_to_text(F.regexp_replace(F.regexp_replace(md, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"(?m)^[#>*\-\s]+|\*\*|`", ""))
    return pages.select(
        F.sha2(url, 256).alias("id"), kind.alias("page_kind"), issue_number(url, md).alias("issue_number"),
        F.coalesce(of("title"), of("og:title"), F.nullif(F.regexp_extract(md, r"(?m)^#\s+(.+)$", 1), F.lit(""))).alias("title"),
        F.coalesce(of("og:description"), F.when(F.length(first) < 200, first)).alias("subtitle"),
        date.alias("published_at"), url.alias("source_url"), of("author").alias("authors"),
        F.when(F.length(first) > 20, F.substring(first, 1, 500)).alias("summary"),
        F.nullif(F.array_join(heading, " | "), F.lit("")).alias("headings"),
        F.nullif(F.get(level_two, F.lit(0)), F.lit("")).alias("lead_essay_title"),
        F.get(F.filter(quotes, lambda x: x != ""), F.lit(0)).alias("opening_quote"),
        F.col("markdown").alias("full_text_markdown"), plain.alias("full_text_plain"), F.sha2(md, 256).alias("content_hash"),
        T.word_count(plain).alias("word_count"), F.substring(date, 1, 4).try_cast("int").alias("year"), F.substring(date, 6, 2).try_cast("int").alias("month"),
    )


_EMOJI = re.compile("^[\U0001f000-\U0001ffff☀-➿️‍\\s]+")
_PATTERNS = [(name, re.compile(p, re.I)) for name, p in D.SECTION_TITLES.items()]


def parse_sections(markdown: str) -> list[tuple[str, str, str]]:
    """(type, title, body) between headings of level two.  The first heading of no known kind is the lead essay, later ones
    are 'other'; over 100 characters before the first heading are a lead essay of their own; a text without headings is
    'other' as a whole."""
    parts: list[tuple[str, list[str]]] = []
    before: list[str] = []
    for line in markdown.split("\n"):
        if line.strip().startswith("## "):
            parts.append((line.strip()[3:], []))
        else:
            (parts[-1][1] if parts else before).append(line)
    if not parts:
        return [("other", "", markdown.strip())]
    sections, lead = [], False
    for title, body in parts:
        kind = next((name for name, p in _PATTERNS if p.search(title)), None)
        if kind is None:
            kind, lead = ("other" if lead else "lead_essay"), True
        sections.append((kind, _EMOJI.sub("", title).strip(), "\n".join(body).strip()))
    opening = "\n".join(before).strip()
    return ([("lead_essay", "", opening)] if len(opening) > 100 else []) + sections


def split_text(text: str, least: int = D.CHUNK_LEAST, most: int = D.CHUNK_MOST, overlap: int = D.CHUNK_OVERLAP) -> list[str]:
    """Pieces of at most ``most`` characters, broken after a paragraph, else a sentence, else a word, if that keeps more than
    ``least``; each begins ``overlap`` before the end of the one before."""
    if len(text) <= most:
        return [text]
    pieces, start = [], 0
    while start + most < len(text):
        segment = text[start : start + most]
        at = next((p for p in (segment.rfind("\n\n"), segment.rfind(". ")) if p >= least), segment.rfind(" "))
        end = start + (at + 1 if at > least else most)
        pieces.append(text[start:end].strip())
        start = end - overlap
    return [p for p in [*pieces, text[start:].strip()] if p]


def document_chunks(title: str | None, summary: str | None, markdown: str | None, least: int = D.CHUNK_LEAST, most: int = D.CHUNK_MOST, overlap: int = D.CHUNK_OVERLAP) -> list[tuple[str, str]]:
    """(label, text): title and summary first, then the pieces of each section that holds text."""
    chunks = [("title_summary", "\n\n".join(x for x in (title, summary) if x))]
    for kind, _, body in parse_sections(markdown) if markdown else []:
        if body:
            chunks += [(kind, piece) for piece in split_text(body, least, most, overlap)]
    return chunks


def chunks(rows: DataFrame, doc_id: str = "id", title: str = "title", summary: str = "summary", markdown: str = "full_text_markdown") -> DataFrame:
    """(id, issue_id, chunk_index, section_label, chunk_text, token_estimate) in Arrow batches; a quarter of the characters,
    rounded up, estimates the tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (f"{key}-chunk-{i}", key, i, label, text, -(-len(text) // 4))
                for key, t, s, m in zip(*(batch[c] for c in ("k", "t", "s", "m")))
                for i, (label, text) in enumerate(document_chunks(t, s, m))
            ]
            yield pd.DataFrame(out, columns=["id", "issue_id", "chunk_index", "section_label", "chunk_text", "token_estimate"]).astype({"chunk_index": "int32", "token_estimate": "int32"})

    picked = rows.select(F.col(doc_id).alias("k"), F.col(title).alias("t"), F.col(summary).alias("s"), F.col(markdown).alias("m"))
    return picked.mapInPandas(run, "id string, issue_id string, chunk_index int, section_label string, chunk_text string, token_estimate int")


def sections(rows: DataFrame, doc_id: str = "id", markdown: str = "full_text_markdown") -> DataFrame:
    """(issue_id, position, section_type, title, characters) of every section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, i, kind, t, len(b)) for k, m in zip(batch["k"], batch["m"]) for i, (kind, t, b) in enumerate(parse_sections(m or ""))]
            yield pd.DataFrame(out, columns=["issue_id", "position", "section_type", "title", "characters"]).astype({"position": "int32", "characters": "int32"})

    return rows.select(F.col(doc_id).alias("k"), F.col(markdown).alias("m")).mapInPandas(run, "issue_id string, position int, section_type string, title string, characters int")


def snippet_sections(rows: DataFrame, doc_id: str, snippet: str, markdown: str) -> DataFrame:
    """(issue_id, section_type): the section of its document that each snippet comes from, null if none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, snippet_section(s, parse_sections(m or ""))) for k, s, m in zip(batch["k"], batch["s"], batch["m"])]
            yield pd.DataFrame(out, columns=["issue_id", "section_type"])

    picked = rows.select(F.col(doc_id).alias("k"), F.col(snippet).alias("s"), F.col(markdown).alias("m"))
    return picked.mapInPandas(run, "issue_id string, section_type string")


def duplicate_decisions(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, duplicate_of, reason, unchanged): the existing document that each incoming one repeats, found by address, else by
    content hash, else by number and date of an active one; the first by identifier among several."""
    one = lambda keys, rows, name: rows.dropna(subset=keys).groupBy(*keys).agg(F.min(F.struct("id", F.col("content_hash").alias("hash"))).alias(name))
    by_url = one(["source_url"], existing, "_url")
    by_hash = one(["content_hash"], existing, "_hash")
    by_date = one(["issue_number", "published_at"], existing.where(F.col("status") == "active"), "_date")
    rows = incoming.select("id", "source_url", "content_hash", "issue_number", "published_at")
    for keys, known in ((["source_url"], by_url), (["content_hash"], by_hash), (["issue_number", "published_at"], by_date)):
        rows = skew_join(rows, known, keys, "left", ["id"])  # one address or hash may be that of very many documents
    reason = F.when(F.col("_url").isNotNull(), "source_url").when(F.col("_hash").isNotNull(), "content_hash").when(F.col("_date").isNotNull(), "issue_number_date")
    found = F.coalesce("_url", "_hash", "_date")
    return rows.select("id", found["id"].alias("duplicate_of"), reason.alias("reason"), F.coalesce(F.col("content_hash") == found["hash"], F.lit(False)).alias("unchanged"))


def vector_records(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Metadata that goes with each chunk's vector; the text is cut after 500 characters and dotted."""
    text = F.when(F.length("chunk_text") > 500, F.concat(F.substring("chunk_text", 1, 500), F.lit("..."))).otherwise(F.col("chunk_text"))
    about = issues.select(F.col("id").alias("issue_id"), "issue_number", "title", "published_at", "year")
    return rows.join(about, "issue_id").select("id", "issue_id", "issue_number", "title", "published_at", "year", F.col("section_label").alias("section"), "chunk_index", text.alias("text"))
