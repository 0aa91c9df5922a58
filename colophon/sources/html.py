"""Sources of pages: sitemaps and folders of HTML files; HTML to Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from colophon.functions import text as T


def sitemap_entries(files: DataFrame, value: str = "value", only: str = "/p/") -> DataFrame:
    """(loc, lastmod) of sitemap texts, one file per row; ``only`` filters addresses.  Index files give none here: see
    :func:`sitemap_indexes`."""
    blocks = files.select(F.explode(F.regexp_extract_all(value, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("b"))
    inner = lambda tag: F.trim(F.regexp_extract("b", rf"<{tag}>([^<]+)</{tag}>", 1))
    rows = blocks.select(F.nullif(inner("loc"), F.lit("")).alias("loc"), F.nullif(inner("lastmod"), F.lit("")).alias("lastmod"))
    return rows.where(F.col("loc").contains(only))


def sitemap_indexes(files: DataFrame, value: str = "value") -> DataFrame:
    """(loc) of the sitemaps that index files name, to be read next."""
    blocks = files.select(F.explode(F.regexp_extract_all(value, F.lit(r"(?s)<sitemap>(.*?)</sitemap>"), F.lit(1))).alias("b"))
    return blocks.select(F.trim(F.regexp_extract("b", r"<loc>([^<]+)</loc>", 1)).alias("loc")).where("loc <> ''")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of all ``*.html`` below ``path``, one row per file, the file's name as address."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("url"), F.col("value").alias("html"))


class _Renderer(HTMLParser):
    """Walks a page and writes Markdown; scripts, styles and heads are left out."""

    skipped = {"script", "style", "noscript", "head", "svg", "iframe", "template"}
    blocks = {"p", "div", "section", "article", "ul", "ol", "table", "figure", "header", "footer", "main", "tr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.links: list[str] = []
        self.lists: list[list] = []
        self.code = False

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in self.skipped:
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            level = self.lists[-1] if self.lists else ["ul", 0]
            level[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{level[1]}. " if level[0] == "ol" else "- "))
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.code = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag == "a":
            self.links.append(values.get("href") or "")
            self.out.append("[")
        elif tag == "img" and values.get("src"):
            self.out.append(f"![{values.get('alt') or ''}]({values['src']})")
        elif tag in self.blocks:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in self.skipped:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.code = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag == "a" and self.links:
            target = self.links.pop()
            self.out.append(f"]({target})" if target else "]")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n")
        elif tag in self.blocks or re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.code else re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str | None:
    """Markdown of a page; null stays null, a page without content gives ''."""
    if html is None:
        return None
    renderer = _Renderer()
    renderer.feed(html)
    renderer.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(renderer.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(StringType())
def markdown_of(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)


def crawled(pages: DataFrame) -> DataFrame:
    """(url, markdown, metadata) of (url, html)."""
    return pages.select("url", markdown_of("html").alias("markdown"), T.page_metadata(F.col("html")).alias("metadata"))
