"""Markup in text: find its constructs and turn them into clean text that keeps headings, lists, code and formulas."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Commands of LaTeX that stand without an argument in braces.
BARE_COMMANDS = (
    "item|par|maketitle|noindent|newpage|clearpage|tableofcontents|appendix|centering|hline|ldots|cdots|dots|LaTeX|TeX"
    "|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|rho|sigma|tau|phi|omega|leq|geq|neq|approx|times|cdot|infty|sum"
    "|prod|int|partial|nabla|forall|exists|rightarrow|leftarrow|Rightarrow|quad|qquad"
)

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*|/)?>|<!--|<https?://[^\s<>]+>|<!DOCTYPE", re.I)
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_TICKS = re.compile(r"`[^`\n]+`|^[ ]{0,3}```", re.M)
_STARS = re.compile(r"\*\*(?:\S|[^\s*][^*\n]*?[^\s*])\*\*|(?<![\w*])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])|^[ \t]*\*+[ \t]+\S", re.M)
_UNDERSCORES = re.compile(r"(?<![\w_])(__?)(?=[^\s_])[^\n]*?(?<=[^\s_])\1(?![\w_])")
_STRUCK = re.compile(r"~~(?=\S)[^~\n]+?~~|^~~~", re.M)
_BRACKETS = re.compile(
    r"\[[^\]\[\n]*\]\([^()\s]*(?:\s+[\"'][^\"'\n]*[\"'])?\)|\[\^[^\]\s]+\]|\[\[[^\]\n]+\]\]|\[(?:https?|ftp)://[^\s\]]+(?:\s[^\]\n]*)?\]"
    r"|\[[^\]\[\n]+\]\[[^\]\[\n]*\]|^\[[^\]\n]+\]:\s+\S",
    re.M,
)
_DOLLARS = re.compile(r"\$\$|(?<![\w$\\])\$(?=[^\s$])([^$\n]+?)(?<=[^\s$])\$(?!\w)")
_FORMULA = re.compile(r"[\\^_=<>+]|^[A-Za-z]$|^[A-Za-z]\s*[-*/]\s*\w")
_COMMAND = re.compile(rf"\\(?:begin|end)\{{|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{{|\\(?:{BARE_COMMANDS})(?![A-Za-z\\])|\\\([^\n]+?\\\)|\\\[(?s:.+?)\\\]")
_BRACES = re.compile(r"\{\{[^{}]+(?:\{\{[^{}]*\}\}[^{}]*)*\}\}|^\{\|", re.M)
_RULED = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[^\n|]+\|[ \t]*$\n^[ \t]*\|[ \t:-]+\|", re.M)
_EQUALS = re.compile(r"^(={1,6})(?!=)[^\n]*?[^=\s][ \t]*\1[ \t]*$|^[^\s=][^\n]*\n={3,}[ \t]*$", re.M)
_QUOTES = re.compile(r"'{2,5}(?=[^\s'])[^\n]*?(?<=[^\s'])'{2,5}")
_HASH = re.compile(r"^[ ]{0,3}#{1,6}[ \t]+\S", re.M)
_DASH = re.compile(r"^[ \t]*-[ \t]+\S|^[^\s\-|][^\n]*\n-{3,}[ \t]*$|^[ ]{0,3}-{3,}[ \t]*$", re.M)
_PLUS = re.compile(r"^[ \t]*\+[ \t]+\S", re.M)
_NUMBER = re.compile(r"^[ \t]*\d{1,3}[.)][ \t]+\S", re.M)
_ANGLE = re.compile(r"^[ ]{0,3}>[ \t]?\S", re.M)

#: Sign that a text must hold -> (notation, pattern); a pattern is only searched where its sign occurs.
_RULES = (
    ("<", "html", _TAG),
    ("&", "html", _REFERENCE),
    ("**", "markdown", _STARS),
    ("*", "markdown", _STARS),
    ("#", "markdown", _HASH),
    ("`", "markdown", _TICKS),
    ("~~", "markdown", _STRUCK),
    ("[", "markdown", _BRACKETS),
    ("|", "markdown", _RULED),
    ("- ", "markdown", _DASH),
    ("---", "markdown", _DASH),
    ("+ ", "markdown", _PLUS),
    (">", "markdown", _ANGLE),
    ("_", "markdown", _UNDERSCORES),
    ("''", "wiki", _QUOTES),
    ("=", "wiki", _EQUALS),
    ("{", "wiki", _BRACES),
    ("\\", "latex", _COMMAND),
)


def has_markup(text: str | None) -> bool:
    """Whether ``text`` holds at least one construct; signs of prose that only look like markup are none."""
    if not text:
        return False
    for sign, _, pattern in _RULES:
        if sign in text:
            if sign == "&":
                if any(m[0].startswith("&#") or m[0][1:] in html5 for m in pattern.finditer(text)):
                    return True
            elif pattern.search(text):
                return True
    if "$" in text and any(m[1] is None or _FORMULA.search(m[1]) for m in _DOLLARS.finditer(text)):
        return True
    return bool(_NUMBER.search(text))


# Conversion.  Code and formulas are put aside first, then each notation is rewritten, then they return.

_KEEP = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z)|<(?P<dead>script|style|noscript)\b[^>]*>.*?</(?P=dead)\s*>)"
    r"|(?P<pre><(?P<t>pre|syntaxhighlight|source)\b[^>]*>(?P<precode>.*?)</(?P=t)\s*>)"
    r"|(?P<nowiki><nowiki>(?P<raw>.*?)</nowiki>)"
    r"|(?P<verb>\\begin\{(?P<v>verbatim|lstlisting)\}(?P<verbcode>.*?)\\end\{(?P=v)\})"
    r"|(?P<fence>^[ ]{0,3}(?P<f>```+|~~~+)[^\n]*\n(?P<fencecode>.*?)(?:^[ ]{0,3}(?P=f)[ \t]*$|\Z))"
    r"|(?P<block>\$\$(?P<d1>.+?)\$\$|\\\[(?P<d2>.+?)\\\]|\\begin\{(?P<e>equation|align|gather|displaymath)\*?\}(?P<d3>.+?)\\end\{(?P=e)\*?\})"
    r"|(?P<inline>\\\((?P<i1>.+?)\\\)|(?<![\w$\\])\$(?=[^\s$])(?P<i2>[^$\n]+?)(?<=[^\s$])\$(?!\w)|<math>(?P<i3>.*?)</math>)"
    r"|(?P<tick>`(?P<code>[^`\n]+)`)",
    re.S | re.M | re.I,
)
_SPOT = re.compile("\ue000(\\d+)\ue001")


def _put_aside(text: str, kept: list[str]) -> str:
    def keep(m: re.Match) -> str:
        kind = m.lastgroup
        g = m.groupdict()
        if g["comment"] is not None:
            return ""
        if g["pre"] is not None:
            code = html.unescape(re.sub(r"</?code\b[^>]*>", "", g["precode"])).strip("\n")
        elif g["nowiki"] is not None:
            kept.append(g["raw"])
            return f"\ue000{len(kept) - 1}\ue001"
        elif g["verb"] is not None or g["fence"] is not None:
            code = (g["verbcode"] if g["verb"] is not None else g["fencecode"]).strip("\n")
        elif g["block"] is not None:
            kept.append("$$\n" + (g["d1"] or g["d2"] or g["d3"]).strip() + "\n$$")
            return f"\n\n\ue000{len(kept) - 1}\ue001\n\n"
        elif g["inline"] is not None:
            body = g["i1"] or g["i2"] or g["i3"] or ""
            if g["i2"] is not None and not _FORMULA.search(body):
                return m[0]
            kept.append(f"${body.strip()}$")
            return f"\ue000{len(kept) - 1}\ue001"
        elif g["tick"] is not None:
            kept.append(f"`{g['code'].strip()}`")
            return f"\ue000{len(kept) - 1}\ue001"
        else:
            raise AssertionError(kind)
        kept.append(f"```\n{code}\n```")
        return f"\n\n\ue000{len(kept) - 1}\ue001\n\n"

    return _KEEP.sub(keep, text)


def _level(n: str, title: str) -> str:
    return f"\n\n{'#' * int(n)} {' '.join(title.split())}\n\n"


_HTML_STEPS = (
    (re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", re.S | re.I), lambda m: _level(m[1], m[2])),
    (re.compile(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", re.S | re.I), ""),
    (re.compile(r"<li\b[^>]*>\s*", re.I), "\n- "),
    (re.compile(r"<t[dh]\b[^>]*>\s*", re.I), " | "),
    (re.compile(r"<tr\b[^>]*>\s*", re.I), "\n"),
    (re.compile(r"<img\b[^>]*\balt=[\"']([^\"']*)[\"'][^>]*>", re.I), r"\1"),
    (re.compile(r"<blockquote\b[^>]*>\s*(?:<p\b[^>]*>)?\s*", re.I), "\n\n> "),
    (re.compile(r"<(?:br|hr)\b[^>]*>", re.I), "\n"),
    (re.compile(r"</?(?:p|div|ul|ol|table|blockquote|figure|figcaption|section|article|header|footer|pre)\b[^>]*>", re.I), "\n\n"),
    (re.compile(r"<(https?://[^\s<>]+)>"), r"\1"),
    (re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*|/)?>|<!DOCTYPE[^>]*>", re.I), ""),
)
_WIKI_STEPS = (
    (re.compile(r"^\{\|[^\n]*$\n?|^\|\}[ \t]*$|^\|-[^\n|]*$\n?", re.M), ""),
    (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"^(={1,6})(?!=)[ \t]*([^\n]*?[^=\s])[ \t]*\1[ \t]*$", re.M), lambda m: _level(str(len(m[1])), m[2])),
    (re.compile(r"\[\[(?:File|Image|Category):[^\]\n|]*(?:\|[^\]\n|]*)*?\|?([^\]\n|]*)\]\]", re.I), r"\1"),
    (re.compile(r"\[\[(?:[^\]\n|]*\|)?([^\]\n|]*)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\]\n]*))?\]"), lambda m: m[1] or ""),
    (re.compile(r"'{2,5}(?=[^\s'])([^\n]*?)(?<=[^\s'])'{2,5}"), r"\1"),
    (re.compile(r"^[!|][ \t]+(?=[^\s|][^\n|]*$)", re.M), "| "),
    (re.compile(r"^\*{2,}[ \t]+", re.M), "  - "),
)
_LATEX_STEPS = (
    (re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}"), lambda m: _level(str(2 + m[0].count("sub")), m[1])),
    (re.compile(r"\\(?:chapter|part|title)\*?\{([^{}]*)\}"), lambda m: _level("1", m[1])),
    (re.compile(r"~?\\(?:cite|citep|citet|ref|label|footnote|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}"), ""),
    (re.compile(r"[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*"), lambda m: "\n- " + (f"{m[1]}: " if m[1] else "")),
    (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?"), "\n\n"),
    (re.compile(r"\\(?:maketitle|noindent|newpage|clearpage|tableofcontents|centering|hline|par)(?![A-Za-z])"), ""),
    (re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\([%&_#${}])"), r"\1"),
)
_MARKDOWN_STEPS = (
    (re.compile(r"^([^\s\-=|#>][^\n]*)\n(=|-)\2{2,}[ \t]*$", re.M), lambda m: _level("1" if m[2] == "=" else "2", m[1])),
    (re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", re.M), lambda m: _level(str(len(m[1])), m[2])),
    (re.compile(r"^\[\^?[^\]\n]+\]:\s+[^\n]*$", re.M), ""),
    (re.compile(r"\[\^[^\]\s]+\]"), ""),
    (re.compile(r"!?\[([^\]\[\n]*)\]\([^()\s]*(?:\s+[\"'][^\"'\n]*[\"'])?\)"), r"\1"),
    (re.compile(r"\[([^\]\[\n]+)\]\[[^\]\[\n]*\]"), r"\1"),
    (re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*$\n?", re.M), ""),
    (re.compile(r"^[ \t]*\|[ \t]*([^\n]*?)[ \t]*\|[ \t]*$", re.M), r"\1"),
    (re.compile(r"^[ ]{0,3}(?:-{3,}|\*{3,}|_{3,})[ \t]*$", re.M), ""),
    (re.compile(r"^([ \t]*)[*+][ \t]+(?=\S)", re.M), r"\1- "),
    (re.compile(r"~~(?=\S)[^~\n]+?~~[ \t]?"), ""),
    (re.compile(r"(\*\*|__)(?=[^\s*_])([^\n]*?[^\s*_])\1"), r"\2"),
    (re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w_])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w_])"), r"\1"),
)
_BLANKS = (
    (re.compile(r"[ \t]+$", re.M), ""),
    (re.compile(r"(?<=\S)[ \t]{2,}"), " "),
    (re.compile(r"^[ \t]*\|[ \t]+", re.M), ""),
    (re.compile(r"^(- [^\n]*)\n\n+(?=- )", re.M), r"\1\n"),
    (re.compile(r"\n{3,}"), "\n\n"),
)


def clean_text(text: str | None) -> str | None:
    """``text`` without markup.  Headings come out as ``#`` lines, list items as ``- `` lines, quotes as ``> `` lines, code
    between lines of three backticks, formulas between dollar signs, cells of a row apart by `` | ``.  Null stays null."""
    if not text or not has_markup(text):
        return text
    kept: list[str] = []
    text = _put_aside(text.replace("\r\n", "\n"), kept)
    for steps in (_HTML_STEPS if "<" in text else (), _WIKI_STEPS, _LATEX_STEPS if "\\" in text else (), _MARKDOWN_STEPS):
        for pattern, by in steps:
            text = pattern.sub(by, text)
    if "&" in text:
        text = html.unescape(text)
    for pattern, by in _BLANKS:
        text = pattern.sub(by, text)
    for _ in range(3):
        text = _SPOT.sub(lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", text)
    return text.strip()


@F.pandas_udf(BooleanType())
def _has_markup(texts: pd.Series) -> pd.Series:
    return texts.map(has_markup).astype("bool")


@F.pandas_udf(StringType())
def _clean_text(texts: pd.Series) -> pd.Series:
    return texts.map(clean_text)


def marked(text: Column) -> Column:
    """True where ``text`` holds a construct; null and empty texts hold none."""
    return F.coalesce(_has_markup(text), F.lit(False))


def cleaned(text: Column) -> Column:
    """:func:`clean_text` of a column, in Arrow batches."""
    return _clean_text(text)


def _marked_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [has_markup(t) for t in batch["text"]]
        yield batch.loc[found, ["record_kind", "record_id"]]


def records_with_markup(records: DataFrame) -> DataFrame:
    """(record_kind, record_id) of the ``records`` (with ``text``) that hold a construct; only keys leave Python."""
    rows = records.where(F.col("text").isNotNull() & (F.col("text") != "")).select("record_kind", "record_id", "text")
    return rows.mapInPandas(_marked_keys, "record_kind string, record_id string")
