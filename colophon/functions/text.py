"""Column builders for text; all run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
PHRASE_WORD = r"[a-z][a-z0-9'-]*"
DRIFT_WORD = r"[a-z][a-z0-9'-]+"


def keyword(raw: Column) -> Column:
    """Lower case, white space (also the non-breaking kind) collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(raw), r"(?U)\s+", " "))


def topic_value(raw: Column) -> Column:
    """A topic as typed in a query: lower case, dashes and all but letters and digits as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}\s]+|[‐-―]", " "), r"\s+", " "))


def words(raw: Column, pattern: str = WORD) -> Column:
    """Array of the matches of ``pattern`` in lower case; of null, an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(raw, F.lit(""))), F.lit(pattern), F.lit(0))


#: Letters with diacritics and what they fold to, by canonical decomposition.
_FOLDS = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()}
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold(raw: str) -> str:
    """``raw`` without diacritics."""
    return raw.translate(str.maketrans({**_FOLDS, **dict.fromkeys(_MARKS)}))


def folded(raw: Column) -> Column:
    """:func:`fold` for a column."""
    return F.translate(raw, "".join(_FOLDS) + _MARKS, "".join(_FOLDS.values()))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where lambdas would evaluate it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Array of the runs of ``n`` neighbouring tokens, joined by spaces."""

    def runs(t: Column) -> Column:
        count = F.greatest(F.size(t) - (n - 1), F.lit(0))
        grams = F.slice(t, F.lit(1), count)
        for j in range(1, n):
            grams = F.zip_with(grams, F.slice(t, F.lit(1 + j), count), lambda a, b: F.concat(a, F.lit(" "), b))
        return grams

    return let(tokens, runs)


def count_run(tokens: Column, run: Sequence[str]) -> Column:
    """How often the words of ``run`` stand in a row among ``tokens``."""
    if len(run) == 1:
        return count_term(tokens, F.lit(run[0]))

    def count(t: Column) -> Column:
        whole = lambda i: all_of(F.get(t, i + j) == word for j, word in enumerate(run))
        starts = F.sequence(F.lit(0), F.greatest(F.size(t) - len(run), F.lit(0)))
        return F.when(all_of(F.array_contains(t, word) for word in run), F.size(F.filter(starts, whole))).otherwise(F.lit(0))

    return let(tokens, count)


def word_count(raw: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(raw, F.lit("")), r"\s+"), lambda w: w != ""))


def count_term(tokens: Column, term: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def bounded_count(raw: Column, alias: str) -> Column:
    """How often ``alias`` stands in the text without a letter a-z or digit at either side."""
    escaped = "".join(c if c.isalnum() or c == " " else "\\" + c for c in alias)
    return F.regexp_count(F.lower(F.coalesce(raw, F.lit(""))), F.lit(rf"(?<![a-z0-9]){escaped}(?![a-z0-9])"))


def stem(word: Column) -> Column:
    """Light stemmer: plural, then derivation, then a doubled consonant; in each step the first rule that applies.  Words of
    fewer than four letters stay."""

    def first(value: Column, rules: Iterable[tuple[str, str]]) -> Column:
        result = value
        for pattern, by in reversed(list(rules)):
            result = F.when(value.rlike(pattern), F.regexp_replace(value, pattern, by)).otherwise(result)
        return result

    # Suffixes and what stands for them.
    plural = (("sses$", "ss"), ("ies$", "y"), ("ied$", "y"), ("([a-rt-z])s$", "$1"))
    derived = (("(iz|is)ation$", "$1e"), ("ation$", "ate"), ("([aeiou][a-z]+)ing$", "$1"), ("([aeiou][a-z]+)ed$", "$1"))
    doubled = (("([bdgmnprt])\\1$", "$1"),)
    low = F.lower(word)
    return F.when(F.length(low) < 4, low).otherwise(first(first(first(low, plural), derived), doubled))


def character_bigrams(raw: Column) -> Column:
    """Set of the pairs of neighbouring characters."""
    n = F.length(raw)
    starts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(raw, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two sets; 0 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def shortened(raw: Column, most: int, dots: str = "...", at_space: bool = True) -> Column:
    """Cut after ``most`` characters, at the last space if that keeps over 70 %, and dotted."""
    head = F.substring(raw, 1, most)
    space = most - F.locate(" ", F.reverse(head))
    fits = F.locate(" ", F.reverse(head)) > 0
    cut = F.when(fits & (space > most * 0.7), F.left(head, space)).otherwise(head) if at_space else head
    return F.when(F.length(raw) <= most, raw).otherwise(F.concat(cut, F.lit(dots)))


def display_section(label: Column, sections: Sequence[str]) -> Column:
    """A chunk's label as shown to readers; a label in words counts by its spelling with underscores, or its first word."""
    key = F.regexp_replace(F.lower(F.trim(label)), r"\s+", "_")
    first = F.regexp_extract(key, r"^([a-z]+)", 1)
    named = F.when(key == "title_summary", F.lit("lead_essay")).when(key.isin(list(sections)), key).when(first.isin(list(sections)), first)
    return F.coalesce(named, F.lit("other"))


def section_of_title(title: Column, patterns: dict[str, str], default: Column) -> Column:
    branches = [F.when(title.rlike(f"(?i){p}"), F.lit(name)) for name, p in patterns.items()]
    return F.coalesce(*branches, default)


def without_leading_emoji(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"^[\x{1F000}-\x{1FFFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}\s]+", ""))


def quarter_key(date: Column) -> Column:
    """``2024-Q3`` of a date text; null if it is no date."""
    day = F.try_to_date(date, "yyyy-MM-dd")
    return F.when(day.isNotNull(), F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")))


def html_to_text(raw: Column) -> Column:
    """Text of a page: scripts, styles and tags out, basic entities decoded, tags they reveal out too, comparisons kept."""
    text = F.regexp_replace(raw, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.regexp_replace(text, r"(?i)</?[a-z][a-z0-9]*(\s+[^>]*)?>", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_metadata(html: Column) -> Column:
    """Map of ``<title>`` and every ``<meta name|property content>``; the last of equal names wins."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    name = lambda t: F.regexp_extract(t, r"(?is)\b(?:name|property)\s*=\s*[\"']([^\"']+)[\"']", 1)
    content = lambda t: F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)
    named = F.filter(tags, lambda t: name(t) != "")
    title = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    pairs = F.transform(named, lambda t: F.struct(name(t).alias("key"), content(t).alias("value")))
    pairs = F.concat(F.array(F.struct(F.lit("title").alias("key"), F.trim(title).alias("value"))), pairs)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.filter(last, lambda p: p["value"] != ""))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    """Conjunction of the conditions; true if there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def escaped(raw: Column, keep_marks: bool = False) -> Column:
    """Text for a page: ``& < > " '`` as references; ``keep_marks`` leaves the marks of a highlight as they are."""
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        raw = F.replace(raw, F.lit(sign), F.lit(reference))
    if keep_marks:
        for mark in ("<mark>", "</mark>"):
            raw = F.replace(raw, F.lit(mark.replace("<", "&lt;").replace(">", "&gt;")), F.lit(mark))
    return raw
