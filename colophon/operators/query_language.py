"""The query language: phrases, operators and free text, parsed on the driver (a query is one short string)."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from datetime import date

from colophon.functions.dictionaries import OPERATORS, SECTIONS

LONGEST = 500
_QUOTED_OPERATOR = re.compile(r'(\w+):"([^"]+)"')
_PHRASE = re.compile(r'"([^"]+)"')
_OPERATOR = re.compile(r"(\w+):(\S+)")


@dataclass
class Filters:
    before: str | None = None
    after: str | None = None
    year: int | None = None
    issue_number: int | None = None
    section: str | None = None
    topic: str | None = None

    def given(self) -> dict:
        return {k: v for k, v in vars(self).items() if v is not None}


@dataclass
class ParsedQuery:
    free_text: str = ""
    phrases: list[str] = field(default_factory=list)
    filters: Filters = field(default_factory=Filters)
    operators: list[str] = field(default_factory=list)

    @property
    def filter_only(self) -> bool:
        """No text and no phrase, but a filter."""
        return not self.free_text and not self.phrases and bool(self.filters.given())


def normal_topic(value: str) -> str:
    """Compatibility form in lower case; dashes and all but letters and digits become spaces."""
    folded = unicodedata.normalize("NFKC", value.lower())
    return " ".join("".join(c if c.isalnum() or unicodedata.category(c).startswith("L") else " " for c in folded).split())


def query_date(value: str) -> str | None:
    """First day of a year, a month, or the day itself; None for what is no date."""
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            return date.fromisoformat(value).isoformat()
        if re.fullmatch(r"\d{4}-\d{2}", value):
            return date.fromisoformat(value + "-01").isoformat()
    except ValueError:
        return None
    return f"{value}-01-01" if re.fullmatch(r"\d{4}", value) else None


def _leading_int(value: str) -> int | None:
    m = re.match(r"\s*[+-]?\d+", value)
    return int(m[0]) if m else None


def parse_query(raw: str) -> ParsedQuery:
    """Quoted topics, then phrases, then ``key:value`` operators; the rest is free text.

    Keys ignore case.  An unknown key stays in the free text; so does an unknown section, which is listed as an operator all
    the same.  A date, year or number that can't be used is consumed without effect.
    """
    parsed = ParsedQuery()

    def quoted(m: re.Match) -> str:
        if m[1].lower() != "topic":
            return m[0]
        if topic := normal_topic(m[2]):
            parsed.filters.topic = topic
            parsed.operators.append(f"{m[1]}:{m[2]}")
        return ""

    def operator(m: re.Match) -> str:
        key, value = m[1].lower(), m[2]
        if key not in OPERATORS:
            return m[0]
        parsed.operators.append(m[0])
        if key in ("before", "after"):
            setattr(parsed.filters, key, query_date(value) or getattr(parsed.filters, key))
        elif key == "section":
            if value.lower() not in SECTIONS:
                return m[0]
            parsed.filters.section = value.lower()
        elif key == "topic":
            if '"' not in value and (topic := normal_topic(value)):
                parsed.filters.topic = topic
        else:
            number = _leading_int(value)
            if key == "year" and number is not None and 2000 <= number <= 2100:
                parsed.filters.year = number
            if key == "issue" and number is not None and number > 0:
                parsed.filters.issue_number = number
        return ""

    rest = _QUOTED_OPERATOR.sub(quoted, raw[:LONGEST].strip())
    parsed.phrases = _PHRASE.findall(rest)
    rest = _OPERATOR.sub(operator, _PHRASE.sub("", rest))
    parsed.free_text = " ".join(rest.split())
    return parsed


def match_groups(parsed: ParsedQuery) -> list[list[str]]:
    """Groups of words that a document must hold, each group in a row: phrases, then single words; hyphenated words count as
    a phrase.  Letters keep their accents."""
    split = lambda text: re.findall(r"[^\W_]+", text.lower())
    groups = [split(p) for p in parsed.phrases] + [split(w) for w in parsed.free_text.split()]
    return [g for g in groups if g]


def page_of(page: str | int | None, limit: str | int | None, most: int = 50, default: int = 20) -> tuple[int, int]:
    """(offset, limit): pages count from 1, limits lie in 1..``most``."""
    number = _leading_int(str(page or "")) or 1
    size = _leading_int(str(limit or "")) or default
    size = max(1, min(most, size))
    return (max(1, number) - 1) * size, size


def with_operator(raw: str, key: str, value: str | None) -> str:
    """``raw`` with its ``key:`` operators replaced by one, or removed if ``value`` is None."""
    kept = re.sub(rf'(?i)(?<!\S){re.escape(key)}:("[^"]*"|\S*)', "", raw)
    word = f'"{value}"' if value and " " in value else value
    return " ".join([*kept.split(), *([f"{key}:{word}"] if word else [])])
