"""Keywords of single documents after R. Campos et al., "YAKE! Keyword extraction from single documents using multiple local
features" (2020)."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions.dictionaries import PHRASE_STOPWORDS

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TOKEN = re.compile(r"[^\W\d_][\w'’-]*|\d[\w.,]*|[^\w\s]")


def _word_scores(sentences: list[list[str]], stop: frozenset[str]) -> dict[str, float]:
    """The paper's term score from casing, position, frequency, relatedness and spread; smaller is better."""
    count, upper, acronym = Counter(), Counter(), Counter()
    places, left, right = defaultdict(list), defaultdict(Counter), defaultdict(Counter)
    for number, tokens in enumerate(sentences):
        previous = None
        for i, token in enumerate(tokens):
            if not token[0].isalnum():
                previous = None
                continue
            word = token.lower()
            count[word] += 1
            places[word].append(number)
            if len(token) > 1 and token.isupper():
                acronym[word] += 1
            elif i > 0 and token[0].isupper():
                upper[word] += 1
            if previous is not None:
                right[previous][word] += 1
                left[word][previous] += 1
            previous = word
    real = [n for w, n in count.items() if w not in stop]
    if not real:
        return {}
    mean = sum(real) / len(real)
    deviation = math.sqrt(sum((n - mean) ** 2 for n in real) / len(real))
    most = max(count.values())
    scores = {}
    for word, n in count.items():
        case = max(upper[word], acronym[word]) / (1 + math.log(n))
        seen = sorted(places[word])
        position = math.log(math.log(3 + seen[len(seen) // 2]))
        frequency = n / (mean + deviation)
        side = lambda c: len(c) / sum(c.values()) if c else 0.0
        related = 1 + (side(left[word]) + side(right[word])) * n / most
        spread = len(set(seen)) / len(sentences)
        scores[word] = related * position / (case + frequency / related + spread / related)
    return scores


def _distance(a: str, b: str) -> float:
    """Levenshtein similarity in [0, 1]."""
    if a == b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def _bag(word: str) -> int:
    """Bits of the letters and how often each stands in ``word``: a bit that another bag lacks costs an edit at least."""
    bits, counts = 0, Counter()
    for c in word:
        place = ord(c) % 64
        bits |= 1 << (place * 8 + min(counts[place], 7))
        counts[place] += 1
    return bits


def _apart(a: str, bag_a: int, b: str, bag_b: int, same: float) -> bool:
    """Whether two spellings are less alike than ``same``; the distance is only worked out where the bags leave it open."""
    longest = max(len(a), len(b))
    if abs(len(a) - len(b)) > (1 - same) * longest:
        return True
    edits = max((bag_a & ~bag_b).bit_count(), (bag_b & ~bag_a).bit_count())
    return 1 - edits / max(longest, 1) < same or _distance(a, b) < same


def extract(text: str | None, top: int = 25, longest: int = 3, same: float = 0.85, stopwords: tuple[str, ...] = PHRASE_STOPWORDS) -> list[tuple[str, str, float]]:
    """(keyword, as written, score) of at most ``top`` keywords of up to ``longest`` words; a smaller score is better, and of
    spellings alike by ``same`` the best stays.  Null and empty texts have none."""
    stop = frozenset(stopwords)
    sentences = [t for t in (_TOKEN.findall(s) for s in _SENTENCE.split(text or "")) if t]
    words = _word_scores(sentences, stop)
    found: Counter = Counter()
    written: dict[str, str] = {}
    for tokens in sentences:
        for i in range(len(tokens)):
            for n in range(1, longest + 1):
                run = tokens[i : i + n]
                if len(run) < n or not all(t[0].isalpha() and len(t) > 1 for t in run):
                    break
                if run[0].lower() in stop or run[-1].lower() in stop:
                    continue
                key = " ".join(run).lower()
                found[key] += 1
                written.setdefault(key, " ".join(run))
    scored = []
    for key, n in found.items():
        product, total = 1.0, 0.0
        for w in key.split():
            if w not in stop:
                product *= words[w]
                total += words[w]
        scored.append((product / (n * (1 + total)), key))
    kept: list[tuple[str, str, float]] = []
    bags: list[int] = []
    for score, key in sorted(scored):
        bag = _bag(key)
        if all(_apart(key, bag, k, b, same) for (k, _, _), b in zip(kept, bags)):
            kept.append((key, written[key], score))
            bags.append(bag)
            if len(kept) == top:
                break
    return kept


def keywords(documents: DataFrame, doc_id: str, text: str, top: int = 25, **options) -> DataFrame:
    """(doc_id, keyword, keyword_display, score, rank) in Arrow batches, one document at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, w, s, i) for d, t in zip(batch["doc_id"], batch["text"]) for i, (k, w, s) in enumerate(extract(t, top, **options), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "keyword", "keyword_display", "score", "rank"]).astype({"score": "float64", "rank": "int32"})

    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, keyword string, keyword_display string, score double, rank int")
