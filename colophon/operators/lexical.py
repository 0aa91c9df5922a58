"""Lexical search: postings, BM25 with column weights, phrases, highlights, suggestions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import dictionaries as D
from colophon.functions import text as T
from colophon.functions.porter import porter, porter_all


def postings(documents: DataFrame, doc_id: str, fields: Sequence[str], stemmed: bool = False) -> DataFrame:
    """(doc_id, field, term, tf, positions): the inverted index.  ``stemmed`` applies Porter's stemmer in Arrow batches."""
    each = [F.struct(F.lit(f).alias("field"), T.words(F.col(f)).alias("tokens")) for f in fields]
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(*each)).alias("f")).select("doc_id", "f.field", "f.tokens")
    if stemmed:
        rows = rows.withColumn("tokens", porter_all("tokens"))
    terms = rows.select("doc_id", "field", F.posexplode("tokens").alias("position", "term"))
    grouped = terms.groupBy("doc_id", "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    return grouped


def bm25(
    documents: DataFrame,
    doc_id: str,
    groups: Sequence[Sequence[str]],
    weights: Mapping[str, float] = D.FIELD_WEIGHTS,
    stemmed: bool = False,
) -> DataFrame:
    """(doc_id, bm25) of the documents that hold every group of words in a row in one column; smaller is better.

    -sum of idf(q) f (k1 + 1) / (f + k1 (1 - b + b |D| / avg|D|)), f weighted by column, |D| over all columns.  The columns
    are tokenized in the scan, and counts of the query's words alone leave it: one pass for the corpus statistics, a few
    numbers for the driver, one pass for the matching documents.  No words match nothing; null columns are empty.
    """
    fields = list(weights)
    tokens = {f: T.words(F.col(f)) for f in fields}
    if stemmed:
        tokens = {f: porter_all(c) for f, c in tokens.items()}
        groups = [[porter(w) for w in g] for g in groups]
    rows = documents.select(F.col(doc_id).alias("doc_id"), *[c.alias(f"_t_{f}") for f, c in tokens.items()])
    frequency = lambda group: {f: T.count_run(F.col(f"_t_{f}"), group) for f in fields}
    sums = [F.struct(*[c.alias(f) for f, c in frequency(g).items()]).alias(f"_q{i}") for i, g in enumerate(groups)]
    length = reduce(lambda a, b: a + b, [F.size(f"_t_{f}") for f in fields])
    counted = rows.select("doc_id", length.cast("double").alias("_length"), *sums)
    hit = [T.any_of(F.col(f"_q{i}.{f}") > 0 for f in fields) for i in range(len(groups))]
    statistics = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_length").alias("average"), *[F.sum(h.cast("long")).alias(f"h{i}") for i, h in enumerate(hit)]
    ).first()
    if not groups or not statistics["n"]:
        return counted.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("bm25"))
    parts = []
    for i in range(len(groups)):
        n, h = float(statistics["n"]), float(statistics[f"h{i}"] or 0)
        idf = F.greatest(F.ln(F.lit((n - h + 0.5) / (h + 0.5))), F.lit(D.LEAST_IDF))
        f = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f"_q{i}.{name}") for name, w in weights.items()])
        norm = F.lit(D.BM25_K1) * (F.lit(1 - D.BM25_B) + F.lit(D.BM25_B) * F.col("_length") / F.lit(float(statistics["average"] or 1.0)))
        parts.append(idf * f * F.lit(D.BM25_K1 + 1) / (f + norm))
    score = -reduce(lambda a, b: a + b, parts)
    return counted.where(T.all_of(hit)).select("doc_id", score.alias("bm25"))


def ranked(scores: DataFrame, top: int = 500) -> DataFrame:
    """The ``top`` documents with their ``rank``; ties go by identifier."""
    best = scores.orderBy(F.col("bm25").asc(), F.col("doc_id").asc()).limit(top)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("bm25").asc(), F.col("doc_id").asc())))


def highlight(raw: Column, terms: Sequence[str], size: int = 24) -> Column:
    """The stretch of ``size`` words with most query words, these marked, dots where text is left out."""
    parts = F.filter(F.split(F.coalesce(raw, F.lit("")), r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", "")
    is_hit = lambda w: bare(w).isin(list(terms))
    hits = F.filter(F.transform(parts, lambda w, i: F.when(is_hit(w), i)), lambda i: i.isNotNull())
    density = F.transform(hits, lambda i: F.struct(F.size(F.filter(hits, lambda j: (j >= i) & (j < i + size))).alias("n"), (-i).alias("at")))
    start = F.coalesce(-F.array_max(density)["at"], F.lit(0))
    shown = F.transform(F.slice(parts, start + 1, size), lambda w: F.when(is_hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
    return F.concat(F.when(start > 0, "... ").otherwise(""), F.array_join(shown, " "), F.when(start + size < F.size(parts), " ...").otherwise(""))


def suggestions(documents: DataFrame, fields: Sequence[str], prefix: str, top: int = 10) -> DataFrame:
    """(word): distinct words of ``fields`` that begin with the last word of ``prefix`` and are longer, shortest first."""
    last = (prefix.lower().split() or [""])[-1]
    if len(last) < 2:
        return documents.where(F.lit(False)).select(F.lit("").alias("word"))
    every = F.concat_ws(" ", *[F.regexp_replace(F.coalesce(F.col(f), F.lit("")), r"\[([^\]]*)\]\([^)]*\)", "$1") for f in fields])
    pieces = F.transform(F.split(F.lower(every), r"[\s|,]+"), lambda w: F.regexp_replace(w, r"[^a-z'-]", ""))
    fitting = F.array_distinct(F.filter(pieces, lambda w: (F.length(w) >= 3) & w.startswith(last) & (w != last)))
    found = documents.select(F.explode(fitting).alias("word")).distinct()
    return found.orderBy(F.length("word"), "word").limit(top)
