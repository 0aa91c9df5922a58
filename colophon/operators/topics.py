"""Topic mining and analytics: lexicon, entities, quality, aggregation, bursts, similarity, drift."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import dictionaries as D
from colophon.functions import text as T
from colophon.functions import vectors as V
from colophon.operators.components import components
from colophon.operators.skew import skew_join
from colophon.session import cut, stored

# Finding topics in texts.


def phrase_lexicon(
    documents: DataFrame, text: str, least_pmi: float = D.LEAST_PMI, least_documents: int = D.LEAST_COOCCURRENCE, size: int | None = D.LEXICON_SIZE, longest: int = 2
) -> DataFrame:
    """(phrase, pmi, cooccurrence, quality): neighbouring words that share documents more than chance allows.

    pmi = ln(c N / (f1 f2)), in documents; the first and last word are no stopwords and have three letters.  Phrases of three
    and four words pass without the limit on pmi.  quality = pmi (1 + log2(c + 1)) (1 + log2(words)).
    """
    rows = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(T.words(F.col(text), T.PHRASE_WORD).alias("tokens"))
    total = rows.count()
    edge = lambda w: (F.length(w) >= 3) & ~w.isin(list(D.PHRASE_STOPWORDS))
    words = rows.select(F.explode(F.array_distinct(F.filter("tokens", edge))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    grams = F.flatten(F.array(*[T.ngrams(F.col("tokens"), n) for n in range(2, max(2, min(4, longest)) + 1)]))
    ends = lambda g: edge(F.substring_index(g, " ", 1)) & edge(F.substring_index(g, " ", -1))
    phrases = rows.select(F.explode(F.array_distinct(F.filter(grams, ends))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("cooccurrence"))
    phrases = phrases.where(F.col("cooccurrence") >= least_documents).withColumns({"first": F.substring_index("phrase", " ", 1), "last": F.substring_index("phrase", " ", -1)})
    joined = phrases.join(words.select(F.col("word").alias("first"), F.col("f").alias("f1")), "first").join(words.select(F.col("word").alias("last"), F.col("f").alias("f2")), "last")
    n = F.size(F.split("phrase", " "))
    scored = joined.withColumn("pmi", F.ln(F.col("cooccurrence") * F.lit(float(total)) / (F.col("f1") * F.col("f2"))))
    scored = scored.where((F.col("pmi") >= least_pmi) | (n >= 3))
    strength = F.when(n >= 3, F.greatest(F.lit(0.1), F.col("pmi"))).otherwise(F.greatest(F.lit(0.0), F.col("pmi")))
    scored = scored.withColumn("quality", strength * (1 + F.log2(F.col("cooccurrence") + 1)) * (1 + F.log2(n.cast("double"))))
    result = scored.select("phrase", "pmi", "cooccurrence", "quality")
    return result if size is None else result.orderBy(F.round("quality", 9).desc(), "phrase").limit(size)


def lexicon_phrases(documents: DataFrame, doc_id: str, text: str, lexicon: DataFrame, small: int = D.SMALL_LEXICON) -> DataFrame:
    """(doc_id, keyword, occurrences): how often each phrase of the lexicon stands in a document.

    The lexicon is written down and measured first: runs of words of its lengths alone are made, and with at most ``small``
    phrases they meet it before they are shuffled; a larger one meets the counts.
    """
    known = stored(lexicon.select(F.col("phrase").alias("keyword")).distinct(), n="count(1)", least="min(size(split(keyword, ' ')))", most="max(size(split(keyword, ' ')))")
    lengths = range(known.observed["least"] or 1, (known.observed["most"] or 0) + 1)
    tokens = T.words(F.col(text), T.PHRASE_WORD)
    if not lengths:
        return documents.where(F.lit(False)).select(F.col(doc_id).alias("doc_id"), F.lit("").alias("keyword"), F.lit(0).cast("long").alias("occurrences"))
    rows = documents.select(F.col(doc_id).alias("doc_id"), tokens.alias("tokens"))
    grams = rows.select("doc_id", F.explode(F.concat(*[T.ngrams(F.col("tokens"), n) for n in lengths])).alias("keyword"))
    if known.observed["n"] <= small:
        grams = grams.join(F.broadcast(known.frame), "keyword", "left_semi")
    counts = grams.groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts if known.observed["n"] <= small else skew_join(counts, known.frame, ["keyword"], "left_semi", ["doc_id"])


def known_entities(documents: DataFrame, doc_id: str, text: str, entities: Mapping[str, Sequence[str]]) -> DataFrame:
    """(doc_id, keyword, occurrences): hits of the aliases of each entity, summed; overlapping aliases each count."""
    counts = []
    for name, aliases in entities.items():
        total = F.lit(0)
        for alias in aliases:
            total = total + T.bounded_count(F.col(text), alias)
        counts.append(F.struct(F.lit(name).alias("keyword"), total.cast("long").alias("occurrences")))
    if not counts:
        return documents.where(F.lit(False)).select(F.col(doc_id).alias("doc_id"), F.lit("").alias("keyword"), F.lit(0).cast("long").alias("occurrences"))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(*counts)).alias("e")).select("doc_id", "e.*")
    return rows.where("occurrences > 0")


#: Fixed value: two to five capitalised words in a row, small words between them allowed.
CAPITALISED = r"(?:[A-Z][a-z0-9]+(?:'s)?(?:\s+(?:of|the|de|von|van|&)\s+|\s+|-)){1,4}[A-Z][a-z0-9]+"


def heuristic_entities(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, keyword, occurrences, sentence_spread): capitalised runs that no function word leads."""
    sentences = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?]+\s+")).alias("sentence", "s"))
    runs = sentences.select("doc_id", "sentence", F.explode(F.regexp_extract_all("s", F.lit(CAPITALISED), F.lit(0))).alias("display"))
    lead = "|".join(D.SENTENCE_LEADS)
    kept = runs.where(~F.col("display").rlike(rf"^({lead})\s"))
    return kept.groupBy("doc_id", T.keyword(F.col("display")).alias("keyword")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.countDistinct("sentence").alias("sentence_spread")
    )


def merged_candidates(found: Mapping[str, DataFrame]) -> DataFrame:
    """(doc_id, keyword, provenance, occurrences, sentence_spread, score, priority, place) of what each source found.

    ``found`` maps a source to (doc_id, keyword, occurrences, sentence_spread, score).  Of a keyword the sources are listed,
    the largest counts and the smallest score kept; candidates are placed by the best source, then score, then keyword.
    """
    tables = []
    for source, rows in found.items():
        score = F.col("score") if "score" in rows.columns else F.lit(D.SOURCE_SCORE.get(source, 1.0))
        spread = F.col("sentence_spread") if "sentence_spread" in rows.columns else F.lit(1)
        tables.append(rows.select("doc_id", T.keyword(F.col("keyword")).alias("keyword"), F.lit(source).alias("source"), F.col("occurrences").cast("long").alias("occurrences"), spread.cast("long").alias("sentence_spread"), score.cast("double").alias("score"), F.lit(D.SOURCE_PRIORITY.get(source, 0)).alias("priority")))
    rows = tables[0]
    for other in tables[1:]:
        rows = rows.unionByName(other)
    merged = rows.where("keyword <> ''").groupBy("doc_id", "keyword").agg(
        F.sort_array(F.collect_set("source")).alias("provenance"), F.max("occurrences").alias("occurrences"), F.max("sentence_spread").alias("sentence_spread"), F.min("score").alias("score"), F.max("priority").alias("priority")
    )
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("priority"), "score", "keyword"))
    return merged.withColumn("place", place)


def component_ratios(candidates: DataFrame) -> DataFrame:
    """(doc_id, keyword, ratio): of each single word, the share of its occurrences that longer candidates explain, 1 at most."""
    words = candidates.where(F.size(F.split("keyword", " ")) == 1).select("doc_id", "keyword", "occurrences")
    phrases = candidates.where(F.size(F.split("keyword", " ")) > 1)
    parts = phrases.select("doc_id", F.explode(F.array_distinct(F.split("keyword", " "))).alias("keyword"), F.col("occurrences").alias("n"))
    explained = parts.groupBy("doc_id", "keyword").agg(F.sum("n").alias("n"))
    joined = words.where("occurrences > 0").join(explained, ["doc_id", "keyword"], "left")
    return joined.select("doc_id", "keyword", F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.col("occurrences")).alias("ratio"))


# Judging topics.


def suppression_reason(keyword: Column, ngram_size: Column, occurrences: Column, spread: Column, blocked: Column, ratio: Column, canonical: Sequence[str] = ()) -> Column:
    """Why a topic is suppressed, null if it isn't; the first rule that applies decides."""
    k = F.lower(keyword)
    tokens = F.filter(F.split(k, r"\s+"), lambda t: t != "")
    single = (F.coalesce(ngram_size, F.lit(0)) == 1) | (F.size(tokens) == 1)
    first, last = F.get(tokens, F.lit(0)), F.get(tokens, F.size(tokens) - 1)
    n, s = F.coalesce(occurrences, F.lit(0)), F.coalesce(spread, F.lit(0))
    has = lambda listed: F.exists(tokens, lambda t: t.isin(list(listed)))
    rules = (
        (F.coalesce(blocked, F.lit(False)), "blocklist"),
        (k.isin([*D.PROTECTED, *canonical]), None),
        (k.isin(list(D.BOILERPLATE)), "boilerplate_phrase"),
        (k.isin(list(D.MALFORMED_PHRASES)), "malformed_phrase"),
        (~single & (first.isin(list(D.MALFORMED_STARTS)) | has(D.MALFORMED_TOKENS)), "malformed_phrase"),
        (k.isin(list(D.MARKUP_PHRASES)) | has(D.MARKUP_TOKENS), "markup_artifact"),
        (single & k.isin(list(D.NOISE_WORDS)), "noise_word"),
        (~single & first.isin(list(D.PRONOUN_LEADS)), "pronoun_lead"),
        (~single & last.isin(list(D.WEAK_ENDS)), "weak_phrase"),
        (single & (F.coalesce(ratio, F.lit(0.0)) >= 0.25), "phrase_component"),
        (single & (F.length(k) < 4) & (n < 20), "short_low_freq"),
        (single & k.rlike(D.WEAK_SUFFIX) & (n < 20) & (s < 4), "weak_suffix"),
        (single & (n < 4) & (s < 2), "weak_singleton"),
    )
    verdict = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        verdict = F.when(condition, F.lit(name).cast("string")).otherwise(verdict)
    return verdict


def constructed(candidates: DataFrame, aliases: Mapping[str, str], denied: Sequence[str] = ()) -> DataFrame:
    """``candidates`` with ``canonical`` (null if denied or ungrammatical); of the rows of a document that become one
    canonical keyword the best placed stays."""
    keyword = F.col("keyword")
    mapped = F.element_at(F.create_map(*[F.lit(x) for p in aliases.items() for x in p]), keyword) if aliases else F.lit(None).cast("string")
    tokens = F.split(keyword, " ")
    many = F.size(tokens) > 1
    bad = F.exists(tokens, lambda t: t.isin(list(D.MARKUP_TOKENS))) | (many & (F.get(tokens, F.lit(0)).isin(list(D.MALFORMED_STARTS)) | F.exists(tokens, lambda t: t.isin(list(D.MALFORMED_TOKENS))) | F.get(tokens, F.size(tokens) - 1).isin(list(D.WEAK_ENDS))))
    canonical = F.when(keyword.isin(list(denied)), F.lit(None)).when(mapped.isNotNull(), mapped).when(~bad, keyword)
    rows = candidates.withColumn("canonical", canonical)
    place = F.row_number().over(W.partitionBy("doc_id", "canonical").orderBy("place"))
    return rows.withColumn("_p", place).where("canonical IS NULL OR _p = 1").drop("_p")


def first_kept(candidates: DataFrame, top: int) -> DataFrame:
    """The ``top`` best placed ``candidates`` of each document: the rules run along the places until so many are kept."""
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("place"))
    return candidates.withColumn("_n", number).where(F.col("_n") <= top).drop("_n")


def background_zipf(documents: DataFrame, text: str, least: int = 2) -> DataFrame:
    """(term, zipf): log10 of a word's occurrences in a billion words of ``documents``; an external table may replace it."""
    words = documents.select(F.explode(T.words(F.col(text), T.PHRASE_WORD)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 1
    return words.where(F.col("n") >= least).select("term", (F.log10(F.col("n") / F.lit(float(total))) + 9).alias("zipf"))


def domain_boost(keywords: DataFrame, zipf: DataFrame, total: int, frequency: str = "doc_frequency") -> DataFrame:
    """``keywords`` with ``commonness`` in general language and ``boost`` = 1 + 0.28 (5.25 - commonness + 0.12 ln(1 + 100 df/N)),
    within 0.35 and 2.5, for protected topics 1 at least.  Commonness is the larger of the phrase's and its words' mean."""
    tokens = T.words(F.col("keyword"), T.PHRASE_WORD)
    rows = keywords.select("keyword").distinct().select("keyword", F.array_join(tokens, " ").alias("phrase"), F.explode_outer(F.filter(tokens, lambda t: ~t.isin(list(D.KEYWORD_STOPWORDS)))).alias("term"))
    per_word = rows.join(zipf, "term", "left").groupBy("keyword", "phrase").agg(F.avg("zipf").alias("mean"))
    both = per_word.join(zipf.select(F.col("term").alias("phrase"), F.col("zipf").alias("exact")), "phrase", "left")
    commonness = F.when(F.col("mean").isNull(), F.coalesce("exact", F.lit(D.COMMONNESS))).otherwise(F.greatest(F.coalesce("exact", F.lit(0.0)), F.col("mean")))
    known = both.select("keyword", commonness.alias("commonness"))
    rate = F.greatest(F.col(frequency), F.lit(0)) / F.lit(float(max(1, total)))
    boost = F.greatest(F.lit(0.35), F.least(F.lit(2.5), 1 + 0.28 * (5.25 - F.col("commonness") + 0.12 * F.log1p(100 * rate))))
    boost = F.when(F.col("keyword").isin(list(D.PROTECTED)), F.greatest(F.lit(1.0), boost)).otherwise(boost)
    return keywords.join(known, "keyword").withColumn("boost", boost)


def reranked(topics: DataFrame, documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, keyword, adjusted, rank): score over the product of its boosts - domain (``boost``), position in the text,
    spread, number of sources, protection; rank 1 is the smallest.

    A keyword's position is that of its first occurrence in whole words.  A document's topics, few as they are, meet its text
    as one row, so that the text is moved once."""
    own = F.struct(*[c for c in topics.columns if c != "doc_id"])
    grouped = topics.groupBy("doc_id").agg(F.collect_list(own).alias("_own"))
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_raw"))
    texts = grouped.join(texts, "doc_id").withColumns({"_text": F.lower("_raw"), "_lines": F.slice(F.split("_raw", r"\n+"), 1, 12)})
    pattern = lambda k: F.concat(F.lit(r"\b"), F.regexp_replace(F.regexp_replace(k, r"([^\p{L}\p{N}_\s])", r"\\$1"), r"\s+", r"\\s+"), F.lit(r"\b"))
    heads = F.filter(F.col("_lines"), lambda x: (F.length(F.trim(x)) <= 120) | x.rlike(r"^[#>*\-\s]"))
    features = lambda t: F.struct(t.alias("t"), F.regexp_instr(F.col("_text"), pattern(t["keyword"])).alias("at"), F.exists("_heads", lambda x: F.contains(x, t["keyword"])).alias("opening"))
    texts = texts.withColumn("_heads", F.transform(heads, lambda x: F.lower(F.trim(x))))
    rows = texts.select("doc_id", F.length("_text").alias("_size"), F.explode(F.transform("_own", features)).alias("f")).select("doc_id", "_size", "f.t.*", "f.at", "f.opening")
    first = F.when(F.col("at") > 0, (F.col("at") - 1) / F.greatest(F.col("_size"), F.lit(1))).otherwise(F.lit(1.0))
    position = F.least(F.lit(1.6), (1 + 0.35 * (1 - first)) * F.when(F.col("opening"), F.lit(1.2)).otherwise(F.lit(1.0)))
    spread = F.least(F.lit(1.6), 1 + 0.08 * F.log2(F.greatest(F.col("occurrences"), F.lit(1)) + 1) + 0.08 * F.log2(F.greatest(F.col("sentence_spread"), F.lit(1)) + 1))
    sources = F.least(F.lit(1.35), 1 + 0.08 * F.greatest(F.size("provenance") - 1, F.lit(0)))
    protected = F.when(F.col("keyword").isin(list(D.PROTECTED)), F.lit(1.12)).otherwise(F.lit(1.0))
    adjusted = F.col("score") / F.greatest(F.lit(0.1), F.col("boost") * position * spread * sources * protected)
    scored = rows.select("doc_id", "keyword", adjusted.alias("adjusted"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.round("adjusted", 9), "keyword")))


def frequency_floor(topics: DataFrame, least: int = 2) -> DataFrame:
    """(issue_id, keyword, rank): topics of at least ``least`` issues, ranked anew without gaps."""
    carriers = topics.groupBy("keyword").agg(F.countDistinct("issue_id").alias("_n")).where(F.col("_n") >= least).select("keyword")
    kept = skew_join(topics, carriers, ["keyword"], "left_semi", ["issue_id"])
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("issue_id").orderBy(F.col("rank").asc_nulls_last(), "keyword")))


# Topics of the corpus.


def cluster_key() -> Column:
    return F.coalesce(F.nullif(F.col("stem"), F.lit("")), F.col("keyword"))


def corpus_topics(topics: DataFrame, issues: DataFrame, total: int, blocked: DataFrame | None = None, least: int = 3) -> DataFrame:
    """One row per stem (or keyword): frequency, mean score, first and last date, aggregate score, name and type.

    The name is that of the best score, suppressed and blocked rows included; the type is the most frequent known one, the
    first in byte order among equals.  aggregate = df / mean score * max(0.01, 1 - df/N) * (1.5 for phrases).
    """
    keyed = topics.withColumn("cluster", cluster_key())
    named = keyed.groupBy("cluster").agg(F.min(F.struct("score", "keyword", "keyword_display")).alias("best"))
    typed = keyed.where("topic_type IS NOT NULL AND topic_type <> 'unknown'").groupBy("cluster", "topic_type").agg(F.count(F.lit(1)).alias("n"))
    typed = typed.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "topic_type")).alias("t")).select("cluster", F.col("t.topic_type").alias("topic_type"))
    counted = keyed.where("suppression_reason IS NULL")
    if blocked is not None:
        counted = counted.join(blocked, "keyword", "left_anti")
    dated = skew_join(counted.select("cluster", "issue_id", "score", "ngram_size"), issues.select(F.col("id").alias("issue_id"), "published_at"), ["issue_id"], "inner", ["cluster"])
    grouped = dated.groupBy("cluster").agg(
        F.countDistinct("issue_id").alias("doc_frequency"), F.avg("score").alias("avg_score"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"), F.max("ngram_size").alias("ngram_size")
    ).where(F.col("doc_frequency") >= least)
    rest = F.greatest(F.lit(0.01), 1.0 - F.col("doc_frequency") / F.lit(float(max(total, 1))))
    aggregate = F.col("doc_frequency") / F.nullif(F.col("avg_score"), F.lit(0.0)) * rest * F.when(F.col("ngram_size") >= 2, F.lit(1.5)).otherwise(F.lit(1.0))
    rows = grouped.join(named, "cluster").join(typed, "cluster", "left")
    return rows.select(
        F.col("best.keyword").alias("keyword"), F.col("best.keyword_display").alias("keyword_display"), "doc_frequency", "avg_score", aggregate.alias("aggregate_score"), rest.alias("distinctiveness"),
        "first_seen", "last_seen", "ngram_size", F.coalesce("topic_type", F.lit("unknown")).alias("topic_type"),
    )


def nested_fragments(keywords: DataFrame, topics: DataFrame, least_overlap: float = 0.8, exempt: Sequence[str] = ()) -> DataFrame:
    """(keyword) of phrases within a longer one that is on at least ``least_overlap`` of their issues.

    Longer phrases send out all their shorter runs of words, which meet the shorter phrases in an equi-join.
    """
    spelled = keywords.select("keyword", F.split("keyword", " ").alias("tokens")).where(F.size("tokens") >= 2)
    size = F.size("tokens")
    runs = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(F.col("tokens"), i, n), " "))
    every = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), runs))
    inner = spelled.where(size > 2).select(F.col("keyword").alias("longer"), F.explode(F.array_distinct(every)).alias("keyword"))
    pairs = inner.join(spelled.select("keyword"), "keyword").where(~F.col("keyword").isin(list(exempt)) if exempt else F.lit(True))
    carried = topics.where("suppression_reason IS NULL").select("keyword", "issue_id").distinct()
    short = pairs.join(carried, "keyword").groupBy("keyword", "longer").agg(F.count(F.lit(1)).alias("n"))
    shared = pairs.join(carried, "keyword").join(carried.select(F.col("keyword").alias("longer"), "issue_id"), ["longer", "issue_id"], "left_semi")
    shared = shared.groupBy("keyword", "longer").agg(F.count(F.lit(1)).alias("both"))
    return short.join(shared, ["keyword", "longer"]).where(F.col("both") >= F.lit(least_overlap) * F.col("n")).select("keyword").distinct()


#: Pairs of characters whose frequencies are told apart.
COMMON_PAIRS = 1 << 16


def _joint(least: float, most: int = 5, rows: int = 72, rows_of_two: int = 400) -> list[int]:
    """How many common pairs of characters two keywords are joined upon, by the size of the smaller set from 1 on (1 beyond
    the list): as many as keep the combinations of the larger set below ``rows``, or below ``rows_of_two`` for two."""
    found: list[int] = []
    for size in range(1, 200):
        larger = math.floor(size * (2 - least) / least + 1e-9)
        missing = larger - math.ceil(least / (2 - least) * larger - 1e-9)  # of the larger set, at most
        fits = [n for n in range(2, most + 1) if math.comb(missing + n, n) <= (rows if n > 2 else rows_of_two)]
        found.append(max(1, min(max(fits, default=1), math.ceil(least * size - 1e-9))))
    return found


def spelling_signatures(keywords: DataFrame, least: float) -> DataFrame:
    """(keyword, size, mask, met): numbers that two keywords have in common if their sets of character pairs are alike.

    With the pairs of a set in order of rarity, of which ``missing`` at most aren't common, two sets alike share n pairs among
    the first ``missing`` + n of each; so ``met`` is all combinations of n of them.  One pair alone is in too many keywords:
    characters are few, however many keywords there are.  All but the ``COMMON_PAIRS`` most frequent pairs count as equally
    rare, so that what is broadcast is bounded; any order would do.
    """
    sets = keywords.select("keyword").distinct().withColumn("pairs", T.character_bigrams(F.lower("keyword")))
    counts = sets.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    frequent = F.broadcast(counts.orderBy(F.desc("n"), "pair").limit(COMMON_PAIRS))
    each = sets.select("keyword", F.explode("pairs").alias("pair")).join(frequent, "pair", "left").groupBy("keyword")  # as distinct left them: no shuffle
    rarest = each.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))).alias("pairs")).select("keyword", F.size("pairs").alias("size"), F.transform("pairs", lambda x: F.xxhash64(x["pair"])).alias("pairs"))
    rarest = rarest.withColumn("mask", F.expr("coalesce(aggregate(pairs, 0L, (m, p) -> m | shiftleft(1L, cast(pmod(p, 64) as int))), 0L)"))
    rarest = rarest.withColumn("needed", F.ceil(F.lit(least / (2 - least)) * F.col("size") - 1e-9).cast("int"))  # common pairs with the smallest partner allowed
    joint = F.array(*[F.lit(n) for n in _joint(least)])
    rarest = rarest.withColumn("joint", F.explode(F.array_distinct(F.transform(F.sequence("needed", "size"), lambda n: F.coalesce(F.get(joint, n - 1), F.lit(1))))))
    rarest = rarest.withColumn("pairs", F.slice("pairs", 1, F.least(F.col("size"), F.col("size") - F.col("needed") + F.col("joint"))))
    # The combinations are told by 40 bits of the exclusive or of hashes: of those that are in, or of all without those that
    # are out.  What meets by chance is compared in vain.
    spare = F.size("pairs") - F.col("joint")
    steps, whole = F.least(F.col("joint"), spare), F.aggregate("pairs", F.lit(0).cast("long"), lambda h, p: h.bitwiseXOR(p))
    rarest = rarest.withColumns({"steps": steps, "start": F.when(F.col("joint") <= spare, F.lit(0).cast("long")).otherwise(whole)})
    met = F.expr(
        """transform(aggregate(filter(sequence(0, steps), s -> s > 0), array(struct(0 AS i, start AS h)),
        (acc, s) -> flatten(transform(acc, c -> transform(slice(pairs, c.i + 1, size(pairs)), (p, j) -> struct(c.i + j + 1 AS i, c.h ^ p AS h))))), c -> c.h & 1099511627775L)"""
    )
    return rarest.select("keyword", "size", "mask", F.explode(met).alias("met"))


def similar_spellings(keywords: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, dice), a < b: keywords whose sets of character pairs have a Dice coefficient of at least ``least``.

    Exact without comparing all: only keywords that share one of their ``spelling_signatures`` are compared.
    """
    met = spelling_signatures(keywords, least)
    one, two = met.alias("one"), met.alias("two")
    size_a, size_b, mask_a, mask_b = F.col("one.size"), F.col("two.size"), F.col("one.mask"), F.col("two.mask")
    shared = F.lit(least / 2) * (size_a + size_b) - 1e-9  # common pairs that reach the coefficient
    # Each bit of one mask that the other lacks is a pair that isn't common.
    alone = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    candidates = one.join(two, F.col("one.met") == F.col("two.met")).where((F.col("one.keyword") < F.col("two.keyword")) & (F.least(size_a, size_b) >= shared))
    candidates = candidates.where((size_a - alone(mask_a, mask_b) >= shared) & (size_b - alone(mask_b, mask_a) >= shared))
    # Sums of sizes come from the aggregate, lest the coefficient be computed for all candidates below it.
    candidates = candidates.groupBy(F.col("one.keyword").alias("a"), F.col("two.keyword").alias("b")).agg(F.max(size_a + size_b).alias("sizes"))
    common = F.size(F.array_intersect(*[T.character_bigrams(F.lower(c)) for c in "ab"]))
    return candidates.select("a", "b", (2.0 * common / F.col("sizes")).alias("dice")).where(F.col("dice") >= least)


def clustered(corpus: DataFrame, aliases: DataFrame | None = None, least: float = 0.85, distinct_issues: DataFrame | None = None) -> DataFrame:
    """``corpus`` with near-duplicates merged under the keyword of the lowest mean score; frequencies are summed, scores stay.

    ``aliases`` (alias, canonical) merge first.  With ``distinct_issues`` (keyword, issue_id), frequencies count each issue
    of a cluster once instead.
    """
    edges = similar_spellings(corpus, least).select("a", "b")
    if aliases is not None:
        edges = edges.unionByName(aliases.select(F.col("alias").alias("a"), F.col("canonical").alias("b")))
        edges = edges.join(corpus.select(F.col("keyword").alias("a")), "a", "left_semi").join(corpus.select(F.col("keyword").alias("b")), "b", "left_semi")
    groups = components(edges, "a", "b").withColumnRenamed("node", "keyword")
    rows = cut(corpus.join(groups, "keyword", "left").withColumn("root", F.coalesce("root", "keyword")))
    first = F.min_by(F.struct(*corpus.columns), F.struct("avg_score", "keyword", "doc_frequency")).alias("first")
    best = rows.groupBy("root").agg(first, F.sum("doc_frequency").alias("merged"), F.count(F.lit(1)).alias("members"))
    if distinct_issues is not None:
        counted = rows.select("keyword", "root").join(distinct_issues, "keyword").groupBy("root").agg(F.countDistinct("issue_id").alias("merged"))
        best = best.drop("merged").join(counted, "root", "left")
    return best.select("first.*", "merged", "members").withColumn("doc_frequency", F.col("merged")).drop("merged")


def timeline(topics: DataFrame, issues: DataFrame) -> DataFrame:
    """(keyword, year, month, occurrences) of the dated issues."""
    dated = issues.where("year IS NOT NULL AND month IS NOT NULL").select(F.col("id").alias("issue_id"), "year", "month")
    rows = skew_join(topics.select("keyword", "issue_id"), dated, ["issue_id"], "inner", ["keyword"])
    return rows.groupBy("keyword", "year", "month").agg(F.count(F.lit(1)).alias("occurrences"))


def bursts(line: DataFrame) -> DataFrame:
    """(keyword, burst_score, burst_quarter): occurrences of the strongest quarter (the first among equals) over the mean of
    all quarters from the first to the last with any."""
    index = F.col("year") * 4 + F.floor((F.greatest(F.lit(1), F.least(F.lit(12), F.col("month"))) - 1) / 3)
    quarters = line.groupBy("keyword", index.cast("long").alias("q")).agg(F.sum("occurrences").alias("n"))
    by_keyword = quarters.where("n > 0").groupBy("keyword").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "q")).alias("top"), F.sum("n").alias("total"), (F.max("q") - F.min("q") + 1).alias("span")
    )
    score = -F.col("top.n") / (F.col("total") / F.col("span"))
    name = F.concat(F.floor(F.col("top.q") / 4).cast("string"), F.lit("-Q"), (F.col("top.q") % 4 + 1).cast("string"))
    return by_keyword.select("keyword", score.alias("burst_score"), name.alias("burst_quarter"))


def topic_confidence(sources: Column, frequency: Column, suppressions: Column) -> Column:
    """high, medium or low by sources and frequency; one step down if the topic was ever suppressed."""
    s, f, d = F.coalesce(sources, F.lit(1)), F.coalesce(frequency, F.lit(0)), F.coalesce(suppressions, F.lit(0))
    tier = F.when((s >= 2) & (f >= 5), 2).when((s >= 2) | (f >= 3), 1).otherwise(0)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.greatest(tier - F.when(d > 0, 1).otherwise(0), F.lit(0)) + 1)


def rebuilt(topics: DataFrame, issues: DataFrame, zipf: DataFrame, total: int, blocked: DataFrame | None = None, exempt: Sequence[str] = ()) -> DataFrame:
    """One row per topic of the rebuilt corpus: (keyword, keyword_display, doc_frequency, members, aggregate_score, topic_type,
    burst_score, burst_quarter, confidence).

    The aggregate of all issues' topics is weighted by its domain boost, phrases covered by longer ones go, near-duplicate
    spellings merge; what is left gets its strongest quarter and its confidence.  The aggregate is written down once.
    """
    corpus = cut(domain_boost(corpus_topics(topics, issues, total, blocked), zipf, total))
    gone = nested_fragments(corpus.select("keyword").distinct(), topics.join(corpus.select("keyword"), "keyword", "left_semi"), exempt=exempt)
    kept = cut(corpus.join(gone, "keyword", "left_anti"))
    quality = topics.groupBy("keyword").agg(F.coalesce(F.max(F.size("provenance")), F.lit(1)).alias("s"), F.sum(F.col("suppression_reason").isNotNull().cast("long")).alias("d"))
    rows = clustered(kept).join(bursts(timeline(topics, issues)), "keyword", "left").join(quality, "keyword", "left")
    return rows.select(
        "keyword", "keyword_display", "doc_frequency", "members", (F.col("aggregate_score") * F.col("boost")).alias("aggregate_score"), "topic_type",
        "burst_score", "burst_quarter", topic_confidence(F.col("s"), F.col("doc_frequency"), F.col("d")).alias("confidence"),
    )


def weighted_score(frequency: Column, distinctiveness: Column, mean: Column, ngram: Column, sources: Column) -> Column:
    good = (frequency > 0) & (mean > 0) & ~F.isnan(mean)
    score = frequency * F.greatest(F.lit(0.01), distinctiveness) / mean * F.when(ngram >= 2, 1.5).otherwise(1.0) * F.when(sources >= 2, 1.2).otherwise(1.0)
    return F.when(good, score).otherwise(F.lit(0.0))


def corpus_share(frequency: Column, total: Column) -> Column:
    return F.when((frequency > 0) & (total > 0), F.greatest(F.lit(0.01), F.least(F.lit(1.0), 1 - frequency / total))).otherwise(F.lit(0.0))


# Relations between topics and issues.


def similar_to(queries: DataFrame, topics: DataFrame, least: float = 0.2, blocks: int = 16) -> DataFrame:
    """(keyword_a, keyword_b, cosine, jaccard, blended) of a stated query set against all topics, both (keyword, embedding,
    issues); blended = 0.6 cosine + 0.4 Jaccard of the issue sets, at least ``least``.

    The topics lie in ``blocks`` hash blocks, and the queries visit each block, so that no task holds either side whole.
    """
    visits = queries.select(F.col("keyword").alias("keyword_a"), F.col("embedding").alias("va"), F.col("issues").alias("ia"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    placed = topics.select(F.col("keyword").alias("keyword_b"), F.col("embedding").alias("vb"), F.col("issues").alias("ib"), F.pmod(F.xxhash64("keyword"), F.lit(blocks)).cast("int").alias("block"))
    pairs = visits.join(placed, "block").where("keyword_a <> keyword_b")
    scored = pairs.select("keyword_a", "keyword_b", V.cosine(F.col("va"), F.col("vb")).alias("cosine"), T.jaccard(F.col("ia"), F.col("ib")).alias("jaccard"))
    return scored.withColumn("blended", 0.6 * F.col("cosine") + 0.4 * F.col("jaccard")).where(F.col("blended") >= least)


def similar_topics(topics: DataFrame, least: float = 0.2, blocks: int = 16) -> DataFrame:
    """(keyword_a, keyword_b, cosine, jaccard, blended) of all pairs of ``topics`` as in :func:`similar_to`, in both directions.

    Each hash block meets each block once; a pair is scored in one cell and then given out twice.
    """
    norm = F.sqrt(V.dot(F.col("embedding"), F.col("embedding")))
    placed = topics.select("keyword", "embedding", "issues", norm.alias("norm"), F.pmod(F.xxhash64("keyword"), F.lit(blocks)).cast("int").alias("own"))
    side = lambda s: placed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("keyword", "embedding", "issues", "norm")], "own")
    left = side("a").withColumn("other", F.explode(F.sequence(F.col("own"), F.lit(blocks - 1)))).withColumnRenamed("own", "row").withColumnRenamed("other", "column")
    right = side("b").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumnRenamed("own", "column").withColumnRenamed("other", "row")
    once = ((F.col("row") < F.col("column")) & (F.col("keyword_a") != F.col("keyword_b"))) | (F.col("keyword_a") < F.col("keyword_b"))
    pairs = left.join(right, ["row", "column"]).where(once)
    norms = F.col("norm_a") * F.col("norm_b")
    value = F.when((F.size("embedding_a") == F.size("embedding_b")) & (norms > 0), V.dot(F.col("embedding_a"), F.col("embedding_b")) / norms)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))
    scored = pairs.select("keyword_a", "keyword_b", cosine.alias("cosine"), T.jaccard(F.col("issues_a"), F.col("issues_b")).alias("jaccard"))
    scored = scored.withColumn("blended", 0.6 * F.col("cosine") + 0.4 * F.col("jaccard")).where(F.col("blended") >= least)
    ways = F.array(F.struct("keyword_a", "keyword_b"), F.struct(F.col("keyword_b").alias("keyword_a"), F.col("keyword_a").alias("keyword_b")))
    return scored.select(F.explode(ways).alias("way"), "cosine", "jaccard", "blended").select("way.*", "cosine", "jaccard", "blended")


def adjacent(topics: DataFrame, keyword: str, top: int = 10) -> DataFrame:
    """(keyword, keyword_display, cooccurrence): what shares most issues with ``keyword``."""
    mine = topics.where(F.col("keyword") == keyword).select("issue_id").distinct()
    rows = topics.where(F.col("keyword") != keyword).join(mine, "issue_id", "left_semi")
    counts = rows.groupBy("keyword").agg(F.max("keyword_display").alias("keyword_display"), F.countDistinct("issue_id").alias("cooccurrence"))
    return counts.orderBy(F.desc("cooccurrence"), "keyword").limit(top)


def related_issues(topics: DataFrame, issue_id: str, top: int = 10, of_topics: int = 10) -> DataFrame:
    """(issue_id, overlap): issues that share most of the first ten topics of one issue."""
    place = F.row_number().over(W.orderBy(F.col("rank").asc_nulls_last(), "keyword"))
    mine = topics.where(F.col("issue_id") == issue_id).select("keyword", "rank").distinct().withColumn("p", place).where(F.col("p") <= of_topics).select("keyword").distinct()
    rows = topics.where(F.col("issue_id") != issue_id).join(F.broadcast(mine), "keyword", "left_semi")  # ten keywords at most
    return rows.groupBy("issue_id").agg(F.countDistinct("keyword").alias("overlap")).orderBy(F.desc("overlap"), "issue_id").limit(top)


def drift(documents: DataFrame, text: str, keyword: str, window: int = 5, top: int = 5, least: int = 2) -> DataFrame:
    """(year, quarter, word, share, lift, place): words that surround ``keyword`` more in a quarter than over all.

    ``documents`` has year and month.  Contexts are the ``window`` tokens before and after; stopwords and single letters are
    left out; a word counts from ``least`` occurrences on.  lift = share in the quarter over share in all.
    """
    wanted = keyword.lower().split()
    n = len(wanted)
    rows = documents.where("year IS NOT NULL AND month IS NOT NULL").select("year", "month", T.words(F.col(text), T.DRIFT_WORD).alias("tokens"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("tokens") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(F.col("tokens"), i, n), " ") == " ".join(wanted))
    found = rows.where(F.size("tokens") >= n).select("year", F.quarter(F.make_date(F.lit(2000), F.greatest(F.lit(1), F.least(F.lit(12), F.col("month"))), F.lit(1))).alias("quarter"), "tokens", F.explode(starts).alias("at"))
    before = F.slice("tokens", F.greatest(F.col("at") - window, F.lit(1)), F.least(F.col("at") - 1, F.lit(window)))
    after = F.slice("tokens", F.col("at") + n, F.lit(window))
    around = F.filter(F.concat(before, after), lambda t: ~t.isin(list(D.DRIFT_STOPWORDS)) & (F.length(t) >= 2))
    words = found.select("year", "quarter", F.explode(around).alias("word")).groupBy("year", "quarter", "word").agg(F.count(F.lit(1)).alias("n"))
    in_quarter = words.groupBy("year", "quarter").agg(F.sum("n").alias("quarter_total"))
    overall = words.groupBy("word").agg(F.sum("n").alias("word_total"))
    total = words.agg(F.sum("n")).first()[0] or 1
    scored = words.where(F.col("n") >= least).join(in_quarter, ["year", "quarter"]).join(overall, "word")
    share = F.col("n") / F.col("quarter_total")
    scored = scored.select("year", "quarter", "word", share.alias("share"), (share / (F.col("word_total") / F.lit(float(total)))).alias("lift"))
    place = F.row_number().over(W.partitionBy("year", "quarter").orderBy(F.round("lift", 9).desc(), F.round("share", 9).desc(), "word"))
    return scored.withColumn("place", place).where(F.col("place") <= top)


def audited(extracted: DataFrame, stored_topics: DataFrame) -> DataFrame:
    """(issue_id, extracted, stored, both_, delta) of two sets of (issue_id, keyword): delta is the share of the extracted that is
    stored less the share of the stored that is extracted; a share of nothing is 0."""
    e, s = extracted.withColumn("e", F.lit(1)), stored_topics.withColumn("s", F.lit(1))
    joined = e.join(s, ["issue_id", "keyword"], "full").where("issue_id IS NOT NULL")
    counts = joined.groupBy("issue_id").agg(F.count("e").alias("extracted"), F.count("s").alias("stored"), F.count(F.when(F.col("e").isNotNull() & F.col("s").isNotNull(), 1)).alias("both_"))
    share = lambda n: F.when(F.col(n) > 0, F.col("both_") / F.col(n)).otherwise(F.lit(0.0))
    return counts.withColumn("delta", share("extracted") - share("stored"))


#: Orders of the list of topics; ties go by keyword, nulls come last.
SORTS = {"frequency": "doc_frequency", "score": "aggregate_score", "burst": "burst_score", "name": None}


def sorted_page(corpus: DataFrame, sort: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of ``corpus`` in one of ``SORTS``, with the ``place`` of each topic; an unknown order counts as ``frequency``."""
    column = SORTS.get(sort, "doc_frequency")
    order = [F.col(column).desc_nulls_last()] if column else []
    page = corpus.orderBy(*order, "keyword").offset(offset).limit(limit)
    return page.withColumn("place", F.row_number().over(W.orderBy(*order, "keyword")).cast("long") + offset)
