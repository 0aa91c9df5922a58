"""Topic queries: lexicon, quality, corpus topics, bursts, similarity, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import dictionaries as D
from colophon.functions import text as T
from colophon.operators import topics, yake
from colophon.plans.base import Queries
from colophon.session import stored
from colophon.sources.tables import table

Q = Queries()


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "issues").where(F.col("status") == "active")


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "issue_topics")


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STOP = _listed(D.PHRASE_STOPWORDS)
_LEXICON_SQL = rf"""
WITH t AS (SELECT regexp_extract_all(lower(full_text_plain), '[a-z][a-z0-9''-]*') AS tokens FROM issues WHERE status = 'active' AND full_text_plain IS NOT NULL AND full_text_plain <> ''),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM t),
w AS (SELECT word, count(*) AS f FROM (SELECT unnest(list_distinct(list_filter(tokens, lambda x: length(x) >= 3 AND x NOT IN ({_STOP})))) AS word FROM t) GROUP BY 1),
p AS (SELECT phrase, count(*) AS c FROM (SELECT unnest(list_distinct(list_filter(list_transform(generate_series(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i + 1]),
    lambda g: length(split_part(g, ' ', 1)) >= 3 AND length(split_part(g, ' ', 2)) >= 3 AND split_part(g, ' ', 1) NOT IN ({_STOP}) AND split_part(g, ' ', 2) NOT IN ({_STOP})))) AS phrase FROM t) GROUP BY 1 HAVING count(*) >= 5),
s AS (SELECT phrase, c AS cooccurrence, ln(c * n / (a.f * b.f)) AS pmi FROM p, n, w a, w b WHERE a.word = split_part(phrase, ' ', 1) AND b.word = split_part(phrase, ' ', 2)),
lexicon AS (SELECT phrase, cooccurrence, pmi, pmi * (1 + log2(cooccurrence + 1)) * 2 AS quality FROM s WHERE pmi >= 3.0)
"""


def _lexicon(spark: SparkSession, sf_dir: str, size: int | None = None) -> DataFrame:
    return topics.phrase_lexicon(_active(spark, sf_dir), "full_text_plain", size=size)


@Q.add(_LEXICON_SQL + "SELECT phrase, cooccurrence, round(pmi, 6) AS pmi, round(quality, 6) AS quality FROM lexicon")
def pmi_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two words that share documents more than chance allows."""
    return _lexicon(spark, sf_dir).select("phrase", "cooccurrence", F.round("pmi", 6).alias("pmi"), F.round("quality", 6).alias("quality"))


@Q.add(
    _LEXICON_SQL
    + """, d AS (SELECT id, regexp_extract_all(lower(coalesce(full_text_plain, '')), '[a-z][a-z0-9''-]*') AS tokens FROM issues WHERE status = 'active'),
g AS (SELECT id, unnest(list_transform(generate_series(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS keyword FROM d)
SELECT id AS doc_id, keyword, count(*) AS occurrences FROM g WHERE keyword IN (SELECT phrase FROM lexicon) GROUP BY 1, 2"""
)
def lexicon_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.lexicon_phrases(_active(spark, sf_dir), "id", "full_text_plain", _lexicon(spark, sf_dir))


_CAPITALISED_SQL = topics.CAPITALISED.replace("'", "''")


@Q.add(
    rf"""WITH s AS (SELECT id, unnest(regexp_split_to_array(full_text_plain, '[.!?]+\s+')) AS s, unnest(generate_series(1, len(regexp_split_to_array(full_text_plain, '[.!?]+\s+')))) AS n FROM issues WHERE status = 'active' AND full_text_plain IS NOT NULL),
r AS (SELECT id, n, unnest(regexp_extract_all(s, '{_CAPITALISED_SQL}')) AS display FROM s)
SELECT id AS doc_id, trim(regexp_replace(lower(display), '\s+', ' ', 'g')) AS keyword, count(*) AS occurrences, count(DISTINCT n) AS sentence_spread FROM r
WHERE NOT regexp_matches(display, '^({"|".join(D.SENTENCE_LEADS)})\s') GROUP BY 1, 2"""
)
def heuristic_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.heuristic_entities(_active(spark, sf_dir), "id", "full_text_plain")


#: The archive's own entities; the default dictionaries match nothing in invented prose.
ENTITIES = {"night shift": ["night shift"], "archive crew": ["archive crew", "the archive crew"], "working maps": ["working maps", "working map"]}


def _hits_sql(alias: str) -> str:
    n = len(alias)
    return f"len(list_filter(generate_series(1, length(t) - {n - 1}), lambda i: substring(t, i, {n}) = '{alias}' AND NOT regexp_matches(substring(' ' || t, i, 1), '[a-z0-9]') AND NOT regexp_matches(substring(t, i + {n}, 1), '[a-z0-9]')))"


@Q.add(
    "WITH d AS (SELECT id AS doc_id, lower(coalesce(full_text_plain, '')) AS t FROM issues WHERE status = 'active'), c AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS keyword, CAST({' + '.join(map(_hits_sql, aliases))} AS BIGINT) AS occurrences FROM d WHERE contains(t, '{min(aliases, key=len)}')" for name, aliases in ENTITIES.items())
    + ") SELECT * FROM c WHERE occurrences > 0"
)
def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.known_entities(_active(spark, sf_dir), "id", "full_text_plain", ENTITIES)


#: Fixed value: topics kept per issue.
TOP = 25


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _active(spark, sf_dir)
    found = {
        "known_entity": topics.known_entities(active, "id", "full_text_plain", ENTITIES),
        "phrase_lexicon": topics.lexicon_phrases(active, "id", "full_text_plain", _lexicon(spark, sf_dir)),
        "heuristic_entity": topics.heuristic_entities(active, "id", "full_text_plain"),
        "yake": yake.keywords(active, "id", "full_text_plain", top=max(4 * TOP, 25)).withColumn("occurrences", F.lit(1)),
    }
    return topics.merged_candidates(found)


@Q.add()
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four ways of finding topics find, merged per issue."""
    return _candidates(spark, sf_dir)


@Q.add()
def yake_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yake.keywords(_active(spark, sf_dir), "id", "full_text_plain", top=10)


@Q.add()
def extracted_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates judged and built: the first 25 of each issue that no rule suppresses, reranked."""
    rows = stored(_candidates(spark, sf_dir)).frame  # each text is searched once, its candidates are used three times
    ratios = topics.component_ratios(rows)
    judged = rows.join(ratios, ["doc_id", "keyword"], "left")
    reason = topics.suppression_reason(F.col("keyword"), F.size(F.split("keyword", " ")), F.col("occurrences"), F.col("sentence_spread"), F.lit(False), F.col("ratio"))
    kept = topics.constructed(judged.withColumn("reason", reason).where("reason IS NULL"), {"working map": "working maps"}).where("canonical IS NOT NULL")
    kept = topics.first_kept(kept, TOP)
    zipf = topics.background_zipf(table(spark, sf_dir, "documents"), "text")
    total = _active(spark, sf_dir).count()
    boosted = topics.domain_boost(kept.withColumn("keyword", F.col("canonical")), zipf, total, "occurrences")
    best = topics.reranked(boosted, _active(spark, sf_dir), "id", "full_text_plain")
    return best.where(F.col("rank") <= TOP)


_REASON_SQL = f"""CASE WHEN k = 'team rituals' THEN 'blocklist' WHEN k IN ({_listed(D.PROTECTED)}) THEN NULL WHEN k IN ({_listed(D.BOILERPLATE)}) THEN 'boilerplate_phrase' WHEN k IN ({_listed(D.MALFORMED_PHRASES)}) THEN 'malformed_phrase'
WHEN NOT single AND (tokens[1] IN ({_listed(D.MALFORMED_STARTS)}) OR len(list_intersect(tokens, [{_listed(D.MALFORMED_TOKENS)}])) > 0) THEN 'malformed_phrase'
WHEN k IN ({_listed(D.MARKUP_PHRASES)}) OR len(list_intersect(tokens, [{_listed(D.MARKUP_TOKENS)}])) > 0 THEN 'markup_artifact' WHEN single AND k IN ({_listed(D.NOISE_WORDS)}) THEN 'noise_word'
WHEN NOT single AND tokens[1] IN ({_listed(D.PRONOUN_LEADS)}) THEN 'pronoun_lead' WHEN NOT single AND tokens[-1] IN ({_listed(D.WEAK_ENDS)}) THEN 'weak_phrase'
WHEN single AND coalesce(ratio, 0.0) >= 0.25 THEN 'phrase_component' WHEN single AND length(k) < 4 AND n < 20 THEN 'short_low_freq' WHEN single AND regexp_matches(k, '{D.WEAK_SUFFIX}') AND n < 20 AND spread < 4 THEN 'weak_suffix'
WHEN single AND n < 4 AND spread < 2 THEN 'weak_singleton' END"""


@Q.add(
    f"""WITH t AS (SELECT issue_id, keyword, lower(keyword) AS k, ngram_size, coalesce(evidence.mentions, 0) AS n, coalesce(len(provenance), 0) AS spread FROM issue_topics WHERE keyword IS NOT NULL),
c AS (SELECT issue_id, k, max(n) AS n FROM t GROUP BY 1, 2),
parts AS (SELECT issue_id, k, sum(n) AS n FROM (SELECT issue_id, unnest(list_distinct(string_split(k, ' '))) AS k, n FROM c WHERE contains(k, ' ')) GROUP BY 1, 2),
ratios AS (SELECT c.issue_id, c.k, least(1.0, coalesce(p.n, 0) / CAST(c.n AS DOUBLE)) AS ratio FROM c LEFT JOIN parts p USING (issue_id, k) WHERE NOT contains(k, ' ') AND c.n > 0)
SELECT issue_id, keyword, {_REASON_SQL} AS reason
FROM (SELECT t.*, ratio, list_filter(regexp_split_to_array(k, '\\s+'), lambda t: t <> '') AS tokens, coalesce(ngram_size, 0) = 1 OR len(list_filter(regexp_split_to_array(k, '\\s+'), lambda t: t <> '')) = 1 AS single FROM t LEFT JOIN ratios USING (issue_id, k))"""
)
def suppression_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule, if any, suppresses each stored topic.  The stored topics hold no spread over sentences; the number of their
    sources stands for it here."""
    rows = _topics(spark, sf_dir).where("keyword IS NOT NULL").select("issue_id", "keyword", F.lower("keyword").alias("k"), "ngram_size", F.coalesce("evidence.mentions", F.lit(0)).alias("n"), F.size(F.coalesce("provenance", F.array().cast("array<string>"))).alias("spread"))
    candidates = rows.groupBy(F.col("issue_id").alias("doc_id"), F.col("k").alias("keyword")).agg(F.max("n").alias("occurrences"))
    ratios = topics.component_ratios(candidates).select(F.col("doc_id").alias("issue_id"), F.col("keyword").alias("k"), "ratio")
    judged = rows.join(ratios, ["issue_id", "k"], "left")
    reason = topics.suppression_reason(F.col("keyword"), F.col("ngram_size"), F.col("n"), F.col("spread"), F.col("k") == "team rituals", F.col("ratio"))
    return judged.select("issue_id", "keyword", reason.alias("reason"))


@Q.add(
    """WITH d AS (SELECT keyword, count(DISTINCT issue_id) AS n FROM issue_topics GROUP BY 1 HAVING count(DISTINCT issue_id) >= 2), k AS (SELECT DISTINCT issue_id, keyword, rank FROM issue_topics WHERE keyword IN (SELECT keyword FROM d))
SELECT issue_id, keyword, row_number() OVER (PARTITION BY issue_id ORDER BY rank NULLS LAST, keyword) AS rank FROM k"""
)
def frequency_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topics.frequency_floor(_topics(spark, sf_dir).select("issue_id", "keyword", "rank").distinct())
    return rows.select("issue_id", "keyword", F.col("rank").cast("long").alias("rank"))


_PLURAL = "CASE WHEN length(w) < 4 THEN w WHEN regexp_matches(w, 'sses$') THEN regexp_replace(w, 'sses$', 'ss') WHEN regexp_matches(w, 'ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, 'ied$') THEN regexp_replace(w, 'ied$', 'y') WHEN regexp_matches(w, '[a-rt-z]s$') THEN left(w, length(w) - 1) ELSE w END"
_DERIVED = "CASE WHEN o < 4 THEN w WHEN regexp_matches(w, '(iz|is)ation$') THEN regexp_replace(w, '(iz|is)ation$', '\\1e') WHEN regexp_matches(w, 'ation$') THEN regexp_replace(w, 'ation$', 'ate') WHEN regexp_matches(w, '[aeiou][a-z]+ing$') THEN left(w, length(w) - 3) WHEN regexp_matches(w, '[aeiou][a-z]+ed$') THEN left(w, length(w) - 2) ELSE w END"
_DOUBLED = "CASE WHEN o >= 4 AND regexp_matches(w, '(bb|dd|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - 1) ELSE w END"


@Q.add(
    f"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[a-z]+')) AS word FROM issues WHERE title IS NOT NULL), b AS (SELECT word, length(word) AS o, {_PLURAL.replace("w,", "word,").replace("(w)", "(word)").replace("THEN w ", "THEN word ").replace("ELSE w ", "ELSE word ")} AS w FROM a),
c AS (SELECT word, o, {_DERIVED} AS w FROM b) SELECT word, {_DOUBLED} AS stem FROM c"""
)
def light_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "issues").select(F.explode(T.words(F.col("title"), "[a-z]+")).alias("word")).distinct()
    return rows.select("word", T.stem(F.col("word")).alias("stem"))


_CORPUS_SQL = """
WITH k AS (SELECT *, coalesce(nullif(stem, ''), keyword) AS cluster FROM issue_topics),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM issues WHERE status = 'active'),
named AS (SELECT cluster, keyword, keyword_display FROM k QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score NULLS LAST, keyword, keyword_display) = 1),
typed AS (SELECT cluster, topic_type FROM (SELECT cluster, topic_type, count(*) AS n FROM k WHERE topic_type IS NOT NULL AND topic_type <> 'unknown' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, topic_type) = 1),
g AS (SELECT cluster, count(DISTINCT issue_id) AS doc_frequency, avg(score) AS avg_score, min(published_at) AS first_seen, max(published_at) AS last_seen, max(ngram_size) AS ngram_size
    FROM k JOIN issues i ON i.id = k.issue_id WHERE suppression_reason IS NULL AND keyword <> 'team rituals' GROUP BY 1 HAVING count(DISTINCT issue_id) >= 3),
corpus AS (SELECT g.cluster, n.keyword, n.keyword_display, doc_frequency, avg_score, doc_frequency / nullif(avg_score, 0) * greatest(0.01, 1.0 - doc_frequency / total.n) * CASE WHEN ngram_size >= 2 THEN 1.5 ELSE 1.0 END AS aggregate_score,
    greatest(0.01, 1.0 - doc_frequency / total.n) AS distinctiveness, first_seen, last_seen, ngram_size, coalesce(t.topic_type, 'unknown') AS topic_type FROM g JOIN named n USING (cluster) LEFT JOIN typed t USING (cluster), total)
"""


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _active(spark, sf_dir).count()
    blocked = spark.createDataFrame([("team rituals",)], "keyword string")
    return topics.corpus_topics(_topics(spark, sf_dir), table(spark, sf_dir, "issues"), total, blocked)


@Q.add(_CORPUS_SQL + "SELECT keyword, keyword_display, doc_frequency, round(avg_score, 12) AS avg_score, round(aggregate_score, 4) AS aggregate_score, round(distinctiveness, 6) AS distinctiveness, first_seen, last_seen, ngram_size, topic_type FROM corpus")
def corpus_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus topics rebuilt from the topics of all issues."""
    rounded = {"avg_score": F.round("avg_score", 12), "aggregate_score": F.round("aggregate_score", 4), "distinctiveness": F.round("distinctiveness", 6)}
    return _corpus(spark, sf_dir).withColumns(rounded)


_ZIPF_SQL = """, words AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9''-]*')) AS term FROM documents) GROUP BY 1),
zipf AS (SELECT term, log10(n / (SELECT CAST(sum(n) AS DOUBLE) FROM words)) + 9 AS zipf FROM words WHERE n >= 2)"""


@Q.add(
    _CORPUS_SQL
    + _ZIPF_SQL
    + f""", x AS (SELECT keyword, doc_frequency, array_to_string(regexp_extract_all(lower(keyword), '[a-z][a-z0-9''-]*'), ' ') AS phrase FROM corpus),
m AS (SELECT keyword, avg(zipf) AS mean FROM (SELECT keyword, unnest(regexp_extract_all(lower(keyword), '[a-z][a-z0-9''-]*')) AS term FROM corpus) LEFT JOIN zipf USING (term) WHERE term NOT IN ({_listed(D.KEYWORD_STOPWORDS)}) GROUP BY 1),
b AS (SELECT keyword, doc_frequency, CASE WHEN mean IS NULL THEN coalesce(z.zipf, 4.75) ELSE greatest(coalesce(z.zipf, 0), mean) END AS commonness FROM x LEFT JOIN m USING (keyword) LEFT JOIN zipf z ON z.term = x.phrase)
SELECT keyword, round(commonness, 6) AS commonness, round(greatest(0.35, least(2.5, 1 + 0.28 * (5.25 - commonness + 0.12 * ln(1 + 100.0 * doc_frequency / (SELECT n FROM total))))), 6) AS boost FROM b"""
)
def domain_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each corpus topic is lifted for being rare in general language and frequent here."""
    zipf = topics.background_zipf(table(spark, sf_dir, "documents"), "text")
    rows = topics.domain_boost(_corpus(spark, sf_dir), zipf, _active(spark, sf_dir).count())
    return rows.select("keyword", F.round("commonness", 6).alias("commonness"), F.round("boost", 6).alias("boost"))


@Q.add(
    """WITH c AS (SELECT DISTINCT keyword, issue_id FROM issue_topics WHERE keyword IS NOT NULL AND suppression_reason IS NULL
    UNION SELECT 'most ' || keyword, issue_id FROM issue_topics WHERE keyword IS NOT NULL AND suppression_reason IS NULL AND rank <= 8),
v AS (SELECT DISTINCT keyword FROM c),
p AS (SELECT a.keyword AS k, b.keyword AS l FROM v a JOIN v b ON a.keyword <> b.keyword AND contains(' ' || b.keyword || ' ', ' ' || a.keyword || ' ') WHERE contains(a.keyword, ' ')),
n AS (SELECT k, l, count(*) AS n FROM p JOIN c ON c.keyword = k GROUP BY 1, 2), s AS (SELECT k, l, count(*) AS b FROM p JOIN c x ON x.keyword = k JOIN c y ON y.keyword = l AND y.issue_id = x.issue_id GROUP BY 1, 2)
SELECT DISTINCT k AS keyword FROM n JOIN s USING (k, l) WHERE b >= 0.8 * n"""
)
def nested_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases to drop because a longer one covers their issues.  The stored topics hold no longer ones; 'most x' stands for
    them here, on the issues that rank x among their first eight."""
    rows = _topics(spark, sf_dir).where("keyword IS NOT NULL AND suppression_reason IS NULL").select("keyword", "issue_id", "suppression_reason", "rank")
    longer = rows.where("rank <= 8").withColumn("keyword", F.concat(F.lit("most "), "keyword"))
    every = rows.unionByName(longer).drop("rank")
    return topics.nested_fragments(every.select("keyword").distinct(), every)


_PAIRS_SQL = "list_distinct(list_transform(generate_series(1, length(k) - 1), lambda i: substring(k, i, 2)))"


@Q.add(
    f"""WITH k AS (SELECT DISTINCT lower(keyword) AS k FROM corpus_topics UNION SELECT DISTINCT lower(keyword) FROM issue_topics), s AS (SELECT k, {_PAIRS_SQL} AS p FROM k WHERE length(k) > 1)
SELECT a.k AS a, b.k AS b, round(2.0 * len(list_intersect(a.p, b.p)) / (len(a.p) + len(b.p)), 6) AS dice FROM s a JOIN s b ON a.k < b.k WHERE 2.0 * len(list_intersect(a.p, b.p)) / (len(a.p) + len(b.p)) >= 0.85"""
)
def similar_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords spelled alike, found by their rarest pairs of characters."""
    names = table(spark, sf_dir, "corpus_topics").select(F.lower("keyword").alias("keyword")).union(_topics(spark, sf_dir).select(F.lower("keyword"))).where("length(keyword) > 1")
    return topics.similar_spellings(names).select("a", "b", F.round("dice", 6).alias("dice"))


_CLUSTER_SQL = f"""
pairs AS (SELECT keyword, avg_score, doc_frequency, {_PAIRS_SQL.replace("k,", "lower(keyword),").replace("(k)", "(keyword)")} AS p FROM {{0}}),
near AS (SELECT a.keyword AS a, b.keyword AS b FROM pairs a JOIN pairs b ON a.keyword <> b.keyword WHERE 2.0 * len(list_intersect(a.p, b.p)) / (len(a.p) + len(b.p)) >= 0.85),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
roots AS (SELECT c.keyword, least(c.keyword, coalesce(min(r.b), c.keyword)) AS root FROM {{0}} c LEFT JOIN reach r ON r.a = c.keyword GROUP BY 1),
merged AS (SELECT first(keyword ORDER BY avg_score, keyword, doc_frequency) AS keyword, first(cluster ORDER BY avg_score, keyword, doc_frequency) AS cluster, sum(doc_frequency) AS doc_frequency, count(*) AS members FROM {{0}} c JOIN roots USING (keyword) GROUP BY root)"""


@Q.add(_CORPUS_SQL.replace("WITH k AS", "WITH RECURSIVE k AS") + "," + _CLUSTER_SQL.format("corpus") + " SELECT keyword, CAST(doc_frequency AS BIGINT) AS doc_frequency, members FROM merged")
def clustered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus topics with near-duplicates merged."""
    return topics.clustered(_corpus(spark, sf_dir)).select("keyword", "doc_frequency", "members")


_LINE_SQL = "SELECT keyword, year, month, count(*) AS occurrences FROM issue_topics t JOIN issues i ON i.id = t.issue_id WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2, 3"


@Q.add(_LINE_SQL)
def topic_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.timeline(_topics(spark, sf_dir), table(spark, sf_dir, "issues"))


@Q.add(
    f"""WITH l AS ({_LINE_SQL}), q AS (SELECT keyword, year * 4 + (greatest(1, least(12, month)) - 1) // 3 AS q, sum(occurrences) AS n FROM l GROUP BY 1, 2),
g AS (SELECT keyword, max(n) AS top, sum(n) AS total, max(q) - min(q) + 1 AS span FROM q GROUP BY 1), f AS (SELECT keyword, min(q) AS q FROM q JOIN g USING (keyword) WHERE n = top GROUP BY 1)
SELECT keyword, round(top / (total / CAST(span AS DOUBLE)), 6) AS burst_score, (q // 4) || '-Q' || (q % 4 + 1) AS burst_quarter FROM g JOIN f USING (keyword)"""
)
def topic_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topics.bursts(topics.timeline(_topics(spark, sf_dir), table(spark, sf_dir, "issues")))
    return rows.withColumn("burst_score", F.round("burst_score", 6))


@Q.add(
    """WITH q AS (SELECT keyword, coalesce(max(len(provenance)), 1) AS s, sum(CASE WHEN suppression_reason IS NOT NULL THEN 1 ELSE 0 END) AS d FROM issue_topics GROUP BY 1)
SELECT c.keyword, ['low', 'medium', 'high'][greatest(CASE WHEN coalesce(s, 1) >= 2 AND coalesce(doc_frequency, 0) >= 5 THEN 2 WHEN coalesce(s, 1) >= 2 OR coalesce(doc_frequency, 0) >= 3 THEN 1 ELSE 0 END - CASE WHEN coalesce(d, 0) > 0 THEN 1 ELSE 0 END, 0) + 1] AS confidence
FROM corpus_topics c LEFT JOIN q USING (keyword)"""
)
def topic_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = _topics(spark, sf_dir).groupBy("keyword").agg(F.coalesce(F.max(F.size("provenance")), F.lit(1)).alias("s"), F.sum(F.col("suppression_reason").isNotNull().cast("long")).alias("d"))
    rows = table(spark, sf_dir, "corpus_topics").select("keyword", "doc_frequency").join(quality, "keyword", "left")
    return rows.select("keyword", topics.topic_confidence(F.col("s"), F.col("doc_frequency"), F.col("d")).alias("confidence"))


@Q.add(
    """SELECT keyword, round(CASE WHEN doc_frequency > 0 AND avg_score > 0 AND NOT isnan(avg_score) THEN doc_frequency * greatest(0.01, distinctiveness) / avg_score * CASE WHEN ngram_size >= 2 THEN 1.5 ELSE 1.0 END ELSE 0.0 END, 6) AS weighted,
round(CASE WHEN doc_frequency > 0 AND total_issues > 0 THEN greatest(0.01, least(1.0, 1 - doc_frequency / CAST(total_issues AS DOUBLE))) ELSE 0.0 END, 6) AS share FROM corpus_topics"""
)
def alternative_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "corpus_topics")
    weighted = topics.weighted_score(F.col("doc_frequency"), F.col("distinctiveness"), F.col("avg_score"), F.col("ngram_size"), F.lit(1))
    return rows.select("keyword", F.round(weighted, 6).alias("weighted"), F.round(topics.corpus_share(F.col("doc_frequency"), F.col("total_issues")), 6).alias("share"))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, keyword, embedding, issues): vectors as topics, their labels as issues."""
    issues = F.array_distinct(F.array(F.col("label").cast("long"), F.col("label") + F.col("vec_id") % 7))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("topic-"), F.col("vec_id").cast("string")).alias("keyword"), "embedding", issues.alias("issues"))


@Q.add(
    """WITH k AS (SELECT 'topic-' || vec_id AS keyword, CAST(embedding AS DOUBLE[]) AS e, [label, label + vec_id % 7] AS i, vec_id FROM embeddings),
p AS (SELECT a.keyword AS keyword_a, b.keyword AS keyword_b, list_cosine_similarity(a.e, b.e) AS c, len(list_intersect(list_distinct(a.i), list_distinct(b.i))) / CAST(len(list_distinct(list_concat(a.i, b.i))) AS DOUBLE) AS j FROM k a JOIN k b ON a.keyword <> b.keyword WHERE a.vec_id % 100 = 0)
SELECT keyword_a, keyword_b, round(c, 6) AS cosine, round(j, 6) AS jaccard, round(0.6 * c + 0.4 * j, 6) AS blended FROM p WHERE 0.6 * c + 0.4 * j >= 0.2"""
)
def blended_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics like the stated query set (identifiers divisible by 100) by vector and by shared issues."""
    rows = _embedded(spark, sf_dir)
    found = topics.similar_to(rows.where("vec_id % 100 = 0"), rows)
    return found.select("keyword_a", "keyword_b", *[F.round(c, 6).alias(c) for c in ("cosine", "jaccard", "blended")])


@Q.add(
    """WITH k AS (SELECT 'topic-' || vec_id AS keyword, CAST(embedding AS DOUBLE[]) AS e, [label, label + vec_id % 7] AS i FROM embeddings),
p AS (SELECT a.keyword AS keyword_a, b.keyword AS keyword_b, list_cosine_similarity(a.e, b.e) AS c, len(list_intersect(list_distinct(a.i), list_distinct(b.i))) / CAST(len(list_distinct(list_concat(a.i, b.i))) AS DOUBLE) AS j FROM k a JOIN k b ON a.keyword <> b.keyword)
SELECT keyword_a, keyword_b, round(c, 6) AS cosine, round(j, 6) AS jaccard, round(0.6 * c + 0.4 * j, 6) AS blended FROM p WHERE 0.6 * c + 0.4 * j >= 0.2"""
)
def similar_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of topics alike by vector and by shared issues, in both directions."""
    found = topics.similar_topics(_embedded(spark, sf_dir))
    return found.select("keyword_a", "keyword_b", *[F.round(c, 6).alias(c) for c in ("cosine", "jaccard", "blended")])


@Q.add(
    """SELECT keyword, max(keyword_display) AS keyword_display, count(DISTINCT issue_id) AS cooccurrence FROM issue_topics WHERE keyword <> 'slow feedback' AND issue_id IN (SELECT issue_id FROM issue_topics WHERE keyword = 'slow feedback') GROUP BY 1 ORDER BY cooccurrence DESC, keyword LIMIT 10"""
)
def adjacent_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.adjacent(_topics(spark, sf_dir), "slow feedback")


@Q.add(
    """WITH f AS (SELECT min(issue_id) AS id FROM issue_topics), m AS (SELECT keyword FROM (SELECT DISTINCT keyword, rank FROM issue_topics, f WHERE issue_id = f.id) ORDER BY rank NULLS LAST, keyword LIMIT 10)
SELECT issue_id, count(DISTINCT keyword) AS overlap FROM issue_topics, f WHERE issue_id <> f.id AND keyword IN (SELECT keyword FROM m) GROUP BY 1 ORDER BY overlap DESC, issue_id LIMIT 10"""
)
def related_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that share most topics with the first one."""
    rows = _topics(spark, sf_dir)
    return topics.related_issues(rows, rows.agg(F.min("issue_id")).first()[0])


_DRIFT_SQL = f"""
WITH t AS (SELECT year, (month - 1) // 3 + 1 AS quarter, regexp_extract_all(lower(full_text_plain), '[a-z][a-z0-9''-]+') AS k FROM issues WHERE status = 'active' AND full_text_plain IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL),
a AS (SELECT year, quarter, k, unnest(list_filter(generate_series(1, len(k)), lambda i: k[i] = 'market')) AS pos FROM t),
w AS (SELECT year, quarter, unnest(list_concat(k[greatest(pos - 5, 1):pos - 1], k[pos + 1:pos + 5])) AS word FROM a),
c AS (SELECT year, quarter, word, count(*) AS n FROM w WHERE length(word) >= 2 AND word NOT IN ({_listed(D.DRIFT_STOPWORDS)}) GROUP BY 1, 2, 3),
s AS (SELECT year, quarter, word, n, n / CAST(sum(n) OVER (PARTITION BY year, quarter) AS DOUBLE) AS share, sum(n) OVER (PARTITION BY word) / CAST(sum(n) OVER () AS DOUBLE) AS overall FROM c)
SELECT year, quarter, word, round(share, 6) AS share, round(share / overall, 6) AS lift, row_number() OVER (PARTITION BY year, quarter ORDER BY round(share / overall, 9) DESC, round(share, 9) DESC, word) AS place FROM s WHERE n >= 2
QUALIFY place <= 5"""


_REBUILD_SQL = (
    _CORPUS_SQL.replace("WITH k AS", "WITH RECURSIVE k AS")
    + _ZIPF_SQL
    + f""", x AS (SELECT DISTINCT keyword, array_to_string(regexp_extract_all(lower(keyword), '[a-z][a-z0-9''-]*'), ' ') AS phrase FROM corpus),
m AS (SELECT keyword, avg(zipf) AS mean FROM (SELECT keyword, unnest(regexp_extract_all(lower(keyword), '[a-z][a-z0-9''-]*')) AS term FROM corpus) LEFT JOIN zipf USING (term) WHERE term NOT IN ({_listed(D.KEYWORD_STOPWORDS)}) GROUP BY 1),
b AS (SELECT keyword, CASE WHEN mean IS NULL THEN coalesce(z.zipf, 4.75) ELSE greatest(coalesce(z.zipf, 0), mean) END AS commonness FROM x LEFT JOIN m USING (keyword) LEFT JOIN zipf z ON z.term = x.phrase),
boosts AS (SELECT cluster, greatest(0.35, least(2.5, 1 + 0.28 * (5.25 - commonness + 0.12 * ln(1 + 100.0 * doc_frequency / (SELECT n FROM total))))) AS boost FROM corpus JOIN b USING (keyword)),
carried AS (SELECT DISTINCT keyword, issue_id FROM issue_topics WHERE suppression_reason IS NULL),
nested AS (SELECT a.keyword AS k, b.keyword AS l FROM corpus a JOIN corpus b ON a.keyword <> b.keyword AND contains(' ' || b.keyword || ' ', ' ' || a.keyword || ' ') WHERE contains(a.keyword, ' ')),
fragments AS (SELECT DISTINCT k AS keyword FROM (SELECT k, l, count(*) AS n FROM nested JOIN carried c ON c.keyword = k GROUP BY 1, 2) JOIN (SELECT k, l, count(*) AS both_ FROM nested JOIN carried x ON x.keyword = k JOIN carried y ON y.keyword = l AND y.issue_id = x.issue_id GROUP BY 1, 2) USING (k, l) WHERE both_ >= 0.8 * n),
kept AS (SELECT c.*, boost FROM corpus c JOIN boosts USING (cluster) ANTI JOIN fragments USING (keyword)),"""
    + _CLUSTER_SQL.format("kept")
    + f""", line AS ({_LINE_SQL}), q AS (SELECT keyword, year * 4 + (greatest(1, least(12, month)) - 1) // 3 AS q, sum(occurrences) AS n FROM line GROUP BY 1, 2),
gq AS (SELECT keyword, max(n) AS top, sum(n) AS total, max(q) - min(q) + 1 AS span FROM q GROUP BY 1), fq AS (SELECT keyword, min(q) AS q FROM q JOIN gq USING (keyword) WHERE n = top GROUP BY 1),
burst AS (SELECT keyword, top / (total / CAST(span AS DOUBLE)) AS burst_score, (q // 4) || '-Q' || (q % 4 + 1) AS burst_quarter FROM gq JOIN fq USING (keyword)),
quality AS (SELECT keyword, coalesce(max(len(provenance)), 1) AS s, sum(CASE WHEN suppression_reason IS NOT NULL THEN 1 ELSE 0 END) AS d FROM issue_topics GROUP BY 1)
SELECT m.keyword, keyword_display, CAST(m.doc_frequency AS BIGINT) AS doc_frequency, members, round(aggregate_score * boost, 4) AS aggregate_score, topic_type, round(burst_score, 6) AS burst_score, burst_quarter,
['low', 'medium', 'high'][greatest(CASE WHEN coalesce(s, 1) >= 2 AND m.doc_frequency >= 5 THEN 2 WHEN coalesce(s, 1) >= 2 OR m.doc_frequency >= 3 THEN 1 ELSE 0 END - CASE WHEN coalesce(d, 0) > 0 THEN 1 ELSE 0 END, 0) + 1] AS confidence
FROM merged m JOIN kept USING (cluster) LEFT JOIN burst ON burst.keyword = m.keyword LEFT JOIN quality ON quality.keyword = m.keyword"""
)


@Q.add(_REBUILD_SQL)
def rebuilt_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus table of a whole rebuild: aggregate, boost, fragments, clusters, bursts, confidence."""
    blocked = spark.createDataFrame([("team rituals",)], "keyword string")
    zipf = topics.background_zipf(table(spark, sf_dir, "documents"), "text")
    rows = topics.rebuilt(_topics(spark, sf_dir), table(spark, sf_dir, "issues"), zipf, _active(spark, sf_dir).count(), blocked)
    return rows.withColumns({"aggregate_score": F.round("aggregate_score", 4), "burst_score": F.round("burst_score", 6)})


@Q.add(_DRIFT_SQL)
def terminology_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that surround one term more in a quarter than over all."""
    rows = topics.drift(_active(spark, sf_dir), "full_text_plain", "market")
    return rows.select("year", "quarter", "word", F.round("share", 6).alias("share"), F.round("lift", 6).alias("lift"), F.col("place").cast("long").alias("place"))


@Q.add(_CORPUS_SQL + "SELECT keyword, doc_frequency, round(aggregate_score, 4) AS aggregate_score FROM corpus WHERE cluster IN (SELECT cluster FROM k WHERE issue_id = (SELECT max(issue_id) FROM issue_topics))")
def refreshed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one changed issue makes to be computed anew: the aggregate of the clusters it touches, by the shared rule."""
    rows = _topics(spark, sf_dir)
    changed = rows.agg(F.max("issue_id")).first()[0]
    touched = rows.where(F.col("issue_id") == changed).select(topics.cluster_key().alias("cluster")).distinct()
    affected = rows.withColumn("cluster", topics.cluster_key()).join(touched, "cluster", "left_semi").drop("cluster")
    blocked = spark.createDataFrame([("team rituals",)], "keyword string")
    fresh = topics.corpus_topics(affected, table(spark, sf_dir, "issues"), _active(spark, sf_dir).count(), blocked)
    return fresh.select("keyword", "doc_frequency", F.round("aggregate_score", 4).alias("aggregate_score"))


@Q.add(
    """WITH e AS (SELECT DISTINCT keyword FROM issue_topics WHERE suppression_reason IS NULL), s AS (SELECT DISTINCT keyword FROM corpus_topics WHERE eligibility_status = 'public_topic')
SELECT (SELECT count(*) FROM e) AS extracted, (SELECT count(*) FROM s) AS stored, (SELECT count(*) FROM e SEMI JOIN s USING (keyword)) AS both_"""
)
def topic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far extracted and stored topics agree."""
    e = _topics(spark, sf_dir).where("suppression_reason IS NULL").select("keyword").distinct().withColumn("e", F.lit(1))
    s = table(spark, sf_dir, "corpus_topics").where("eligibility_status = 'public_topic'").select("keyword").distinct().withColumn("s", F.lit(1))
    return e.join(s, "keyword", "full").agg(F.count("e").alias("extracted"), F.count("s").alias("stored"), F.count(F.when(F.col("e").isNotNull() & F.col("s").isNotNull(), 1)).alias("both_"))


@Q.add(
    """WITH e AS (SELECT DISTINCT issue_id, keyword FROM issue_topics WHERE keyword IS NOT NULL AND suppression_reason IS NULL QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY score NULLS LAST, keyword) <= 25),
s AS (SELECT DISTINCT issue_id, keyword FROM issue_topics WHERE keyword IS NOT NULL AND eligibility_status = 'public_topic')
SELECT issue_id, count(e.keyword) AS extracted, count(s.keyword) AS stored, count(CASE WHEN e.keyword IS NOT NULL AND s.keyword IS NOT NULL THEN 1 END) AS both_,
round(coalesce(count(CASE WHEN e.keyword IS NOT NULL AND s.keyword IS NOT NULL THEN 1 END) / nullif(CAST(count(e.keyword) AS DOUBLE), 0), 0.0) - coalesce(count(CASE WHEN e.keyword IS NOT NULL AND s.keyword IS NOT NULL THEN 1 END) / nullif(CAST(count(s.keyword) AS DOUBLE), 0), 0.0), 6) AS delta
FROM e FULL JOIN s USING (issue_id, keyword) WHERE issue_id IS NOT NULL GROUP BY 1"""
)
def issue_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each issue, how far its best topics and its public ones agree, and the difference of both precisions."""
    rows = _topics(spark, sf_dir).where("keyword IS NOT NULL")
    place = F.row_number().over(W.partitionBy("issue_id").orderBy(F.col("score").asc_nulls_last(), "keyword"))
    best = rows.where("suppression_reason IS NULL").select("issue_id", "keyword", "score").distinct().withColumn("p", place).where("p <= 25").select("issue_id", "keyword").distinct()
    public = rows.where("eligibility_status = 'public_topic'").select("issue_id", "keyword").distinct()
    return topics.audited(best, public).withColumn("delta", F.round("delta", 6))


@Q.add(
    """SELECT keyword, doc_frequency, CASE WHEN length(keyword) < 4 THEN 'short' WHEN doc_frequency IS NULL OR doc_frequency < 3 THEN 'rare' WHEN coalesce(topic_type, 'unknown') = 'unknown' THEN 'untyped' WHEN coalesce(distinctiveness, 0) < 0.5 THEN 'common' END AS suspicion FROM corpus_topics
WHERE eligibility_status = 'public_topic' AND (length(keyword) < 4 OR doc_frequency IS NULL OR doc_frequency < 3 OR coalesce(topic_type, 'unknown') = 'unknown' OR coalesce(distinctiveness, 0) < 0.5)"""
)
def suspicious_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public topics that look wrong, with the first reason why."""
    rows = table(spark, sf_dir, "corpus_topics").where("eligibility_status = 'public_topic'")
    why = F.when(F.length("keyword") < 4, "short").when(F.col("doc_frequency").isNull() | (F.col("doc_frequency") < 3), "rare")
    why = why.when(F.coalesce("topic_type", F.lit("unknown")) == "unknown", "untyped").when(F.coalesce("distinctiveness", F.lit(0.0)) < 0.5, "common")
    return rows.select("keyword", "doc_frequency", why.alias("suspicion")).where("suspicion IS NOT NULL")


_SORTS = {"frequency": "doc_frequency DESC NULLS LAST, keyword", "score": "aggregate_score DESC NULLS LAST, keyword", "burst": "burst_score DESC NULLS LAST, keyword", "name": "keyword"}


@Q.add(" UNION ALL ".join(f"SELECT '{name}' AS sort, keyword, row_number() OVER (ORDER BY {order}) AS place FROM corpus_topics QUALIFY place <= 20" for name, order in _SORTS.items()))
def topic_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty topics in each of the four orders."""
    rows = table(spark, sf_dir, "corpus_topics").select("keyword", "doc_frequency", "aggregate_score", "burst_score")
    found = [topics.sorted_page(rows, name, 20).select(F.lit(name).alias("sort"), "keyword", "place") for name in _SORTS]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


QUERIES, ORACLES = Q.functions, Q.sql
