"""Search queries over issues, chunks, vectors and recorded hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import dictionaries as D
from colophon.functions import text as T
from colophon.operators import fusion, ingest, lexical, query_language, semantic
from colophon.plans.base import Queries
from colophon.sources.tables import table

Q = Queries()

WORDS_SQL = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _issues(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "issues").where(F.col("status") == "active").select("id", *columns)


@Q.add(
    "WITH w AS (SELECT id AS doc_id, unnest("
    + WORDS_SQL.format("title")
    + ") AS term FROM issues WHERE status = 'active') SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2"
)
def title_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of titles."""
    return lexical.postings(_issues(spark, sf_dir, "title"), "id", ["title"]).select("doc_id", "term", "tf")


@Q.add()
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best stretch of each issue that holds the word, marked."""
    rows = _issues(spark, sf_dir, "full_text_plain").where(F.array_contains(T.words(F.col("full_text_plain")), "compass"))
    return rows.select("id", lexical.highlight(F.col("full_text_plain"), ["compass"]).alias("highlight"))


@Q.add(
    """WITH h AS (SELECT id, replace(replace(full_text_plain, 'compass', '<mark>compass</mark>'), chr(39), '"') AS t FROM issues WHERE status = 'active' AND full_text_plain IS NOT NULL)
SELECT id, replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '&lt;mark&gt;', '<mark>'), '&lt;/mark&gt;', '</mark>') AS shown FROM h"""
)
def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a word marked, escaped for a page but for the marks."""
    marked = F.replace(F.replace(F.col("full_text_plain"), F.lit("compass"), F.lit("<mark>compass</mark>")), F.lit("'"), F.lit('"'))
    return _issues(spark, sf_dir, "full_text_plain").where("full_text_plain IS NOT NULL").select("id", T.escaped(marked, keep_marks=True).alias("shown"))


@Q.add()
def highlighted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that each issue's highlight comes from."""
    rows = _issues(spark, sf_dir, "full_text_plain", "full_text_markdown").where(F.array_contains(T.words(F.col("full_text_plain")), "compass"))
    rows = rows.withColumn("highlight", lexical.highlight(F.col("full_text_plain"), ["compass"]))
    return ingest.snippet_sections(rows, "id", "highlight", "full_text_markdown")


@Q.add(
    r"""WITH d AS (SELECT concat_ws(' ', regexp_replace(coalesce(title, ''), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), regexp_replace(coalesce(headings, ''), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')) AS s FROM issues WHERE status = 'active'),
w AS (SELECT DISTINCT regexp_replace(unnest(regexp_split_to_array(lower(s), '[\s|,]+')), '[^a-z''-]', '', 'g') AS word FROM d)
SELECT word FROM w WHERE length(word) >= 3 AND starts_with(word, 'ma') AND word <> 'ma' ORDER BY length(word), word LIMIT 10"""
)
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten suggestions for the last word typed."""
    return lexical.suggestions(_issues(spark, sf_dir, "title", "headings"), ["title", "headings"], "quiet ma")


@Q.add(
    "SELECT id, published_at FROM issues WHERE status = 'active' AND published_at < '2023-06-01' AND published_at > '2022-01-01' AND year = 2022 ORDER BY published_at DESC, id LIMIT 20 OFFSET 20"
)
def filter_only_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of a query of filters only, newest first."""
    parsed = query_language.parse_query("before:2023-06 after:2022-01 year:2022")
    given = parsed.filters
    offset, limit = query_language.page_of(2, 20)
    rows = _issues(spark, sf_dir, "published_at", "year").where(semantic.date_filter(F.col("published_at"), given.before, given.after, nulls_pass=False))
    return rows.where(F.col("year") == given.year).orderBy(F.col("published_at").desc(), "id").offset(offset).limit(limit).select("id", "published_at")


@Q.add(
    "SELECT id FROM issues WHERE status = 'active' AND id IN (SELECT issue_id FROM issue_topics WHERE trim(regexp_replace(regexp_replace(lower(keyword), '[^\\p{L}\\p{N}\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) = 'slow feedback')"
)
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that carry a topic, both sides normalised."""
    wanted = query_language.parse_query('topic:"Slow Feedback"').filters.topic
    carriers = table(spark, sf_dir, "issue_topics").where(T.topic_value(F.col("keyword")) == wanted).select(F.col("issue_id").alias("id"))
    return _issues(spark, sf_dir).join(carriers, "id", "left_semi")


_COSINE_SQL = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7))"


def _query_vectors(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """(query_id, query_vector, query_label) of the vectors that are asked for."""
    return table(spark, sf_dir, "embeddings").where(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


#: The query set prescribed for searches.
QUERY_SET = "vec_id % 100 = 0"


@Q.add(f"SELECT vec_id, label, round({_COSINE_SQL}, 6) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY round({_COSINE_SQL}, 6) DESC, vec_id LIMIT 15")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 nearest chunks among those that pass a filter on their metadata."""
    keep = F.col("label").isin(1, 2, 3)
    return semantic.top_chunks_each(_query_vectors(spark, sf_dir, "vec_id = 7"), table(spark, sf_dir, "embeddings"), "query_id", "vec_id", "embedding", keep).select("vec_id", "label", "score")


@Q.add(
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.label IN (q.label, (q.label + 1) % 10, (q.label + 2) % 10))
SELECT query_id, vec_id, label, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 15"""
)
def semantic_topk_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 nearest chunks of each vector of the query set, each behind a filter of its own."""
    queries = _query_vectors(spark, sf_dir, QUERY_SET)
    keep = F.col("label").isin([(F.col("query_label") + i) % 10 for i in range(3)])
    return semantic.top_chunks_each(queries, table(spark, sf_dir, "embeddings"), "query_id", "vec_id", "embedding", keep).select("query_id", "vec_id", "label", "score")


@Q.add(
    f"""WITH s AS (SELECT vec_id, vec_id // 4 AS document, round({_COSINE_SQL}, 6) AS score FROM embeddings),
g AS (SELECT document, max(score) AS top_score, arg_max(vec_id, score + vec_id * 1e-12) AS top_chunk, count(*) AS chunk_count FROM s WHERE score >= 0.05 GROUP BY 1)
SELECT document, top_score, top_chunk, chunk_count, row_number() OVER (ORDER BY top_score DESC, document) AS semantic_rank FROM g ORDER BY top_score DESC, document LIMIT 500"""
)
def chunk_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks collapsed to documents of four, each with its best chunk."""
    return _collapsed(spark, sf_dir, "vec_id = 7").drop("query_id")


def _collapsed(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 4).cast("long").alias("document"))
    scored = semantic.query_scores(_query_vectors(spark, sf_dir, which), rows, "vec_id", "embedding")
    return semantic.collapsed(scored, "document", "vec_id", floor=0.05, query="query_id")


@Q.add(
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.vec_id // 4 AS document, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
g AS (SELECT query_id, document, max(score) AS top_score, first(vec_id ORDER BY score DESC, vec_id DESC) AS top_chunk, count(*) AS chunk_count FROM s WHERE score >= 0.05 GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY top_score DESC, document) AS semantic_rank FROM g QUALIFY semantic_rank <= 500"""
)
def chunk_collapse_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks collapsed to documents for each vector of the query set."""
    return _collapsed(spark, sf_dir, QUERY_SET)


# Hybrid ranking of recorded hits.

_HITS_SQL = r"""
WITH hits AS (SELECT query_id, any_value(query_text ORDER BY query_text) AS query_text, issue_id, min(bm25_score) AS bm25, max(top_score) AS top_score, max(chunk_count) AS chunk_count
    FROM search_hits GROUP BY query_id, issue_id),
ranked AS (SELECT *, CASE WHEN bm25 IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY bm25 NULLS LAST, issue_id) END AS lexical_rank,
    CASE WHEN top_score IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY top_score DESC NULLS LAST, issue_id) END AS semantic_rank,
    count(bm25) OVER (PARTITION BY query_id) AS lexical_hits FROM hits),
parsed AS (SELECT *, regexp_extract_all(query_text, '"([^"]+)"', 1) AS phrases,
    trim(regexp_replace(regexp_replace(regexp_replace(query_text, '"[^"]+"', '', 'g'), '(?i)\b(before|after|year|issue|section|topic):\S+', '', 'g'), '\s+', ' ', 'g')) AS free_text,
    TRY_CAST(nullif(regexp_extract(query_text, '(?i)\bissue:([0-9]+)', 1), '') AS INTEGER) AS wanted_issue,
    nullif(lower(regexp_extract(query_text, '(?i)\btopic:([^\s"]+)', 1)), '') AS wanted_topic FROM ranked),
joined AS (SELECT p.*, i.title, i.subtitle, i.headings, i.full_text_plain, i.issue_number, i.published_at, i.year,
    list_filter(string_split(regexp_replace(lower(free_text), '\s+', ' ', 'g'), ' '), lambda w: w <> '') AS words,
    EXISTS (SELECT 1 FROM issue_topics t WHERE t.issue_id = p.issue_id AND trim(regexp_replace(lower(t.keyword), '\s+', ' ', 'g')) IN (lower(p.free_text), p.wanted_topic, lower(p.phrases[1]))) AS topic_hit
    FROM parsed p JOIN issues i ON i.id = p.issue_id WHERE lexical_rank IS NOT NULL OR semantic_rank IS NOT NULL),
points AS (SELECT *,
    CASE WHEN issue_number = wanted_issue THEN 10.0 ELSE 0.0 END AS exact_issue,
    6.0 * len(list_filter(phrases, lambda p: coalesce(contains(lower(title), lower(p)), false))) AS phrase_title,
    4.0 * len(list_filter(phrases, lambda p: coalesce(contains(lower(subtitle), lower(p)), false) OR coalesce(contains(lower(headings), lower(p)), false))) AS phrase_heading,
    3.0 * len(list_filter(phrases, lambda p: coalesce(contains(lower(full_text_plain), lower(p)), false))) AS phrase_body,
    len(list_filter(words, lambda w: list_contains(string_split(regexp_replace(lower(coalesce(title, '')), '\s+', ' ', 'g'), ' '), w))) AS overlap FROM joined),
scored AS (SELECT *, coalesce(1.0 / (40.0 + lexical_rank), 0.0) + coalesce(0.55 / (40.0 + semantic_rank), 0.0) + exact_issue + phrase_title + phrase_heading + phrase_body
    + CASE WHEN overlap >= 2 OR (overlap = 1 AND len(words) = 1) THEN 1.5 ELSE 0.0 END
    + CASE WHEN lexical_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 1.25 ELSE 0.0 END + CASE WHEN topic_hit THEN 1.5 ELSE 0.0 END
    + CASE WHEN chunk_count > 1 AND semantic_rank IS NOT NULL THEN 0.75 ELSE 0.0 END
    + CASE WHEN lexical_rank IS NULL AND lexical_hits >= 3 THEN -3.5 ELSE 0.0 END AS final_score,
    CASE WHEN exact_issue > 0 OR phrase_title > 0 OR phrase_body > 0 THEN 'high' WHEN lexical_rank IS NULL AND lexical_hits >= 3 THEN 'low' ELSE 'medium' END AS confidence FROM points),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, lexical_rank NULLS LAST, semantic_rank NULLS LAST, issue_id) AS rank FROM scored)
"""


def hybrid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query of search_hits, ranked anew: fused ranks, boosts, confidence and final rank of each issue."""
    hits = table(spark, sf_dir, "search_hits").groupBy("query_id", "issue_id").agg(
        F.min("query_text").alias("query_text"), F.min("bm25_score").alias("bm25"), F.max("top_score").alias("top_score"), F.max("chunk_count").alias("chunk_count")
    )
    per_query = W.partitionBy("query_id")
    ranked = hits.withColumns(
        {
            "lexical_rank": F.when(F.col("bm25").isNotNull(), F.row_number().over(per_query.orderBy(F.col("bm25").asc_nulls_last(), "issue_id"))),
            "semantic_rank": F.when(F.col("top_score").isNotNull(), F.row_number().over(per_query.orderBy(F.col("top_score").desc_nulls_last(), "issue_id"))),
            "lexical_hits": F.count("bm25").over(per_query),
        }
    ).where(F.col("lexical_rank").isNotNull() | F.col("semantic_rank").isNotNull())
    text = F.col("query_text")
    without_phrases = F.regexp_replace(text, r'"[^"]+"', "")
    operators = "|".join(D.OPERATORS)
    parsed = ranked.withColumns(
        {
            "phrases": F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), F.lit(1)),
            "free_text": F.trim(F.regexp_replace(F.regexp_replace(without_phrases, rf"(?i)\b({operators}):\S+", ""), r"\s+", " ")),
            "wanted_issue": F.regexp_extract(text, r"(?i)\bissue:([0-9]+)", 1).try_cast("int"),
            "wanted_topic": F.lower(F.regexp_extract(text, r'(?i)\btopic:([^\s"]+)', 1)),
        }
    )
    topics = table(spark, sf_dir, "issue_topics").select("issue_id", T.keyword(F.col("keyword")).alias("topic")).distinct()
    wanted = F.array(F.lower("free_text"), F.nullif(F.col("wanted_topic"), F.lit("")), F.lower(F.try_element_at("phrases", F.lit(1))))
    asked = parsed.select("query_id", "issue_id", F.explode(F.array_distinct(F.filter(wanted, lambda x: x.isNotNull()))).alias("topic"))
    matches = asked.join(topics, ["issue_id", "topic"], "left_semi").select("query_id", "issue_id").distinct().withColumn("topic_hit", F.lit(True))
    issues = table(spark, sf_dir, "issues").select(F.col("id").alias("issue_id"), "title", "subtitle", "headings", "summary", "full_text_plain", "issue_number", "published_at", "year")
    rows = parsed.join(issues, "issue_id").join(matches, ["query_id", "issue_id"], "left")
    points = fusion.boosts(F.col("phrases"), F.col("free_text"), F.col("wanted_issue"), F.col("topic_hit"), F.col("lexical_hits"))
    rows = rows.withColumns({f"p_{k}": v for k, v in points.items()})
    named = {k: F.col(f"p_{k}") for k in points}
    total = fusion.reciprocal_ranks()
    for c in named.values():
        total = total + c
    rows = rows.withColumns({"final_score": total, "confidence": fusion.confidence(named)})
    return rows.withColumn("rank", fusion.final_rank(["query_id"]))


@Q.add(_HITS_SQL + "SELECT query_id, issue_id, round(final_score, 6) AS final_score, confidence, rank FROM final")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, score and confidence of every issue of every recorded query."""
    return hybrid_results(spark, sf_dir).select("query_id", "issue_id", F.round("final_score", 6).alias("final_score"), "confidence", F.col("rank").cast("long").alias("rank"))


@Q.add(
    """WITH hits AS (SELECT query_id, issue_id, min(bm25_score) AS b, max(top_score) AS t FROM search_hits GROUP BY 1, 2),
l AS (SELECT query_id, issue_id, row_number() OVER (PARTITION BY query_id ORDER BY b, issue_id) AS lexical_rank FROM hits WHERE b IS NOT NULL),
s AS (SELECT query_id, issue_id, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, issue_id) AS semantic_rank FROM hits WHERE t IS NOT NULL)
SELECT query_id, issue_id, round(coalesce(1.0 / (40.0 + lexical_rank), 0.0) + coalesce(0.55 / (40.0 + semantic_rank), 0.0), 9) AS rrf
FROM l FULL JOIN s USING (query_id, issue_id)"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted reciprocal rank fusion by a full outer join of the two sides."""
    hits = table(spark, sf_dir, "search_hits").groupBy("query_id", "issue_id").agg(F.min("bm25_score").alias("b"), F.max("top_score").alias("t"))
    w = W.partitionBy("query_id")
    left = hits.where("b IS NOT NULL").select("query_id", "issue_id", F.row_number().over(w.orderBy("b", "issue_id")).alias("lexical_rank"))
    right = hits.where("t IS NOT NULL").select("query_id", "issue_id", F.row_number().over(w.orderBy(F.desc("t"), "issue_id")).alias("semantic_rank"))
    return fusion.fused(left, right, ["query_id", "issue_id"]).select("query_id", "issue_id", F.round(fusion.reciprocal_ranks(), 9).alias("rrf"))


@Q.add(_HITS_SQL + "SELECT confidence, count(*) AS results FROM final GROUP BY 1")
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_results(spark, sf_dir).groupBy("confidence").agg(F.count(F.lit(1)).alias("results"))


@Q.add(_HITS_SQL + "SELECT query_id, year, count(*) AS hits FROM final WHERE year IS NOT NULL GROUP BY 1, 2")
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per year of each query."""
    return hybrid_results(spark, sf_dir).where("year IS NOT NULL").groupBy("query_id", "year").agg(F.count(F.lit(1)).alias("hits"))


_SECTION_SQL = r""", labelled AS (SELECT f.query_id, f.issue_id, f.published_at, f.rank, coalesce(c.section, 'other') AS section FROM final f
    LEFT JOIN (SELECT issue_id, arg_min(CASE WHEN lower(trim(section_label)) = 'title_summary' THEN 'lead_essay' WHEN regexp_replace(lower(trim(section_label)), '\s+', '_', 'g') IN ('lead_essay', 'signposts', 'worth_your_time', 'lens', 'book', 'postcard', 'more_from', 'other') THEN regexp_replace(lower(trim(section_label)), '\s+', '_', 'g')
        WHEN regexp_extract(lower(trim(section_label)), '^([a-z]+)', 1) IN ('lens', 'book', 'postcard', 'signposts') THEN regexp_extract(lower(trim(section_label)), '^([a-z]+)', 1) ELSE 'other' END, (chunk_index, id)) AS section
               FROM issue_chunks GROUP BY 1) c ON c.issue_id = f.issue_id)
"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the display section of their issue's first chunk."""
    section = T.display_section(F.col("section_label"), D.SECTIONS)
    chunks = table(spark, sf_dir, "issue_chunks").groupBy("issue_id").agg(F.min_by(section, F.struct("chunk_index", "id")).alias("section"))
    return hybrid_results(spark, sf_dir).select("query_id", "issue_id", "published_at", "rank").join(chunks, "issue_id", "left")


@Q.add(_HITS_SQL + _SECTION_SQL + "SELECT section, count(*) AS hits FROM labelled GROUP BY 1")
def section_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.facets(_labelled(spark, sf_dir))


@Q.add(
    _HITS_SQL
    + _SECTION_SQL
    + """SELECT year(d) || '-Q' || quarter(d) AS quarter, section, count(*) AS hits FROM (SELECT TRY_CAST(published_at AS DATE) AS d, section FROM labelled) WHERE d IS NOT NULL GROUP BY 1, 2"""
)
def quarter_section_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per quarter and section, from the map of each quarter."""
    return fusion.quarter_sections(_labelled(spark, sf_dir)).select("quarter", F.explode("sections").alias("section", "hits"))


@Q.add(_HITS_SQL + _SECTION_SQL + "SELECT query_id, issue_id, rank FROM labelled WHERE section = 'lead_essay' AND rank <= 10")
def section_filter_after_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section filter applies to ranked results: ranks keep their gaps."""
    return _labelled(spark, sf_dir).where((F.col("section") == "lead_essay") & (F.col("rank") <= 10)).select("query_id", "issue_id", F.col("rank").cast("long").alias("rank"))


@Q.add(
    _HITS_SQL
    + """, top AS (SELECT issue_id, string_agg(keyword, '|' ORDER BY rank, keyword) AS topics FROM (SELECT issue_id, keyword, rank FROM (SELECT DISTINCT issue_id, keyword, rank FROM issue_topics) QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY rank NULLS LAST, keyword) <= 3) GROUP BY 1)
SELECT f.query_id, f.issue_id, f.rank, coalesce(nullif(i.canonical_url, ''), i.source_url) AS display_url, t.topics FROM final f JOIN issues i ON i.id = f.issue_id LEFT JOIN top t ON t.issue_id = f.issue_id WHERE f.rank > 5 AND f.rank <= 10"""
)
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of five of every query, with address and three topics each."""
    topics = table(spark, sf_dir, "issue_topics").select("issue_id", "keyword", "rank").distinct()
    place = F.row_number().over(W.partitionBy("issue_id").orderBy(F.col("rank").asc_nulls_last(), "keyword"))
    best = topics.withColumn("place", place).where("place <= 3").groupBy("issue_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "keyword"))), lambda s: s["keyword"]), "|").alias("topics"))
    page = hybrid_results(spark, sf_dir).where((F.col("rank") > 5) & (F.col("rank") <= 10)).select("query_id", "issue_id", F.col("rank").cast("long").alias("rank"))
    address = F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("source_url"))
    issues = table(spark, sf_dir, "issues").select(F.col("id").alias("issue_id"), address.alias("display_url"))
    return page.join(issues, "issue_id").join(best, "issue_id", "left")


@Q.add()
def result_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of the first ten results of every query."""
    rows = hybrid_results(spark, sf_dir).where("rank <= 10")
    cut = fusion.snippet(F.col("rank"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("summary"), F.col("full_text_plain"))
    return rows.select("query_id", "issue_id", "rank", cut.alias("snippet"))


@Q.add(
    """SELECT id, CASE WHEN length(summary) <= 150 THEN summary ELSE CASE WHEN strpos(reverse(left(summary, 150)), ' ') > 0 AND 150 - strpos(reverse(left(summary, 150)), ' ') > 105
    THEN left(summary, 150 - strpos(reverse(left(summary, 150)), ' ')) ELSE left(summary, 150) END || '...' END AS snippet FROM issues WHERE summary IS NOT NULL"""
)
def shortened_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "issues").where("summary IS NOT NULL").select("id", T.shortened(F.col("summary"), D.SNIPPET_SHORT).alias("snippet"))


@Q.add("SELECT id, published_at FROM issues WHERE status = 'active' AND published_at IS NOT NULL ORDER BY published_at DESC, id LIMIT 1")
def latest_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir, "published_at").where("published_at IS NOT NULL").orderBy(F.desc("published_at"), "id").limit(1)


@Q.add("SELECT id, issue_number, title FROM issues WHERE status = 'active' AND issue_number = 12")
def issue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir, "issue_number", "title").where("issue_number = 12")


@Q.add()
def random_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opening quote at random, the same for the same seed and files."""
    return _issues(spark, sf_dir, "opening_quote").where("opening_quote IS NOT NULL").orderBy(F.rand(7)).limit(1)


@Q.add(
    "SELECT id FROM issues WHERE status = 'active' AND (published_at IS NULL OR published_at < '2022-01-01')"
)
def semantic_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the semantic side an issue without a date passes a date filter."""
    return _issues(spark, sf_dir, "published_at").where(semantic.date_filter(F.col("published_at"), before="2022-01-01")).select("id")


QUERIES, ORACLES = Q.functions, Q.sql
