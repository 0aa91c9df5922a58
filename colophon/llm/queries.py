"""Queries of this subpackage over the archive's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.llm import distinctiveness, markup, match_groups, mixing, packing, page_wrapper, rank_fusion, site_lines, truncation
from colophon.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# 2. One ranking from several scores

#: Score columns of search_hits; True: larger is better.
HIT_SCORES = {"bm25_score": False, "top_score": True, "final_score": True}


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three leading issues of each query."""
    hits = table(spark, sf_dir, "search_hits")
    return rank_fusion.leading_items(hits, "query_id", "issue_id", HIT_SCORES).select("query_id", "issue_id")


@query
def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of every query with its significance."""
    ranked = rank_fusion.aggregate_ranks(table(spark, sf_dir, "search_hits"), "query_id", "issue_id", HIT_SCORES)
    return ranked.select("query_id", "issue_id", F.round("rho", 9).alias("rho"), F.round("mean_rank", 9).alias("mean_rank"))


_RANKED_SQL = """
WITH best AS (SELECT query_id, issue_id, min(bm25_score) AS b, max(top_score) AS t, max(final_score) AS f
              FROM search_hits WHERE query_id IS NOT NULL AND issue_id IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT query_id, issue_id,
    CASE WHEN b IS NULL THEN 1.0 ELSE rank() OVER (PARTITION BY query_id ORDER BY b NULLS LAST) / n END AS r1,
    CASE WHEN t IS NULL THEN 1.0 ELSE rank() OVER (PARTITION BY query_id ORDER BY t DESC NULLS LAST) / n END AS r2,
    CASE WHEN f IS NULL THEN 1.0 ELSE rank() OVER (PARTITION BY query_id ORDER BY f DESC NULLS LAST) / n END AS r3
    FROM (SELECT *, CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE) AS n FROM best)),
sorted AS (SELECT *, (r1 + r2 + r3) / 3.0 AS mean_rank, least(r1, r2, r3) AS x, greatest(r1, r2, r3) AS z,
    CAST(list_sort([r1, r2, r3])[2] AS DOUBLE) AS y FROM ranked),
scored AS (SELECT query_id, issue_id, mean_rank,
    least(1.0, 3.0 * least(1.0 - pow(1.0 - x, 3), 3.0 * y * y * (1.0 - y) + y * y * y, z * z * z)) AS rho FROM sorted)
"""
ORACLES["p2_ranking"] = _RANKED_SQL + "SELECT query_id, issue_id, round(rho, 9) AS rho, round(mean_rank, 9) AS mean_rank FROM scored"
ORACLES["p2_found"] = (
    _RANKED_SQL
    + """SELECT query_id, issue_id FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rho, 12), round(mean_rank, 12), issue_id) <= 3"""
)


# 3. How distinctive a term is


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most characteristic keyword of each probed issue."""
    weights = distinctiveness.term_weights(table(spark, sf_dir, "issue_topics"), "issue_id", "keyword", "score")
    probes = table(spark, sf_dir, "topic_probes").select(F.col("issue_id").alias("record"))
    scored = distinctiveness.pointwise_information(weights, probes)
    best = distinctiveness.most_characteristic(scored)
    return best.select(F.col("record").alias("issue_id"), F.col("term").alias("keyword"))


@query
def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyword of every issue with its distinctiveness."""
    weights = distinctiveness.term_weights(table(spark, sf_dir, "issue_topics"), "issue_id", "keyword", "score")
    scored = distinctiveness.pointwise_information(weights)
    return scored.select(F.col("record").alias("issue_id"), F.col("term").alias("keyword"), "records", F.round("ppmi", 6).alias("ppmi"))


_TERMS_SQL = r"""
WITH rows_ AS (SELECT issue_id, trim(regexp_replace(lower(keyword), '[ _-]+', ' ', 'g')) AS keyword, score FROM issue_topics
               WHERE issue_id IS NOT NULL AND keyword IS NOT NULL AND score > 0 AND NOT isnan(score)),
w AS (SELECT issue_id, keyword, 1.0 / min(score) AS weight FROM rows_ WHERE keyword <> '' GROUP BY 1, 2),
r AS (SELECT issue_id, sum(weight) AS rw, max(weight) AS top FROM w GROUP BY 1),
t AS (SELECT keyword, pow(sum(weight), 0.75) AS sm, count(*) AS records FROM w GROUP BY 1),
total AS (SELECT sum(sm) AS s FROM t),
scored AS (SELECT w.issue_id, w.keyword, w.weight, t.records, w.weight / r.top AS share,
                  greatest(0.0, ln(w.weight * (SELECT s FROM total) / (r.rw * t.sm))) AS ppmi
           FROM w JOIN r USING (issue_id) JOIN t USING (keyword))
"""
ORACLES["p3_terms"] = _TERMS_SQL + "SELECT issue_id, keyword, records, round(ppmi, 6) AS ppmi FROM scored"
ORACLES["p3_found"] = (
    _TERMS_SQL
    + """SELECT issue_id, keyword FROM scored WHERE share >= 0.1 AND issue_id IN (SELECT issue_id FROM topic_probes)
QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY round(ppmi, 9) DESC, records, weight DESC, keyword) = 1"""
)


# 4. Consolidating pairwise matches


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every keyword that matches link to another."""
    groups = match_groups.linked_groups(table(spark, sf_dir, "topic_similarity"), "keyword_a", "keyword_b", "blended", 0.6)
    return groups.select(F.col("member").alias("keyword"), "group_key")


ORACLES["p4_found"] = """
WITH RECURSIVE links AS (
    SELECT DISTINCT a, b FROM (
        SELECT keyword_a AS a, keyword_b AS b FROM topic_similarity WHERE blended >= 0.6 AND NOT isnan(blended)
        UNION ALL SELECT keyword_b, keyword_a FROM topic_similarity WHERE blended >= 0.6 AND NOT isnan(blended))
    WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS keyword, least(a, min(b)) AS group_key FROM reach GROUP BY a"""


# 6. Lines repeated across one site's documents


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that recurs too often on its issue's host."""
    issues = table(spark, sf_dir, "issues").select("id", "source_url", "full_text_plain")
    found = site_lines.recurring_lines(issues, "id", "source_url", "full_text_plain")
    return found.select(F.col("doc_id").alias("issue_id"), "line_no")


@query
def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each issue's plain text without these lines."""
    issues = table(spark, sf_dir, "issues").select("id", "source_url", "full_text_plain")
    clean = site_lines.without_recurring_lines(issues, "id", "source_url", "full_text_plain")
    return clean.select(F.col("id").alias("issue_id"), F.col("full_text_plain").alias("clean_text"))


_LINES_SQL = r"""
WITH docs AS (SELECT id, full_text_plain,
    nullif(lower(regexp_replace(regexp_replace(regexp_extract(trim(source_url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '') AS host
    FROM issues WHERE full_text_plain IS NOT NULL),
split_ AS (SELECT id, host, string_split(full_text_plain, chr(10)) AS ls FROM docs),
lines AS (SELECT id, host, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS line_no FROM split_),
forms AS (SELECT id, host, line, line_no, regexp_replace(trim(regexp_replace(lower(line), '[ 	]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS form FROM lines),
hosts AS (SELECT host, count(*) AS n FROM docs WHERE host IS NOT NULL GROUP BY 1),
often AS (SELECT host, form, count(DISTINCT id) AS d FROM forms WHERE host IS NOT NULL AND form <> '' GROUP BY 1, 2),
gone AS (SELECT host, form FROM often JOIN hosts USING (host) WHERE d >= 5 AND d >= 0.1 * n)
"""
ORACLES["p6_found"] = _LINES_SQL + "SELECT id AS issue_id, CAST(line_no AS BIGINT) AS line_no FROM forms SEMI JOIN gone USING (host, form)"
ORACLES["p6_clean"] = (
    _LINES_SQL
    + """, kept AS (SELECT id, string_agg(line, chr(10) ORDER BY line_no) AS clean_text FROM forms ANTI JOIN gone USING (host, form) GROUP BY id)
SELECT i.id AS issue_id, CASE WHEN i.full_text_plain IS NULL THEN NULL ELSE coalesce(k.clean_text, '') END AS clean_text
FROM issues i LEFT JOIN kept k ON i.id = k.id"""
)


# 7. Page boilerplate mixed with main content


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawled = table(spark, sf_dir, "crawl_pages").select("url", "markdown")
    issues = table(spark, sf_dir, "issues").select("id", "source_url", "full_text_markdown")
    return page_wrapper.page_rows(crawled, "page", "url", "url", "markdown").unionByName(
        page_wrapper.page_rows(issues, "issue", "id", "source_url", "full_text_markdown")
    )


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line outside the article of a page or issue."""
    return page_wrapper.lines_outside(_pages(spark, sf_dir))


@query
def p7_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page and issue."""
    return page_wrapper.articles(_pages(spark, sf_dir))


# 5. Markup residue in text documents


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "issue_chunks").select(F.lit("chunk").alias("record_kind"), F.col("id").alias("record_id"), F.col("chunk_text").alias("text"))
    issues = table(spark, sf_dir, "issues").select(F.lit("issue").alias("record_kind"), F.col("id").alias("record_id"), F.col("full_text_markdown").alias("text"))
    return chunks.unionByName(issues)


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk and issue whose text holds markup."""
    return markup.records_with_markup(_records(spark, sf_dir))


@query
def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk and issue as clean text."""
    return _records(spark, sf_dir).select("record_kind", "record_id", markup.cleaned(F.col("text")).alias("clean_text"))


# 10. Text cut off by field limits


def _endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_texts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source")


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose text was cut off."""
    return _endings(spark, sf_dir).where("truncated").select("doc_id")


@query
def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_shares(_endings(spark, sf_dir))


# 8. Filling fixed-capacity containers


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "pack_specs").select("spec_id", "capacity_tokens").collect()  # a fixed table of four rows
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(documents, "doc_id", "text", [(r[0], r[1]) for r in specs])


@query
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of its parts, for every capacity."""
    return _packed(spark, sf_dir)


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(_packed(spark, sf_dir))


@query
def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packing must not hold: rows here are faults."""
    return packing.violations(_packed(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id")


ORACLES["p8_violations"] = "SELECT CAST(NULL AS INTEGER) AS spec_id, '' AS problem, '' AS name WHERE false"


# 9. Mixing sources to target weights


def _sized(spark: SparkSession, sf_dir: str):
    targets = [(r[0], r[1], r[2]) for r in table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").collect()]  # a fixed table of twelve rows
    return targets, mixing.sized_documents(table(spark, sf_dir, "documents"), "doc_id", "source", "text", [t[0] for t in targets])


def _mixed(spark: SparkSession, sf_dir: str):
    targets, sized = _sized(spark, sf_dir)
    return mixing.mixture(sized, targets)


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, a row per use."""
    return _mixed(spark, sf_dir)[0]


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.share_report(*_mixed(spark, sf_dir))


@query
def p9_scarce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mixture as large as half of all documents: sources too small for their part give all they may and fall short."""
    targets, sized = _sized(spark, sf_dir)
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    chosen, plans = mixing.mixture(sized, targets, total_tokens=0.5 * total)
    report = mixing.share_report(chosen, plans)
    short = (F.col("available_tokens") > 0) & (F.col("target_share") - F.col("actual_share") > 0.001)
    return report.withColumn("falls_short", short)


@query
def p9_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture must not hold: rows here are faults."""
    return mixing.violations(*_mixed(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "source")


ORACLES["p9_violations"] = "SELECT '' AS source, '' AS problem WHERE false"
