"""Relational queries on the archive: scans, facets, gaps, neighbours, set operations, upserts, quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.operators import upserts
from colophon.plans.base import Queries
from colophon.sources.tables import table
from colophon.streaming import jobs

Q = Queries()


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "issues").where(F.col("status") == "active")


@Q.add("SELECT count(*) AS issues, min(published_at) AS first_date, max(published_at) AS last_date, count(DISTINCT year) AS years FROM issues WHERE status = 'active'")
def archive_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _active(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("issues"), F.min("published_at").alias("first_date"), F.max("published_at").alias("last_date"), F.countDistinct("year").alias("years")
    )


@Q.add(
    """WITH b AS (SELECT min(issue_number) AS lo, max(issue_number) AS hi FROM issues WHERE status = 'active')
SELECT CAST(n AS INTEGER) AS issue_number FROM (SELECT unnest(generate_series(lo, hi)) AS n FROM b) WHERE n NOT IN (SELECT issue_number FROM issues WHERE status = 'active' AND issue_number IS NOT NULL)"""
)
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers between the first and the last issue that no issue has."""
    numbers = _active(spark, sf_dir).select("issue_number").where("issue_number IS NOT NULL")
    ends = numbers.agg(F.min("issue_number").alias("lo"), F.max("issue_number").alias("hi")).where("lo IS NOT NULL")
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("issue_number")).join(numbers, "issue_number", "left_anti")


@Q.add(
    """SELECT issue_number, id, lag(issue_number) OVER (ORDER BY issue_number, id) AS previous_number, lead(issue_number) OVER (ORDER BY issue_number, id) AS next_number
FROM issues WHERE status = 'active' AND issue_number IS NOT NULL"""
)
def neighbour_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issue before and after each issue by number.

    A window over all issues would meet in one task; here each issue number range of 1,000 is a window of its own, and the
    numbers at the borders come from one row per range.
    """
    rows = _active(spark, sf_dir).where("issue_number IS NOT NULL").select("issue_number", "id").withColumn("range", F.floor(F.col("issue_number") / 1000))
    borders = rows.groupBy("range").agg(F.min("issue_number").alias("lo"), F.max("issue_number").alias("hi"))
    around = W.orderBy("range")  # one row per thousand numbers
    borders = borders.select("range", F.lag("hi").over(around).alias("before"), F.lead("lo").over(around).alias("after"))
    inside = W.partitionBy("range").orderBy("issue_number", "id")
    near = rows.withColumns({"previous_number": F.lag("issue_number").over(inside), "next_number": F.lead("issue_number").over(inside)}).join(borders, "range")
    return near.select("issue_number", "id", F.coalesce("previous_number", "before").alias("previous_number"), F.coalesce("next_number", "after").alias("next_number"))


@Q.add(
    """SELECT issue_id, keyword, rank, place FROM (SELECT issue_id, keyword, rank, row_number() OVER (PARTITION BY issue_id ORDER BY rank NULLS LAST, keyword) AS place
FROM (SELECT DISTINCT issue_id, keyword, rank FROM issue_topics)) WHERE place <= 3"""
)
def top_topics_per_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "issue_topics").select("issue_id", "keyword", "rank").distinct()
    place = F.row_number().over(W.partitionBy("issue_id").orderBy(F.col("rank").asc_nulls_last(), "keyword"))
    return rows.withColumn("place", place.cast("long")).where("place <= 3")


@Q.add(
    """SELECT run_id, count(*) AS jobs, sum(CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END) AS succeeded, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed,
sum(CASE WHEN status = 'deferred' THEN 1 ELSE 0 END) AS deferred, bool_or(status = 'failed') AS fail_fast, sum(CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END) = count(*) AS ready FROM pipeline_jobs GROUP BY run_id"""
)
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run the counts by status, and whether its last step may start."""
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    return table(spark, sf_dir, "pipeline_jobs").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("jobs"), count("succeeded").alias("succeeded"), count("failed").alias("failed"), count("deferred").alias("deferred"),
        F.bool_or(F.col("status") == "failed").alias("fail_fast"), (count("succeeded") == F.count(F.lit(1))).alias("ready"),
    )


@Q.add("SELECT count(*) AS repeated_keys, coalesce(sum(n), 0) AS their_rows FROM (SELECT semantic_key, count(*) AS n FROM pipeline_jobs WHERE semantic_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "pipeline_jobs").where("semantic_key IS NOT NULL").groupBy("semantic_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1").agg(F.count(F.lit(1)).alias("repeated_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("their_rows"))


@Q.add("SELECT url FROM crawl_pages WHERE lower(url) NOT IN (SELECT lower(source_url) FROM issues WHERE source_url IS NOT NULL)")
def new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses found that no issue has."""
    known = table(spark, sf_dir, "issues").where("source_url IS NOT NULL").select(F.lower("source_url").alias("_url"))
    pages = table(spark, sf_dir, "crawl_pages").select("url")
    return pages.join(known, F.lower("url") == F.col("_url"), "left_anti")


@Q.add("SELECT url FROM crawl_pages WHERE lower(url) NOT IN (SELECT lower(source_url) FROM issues WHERE source_url IS NOT NULL) ORDER BY url LIMIT 20")
def crawl_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty of them, in the order of their addresses."""
    return new_pages(spark, sf_dir).orderBy("url").limit(20)


@Q.add("SELECT id, CAST((row_number() OVER (PARTITION BY year ORDER BY id) - 1) // 10 AS BIGINT) AS batch, year FROM issues WHERE status = 'active'")
def rebuild_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues in batches of ten per year, for jobs of bounded size."""
    return jobs.paced(_active(spark, sf_dir).select("id", "year"), "year", "id", 10).select("id", "batch", "year")


@Q.add("SELECT id FROM issue_chunks WHERE issue_id NOT IN (SELECT id FROM issues WHERE status = 'active')")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose issue is gone."""
    return table(spark, sf_dir, "issue_chunks").select("id", "issue_id").join(_active(spark, sf_dir).select(F.col("id").alias("issue_id")), "issue_id", "left_anti").select("id")


@Q.add("SELECT id, issue_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY issue_id, chunk_index ORDER BY id DESC) AS p FROM issue_chunks) WHERE p > 1")
def superseded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks left over from an earlier ingest: another row holds their place."""
    place = F.row_number().over(W.partitionBy("issue_id", "chunk_index").orderBy(F.col("id").desc()))
    return table(spark, sf_dir, "issue_chunks").withColumn("p", place).where("p > 1").select("id", "issue_id", "chunk_index")


_CHANGES = "SELECT id || CASE WHEN issue_number % 2 = 0 THEN '' ELSE '-new' END AS id, 'Renamed ' || title AS title, source_url || '#2' AS source_url, 'active' AS status FROM issues WHERE issue_number IS NOT NULL AND issue_number <= 40"


@Q.add(
    f"""WITH ch AS ({_CHANGES})
SELECT coalesce(i.id, ch.id) AS id, coalesce(ch.title, i.title) AS title, coalesce(i.source_url, ch.source_url) AS source_url, coalesce(i.status, ch.status) AS status FROM issues i FULL JOIN ch ON i.id = ch.id"""
)
def upserted_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues after an upsert that may change titles, never addresses or states."""
    issues = table(spark, sf_dir, "issues").select("id", "title", "source_url", "status")
    early = table(spark, sf_dir, "issues").where("issue_number IS NOT NULL AND issue_number <= 40")
    suffix = F.when(F.col("issue_number") % 2 == 0, F.lit("")).otherwise(F.lit("-new"))
    changes = early.select(F.concat("id", suffix).alias("id"), F.concat(F.lit("Renamed "), "title").alias("title"), F.concat("source_url", F.lit("#2")).alias("source_url"), F.lit("active").alias("status"))
    return upserts.upserted(issues, changes, ["id"], ["title"])


@Q.add("SELECT id, CASE WHEN issue_number <= 10 THEN 'quarantined' ELSE status END AS status, title FROM issues")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns that a change names are set."""
    issues = table(spark, sf_dir, "issues")
    changes = issues.where("issue_number <= 10").select("id", F.lit("quarantined").alias("status"), F.lit(None).cast("string").alias("title"))
    return upserts.partially_updated(issues.select("id", "status", "title"), changes, "id")


@Q.add(
    """WITH r AS (SELECT issue_id, keyword, rank FROM issue_topics WHERE rank <= 2), k AS (SELECT DISTINCT issue_id FROM r WHERE rank = 1)
SELECT issue_id, keyword, rank FROM issue_topics WHERE issue_id NOT IN (SELECT issue_id FROM k) UNION ALL SELECT issue_id, keyword, rank FROM r WHERE issue_id IN (SELECT issue_id FROM k)"""
)
def replaced_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics of some issues replaced, all others as they were."""
    topics = table(spark, sf_dir, "issue_topics").select("issue_id", "keyword", "rank")
    fresh = topics.where("rank <= 2")
    first = topics.where("rank = 1").select("issue_id").distinct()
    return upserts.replaced(topics, fresh.join(first, "issue_id", "left_semi"), "issue_id")


_FENCE_SQL = """
WITH seen AS (SELECT keyword, coalesce(doc_frequency, 0) AS version FROM corpus_topics), now_ AS (SELECT keyword, coalesce(doc_frequency, 0) + CASE WHEN burst_score > 4 THEN 1 ELSE 0 END AS version FROM corpus_topics),
stable AS (SELECT keyword FROM seen SEMI JOIN now_ USING (keyword, version)), e AS (SELECT DISTINCT keyword_a, keyword_b, 'old' AS state FROM topic_similarity),
f AS (SELECT DISTINCT keyword_a, keyword_b, 'fresh' AS state FROM topic_similarity WHERE blended >= 0.6 AND NOT isnan(blended))
SELECT * FROM e WHERE NOT (keyword_a IN (SELECT keyword FROM stable) AND keyword_b IN (SELECT keyword FROM stable))
UNION ALL SELECT * FROM f WHERE keyword_a IN (SELECT keyword FROM stable) AND keyword_b IN (SELECT keyword FROM stable)"""


@Q.add(_FENCE_SQL)
def fenced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity edges after an incremental rebuild: only those whose ends didn't change meanwhile are replaced."""
    corpus = table(spark, sf_dir, "corpus_topics")
    version = F.coalesce("doc_frequency", F.lit(0))
    seen = corpus.select("keyword", version.alias("version"))
    now = corpus.select("keyword", (version + F.when(F.col("burst_score") > 4, 1).otherwise(0)).alias("version"))
    pairs = table(spark, sf_dir, "topic_similarity")
    edges = pairs.select("keyword_a", "keyword_b", F.lit("old").alias("state")).distinct()
    fresh = pairs.where((F.col("blended") >= 0.6) & ~F.isnan("blended")).select("keyword_a", "keyword_b", F.lit("fresh").alias("state")).distinct()
    return upserts.fenced_edges(edges, seen, now, fresh)


@Q.add("SELECT keyword FROM issue_topics UNION SELECT keyword FROM corpus_topics")
def keyword_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "issue_topics").select("keyword").union(table(spark, sf_dir, "corpus_topics").select("keyword")).distinct()


@Q.add("SELECT keyword FROM issue_topics INTERSECT SELECT keyword FROM corpus_topics")
def keyword_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "issue_topics").select("keyword").intersect(table(spark, sf_dir, "corpus_topics").select("keyword"))


@Q.add("SELECT keyword FROM corpus_topics EXCEPT SELECT keyword FROM issue_topics")
def stale_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus_topics").select("keyword").subtract(table(spark, sf_dir, "issue_topics").select("keyword"))


@Q.add("SELECT keyword, burst_score, aggregate_score FROM corpus_topics ORDER BY burst_score DESC NULLS LAST, aggregate_score DESC NULLS LAST, keyword LIMIT 50 OFFSET 50")
def topics_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of fifty topics by burst; unknown bursts come last."""
    order = [F.col("burst_score").desc_nulls_last(), F.col("aggregate_score").desc_nulls_last(), F.col("keyword").asc()]
    return table(spark, sf_dir, "corpus_topics").orderBy(*order).offset(50).limit(50).select("keyword", "burst_score", "aggregate_score")


@Q.add(
    """SELECT quality_status, count(*) AS topics, sum(CASE WHEN doc_frequency IS NULL THEN 1 ELSE 0 END) AS no_frequency, sum(CASE WHEN eligibility_status = 'public_topic' AND quality_status = 'valid' THEN 1 ELSE 0 END) AS public FROM corpus_topics GROUP BY 1"""
)
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = (F.col("eligibility_status") == "public_topic") & (F.col("quality_status") == "valid")
    return table(spark, sf_dir, "corpus_topics").groupBy("quality_status").agg(
        F.count(F.lit(1)).alias("topics"), F.sum(F.col("doc_frequency").isNull().cast("long")).alias("no_frequency"), F.sum(F.when(public, 1).otherwise(0)).alias("public")
    )


@Q.add(
    """SELECT rule, count(*) AS checked, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS failed FROM (
SELECT 'title' AS rule, title IS NOT NULL AND title <> '' AS ok FROM issues UNION ALL SELECT 'date', published_at IS NOT NULL AND TRY_CAST(published_at AS DATE) IS NOT NULL FROM issues
UNION ALL SELECT 'body', coalesce(length(full_text_plain), 0) > 100 FROM issues UNION ALL SELECT 'words', coalesce(word_count, 0) > 0 FROM issues UNION ALL SELECT 'month', month IS NOT NULL AND month BETWEEN 1 AND 12 FROM issues) GROUP BY rule"""
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many issues break each rule, in one scan."""
    rules = {
        "title": F.col("title").isNotNull() & (F.col("title") != ""),
        "date": F.try_to_date("published_at", "yyyy-MM-dd").isNotNull(),
        "body": F.coalesce(F.length("full_text_plain"), F.lit(0)) > 100,
        "words": F.coalesce("word_count", F.lit(0)) > 0,
        "month": F.coalesce(F.col("month").between(1, 12), F.lit(False)),
    }
    checks = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in rules.items()])
    rows = table(spark, sf_dir, "issues").select(F.explode(checks).alias("c")).select("c.*")
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("checked"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("failed"))


@Q.add(
    """WITH gold AS (SELECT DISTINCT issue_id, lower(keyword) AS k FROM issue_topics WHERE rank <= 5), got AS (SELECT DISTINCT issue_id, lower(keyword) AS k FROM issue_topics WHERE score <= 0.15),
h AS (SELECT g.issue_id, count(x.k) AS hits FROM gold g LEFT JOIN got x USING (issue_id, k) GROUP BY 1)
SELECT count(*) AS issues, round(avg(hits), 6) AS mean_hits, min(hits) AS least_hits, sum(CASE WHEN hits >= 3 THEN 1 ELSE 0 END) AS with_three, sum(CASE WHEN hits >= 4 THEN 1 ELSE 0 END) AS with_four FROM h"""
)
def hits_at_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the five topics expected of an issue a cut by score keeps."""
    rows = table(spark, sf_dir, "issue_topics").select("issue_id", F.lower("keyword").alias("k"), "rank", "score")
    gold = rows.where("rank <= 5").select("issue_id", "k").distinct()
    got = rows.where("score <= 0.15").select("issue_id", "k").distinct().withColumn("hit", F.lit(1))
    hits = gold.join(got, ["issue_id", "k"], "left").groupBy("issue_id").agg(F.count("hit").alias("hits"))
    return hits.agg(
        F.count(F.lit(1)).alias("issues"), F.round(F.avg("hits"), 6).alias("mean_hits"), F.min("hits").alias("least_hits"),
        F.sum((F.col("hits") >= 3).cast("long")).alias("with_three"), F.sum((F.col("hits") >= 4).cast("long")).alias("with_four"),
    )


@Q.add("SELECT j.issue_id, t.keyword FROM (SELECT DISTINCT payload_json->>'$.issueId' AS issue_id FROM pipeline_jobs WHERE kind = 'rebuild-issue-topics') j JOIN (SELECT DISTINCT issue_id, keyword FROM issue_topics) t USING (issue_id)")
def requested_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the issues that job payloads name."""
    jobs = table(spark, sf_dir, "pipeline_jobs").where("kind = 'rebuild-issue-topics'")
    asked = jobs.select(F.get_json_object("payload_json", "$.issueId").alias("issue_id")).distinct()
    return table(spark, sf_dir, "issue_topics").select("issue_id", "keyword").distinct().join(asked, "issue_id", "left_semi")


@Q.add(
    """SELECT c_mktsegment AS segment, n_name AS nation, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2"""
)
def revenue_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join with filters pushed into the scans; the size of each side decides how it is joined."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    per_order = lines.groupBy("l_orderkey").agg(F.sum("amount").alias("amount"))
    rows = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("amount"), 2).alias("revenue"))


QUERIES, ORACLES = Q.functions, Q.sql
