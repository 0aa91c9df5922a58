"""Searches from a query's text to a page of results, over stored indexes of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import dictionaries as D
from colophon.operators import lexical, search, search_index
from colophon.plans.base import Queries
from colophon.sources.tables import table

Q = Queries()

FIELDS = tuple(D.FIELD_WEIGHTS)
WORDS_SQL = "regexp_extract_all(lower(strip_accents(coalesce({0}, ''))), '[\\p{{L}}\\p{{N}}]+')"
#: The identifier of the vector that stands for the embedding of a query's text: no model is at hand.
QUERY_VECTOR = 7
_indexes: dict[tuple, search_index.SearchIndex] = {}


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "issues").where(F.col("status") == "active")


def index_of(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> search_index.SearchIndex:
    """The index of the active issues, built once in a session for each folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir, stemmed)
    if key not in _indexes:
        _indexes[key] = search_index.build(_active(spark, sf_dir), "id", FIELDS, stemmed=stemmed)
    return _indexes[key]


def bm25_sql(groups: list[list[str]]) -> str:
    """SQL up to ``scored`` (doc_id, score) of the active issues that hold every group of words."""
    tokens = ", ".join(f"{WORDS_SQL.format(f)} AS t_{f}" for f in FIELDS)
    count = lambda f, g: (
        f"len(list_filter(t_{f}, lambda x: x = '{g[0]}'))" if len(g) == 1 else f"len(list_filter(generate_series(1, len(t_{f})), lambda i: array_to_string(t_{f}[i:i+{len(g) - 1}], ' ') = '{' '.join(g)}'))"
    )
    f_sql = ", ".join("(" + " + ".join(f"{w} * {count(f, g)}" for f, w in D.FIELD_WEIGHTS.items()) + f") AS f{i}" for i, g in enumerate(groups))
    length = " + ".join(f"len(t_{f})" for f in FIELDS)
    n = len(groups)
    idf = lambda i: f"greatest(ln((n - h{i} + 0.5) / (h{i} + 0.5)), 1e-6)"
    terms = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(n))
    return f"""WITH t AS (SELECT id, {tokens} FROM issues WHERE status = 'active'),
c AS (SELECT id, CAST({length} AS DOUBLE) AS dl, {f_sql} FROM t),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS av, {", ".join(f"CAST(sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS h{i}" for i in range(n))} FROM c),
scored AS (SELECT id AS doc_id, -({terms}) AS score FROM c, s WHERE {" AND ".join(f"f{i} > 0" for i in range(n))})"""


_TOP_SQL = " SELECT doc_id, round(score, 6) AS bm25, row_number() OVER (ORDER BY score, doc_id) AS rank FROM scored ORDER BY score, doc_id LIMIT 20"


def _best(index: search_index.SearchIndex, groups: list[list[str]]) -> DataFrame:
    rows = lexical.ranked(search_index.bm25(index, groups), 20)
    return rows.select("doc_id", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("long").alias("rank"))


@Q.add(bm25_sql([["market"], ["season"]]) + _TOP_SQL)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words, both required: the 20 best issues."""
    return _best(index_of(spark, sf_dir), [["market"], ["season"]])


@Q.add(bm25_sql([["never", "quite", "recovered"], ["lattice"]]) + _TOP_SQL)
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase and a word."""
    return _best(index_of(spark, sf_dir), [["never", "quite", "recovered"], ["lattice"]])


@Q.add()
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words match by their Porter stem."""
    return _best(index_of(spark, sf_dir, stemmed=True), [["gardeners"], ["mapped"]])


@Q.add(bm25_sql([["market"], ["season"]]) + _TOP_SQL)
def updated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search after an update: the index knew issues up to 2022, and later ones by their title alone; then those are
    indexed anew, which replaces what it held of them."""
    active = _active(spark, sf_dir)
    late = F.coalesce(F.col("year") >= 2023, F.lit(False))
    stale = active.withColumns({f: F.when(~late, F.col(f)) for f in FIELDS if f != "title"})
    index = search_index.build(stale, "id", FIELDS)
    return _best(search_index.updated(index, active.where(late), "id"), [["market"], ["season"]])


def _results(spark: SparkSession, sf_dir: str, raw: str, vector: int | None, **options) -> DataFrame:
    """A page of results for ``raw``; chunks of vectors belong to the issue of the number vec_id // 4."""
    active = _active(spark, sf_dir)
    issues = active.select("id", "title", "subtitle", "headings", "full_text_plain", "issue_number", "published_at", "year")
    numbered = active.where("issue_number IS NOT NULL").groupBy("issue_number").agg(F.min("id").alias("issue_id"))
    vectors = table(spark, sf_dir, "embeddings")
    chunks = vectors.withColumn("issue_number", F.floor(F.col("vec_id") / 4).cast("int")).join(numbered, "issue_number")
    chunks = chunks.select(F.col("vec_id").alias("chunk_id"), "issue_id", F.lit("other").alias("section_label"), "embedding")

    def embed(text: str):
        row = vectors.where(F.col("vec_id") == vector).select("embedding").first()
        return None if row is None else list(row[0])

    topics = table(spark, sf_dir, "issue_topics").select("issue_id", "keyword")
    page = search.search(raw, index_of(spark, sf_dir), issues, topics, chunks, embed if vector is not None else None, chunk_floor=0.05, semantic_floor=0.3, **options)
    return page.withColumns({"final_score": F.round("final_score", 6), "lexical_rank": F.col("lexical_rank").cast("long"), "semantic_rank": F.col("semantic_rank").cast("long"), "rank": F.col("rank").cast("long")})


_COSINE = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {QUERY_VECTOR})), 6)"


def _page_sql(groups: list[list[str]], phrases: list[str], free_text: str, bounds: str, near: str, topics: list[str], semantic: bool, offset: int) -> str:
    """SQL of a page of 20: ``bounds`` filters the lexical side, ``near`` the chunks."""
    listed = ", ".join(f"'{p}'" for p in phrases)
    any_phrase = lambda *columns: " + ".join(f"CASE WHEN {' OR '.join(f"coalesce(contains(lower({c}), '{p}'), false)" for c in columns)} THEN 1 ELSE 0 END" for p in phrases) or "0"
    words = ", ".join(f"'{w}'" for w in free_text.split())
    return f"""{bm25_sql(groups)},
a AS (SELECT * FROM issues WHERE status = 'active'),
lex AS (SELECT doc_id AS issue_id, row_number() OVER (ORDER BY score, doc_id) AS lexical_rank FROM scored JOIN a ON a.id = doc_id WHERE {bounds} ORDER BY score, doc_id LIMIT 500),
numbered AS (SELECT issue_number, min(id) AS issue_id FROM a WHERE issue_number IS NOT NULL GROUP BY 1),
near AS (SELECT vec_id, issue_id, {_COSINE} AS score FROM embeddings JOIN numbered ON numbered.issue_number = vec_id // 4 JOIN a ON a.id = issue_id WHERE {near} ORDER BY score DESC, vec_id LIMIT 15),
sem AS (SELECT issue_id, max(score) AS top_score, count(*) AS chunk_count, row_number() OVER (ORDER BY max(score) DESC, issue_id) AS semantic_rank FROM near WHERE score >= 0.05 AND {str(semantic).lower()} GROUP BY 1),
fused AS (SELECT *, (SELECT count(*) FROM lex) AS lexical_hits FROM lex FULL JOIN sem USING (issue_id) WHERE lexical_rank IS NOT NULL OR top_score >= 0.3),
points AS (SELECT f.*, 6.0 * ({any_phrase("title")}) AS pt, 4.0 * ({any_phrase("subtitle", "headings")}) AS ph, 3.0 * ({any_phrase("full_text_plain")}) AS pb,
    len(list_filter([{words}]::VARCHAR[], lambda w: list_contains(string_split(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g'), ' '), w))) AS overlap,
    issue_id IN (SELECT issue_id FROM issue_topics WHERE trim(regexp_replace(lower(keyword), '\\s+', ' ', 'g')) IN ({", ".join(f"'{t}'" for t in topics)})) AS topic_hit FROM fused f JOIN a ON a.id = f.issue_id),
final AS (SELECT issue_id, lexical_rank, semantic_rank, top_score, round(coalesce(1.0 / (40.0 + lexical_rank), 0.0) + coalesce(0.55 / (40.0 + semantic_rank), 0.0) + pt + ph + pb
    + CASE WHEN overlap >= 2 OR (overlap = 1 AND len([{words}]) = 1) THEN 1.5 ELSE 0.0 END + CASE WHEN lexical_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 1.25 ELSE 0.0 END
    + CASE WHEN topic_hit THEN 1.5 ELSE 0.0 END + CASE WHEN chunk_count > 1 AND semantic_rank IS NOT NULL THEN 0.75 ELSE 0.0 END + CASE WHEN lexical_rank IS NULL AND lexical_hits >= 3 THEN -3.5 ELSE 0.0 END, 6) AS final_score,
    CASE WHEN pt > 0 OR pb > 0 THEN 'high' WHEN lexical_rank IS NULL AND lexical_hits >= 3 THEN 'low' ELSE 'medium' END AS confidence FROM points)
SELECT *, row_number() OVER (ORDER BY final_score DESC, lexical_rank NULLS LAST, semantic_rank NULLS LAST, issue_id) AS rank FROM final
QUALIFY rank > {offset} AND rank <= {offset + 20}""".replace("[]) = 1", "[]::VARCHAR[]) = 1")


_DATES = "published_at > '2019-01-01' AND published_at < '2025-01-01'"


@Q.add(_page_sql([["market"], ["season"]], [], "market season", _DATES, f"(published_at IS NULL OR ({_DATES}))", ["market season"], True, 0))
def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of a search by words and vector between two dates."""
    return _results(spark, sf_dir, "market season after:2019 before:2025", QUERY_VECTOR)


@Q.add(_page_sql([["never", "quite", "recovered"], ["lattice"]], ["never quite recovered"], "lattice", "true", "true", ["lattice", "never quite recovered"], False, 20))
def searched_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of a search for a phrase and a word where no vector is at hand."""
    return _results(spark, sf_dir, '"never quite recovered" lattice', None, page=2)


@Q.add(
    f"""SELECT id AS issue_id, CAST(NULL AS BIGINT) AS lexical_rank, CAST(NULL AS BIGINT) AS semantic_rank, CAST(NULL AS DOUBLE) AS top_score, CAST(0 AS DOUBLE) AS final_score, 'medium' AS confidence, row_number() OVER (ORDER BY published_at DESC, id) AS rank
FROM issues WHERE status = 'active' AND {_DATES} AND id IN (SELECT issue_id FROM issue_topics WHERE trim(regexp_replace(regexp_replace(lower(keyword), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) = 'slow feedback') QUALIFY rank <= 20"""
)
def searched_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters without text: the newest issues of a topic between two dates."""
    return _results(spark, sf_dir, 'topic:"Slow Feedback" after:2019 before:2025', None)


QUERIES, ORACLES = Q.functions, Q.sql
