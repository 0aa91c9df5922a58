import pytest
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import lexical, search, search_index

FIELDS = ("title", "body")
WEIGHTS = {"title": 4.0, "body": 1.0}
ROWS = [("a", "Café maps", "the quiet map of the city"), ("b", "Quiet city", None), ("c", None, "maps and more maps; a quiet map of cafes"), ("d", "", ""), ("e", "city quiet", "quiet " * 5000)]
DOCS = "id string, title string, body string"


def _scores(frame):
    return {r.doc_id: round(r.bm25, 9) for r in frame.collect()}


@pytest.mark.parametrize("groups", [[["quiet"]], [["quiet", "city"]], [["map"], ["quiet", "map"]], [["absent"]], [["the"], ["city"]]])
def test_index_equals_scan(spark, groups):
    docs = spark.createDataFrame(ROWS, DOCS)
    index = search_index.build(docs, "id", FIELDS, buckets=4)
    assert _scores(search_index.bm25(index, groups, WEIGHTS)) == _scores(lexical.bm25(docs, "id", groups, WEIGHTS))


def test_folding_stems_and_nothing(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    assert T.fold("Éclair ñandú café") == "Eclair nandu cafe"
    assert docs.select(T.folded(F.lit("Ćafé ÜBER"))).first()[0] == "Cafe UBER"
    index = search_index.build(docs, "id", FIELDS)
    assert set(_scores(search_index.bm25(index, [["café"]]))) == set(_scores(search_index.bm25(index, [["CAFE"]]))) == {"a"}
    stems = search_index.build(docs, "id", FIELDS, stemmed=True)
    assert set(_scores(search_index.bm25(stems, [["cafes"]]))) == {"a", "c"}
    assert search_index.bm25(index, []).count() == 0
    assert search_index.bm25(search_index.build(docs.where("false"), "id", FIELDS), [["quiet"]]).count() == 0


def test_only_buckets_of_the_words_are_read(spark):
    index = search_index.build(spark.createDataFrame(ROWS, DOCS), "id", FIELDS, buckets=16)
    plan = index.postings(["quiet"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,quiet)]" in plan


def test_update_replaces(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    old = spark.createDataFrame([("a", "Other", "city"), ("x", "quiet", "gone"), ("b", "Quiet city", None)], DOCS)
    changed = docs.where("id <> 'b'")
    index = search_index.updated(search_index.build(old, "id", FIELDS), changed, "id", spark.createDataFrame([("x",)], "id string"))
    assert (index.documents, len(index.segments)) == (5, 2)
    for groups in ([["quiet"]], [["city"]], [["quiet", "city"]]):
        assert _scores(search_index.bm25(index, groups, WEIGHTS)) == _scores(lexical.bm25(docs, "id", groups, WEIGHTS))
    again = search_index.updated(index, spark.createDataFrame([("a", "city", None)], DOCS), "id")
    assert set(_scores(search_index.bm25(again, [["map"]]))) == {"c"}


ISSUES = "id string, title string, subtitle string, headings string, full_text_plain string, issue_number int, published_at string, year int"


def _archive(spark, rows):
    issues = spark.createDataFrame(rows, ISSUES)
    index = search_index.build(issues, "id", ("title", "full_text_plain"))
    topics = spark.createDataFrame([("a", "Slow  Maps"), ("b", None), ("c", "slow maps")], "issue_id string, keyword string")
    chunks = spark.createDataFrame([(1, "a", "lens", [1.0, 0.0]), (2, "a", "book", [0.9, 0.1]), (3, "b", "lens", [0.8, 0.6]), (4, "c", None, [1.0, 0.1]), (5, "n", "lens", None)], "chunk_id long, issue_id string, section_label string, embedding array<double>")
    return index, issues, topics, chunks


ARCHIVE = [("a", "Slow maps", None, None, "a slow map", 1, "2022-01-05", 2022), ("b", "City", "x", "y", "slow city", 2, None, None), ("c", None, None, None, None, None, "2023-05-01", 2023), ("n", "News", "", "", "slow news", 3, "2024-01-01", 2024)]


def test_paths_of_a_search(spark):
    archive = _archive(spark, ARCHIVE)
    ids = lambda raw, **more: [r.issue_id for r in search.search(raw, *archive, **more).orderBy("rank").collect()]
    east = lambda text: [1.0, 0.0]
    assert set(ids("slow")) == {"a", "b", "n"}
    assert ids("after:2022-06") == ["n", "c"] and ids("topic:slow-maps") == ["c", "a"] and ids("year:2024") == ["n"]
    assert set(ids("slow", embed=east)) == {"a", "b", "c", "n"}  # c by its vector alone
    assert ids("slow", embed=east)[0] == "a"
    assert set(ids("slow", embed=east, semantic_floor=1.1)) == {"a", "b", "n"}
    assert set(ids("slow before:2023", embed=east)) == {"a", "b"}  # b has no date: by its vector, not by its words
    assert set(ids("slow section:lens", embed=east)) == {"a", "b", "n"}
    assert ids("slow", page=2, limit=2) == ids("slow")[2:] and ids("absent") == [] and ids('"slow map"')[0] == "a"
    row = next(r for r in search.search("slow maps", *archive, embed=east).collect() if r.issue_id == "a")
    assert row.lexical_rank == 1 and row.semantic_rank == 1 and row.confidence == "medium"
    assert search.search("slow issue:1", *archive).where("issue_id = 'a'").first().confidence == "high"


def test_search_of_nothing(spark):
    archive = _archive(spark, [])
    assert search.search("slow", *archive, embed=lambda t: [1.0, 0.0]).count() == 0
    assert search.search("year:2022", *archive).count() == 0
