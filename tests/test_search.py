import math

import pytest
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.functions import vectors as V
from colophon.functions.porter import porter
from colophon.operators import fusion, lexical, semantic

ISSUES = [
    ("1", "Trust in systems", None, "a | b", None, "trust trust and more trust", None),
    ("2", "Other", "trust", None, "summary", "systems of systems", None),
    ("3", None, None, None, None, None, None),
    ("4", "Systems thinking", None, None, None, "we trust systems thinking here", "someone"),
]
SCHEMA = "id string, title string, subtitle string, headings string, summary string, full_text_plain string, contributors string"


def test_bm25_against_the_formula(spark):
    rows = spark.createDataFrame(ISSUES, SCHEMA)
    got = {r.doc_id: r.bm25 for r in lexical.bm25(rows, "id", [["trust"], ["systems"]]).collect()}
    weights = dict(zip(SCHEMA.replace(" string", "").split(", ")[1:], (16, 8, 8, 4, 1, 2)))
    docs = {i[0]: {f: (t or "").lower().replace("|", " ").split() for f, t in zip(weights, i[1:])} for i in ISSUES}
    n, lengths = len(docs), {d: sum(map(len, f.values())) for d, f in docs.items()}
    average = sum(lengths.values()) / n
    want = {}
    for d, fields in docs.items():
        total = 0.0
        for term in ("trust", "systems"):
            hits = sum(any(term in f for f in other.values()) for other in docs.values())
            idf = max(math.log((n - hits + 0.5) / (hits + 0.5)), 1e-6)
            f = sum(weights[name] * words.count(term) for name, words in fields.items())
            total += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[d] / average)) if f else -math.inf
        if total > -math.inf:
            want[d] = -total
    assert got == pytest.approx(want)


def test_phrases_and_empty_queries(spark):
    rows = spark.createDataFrame(ISSUES, SCHEMA)
    assert [r.doc_id for r in lexical.bm25(rows, "id", [["systems", "thinking"]]).collect()] == ["4"]
    assert lexical.bm25(rows, "id", []).count() == 0
    assert lexical.bm25(rows.where(F.lit(False)), "id", [["trust"]]).count() == 0
    assert lexical.bm25(rows, "id", [["trusting"]], stemmed=True).count() == 3


def test_highlight_and_suggestions(spark):
    rows = spark.createDataFrame(ISSUES, SCHEMA)
    text = F.lit("one two Three, four five six seven")
    assert rows.limit(1).select(lexical.highlight(text, ["three", "five"], 3).alias("h")).first().h == "... <mark>Three,</mark> four <mark>five</mark> ..."
    assert rows.limit(1).select(lexical.highlight(F.lit(None).cast("string"), ["x"]).alias("h")).first().h == ""
    assert [r.word for r in lexical.suggestions(rows, ["title", "full_text_plain"], "see sys").collect()] == ["systems"]
    assert lexical.suggestions(rows, ["title"], "s").count() == 0


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("sky", "sky"), ("electriciti", "electr"), ("adjustable", "adjust"), ("probate", "probat"), ("controll", "control"), ("agreed", "agre"), ("é", "é")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_light_stem_and_dice(spark):
    frame = spark.createDataFrame([(w,) for w in ("models", "running", "shipped", "studies", "organisation", "class", "is")], "w string")
    assert [r.s for r in frame.select(T.stem(F.col("w")).alias("s")).collect()] == ["model", "run", "ship", "study", "organise", "class", "is"]
    pair = spark.createDataFrame([("night", "nacht")], "a string, b string")
    assert pair.select(T.dice(T.character_bigrams(F.col("a")), T.character_bigrams(F.col("b"))).alias("d")).first().d == pytest.approx(0.25)


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.c for r in rows.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == pytest.approx([1 / math.sqrt(2), 0, 0, 0])


def test_filter_comes_before_top_k(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)], "k int, e array<double>, odd int")
    found = semantic.top_chunks(rows, "k", "e", [1.0, 0.0], F.col("odd") == 1, top=3)
    assert [r.k for r in found.orderBy(F.desc("score")).collect()] == [19, 17, 15]


def test_searches_of_many_queries(spark):
    rows = spark.createDataFrame([(i, i // 4, [float(i % 7), 1.0], i % 3) for i in range(40)], "k int, doc int, e array<double>, kind int")
    queries = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 1.0], 5)], "q int, query_vector array<double>, wanted int")
    found = semantic.top_chunks_each(queries, rows, "q", "k", "e", F.col("kind") == F.col("wanted"), top=4, blocks=3).collect()
    for q, vector, wanted in ((0, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 1.0], 5)):
        alone = rows.where(F.col("kind") == wanted).withColumn("score", F.round(V.cosine(F.col("e"), V.vector(vector)), 6))
        want = alone.orderBy(F.desc("score"), "k").limit(4).collect()  # equal scores of k, k + 21, ... go by k
        assert sorted((r.k, r.score) for r in found if r.q == q) == sorted((r.k, r.score) for r in want)
        scored = rows.withColumn("score", F.round(V.cosine(F.col("e"), V.vector(vector)), 6))
        want = semantic.collapsed(scored, "doc", "k", floor=0.3, top=5).collect()
        got = semantic.collapsed(semantic.query_scores(queries, rows, "k", "e", blocks=3), "doc", "k", floor=0.3, top=5, query="q").where(F.col("q") == q).drop("q")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) == 5


def _fused(spark, rows):
    schema = "issue_id string, lexical_rank int, semantic_rank int, chunk_count int, lexical_hits int, title string, subtitle string, headings string, full_text_plain string, issue_number int"
    frame = spark.createDataFrame(rows, schema)
    phrases = F.array(F.lit("mental models"))
    points = fusion.boosts(phrases, F.lit("maps"), F.lit(7), F.lit(None).cast("boolean"), F.col("lexical_hits"))
    frame = frame.withColumns({f"p_{k}": v for k, v in points.items()})
    named = {k: F.col(f"p_{k}") for k in points}
    return {r.issue_id: r.asDict() for r in frame.withColumn("confidence", fusion.confidence(named)).withColumn("rrf", fusion.reciprocal_ranks()).collect()}


def test_boosts_and_confidence(spark):
    got = _fused(spark, [
        ("a", 1, 2, 2, 3, "Maps", None, "On mental models", "mental models, again", 7),
        ("b", None, 1, 1, 3, "x", None, None, None, None),
        ("c", None, 1, 1, 2, "Mental Models", None, None, None, 1),
        ("d", 4, None, None, 3, None, None, None, None, None),
    ])
    a = got["a"]
    assert (a["p_exact_issue"], a["p_phrase_title"], a["p_phrase_heading"], a["p_phrase_body"]) == (10.0, 0.0, 4.0, 3.0)
    assert (a["p_title_overlap"], a["p_lexical_semantic_agreement"], a["p_multi_chunk_support"], a["p_semantic_only_penalty"]) == (1.5, 1.25, 0.75, 0.0)
    assert a["rrf"] == pytest.approx(1 / 41 + 0.55 / 42)
    assert got["b"]["p_semantic_only_penalty"] == -3.5 and got["b"]["confidence"] == "low"
    assert got["c"]["confidence"] == "high" and got["c"]["p_semantic_only_penalty"] == 0.0
    assert got["d"]["confidence"] == "medium"


def test_snippet_section():
    sections = [("lead_essay", "On maps", "A map is not the territory it shows at all"), ("book", "Book for your shelf", "Read this very good book about bridges")]
    assert fusion.snippet_section("<mark>Read</mark> this very good book about", sections) == "book"
    assert fusion.snippet_section("see: book for your shelf", sections) == "book"
    assert fusion.snippet_section("and so not the territory it is", sections) == "lead_essay"
    assert fusion.snippet_section("nothing of this", sections) is None and fusion.snippet_section(None, sections) is None


def test_facets_add_up(spark, sf):
    from colophon.plans import search

    results = search.hybrid_results(spark, sf)
    total = results.count()
    assert search.section_facets(spark, sf).agg(F.sum("hits")).first()[0] == total
    dated = results.where("published_at IS NOT NULL").count()
    assert search.quarter_section_histogram(spark, sf).agg(F.sum("hits")).first()[0] == dated
    per_query = results.groupBy("query_id").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"))
    assert per_query.where("m <> n").isEmpty()
