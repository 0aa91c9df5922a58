"""One key on nine tenths of the rows, and the pieces of the job pipeline that need no stream."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import ingest, skew, topics, upserts
from colophon.streaming import jobs


def test_numbers_within_a_hot_group(spark):
    rows = [("hot" if i % 10 else None if i % 20 else "cold", f"k{i:04d}", i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "g string, k string, x int").repartition(7)
    got = skew.numbered_within(frame, ["g"], ["k"], "n").collect()
    seen = Counter()
    for r in sorted(got, key=lambda r: r.k):
        seen[r.g] += 1
        assert r.n == seen[r.g]
    assert len(got) == 1000 and seen["hot"] == 900
    assert skew.numbered_within(frame.where("false"), ["g"], ["k"], "n").count() == 0
    batches = Counter((r.g, r.batch) for r in jobs.paced(frame, "g", "k", 10).collect())
    assert set(batches.values()) == {10} and len(batches) == 100


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_fenced_edges_of_a_hot_keyword(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    edges = [("hub", f"k{i}", 0.5) for i in range(90)] + [(f"k{i}", f"k{i + 1}", 0.5) for i in range(9)] + [(None, "k1", 0.1)]
    frame = spark.createDataFrame(edges, "keyword_a string, keyword_b string, s double")
    before = spark.createDataFrame([("hub", 1)] + [(f"k{i}", 1) for i in range(90)], "keyword string, version int")
    now = before.withColumn("version", F.when(F.col("keyword") == "k3", 2).otherwise(F.col("version")))
    fresh = spark.createDataFrame([("hub", "k1", 0.9), ("hub", "k3", 0.9)], "keyword_a string, keyword_b string, s double")
    got = sorted(map(str, (tuple(r) for r in upserts.fenced_edges(frame, before, now, fresh).collect())))
    assert got == sorted(map(str, [("hub", "k3", 0.5), ("k2", "k3", 0.5), ("k3", "k4", 0.5), (None, "k1", 0.1), ("hub", "k1", 0.9)]))


def test_duplicates_of_a_hot_hash(spark):
    schema = "id string, source_url string, content_hash string, issue_number int, published_at string, status string"
    old = spark.createDataFrame([("o1", "u1", "h", 1, "2020", "active"), ("o0", "u2", "h", None, None, "active"), ("o3", None, None, 3, "2021", "gone")], schema)
    new = spark.createDataFrame([(f"n{i}", None, "h", None, None, "active") for i in range(90)] + [("x", "u1", "h", 9, None, "active"), ("y", "u9", None, 3, "2021", "active"), ("z", "u2", "other", 1, "2020", "active")], schema)
    got = {r.id: (r.duplicate_of, r.reason, r.unchanged) for r in ingest.duplicate_decisions(new, old).collect()}
    assert len(got) == 93 and all(got[f"n{i}"] == ("o0", "content_hash", True) for i in range(90))
    assert got["x"] == ("o1", "source_url", True) and got["y"] == (None, None, False) and got["z"] == ("o0", "source_url", False)
    assert ingest.duplicate_decisions(new.where("false"), old).count() == 0


def test_fnv1a_and_escapes(spark):
    row = spark.createDataFrame([("", "a", "foobar", None, "a<b & \"c\" 'd' <mark>e</mark>")], "e string, a string, f string, n string, t string")
    got = row.select(*[jobs.fnv1a(F.col(c)).alias(c) for c in "eafn"], T.escaped(F.col("t"), True).alias("t"), T.escaped(F.col("n")).alias("x")).first()
    assert (got.e, got.a, got.f, got.n) == ("811c9dc5", "e40c292c", "bf9cf968", None)
    assert got.t == "a&lt;b &amp; &quot;c&quot; &#39;d&#39; <mark>e</mark>" and got.x is None


JOBS = "id string, run_id string, kind string, status string, attempts int, error string, queued_at string, started_at string, completed_at string"


def test_job_pipeline(spark):
    rows = spark.createDataFrame(
        [
            ("1", "a", "work", "succeeded", 1, None, "2024-01-01T00:00:00Z", "x", "x"), ("2", "a", "work", "queued", None, None, "2024-01-01T00:00:00Z", None, None), ("3", "b", "work", "failed", 3, "bad", "2024-01-01T02:00:00Z", "x", "x"),
            ("4", "c", "topic-finalize-rebuild", "queued", 0, None, "2024-01-01T02:30:00Z", None, None), ("5", None, "work", "queued", 1, None, None, None, None),
        ],
        JOBS,
    )
    assert [r.run_id for r in jobs.ready_to_finish(rows).collect()] == ["b"]
    assert [r.id for r in jobs.never_sent(rows).collect()] == ["2"]
    claims = spark.createDataFrame([("2", "queued", None), ("2", "queued", None), ("4", "queued", 7), ("3", "queued", 3), (None, "queued", 1)], "id string, expected string, attempts int")
    after = {r.id: (r.status, r.attempts) for r in jobs.claimed(rows, claims).collect()}
    assert after == {"1": ("succeeded", 1), "2": ("processing", 1), "3": ("failed", 3), "4": ("queued", 0), "5": ("queued", 1)}
    (again,) = jobs.replayed(jobs.dead_letters(rows)[1]).collect()
    assert (again.id, again.status, again.attempts, again.error, again.started_at) == ("3:replay", "queued", 0, None, None)


def test_audit_and_sorts(spark):
    a = spark.createDataFrame([("i", "x"), ("i", "y"), ("j", "x"), (None, "z")], "issue_id string, keyword string")
    b = spark.createDataFrame([("i", "x"), ("k", "x")], "issue_id string, keyword string")
    assert {tuple(r) for r in topics.audited(a, b).collect()} == {("i", 2, 1, 1, -0.5), ("j", 1, 0, 0, 0.0), ("k", 0, 1, 0, 0.0)}
    corpus = spark.createDataFrame([("a", 1, 2.0, None), ("b", 3, None, 1.0), ("c", None, 5.0, 1.0)], "keyword string, doc_frequency int, aggregate_score double, burst_score double")
    order = lambda sort, **more: [r.keyword for r in topics.sorted_page(corpus, sort, 9, **more).orderBy("place").collect()]
    assert order("frequency") == ["b", "a", "c"] == order("odd") and order("score") == ["c", "a", "b"] and order("burst") == ["b", "c", "a"] and order("name", offset=1) == ["b", "c"]


def test_first_occurrence_in_whole_words(spark):
    found = spark.createDataFrame([("d", "ai", 0.5, 1, 1, ["a"], 1.0), ("d", "c++ maps", 0.5, 1, 1, ["a"], 1.0)], "doc_id string, keyword string, score double, occurrences int, sentence_spread int, provenance array<string>, boost double")
    said = "x" * 200
    texts = spark.createDataFrame([("d", f"{said} said it was c++  maps, then ai"), ("e", None)], "id string, body string")
    ranked = {r.keyword: r.adjusted for r in topics.reranked(found, texts, "id", "body").collect()}
    assert len(ranked) == 2 and ranked["c++ maps"] == pytest.approx(ranked["c++ maps"])
    length = len(f"{said} said it was c++  maps, then ai")
    spread = 1 + 0.08 + 0.08
    assert ranked["ai"] == pytest.approx(0.5 / ((1 + 0.35 * (1 - (length - 2) / length)) * spread * 1.12))
