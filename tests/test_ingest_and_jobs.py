import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import ingest, upserts
from colophon.sources import html
from colophon.streaming import jobs


def test_html(spark):
    page = "<html><head><title> T </title><meta name='a' content='1'><meta content='2' property=\"a\"></head><script>x<y</script><body><h2>H</h2><ul><li>i<li>j</ul><p>A &lt; B &amp;amp; <b>c</b></p><pre>k = 1\n</pre></body></html>"
    row = spark.createDataFrame([(page,)], "h string").select(T.html_to_text(F.col("h")).alias("t"), T.page_metadata(F.col("h")).alias("m")).first()
    assert "x<y" not in row.t and "A < B &amp; c" in row.t and row.m == {"title": "T", "a": "2"}
    markdown = html.to_markdown(page)
    assert "## H" in markdown and "- i\n- j" in markdown and "```\nk = 1" in markdown and "**c**" in markdown
    assert html.to_markdown(None) is None and html.to_markdown("") == ""


def test_sitemaps(spark):
    xml = "<urlset><url><loc> https://a.example/p/1 </loc><lastmod>2024</lastmod></url><url><loc>https://a.example/about</loc></url></urlset>"
    index = "<sitemapindex><sitemap><loc>https://a.example/s1.xml</loc></sitemap></sitemapindex>"
    files = spark.createDataFrame([(xml,), (index,), ("",)], "value string")
    assert [tuple(r) for r in html.sitemap_entries(files).collect()] == [("https://a.example/p/1", "2024")]
    assert [r.loc for r in html.sitemap_indexes(files).collect()] == ["https://a.example/s1.xml"]


def test_documents(spark):
    md = "# Title\n\nEp. 12\nMarch 5th, 2024\n\n> “A quote”\n\n## 🌱 Lead\n\nFirst paragraph of it.\n\n" + "x" * 200
    rows = spark.createDataFrame([("https://a.example/p/9-x", md, None), ("https://a.example/about", "x", {"title": "About"}), ("u", None, {})], "url string, markdown string, metadata map<string,string>")
    a, b, c = ingest.documents(rows).collect()
    assert (a.page_kind, a.title, a.issue_number, a.published_at, a.year, a.opening_quote, a.lead_essay_title) == ("issue", "Title", 9, "2024-03-05", 2024, "A quote", "Lead")
    assert (b.page_kind, b.title) == ("non_issue_post", "About") and c.page_kind == "junk" and c.word_count == 0


def test_sections():
    md = "x" * 101 + "\n## Signposts\na\n## Something\nb\n## Else\nc"
    assert [s[0] for s in ingest.parse_sections(md)] == ["lead_essay", "signposts", "lead_essay", "other"]
    assert ingest.parse_sections("plain") == [("other", "", "plain")] and ingest.parse_sections("") == [("other", "", "")]


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.sampled_from([" ", ". ", "\n\n", "x" * 50 + " "]), max_size=400))
def test_chunks_cover_the_text(gaps):
    text = "".join(f"w{i}{gap}" for i, gap in enumerate(gaps))
    pieces = ingest.split_text(text, least=100, most=300, overlap=20)
    assert all(len(p) <= 300 for p in pieces)
    found = {w for p in pieces for w in p.replace(".", " ").split()}
    assert {w for w in text.replace(".", " ").split() if w.startswith("w")} <= found
    assert all(p in text for p in pieces)


def test_upserts(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, title string, url string")
    changes = spark.createDataFrame([(2, "B", "z"), (3, "c", "w")], "id int, title string, url string")
    assert sorted(map(tuple, upserts.upserted(table, changes, ["id"], ["title"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "c", "w")]
    part = spark.createDataFrame([(1, None), (9, "q")], "id int, title string")
    assert sorted(map(tuple, upserts.partially_updated(table, part, "id").collect())) == [(1, "a", "x"), (2, "b", "y")]
    assert sorted(map(tuple, upserts.replaced(table, changes, "id").collect())) == [(1, "a", "x"), (2, "B", "z"), (3, "c", "w")]
    assert upserts.upserted(table, changes.where("false"), ["id"], ["title"]).count() == 2


def test_fenced_edges(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 1)], "keyword_a string, keyword_b string, v int")
    seen = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "keyword string, version int")
    now = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "keyword string, version int")
    fresh = spark.createDataFrame([("a", "b", 2), ("b", "c", 2)], "keyword_a string, keyword_b string, v int")
    assert sorted(map(tuple, upserts.fenced_edges(edges, seen, now, fresh).collect())) == [("a", "b", 2), ("a", "c", 1)]


def test_overwrite_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    upserts.overwrite_partitions(rows, path, ["p"])
    upserts.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert sorted((r.v, r.p) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def test_states_fold_in_any_batches(spark):
    schema = "key string, status string, attempts int, changed_at timestamp"
    rows = spark.createDataFrame([("a", "queued", 0, None), ("a", "succeeded", 1, None), ("a", "failed", 2, None), ("b", "failed", 1, None), (None, "queued", 0, None)], schema)
    once = sorted(map(tuple, jobs.folded(rows).collect()))
    twice = sorted(map(tuple, jobs.folded(rows.where("status = 'failed'"), jobs.folded(rows.where("status <> 'failed'"))).collect()))
    assert once == twice == [("a", "succeeded", 1, None), ("b", "failed", 1, None)]


def test_stream_equals_batch(spark, sf):
    from colophon.plans import jobs as plans

    for stream, batch in ((plans.event_windows_stream, plans.event_windows),):
        assert sorted(map(tuple, stream(spark, sf).collect())) == sorted(map(tuple, batch(spark, sf).collect()))
    claims = plans.job_claims_stream(spark, sf)
    assert claims.groupBy("key").agg(F.sum((F.col("status") == "succeeded").cast("int")).alias("n")).where("n > 1").isEmpty()


def test_claims_do_not_depend_on_slices(spark, tmp_path):
    steps = ["queued", "processing", "failed", "queued", "unknown", "processing", "succeeded"]
    rows = [("k", s, i, f"2024-01-0{i + 1} 00:00:00") for i, s in reversed(list(enumerate(steps)))] + [("none", None, None, None)]
    frame = spark.createDataFrame(rows, "key string, status string, attempts int, changed_at string").withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    name, got = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    spark.conf.set(name, 2)
    try:
        claims = jobs.stateful_claims(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), remember_ms=None)
        jobs.run_available(claims, lambda batch, n: got.extend(map(tuple, batch.collect())), f"{tmp_path}/state")
    finally:
        spark.conf.set(name, before)
    assert got == [("k", s, i) for i, s in enumerate(steps) if s != "unknown"]


def test_claims_of_a_table_need_no_python_call_per_key(spark, tmp_path, monkeypatch):
    from random import Random

    from colophon.plans import jobs as plans

    random, data, rows = Random(1), tmp_path / "pipeline_jobs.parquet", []
    for _ in range(1200):
        at = random.choice([None, *(f"2024-01-01 00:0{i}:00" for i in range(6))])
        rows.append((f"k{random.randrange(150)}", random.choice([*jobs.STATUSES[:4] * 4, "succeeded", "unknown", None]), random.choice([None, 0, 1]), at))
    rows += [(None, "queued", 0, None)] + [(key, s, 0, "2024-01-01 00:00:00") for key, steps in (("x", ["queued", "processing"]), ("y", ["processing", "queued"])) for s in steps]
    # One file for each row group; the stream takes 20 files at a time, by their time.
    for i in range(45):
        spark.createDataFrame(rows[i::45], "semantic_key string, status string, attempts int, queued_at string").coalesce(1).write.mode("append").parquet(str(data))
    streams, run = [], jobs.run_available
    monkeypatch.setattr(jobs, "run_available", lambda stream, *rest: (streams.append(stream._jdf.queryExecution().logical().toString()), run(stream, *rest)))
    got = sorted(map(tuple, plans.job_claims_stream(spark, str(tmp_path)).collect()))
    assert len(streams) == 1 and "Pandas" not in streams[0]
    assert [g for g in got if g[0] in "xy"] == [(k, s, 0) for k in "xy" for s in ("processing", "queued")]
    claims = []
    stream = jobs.stateful_claims(jobs.job_changes(jobs.events(spark, str(tmp_path), "pipeline_jobs")))
    run(stream, lambda batch, n: claims.extend((n, *r) for r in batch.collect()), f"{tmp_path}/state")
    assert got == sorted(c[1:] for c in claims) and {c[0] for c in claims} == {0, 1, 2}


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 temporarily unavailable")
        return "done"

    pauses = []
    assert jobs.with_retries(flaky, sleep=pauses.append) == "done" and len(pauses) == 2 and pauses[1] > pauses[0] * 0.9
    with pytest.raises(ValueError):
        jobs.with_retries(lambda: (_ for _ in ()).throw(ValueError("bad input")), sleep=pauses.append)
