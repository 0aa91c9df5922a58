import os

import duckdb
import pytest

from colophon.llm import queries

TABLES = "documents embeddings issues issue_chunks crawl_pages issue_topics corpus_topics topic_similarity pipeline_jobs search_hits topic_probes pack_specs mix_targets".split()
COLUMNS = {
    "p2_found": ["query_id", "issue_id"], "p3_found": ["issue_id", "keyword"], "p4_found": ["keyword", "group_key"], "p5_found": ["record_kind", "record_id"],
    "p6_found": ["issue_id", "line_no"], "p7_found": ["record_kind", "record_id", "line_no"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([clean(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert sorted(repr([clean(r[c]) for c in columns]) for r in frame.collect()) == want


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_columns(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).columns == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_violations_are_seen(spark):
    documents = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, source string")
    packed = [(1, 10, "c1", 1, 0, 0, 6), (1, 10, "c1", 2, 0, 0, 6), (1, 10, "c2", 9, 0, 0, 1), (2, 20, "c3", 1, 0, 0, 3), (2, 20, "c4", 1, 1, 3, 3), (2, 20, "c4", 2, 0, 0, 6), (2, 20, "c4", 3, 1, 1, 1)]
    rows = spark.createDataFrame(packed, "spec_id int, capacity_tokens int, container_id string, doc_id long, piece int, first_token long, n_tokens long")
    assert sorted(map(tuple, queries.packing.violations(rows, documents, "doc_id").collect()), key=str) == sorted(
        [(1, "overfull", "c1"), (2, "split", "1"), (2, "gap", "3"), (1, "missing", "3"), (1, "invented", "9")], key=str
    )
    plans = queries.mixing.plan_mixture([("a", 1.0, 2)], {"a": 9}, seed=0)
    chosen = spark.createDataFrame([(1, "a", 1, 3), (1, "a", 2, 3), (1, "a", 3, 3), (3, "a", 1, 3), (2, "a", 1, 3)], "doc_id long, source string, copy_no int, n_tokens long")
    assert sorted(map(tuple, queries.mixing.violations(chosen, plans, documents, "doc_id", "source").collect())) == [("a", "foreign"), ("a", "repeated")]
