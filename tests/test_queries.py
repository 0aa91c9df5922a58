"""Every query gives what its SQL gives, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from colophon.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings issues issue_chunks crawl_pages issue_topics corpus_topics topic_similarity pipeline_jobs search_hits topic_probes pack_specs mix_targets".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in TABLES:
        if os.path.exists(f"{sf}/{name}.parquet"):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return value if value is None or isinstance(value, (int, bool)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, sf, duck, name):
    frame = registry.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(repr([normal(r[c]) for c in columns]) for r in frame.collect())
    result = duck.execute(registry.oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([normal(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_name_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) == len({n for m in registry._modules() for n in m.QUERIES})
